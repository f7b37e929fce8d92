from __future__ import annotations

import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vitalgrid.operators.contract import ContractError, validate, violations
from vitalgrid.plans.views import population
from vitalgrid.schema import COLUMNS, definitions
from vitalgrid.sources import build, product

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def observations(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "rows")
    population(spark, SF).where("geo_code <> 'W'").select(*COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


def contents(folder):
    return sorted(hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{folder}/*.parquet"))


def test_two_builds_have_the_same_bytes(spark, observations, tmp_path):
    once, again = str(tmp_path / "a"), str(tmp_path / "b")
    product.write_product(observations, definitions(spark), once)
    product.write_product(observations.repartition(5, F.rand(1)), definitions(spark), again)
    assert contents(f"{once}/parquet") == contents(f"{again}/parquet") and len(contents(f"{once}/parquet")) > 1
    assert spark.read.parquet(f"{once}/parquet").exceptAll(observations).isEmpty()
    assert spark.read.csv(f"{once}/csv", header=True).count() == observations.count()
    with pytest.raises(FileExistsError):
        product.write_product(observations, definitions(spark), once)


def test_input_is_computed_once(spark, observations, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    product.write_product(observations.mapInArrow(count, observations.schema), definitions(spark), str(tmp_path / "p"))
    assert seen.value == observations.count()


def broken(observations):
    geo, age = F.col("geo_code"), F.col("age")
    rows = observations.withColumns(
        {
            "unit": F.when(geo == "W1", "heads").otherwise(F.col("unit")),
            "value": F.when((geo == "W2") & (age == "1"), None).otherwise(F.col("value")),
            "interval": F.when((geo == "W3") & (age == "2"), "80_lower").when((geo == "W3") & (age == "3"), "70").otherwise(F.col("interval")),
            "sex": F.when(geo == "W4", "none").otherwise(F.col("sex")),
        }
    )
    some = rows.where("age = '3'")
    bounds = rows.where("geo_code = 'W0' AND age = '5'")
    upper, lower = bounds.withColumn("interval", F.lit("95_upper")), bounds.withColumn("interval", F.lit("95_lower"))
    lower = lower.withColumn("value", F.when(F.col("period") > "1997", F.col("value") + 1).otherwise(F.col("value")))
    return rows.unionByName(some).unionByName(upper).unionByName(lower)


def test_a_broken_rule_publishes_nothing(spark, observations, tmp_path):
    rows = broken(observations)
    with pytest.raises(ContractError) as found:
        product.write_product(rows, definitions(spark), str(tmp_path / "p"))
    with pytest.raises(ContractError) as expected:
        validate(rows, definitions(spark))
    assert str(found.value) == str(expected.value)
    assert {r.rule for r in violations(rows, definitions(spark)).collect()} >= {"unique key", "interval pair", "definition match"}
    assert not list(tmp_path.iterdir())
    with pytest.raises(ContractError, match="value: string"):
        product.write_product(observations.withColumn("value", F.lit("x")), definitions(spark), str(tmp_path / "p"))


def chain(calls, code="1"):
    def make(name, fn):
        def run(tables):
            calls.append(name)
            return fn(tables)

        return run

    return [
        build.Product("c", "1", ("b", "x"), make("c", lambda t: t["b"].join(t["x"], "id"))),
        build.Product("b", code, ("a",), make("b", lambda t: t["a"].where("id % 2 = 0"))),
        build.Product("a", "1", ("x",), make("a", lambda t: t["x"].where("id > 3")), decimals=2),
        build.Product("d", "1", ("y",), make("d", lambda t: t["y"])),
    ]


def states(manifest):
    return {r["product"]: (r.state, r.rows) for r in manifest.collect()}


def test_only_what_changed_is_made(spark, tmp_path):
    tables = {"x": spark.range(10), "y": spark.range(5)}
    at, path, calls = {"x": "1", "y": "1"}, str(tmp_path / "b"), []
    first = build.build(spark, chain(calls), tables, at, path)
    assert calls == [n for n in calls if n in "abcd"] and sorted(calls) == list("abcd") and calls.index("a") < calls.index("b") < calls.index("c")
    assert states(first) == {"a": ("added", 6), "b": ("added", 3), "c": ("added", 3), "d": ("added", 5)}
    calls.clear()
    same = build.build(spark, chain(calls), {}, at, path, first)  # not even the tables are needed
    assert not calls and set(states(same).values()) == {("unchanged", 6), ("unchanged", 3), ("unchanged", 5)}
    # code in the middle: what comes before it is read from its files
    second = build.build(spark, chain(calls, "2"), tables, at, path, same)
    assert calls == ["b", "c"] and states(second)["b"][0] == "changed code" and states(second)["c"][0] == "changed input"
    calls.clear()
    third = build.build(spark, chain(calls, "2")[:3], tables, at | {"x": "2"}, path, second)
    assert calls == ["a", "b", "c"]
    assert states(third) == {"a": ("changed input", 6), "b": ("changed input", 3), "c": ("changed input", 3), "d": ("removed", None)}
    assert third.where("product = 'a'").first().decimals == 2


def test_a_failed_build_goes_on_where_it_stopped(spark, tmp_path):
    tables, at, path, calls = {"x": spark.range(10)}, {"x": "1"}, str(tmp_path / "b"), []
    bad = [*chain(calls)[1:3], build.Product("c", "1", ("b",), lambda t: t["b"].select("nothing"))]
    with pytest.raises(Exception, match="nothing"):
        build.build(spark, bad, tables, at, path)
    (manifest,) = glob.glob(f"{path}/manifest-*")
    assert set(states(spark.read.parquet(manifest))) == {"a", "b"}
    calls.clear()
    good = [*chain(calls)[1:3], build.Product("c", "1", ("b",), lambda t: t["b"])]
    assert states(build.build(spark, good, tables, at, path, spark.read.parquet(manifest)))["c"] == ("added", 3)
    assert not calls


def test_products_that_cannot_be_built(spark):
    one = build.Product("a", "1", ("b",), dict)
    with pytest.raises(ValueError, match="a reads b"):
        build.digests([one], {})
    with pytest.raises(ValueError, match="cycle|\\['a'"):
        build.digests([one, build.Product("b", "1", ("a",), dict)], {})
    with pytest.raises(ValueError, match="name of its own"):
        build.digests([one, one], {"b": "1"})


def test_files_digest_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).repartition(3).write.parquet(path)
    one = build.files_digest(spark.read.parquet(path)).first()
    assert one.files == 3 and one == build.files_digest(spark.read.parquet(path)).first()
    spark.range(1).write.mode("append").parquet(path)
    assert build.files_digest(spark.read.parquet(path)).first().digest != one.digest


def test_sources_of_kept_products_from_one_pass(spark, tmp_path):
    rows_ = [("a", "x"), ("a", "y"), ("a", "x"), ("b", "x"), ("b", "shut"), ("c", "unlisted"), ("d", None), ("e", "z")]
    path = str(tmp_path / "entries")
    spark.createDataFrame(rows_, "product string, source_id string").write.parquet(path)
    listed = [("x", True), ("y", True), ("z", None), ("shut", False), ("idle", True)]
    registry = spark.createDataFrame(
        [(k, ok, f"ds_{k}", "by {dataset_code}.") for k, ok in listed],
        "source_id string, commercial_reuse boolean, dataset_code string, attribution string",
    )
    entries = spark.read.parquet(path)
    used = product.sources_used(entries, registry)
    assert rows(used.select("source_id", "credit")) == [("x", "by ds_x."), ("y", "by ds_y.")]
    kept = {r.product for r in product.licence_filter(entries, registry).collect()}
    assert kept == {"a"}
    plan = used._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert product.sources_used(entries.limit(0), registry).count() == 0
