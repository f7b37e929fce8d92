"""Cubes, ledgers and products on small inputs written by the test."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vitalgrid.functions.frames import scratch_path, values_frame, written
from vitalgrid.sources import cubes, product, snapshots, wide

# tons of fruit landed at two quays, by kind and quarter: 2 x 3 x 2 cells, quays listed backwards
CUBE = {
    "class": "dataset", "label": "Fruit", "updated": "2025-07-09",
    "id": ["quay", "kind", "quarter"], "size": [2, 3, 2],
    "dimension": {
        "quay": {"category": {"index": {"south": 1, "north": 0}}},
        "kind": {"category": {"label": {"fig": "figs", "kiwi": "kiwis", "plum": "plums"}}},
        "quarter": {"category": {"index": ["Q2", "Q3"]}},
    },
    "value": {"0": 1.5, "3": 40, "5": 0, "6": 7, "11": 2},
    "status": {"4": "c", "6": "e"},
}
DIMS = ("quay", "kind", "quarter")
CELLS = {
    ("north", "fig", "Q2"): (1.5, None), ("north", "kiwi", "Q3"): (40.0, None), ("north", "plum", "Q2"): (None, "c"),
    ("north", "plum", "Q3"): (0.0, None), ("south", "fig", "Q2"): (7.0, "e"), ("south", "plum", "Q3"): (2.0, None),
}


def docs(spark, *documents):
    data = [(str(i), d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(data, "doc_id string, json string")


def exploded(spark, document):
    out = cubes.explode_cube(docs(spark, document), DIMS).collect()
    assert len(out) == 12
    return {tuple(r[d] for d in DIMS): (r["value"], r["flag"]) for r in out}


def test_cells_of_an_object_and_of_a_list(spark):
    every = {(q, k, t): CELLS.get((q, k, t), (None, None)) for q in ("north", "south")
             for k in ("fig", "kiwi", "plum") for t in ("Q2", "Q3")}
    assert exploded(spark, CUBE) == every
    place = {key: i for i, key in enumerate(every)}
    listed = {**CUBE, "value": [None] * 12, "status": [None] * 12}
    for key, (value, flag) in CELLS.items():
        listed["value"][place[key]], listed["status"][place[key]] = value, flag
    assert exploded(spark, listed) == every


BAD = {
    "not a dataset": {**CUBE, "class": "dimension"},
    "category counts do not match size": {**CUBE, "size": [2, 4, 2]},
    "list of another length": {**CUBE, "value": [1.0] * 13},
    "cell outside the cube": {**CUBE, "value": {"12": 5}},
    "not a document": '{"class": "dataset", "id": [',
}


@pytest.mark.parametrize("problem", list(BAD))
def test_bad_cubes_raise(spark, problem):
    bad = docs(spark, CUBE, BAD[problem])
    assert rows(cubes.cube_violations(bad)) == [("1", problem)]
    with pytest.raises(Exception, match=problem):
        cubes.explode_cube(bad, DIMS).collect()


@pytest.mark.parametrize("key", ["-1", "seven", "2.5"])
def test_bad_keys(spark, key):
    for part in ("value", "status"):
        bad = docs(spark, {**CUBE, part: {key: "1"}})
        assert rows(cubes.cube_violations(bad)) == [("0", "cell outside the cube")]


def test_large_cube(spark):
    """Two million cells, almost all left out."""
    codes = [f"c{i}" for i in range(2000)]
    big = {
        "class": "dataset", "id": ["a", "b"], "size": [1000, 2000],
        "dimension": {"a": {"category": {"index": codes[:1000]}}, "b": {"category": {"index": codes}}},
        "value": {"0": 1, "1999999": 3},
    }
    out = cubes.explode_cube(docs(spark, big), ("a", "b"))
    total = out.agg(F.count("*"), F.count("value"), F.sum("value")).first()
    assert tuple(total) == (2_000_000, 2, 4.0)
    assert rows(out.where("value = 3").select("a", "b")) == [("c999", "c1999")]


def test_summary(spark):
    r = cubes.cube_summary(docs(spark, CUBE)).first()
    assert (r["label"], r["n_values"], r["dimensions"]) == ("Fruit", 5, dict(zip(DIMS, (2, 3, 2))))


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(CUBE, indent=1))
    out = cubes.explode_cube(cubes.read_documents(spark, str(tmp_path)), DIMS)
    assert out.count() == 12


def test_scan_snapshots(spark, tmp_path):
    good = b"content"
    (tmp_path / hashlib.sha256(good).hexdigest()).write_bytes(good)
    (tmp_path / hashlib.sha256(b"other").hexdigest()).write_bytes(b"damaged")
    files = snapshots.scan_snapshots(spark, str(tmp_path))
    assert files.count() == 2
    assert rows(snapshots.corrupt_snapshots(files).select("size")) == [(7,)]


LEDGER = "source_id string, sha256 string, retrieved_at int"


def test_ledger(spark):
    """a, a, b, a after a: only b and the second a are new versions."""
    past = spark.createDataFrame([("s", "z", 1), ("s", "a", 2)], LEDGER)
    new = [("s", h, 10 + i) for i, h in enumerate("aabaa")] + [("t", "q", 11), ("t", "q", 12)]
    downloads = spark.createDataFrame(new, LEDGER)
    out = snapshots.ledger_append(past, downloads)
    assert rows(out) == [("s", "a", 13), ("s", "b", 12), ("t", "q", 11)]


def test_pins(spark):
    ledger = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("t", "c", 1)], LEDGER)
    pins = values_frame(spark, ("sha256",), [("a",)])
    latest = snapshots.latest_snapshot(ledger, pins)
    assert rows(latest.select("source_id", "sha256")) == [("s", "a")]
    required = values_frame(spark, ("source_id",), [("s",), ("t",)])
    assert rows(snapshots.missing_sources(required, latest)) == [("t",)]


def test_manifest_is_about_content(spark):
    df = spark.createDataFrame([("p", i, float(i)) for i in range(100)], "product string, i int, v double")
    cols = ("i", "v")
    one = product.manifest(df, ("product",), cols)
    two = product.manifest(df.orderBy(F.desc("i")).repartition(7), ("product",), cols)
    three = product.manifest(df.where("i <> 5"), ("product",), cols)
    assert rows(product.changed_products(one, two, ("product",)).select("state")) == [("unchanged",)]
    assert rows(product.changed_products(one, three, ("product",)).select("state")) == [("changed",)]


def test_unknown_source_is_not_reusable(spark):
    entries = values_frame(spark, ("product", "source_id"), [("p", "a"), ("p", "b"), ("q", "a"), ("r", "x")])
    registry = values_frame(spark, ("source_id", "commercial_reuse"), [("a", True), ("b", False)])
    assert rows(product.licence_filter(entries, registry)) == [("q",)]


def test_wide(spark):
    sheet = spark.createDataFrame(
        [("GR", "10.5", None)], "iso string, `2020` string, `2021` string"
    )
    out = wide.wide_years_to_long({None: sheet, "80_lower": sheet}, ["iso"], ["2020", "2021"])
    assert out.count() == 4
    assert rows(out.where("interval is null and value is not null")) == [("GR", "2020", 10500.0, None)]


class Named:
    """Stands in for a session with the given settings."""

    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_scratch_is_a_shared_folder(spark):
    named = Named(spark_checkpoint_dir="hdfs://shared/dir/", spark_sql_warehouse_dir="hdfs://w")
    assert scratch_path(named, "x").startswith("hdfs://shared/dir/x-")
    assert scratch_path(Named(spark_sql_warehouse_dir="s3://w"), "x").startswith("s3://w/_scratch/x-")
    assert rows(written(spark.range(3).toDF("i"), "t")) == [(0,), (1,), (2,)]


@pytest.mark.parametrize("method", ["quantize", "quantile"])
def test_equal_values_share_a_class(spark, method):
    from vitalgrid.operators.presentation import classify

    df = spark.createDataFrame([("m", float(v)) for v in (1, 1, 1, 2, 3, 9)], "m string, value double")
    out = classify(df, ("m",), 3, method).groupBy("value").agg(F.count_distinct("class").alias("n"))
    assert {r["n"] for r in out.collect()} == {1}


def test_delivery_violations(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    header = ("a", "b", "c")
    texts = {
        "good": "a,b,c\n1,x,2\n2,y,3\n", "empty": "", "header": "a,b,c\n", "cut": "a,b,c\n1,x,2\n1,x", "more": "a,b,c\n1,x,2,9\n1,x,2\n3,z,4,5,6\n",
        "quoted": 'a,b,c\n1,"x, or\ty",2\n',
    }
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    got = wide.delivery_violations(spark, str(folder), header, a="1", b="nobody")
    found = {(r.file and r.file.rsplit("/", 1)[1].split(".")[0], r.rule, r.n) for r in got.collect()}
    assert found == {
        ("empty", "file without rows", 0), ("header", "file without rows", 0), ("cut", "malformed rows", 1),
        ("more", "malformed rows", 2), (None, "no row of b nobody", 0),
    }
    good = tmp_path / "good"
    good.mkdir()
    (good / "one.csv").write_text(texts["good"])
    assert wide.delivery_violations(spark, str(good), header, a="1").isEmpty()
    (tmp_path / "none").mkdir()
    got = wide.delivery_violations(spark, str(tmp_path / "none"), header, a="1").collect()
    assert {r.rule for r in got} == {"delivery without files", "no row of a 1"}


@pytest.mark.parametrize("name, scans", [("A07_slice_violations", 1), ("D01_equi_join", 0)])
def test_lineitem_is_scanned_once(spark, name, scans):
    """D01 reads it while the cells are written, its own plan reads these."""
    from vitalgrid.plans import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_returnflag" in line for line in plan.splitlines()) == scans
