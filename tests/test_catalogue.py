"""Catalogues of series: routing against a filter per series, and the plan's shape."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vitalgrid.operators.observations import Series, catalogue_violations, read_catalogue, read_series, route
from vitalgrid.schema import definitions

SOURCE = {"source": "S", "dataset_code": "c", "source_url": "u", "transform_version": "t@1"}
DIMS = ("geo", "unit", "kind", "time", "sex", "age")


def births(select, prefix="", fixed=None, nature="observed"):
    return Series("live_births@v1", nature, "G", select, fixed or {}, prefix)


CATALOGUE = {
    "plain": births({"unit": "NR", "kind": "a"}),
    "overlap": births({"unit": "NR", "kind": "a"}, prefix="L"),
    "other unit": births({"unit": "PC", "kind": "b"}, nature="projected"),
    "one year": births({"unit": "NR", "kind": "b", "time": "2001"}),
    "fixed": births({"unit": "NR", "kind": "a", "age": "ODD"}, fixed={"age": "65+"}),
    "one sex": births({"unit": "PC", "kind": "a", "sex": "F"}),
    "nothing": births({"unit": "ZZ", "kind": "a"}),
}


@pytest.fixture(scope="module")
def cube(spark):
    rng = random.Random(4)
    data = [
        ("d", "2024-05-01", geo, unit, kind, time, sex, age, rng.choice((None, float(rng.randrange(90)))), rng.choice((None, "p", "e", "b")))
        for geo in ("LT", "LV", "HR", None)
        for unit in ("NR", "PC", "XX", None)
        for kind in ("a", "b")
        for time in ("2000", "2001")
        for sex in ("T", "F")
        for age in ("Y0", "Y1", "Y_OPEN", "TOTAL")
    ]
    # an age code that cannot be decoded, in cells that only a series with an age of its own wants
    data += [("d", "2024-05-01", "LT", "NR", "a", "2000", "T", "ODD", 5.0, None)]
    return spark.createDataFrame(data, "doc_id string, updated string, geo string, unit string, kind string, time string, sex string, age string, value double, flag string")


def test_catalogue_equals_one_read_per_series(spark, cube):
    sound = {k: s for k, s in CATALOGUE.items() if k != "fixed"}
    clean = cube.where("age <> 'ODD'")
    found = read_catalogue(clean, sound, definitions(spark), SOURCE)
    each = None
    for name, series in sound.items():
        fixed = {k: v for k, v in series.select.items() if k in ("time", "sex", "age")}
        # read_series drops what it fixes, so its coordinates are given
        given = {"time": "period", "sex": "sex", "age": "age"}
        told = {given[k]: {"F": "female"}.get(v, v) for k, v in fixed.items()}
        one_cube = clean
        for k, v in series.select.items():
            one_cube = one_cube.where(F.col(k) == v)
        rest = {k: v for k, v in series.select.items() if k not in fixed}
        alone = Series(series.definition_id, series.nature, series.geo_vintage, rest, told, series.geo_prefix)
        one = read_series(one_cube, alone, definitions(spark), SOURCE).select(F.lit(name).alias("series"), "*")
        each = one if each is None else each.unionByName(one)
    assert rows(found) == rows(each) and found.count() > 100
    assert {r.series for r in found.select("series").distinct().collect()} == set(sound) - {"nothing"}


def test_a_fixed_coordinate_is_not_decoded(spark, cube):
    only = {"fixed": CATALOGUE["fixed"]}
    found = read_catalogue(cube, only, definitions(spark), SOURCE).collect()
    assert [(r.series, r.geo_code, r.age, r.value) for r in found] == [("fixed", "LT", "65+", 5.0)]
    with pytest.raises(Exception, match="unknown age code: ODD"):
        read_catalogue(cube, {"plain": CATALOGUE["plain"]}, definitions(spark), SOURCE).collect()


def test_violations_of_catalogues(spark, cube):
    more = CATALOGUE | {"units": births({"kind": "a"}), "both": births({}, prefix="H"), "gone": births({"kind": "b"}, prefix="X")}
    found = rows(catalogue_violations(cube, more, DIMS))
    assert found == [
        ("both", "several codes of kind"), ("both", "several codes of unit"), ("gone", "no cell"),
        ("nothing", "no cell"), ("units", "several codes of unit"),
    ]
    assert catalogue_violations(cube, {"plain": CATALOGUE["plain"]}, DIMS).count() == 0
    assert rows(catalogue_violations(cube.limit(0), {"plain": CATALOGUE["plain"]}, DIMS)) == [("plain", "no cell")]


def test_errors(spark, cube):
    with pytest.raises(ValueError, match="no dimension colour"):
        route(cube, {"x": births({"colour": "red"})})
    unknown = {"x": Series("nope@v1", "observed", "G", {"unit": "NR", "kind": "b"})}
    with pytest.raises(Exception, match="unknown definition: nope@v1"):
        read_catalogue(cube, unknown, definitions(spark), SOURCE).collect()


def test_one_scan_with_pushed_filters(spark, cube, tmp_path):
    path = str(tmp_path / "cube")
    cube.where("age <> 'ODD'").write.parquet(path)
    many = {f"s{i}": births({"unit": "NR", "kind": "ab"[i % 2]}, prefix="LH"[i % 2]) for i in range(50)}
    found = route(spark.read.parquet(path), many)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "PushedFilters: []" not in plan
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Union" not in plan
    assert found.groupBy("series").count().count() == 50
