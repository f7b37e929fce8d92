from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import provenance as pv
from vitalgrid.operators.contract import violations
from vitalgrid.operators.provenance import Input
from vitalgrid.plans import derived, views
from vitalgrid.schema import OBSERVATION, definitions

ROW = "geo_code string, period string, source string, dataset_code string, source_url string, geo_vintage string, vintage string, retrieved_at timestamp, status string, break_in_series boolean"


def rows(spark, *given):
    full = [
        (geo, period, source, code, code and f"https://x/{code}", "G1", vintage, None, status, broken)
        for geo, period, source, code, vintage, status, broken in given
    ]
    return spark.createDataFrame(full, ROW).withColumn("retrieved_at", F.to_timestamp(F.col("vintage")))


def test_order_of_tables_is_kept(spark):
    b = rows(spark, ("A", "2000", "Zeta", "b", "2020-01-01", "final", False), ("A", "2000", "Alpha", "b", "2021-01-01", "final", None))
    a = rows(spark, ("A", "2000", "Alpha", "a", "2019-01-01", "provisional", False))
    c = rows(spark, ("A", "2000", None, None, None, None, None))
    all_marks = pv.marks(b, "b").unionByName(pv.marks(a, "a")).unionByName(pv.marks(c, "c"))
    inputs = pv.inputs_frame(spark, {"f": (Input("b"), Input("a"), Input("c")), "g": (Input("c"), Input("a"), Input("b"))})
    wanted = spark.createDataFrame([("f", "A", "2000"), ("g", "A", "2000")], "formula string, geo_code string, period string")
    got = {r.formula: r for r in pv.combined(wanted, inputs, all_marks).collect()}
    # sources of one table in their own order, a repeated one once, where it comes first
    assert (got["f"].source, got["f"].dataset_code, got["f"].source_url) == ("Alpha + Zeta", "b+a", "https://x/b")
    assert (got["g"].source, got["g"].dataset_code, got["g"].source_url) == ("Alpha + Zeta", "a+b", "https://x/a")
    assert all((r.vintage, r.provisional, r.break_in_series, r.lacking) == ("2021-01-01", True, False, 0) for r in got.values())


def test_years_of_each_table(spark):
    pop = rows(spark, *[("A", str(y), "S", "pop", f"20{y - 1990:02d}-01-01", "provisional" if y == 2003 else "final", y == 2001) for y in range(2000, 2004)])
    inputs = pv.inputs_frame(spark, {"now": (Input("p"),), "pair": (Input("p", (0, 1)),), "base": (Input("p", at=("2001",)),), "both": (Input("p", (0,), ("2001",)),)})
    wanted = spark.createDataFrame(
        [(f, "A", str(y)) for f in ("now", "pair", "base", "both") for y in (2000, 2002, 2003)], "formula string, geo_code string, period string"
    )
    got = {(r.formula, r.period): (r.provisional, r.break_in_series, r.vintage[:4], r.lacking) for r in pv.combined(wanted, inputs, pv.marks(pop, "p")).collect()}
    assert got == {
        ("now", "2000"): (False, False, "2010", 0), ("now", "2002"): (False, False, "2012", 0), ("now", "2003"): (True, False, "2013", 0),
        ("pair", "2000"): (False, True, "2011", 0), ("pair", "2002"): (True, False, "2013", 0), ("pair", "2003"): (True, False, "2013", 1),
        ("base", "2000"): (False, True, "2011", 0), ("base", "2002"): (False, True, "2011", 0), ("base", "2003"): (False, True, "2011", 0),
        ("both", "2000"): (False, True, "2011", 0), ("both", "2002"): (False, True, "2012", 0), ("both", "2003"): (True, True, "2013", 0),
    }


def test_a_value_without_provenance_is_refused(spark):
    columns = "formula string, definition_id string, geo_code string, period string, sex string, age string, interval string, nature string, value double"
    values = spark.createDataFrame(
        [("f", "median_age@v1", "AA", "2000", "total", "total", None, "derived", 1.0), ("f", "median_age@v1", "AA", "2001", "total", "total", None, "derived", None)], columns
    )
    pop = rows(spark, ("AA", "2000", "S", "pop", "2020-01-01", "final", False))
    inputs = pv.inputs_frame(spark, {"f": (Input("p"),)})
    good = pv.derived(values.where("period = '2000'"), inputs, pv.marks(pop, "p"), definitions(spark))
    assert [(f.name, f.dataType) for f in good.schema] == [(f.name, f.dataType) for f in OBSERVATION]
    row = good.first()
    assert (row.metric, row.unit, row.transform_version, row.nature, row.status) == ("median_age", "years", "f@0.1", "derived", "final")
    assert violations(good, definitions(spark)).count() == 0
    missing = pv.inputs_frame(spark, {"f": (Input("p"), Input("q"))})
    assert [tuple(r) for r in pv.lacking(values, missing, pv.marks(pop, "p")).orderBy("period").collect()] == [("f", "AA", "2000", 1), ("f", "AA", "2001", 2)]
    with pytest.raises(Exception, match="input without provenance: f"):
        pv.derived(values, missing, pv.marks(pop, "p"), definitions(spark)).collect()


def test_derived_plans_share_the_cells(spark):
    sf = "/root/testdata/sf0.001"
    with views.shared_cells(spark, sf):
        plan = derived.values(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # lineitem is read for the births by order alone, which no cell holds: for births and rates, whose exchange is one
    assert sum("l_orderkey" in line and "Relation" in line for line in plan.splitlines()) <= 2
    assert not views._SHARED.get()
