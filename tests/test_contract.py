"""The contract, one field of a valid row changed at a time; groups and gates on small tables."""

from __future__ import annotations

import datetime as dt
import statistics

import pytest

from tests.conftest import rows
from vitalgrid.functions.frames import values_frame
from vitalgrid.operators import contract as c
from vitalgrid.operators import gates as g
from vitalgrid.operators import groups as gr
from vitalgrid.schema import OBSERVATION, definitions

VALID = {
    "metric": "population", "definition_id": "population_1jan@v1", "geo_code": "AA",
    "geo_vintage": "V1", "period": "2024", "sex": "total", "age": "total", "value": 10.0,
    "unit": "persons", "source": "S", "dataset_code": "d", "source_url": "https://e.org",
    "vintage": "v", "retrieved_at": dt.datetime(2026, 1, 1), "transform_version": "t@1",
    "nature": "observed", "status": "final", "break_in_series": False, "scenario_id": None,
    "interval": None,
}


def table(spark, *changes):
    return spark.createDataFrame([{**VALID, **ch} for ch in changes], OBSERVATION)


def broken(spark, *changes):
    found = c.violations(table(spark, *changes), definitions(spark))
    return {r["rule"]: r["n"] for r in found.collect()}


def test_valid(spark):
    obs = table(spark, {})
    assert broken(spark, {}) == {}
    assert c.validate(obs, definitions(spark)) is obs


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"definition_id": "Population"}, "definition_id format"),
        ({"geo_code": "A"}, "geo_code length"),
        ({"period": "24"}, "period format"),
        ({"period": "2024-1"}, "period format"),
        ({"sex": "T"}, "sex vocabulary"),
        ({"sex": None}, "sex vocabulary"),
        ({"age": "Y15"}, "age format"),
        ({"age": "-5"}, "age format"),
        ({"age": "1000"}, "age format"),
        ({"age": ""}, "age format"),
        ({"age": "31-22"}, "age band order"),
        ({"age": "40-40"}, "age band order"),
        ({"value": None}, "value null iff not_available"),
        ({"status": "not_available"}, "value null iff not_available"),
        ({"unit": ""}, "unit is required"),
        ({"unit": "people"}, "definition match"),
        ({"source_url": "http://e.org"}, "source_url prefix"),
        ({"nature": "guess"}, "nature vocabulary"),
        ({"nature": "scenario"}, "scenario_id iff scenario"),
        ({"scenario_id": "s"}, "scenario_id iff scenario"),
        ({"status": None}, "status vocabulary"),
        ({"break_in_series": None}, "break_in_series is required"),
        ({"interval": "90_lower"}, "interval vocabulary"),
        ({"interval": "80_lower"}, "interval pair"),
    ],
)
def test_one_change(spark, change, rule):
    assert rule in broken(spark, change)


@pytest.mark.parametrize("age", ["total", "unknown", "3", "71", "110", "20-34", "92+"])
def test_ages_that_pass(spark, age):
    assert broken(spark, {"age": age}) == {}


def bound(side, value, level="80"):
    return {"interval": f"{level}_{side}", "value": value}


def test_intervals(spark):
    assert broken(spark, {}, bound("lower", 9.0), bound("upper", 11.0)) == {}
    assert broken(spark, {}, bound("lower", 9.0)) == {"interval pair": 1}
    assert broken(spark, {}, bound("lower", 11.0), bound("upper", 9.0)) == {"interval pair": 2}
    assert broken(spark, bound("lower", 9.0), bound("upper", 11.0)) == {"interval pair": 2}
    other = [bound("lower", 9.0), bound("upper", 11.0, "95")]
    assert broken(spark, {}, *other) == {"interval pair": 2}


def test_duplicate_key(spark):
    assert broken(spark, {}, {"value": 11.0}) == {"unique key": 2}
    assert broken(spark, {}, {"vintage": "w"}) == {}


def test_every_rule_is_named(spark):
    with pytest.raises(c.ContractError) as error:
        c.validate(table(spark, {"sex": "T", "period": "x"}), definitions(spark))
    assert "sex vocabulary" in str(error.value) and "period format" in str(error.value)


def test_schema(spark):
    obs = table(spark, {}).drop("unit").withColumnRenamed("age", "ages")
    assert sorted(c.schema_violations(obs)) == [
        "missing column age", "missing column unit", "undeclared column ages",
    ]
    wrong = table(spark, {}).selectExpr("* except (value)", "cast(value as string) value")
    assert c.schema_violations(wrong) == ["value: string instead of double"]


def test_median(spark):
    geos, vals = [f"G{i}" for i in range(27)], [float((i * 37) % 101) for i in range(27)]
    obs = [{"geo_code": a, "value": v} for a, v in zip(geos, vals)]
    obs[3]["status"] = "revised"
    codes = values_frame(spark, ("geo_code",), [(a,) for a in geos])
    out = gr.group_median(table(spark, *obs), codes, 27, "MEDIAN", "m@1").collect()
    assert [(r["value"], r["status"], r["nature"]) for r in out] == [
        (statistics.median(vals), "final", "derived")
    ]
    obs[5] |= {"value": None, "status": "not_available"}
    assert gr.group_median(table(spark, *obs), codes, 27, "MEDIAN", "m@1").count() == 0


def test_listed_differences_fail_both_ways(spark):
    row = "geo_code string, period string, sex string, age string, value double"
    ours = spark.createDataFrame(
        [("A", "1", "t", "t", 1.00), ("B", "1", "t", "t", 1.06), ("C", "1", "t", "t", 1.0)], row
    )
    official = spark.createDataFrame(
        [("A", "1", "t", "t", 1.0), ("B", "1", "t", "t", 1.0), ("C", "1", "t", "t", 1.0)], row
    )
    known = values_frame(spark, ("geo_code", "period"), [("A", "1"), ("Z", "1")])
    assert rows(g.reconcile_gate(ours, official, known)) == [
        ("gone", "A", "1", None, None, None, None), ("unexplained", "B", "1", "t", "t", 1.06, 1.0),
    ]
    alt = ours.where("geo_code = 'B'")
    assert rows(g.reconcile_gate(ours, official, known, alternatives=[alt])) == [
        ("gone", "A", "1", None, None, None, None)
    ]
    # half a unit of the last decimal exactly is no difference
    edge = ours.selectExpr("* except (value)", "value + 0.05 value").where("geo_code = 'C'")
    assert g.disagreements(edge, official, known).count() == 0


def test_age_gaps(spark):
    def ages(**values):
        return [{"age": a.replace("_", "-").lstrip("a").replace("p", "+"), "value": v} for a, v in values.items()]
    good = {"total": 100.0, "unknown": 5.0, "a0_4": 20.0, "a5_84": 60.0, "a85p": 15.0}
    assert g.age_gaps(table(spark, *ages(**good))).count() == 0
    bad = {**good, "total": 101.0}
    got = g.age_gaps(table(spark, *ages(**bad))).select("open", "total", "sum")
    assert rows(got) == [(85, 101.0, 100.0)]
    # two open groups, with bands for the lower one only up to it: both are checked
    both = {"total": 100.0, "a0_84": 80.0, "a85_89": 12.0, "a85p": 20.0, "a90p": 9.0}
    got = g.age_gaps(table(spark, *ages(**both))).select("open", "total", "sum")
    assert rows(got) == [(90, 100.0, 101.0)]
    # a hole below the open group: nothing to compare
    hole = {"total": 100.0, "a0_4": 20.0, "a10_84": 60.0, "a85p": 15.0}
    assert g.age_gaps(table(spark, *ages(**hole))).count() == 0


def test_hierarchy(spark):
    codes = values_frame(spark, ("geo_code",), [("EL",), ("EL3",), ("EL30",), ("EL31",), ("EL5",)])
    obs = [{"geo_code": k, "value": v} for k, v in
           {"EL": 30.0, "EL3": 20.0, "EL30": 12.0, "EL31": 7.0, "EL5": 10.0}.items()]
    got = g.hierarchy_gaps(table(spark, *obs), codes).select("geo_code", "value", "children")
    assert rows(got) == [("EL3", 20.0, 19.0)]
    obs[3] |= {"value": None, "status": "not_available"}
    assert g.hierarchy_gaps(table(spark, *obs), codes).count() == 0


def test_controls(spark):
    df = spark.createDataFrame(
        [("a", "total", 3.0), ("a", "x", 1.0), ("a", "y", 2.0), ("b", "total", 3.0), ("b", "x", 1.0)],
        "g string, k string, value double",
    )
    from pyspark.sql import functions as F

    total = F.col("k") == "total"
    assert rows(g.control_totals(df, ("g",), total, ~total)) == [("b", 3.0, 1.0)]
    divorces = spark.createDataFrame(
        [("1", "divorces", 5.0), ("1", "persons", 10.0), ("2", "divorces", 5.0), ("2", "persons", 9.0)],
        "g string, k string, value double",
    )
    got = g.linear_identity(divorces, ("g",), "k", {"divorces": 2, "persons": -1})
    assert rows(got) == [("2", 1.0)]
