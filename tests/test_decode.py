"""Decoders, on codes as the sources write them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vitalgrid.functions import decode as d
from vitalgrid.functions.frames import lag_in_ranges, values_frame, year_shift
from vitalgrid.operators import harmonize
from vitalgrid.schema import OBSERVATION


def column(spark, values, name="c"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize(
    ("flag", "meaning"),
    [
        (None, (False, False, False)),
        ("p", (True, False, False)),
        ("bp", (True, False, True)),
        ("e", (False, True, False)),
        ("i|C", (False, True, False)),
        ("|N", (False, False, False)),
        ("u", (False, False, False)),
    ],
)
def test_flags(spark, flag, meaning):
    df = column(spark, [flag]).select(d.decode_flag(F.col("c")).alias("m")).select("m.*")
    assert rows(df) == [meaning]


@pytest.mark.parametrize("flag", ["x", "p|X", "N"])
def test_unknown_flag_is_an_error(spark, flag):
    with pytest.raises(Exception, match="unknown flag"):
        column(spark, [flag]).select(d.decode_flag(F.col("c")).alias("m")).collect()


def test_ages(spark):
    codes = ["TOTAL", "UNK", "Y_LT1", "Y_LT15", "Y7", "Y15-64", "Y_GE85"]
    got = column(spark, codes).select("c", d.decode_age(F.col("c")).alias("a")).collect()
    assert {r["c"]: r["a"] for r in got} == dict(
        zip(codes, ["total", "unknown", "0", "0-14", "7", "15-64", "85+"])
    )


@pytest.mark.parametrize("code", ["Y_OPEN", "15", "Y", "Y_GE"])
def test_unknown_age_is_an_error(spark, code):
    with pytest.raises(Exception, match="unknown age code"):
        column(spark, [code]).select(d.decode_age(F.col("c"))).collect()


def test_error_only_where_value_is_used(spark):
    df = column(spark, ["Y7", "nonsense"]).where("c <> 'nonsense'")
    assert rows(df.select(d.decode_age(F.col("c")))) == [("7",)]


def test_open_age(spark):
    cube = spark.createDataFrame(
        [("A", "2020", "T", "Y0", 1.0), ("A", "2020", "T", "Y1", 2.0), ("A", "2020", "T", "Y2", None),
         ("A", "2020", "T", "Y_OPEN", 5.0), ("B", "2020", "T", "Y_OPEN", 5.0),
         ("A", "2021", "T", "Y0", 1.0), ("A", "2021", "T", "Y_OPEN", None)],
        "geo string, time string, sex string, age string, value double",
    )
    got = rows(d.resolve_open_age(cube).where("age not rlike '^Y[0-9]'").select("geo", "time", "age"))
    assert got == [("A", "2020", "Y_GE2")]


def test_parse_age(spark):
    age = d.parse_age(F.col("c"))
    df = column(spark, ["7", "15-64", "85+", "total", "unknown"])
    got = df.select("c", age.lo, age.hi, age.is_open, age.width).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {
        "7": (7, 7, False, 1),
        "15-64": (15, 64, False, 50),
        "85+": (85, None, True, None),
        "total": (None, None, False, None),
        "unknown": (None, None, False, None),
    }


def test_text(spark):
    df = column(spark, ["Lowest‐Low", "lowest-low ", "Größe", "ﬁn  ÉTÉ"])
    got = [r[0] for r in df.select(d.normalise_text(F.col("c"))).collect()]
    assert got == ["lowest low", "lowest low", "grosse", "fin ete"]


def test_numbers_and_names(spark):
    one = spark.range(1).select(
        d.localised_count(F.lit("1.234")),
        d.localised_count(F.lit("-")),
        d.localised_count(F.lit("-"), dash_is_zero=False),
        d.localised_decimal(F.lit("12,3")),
        d.round_half_up_percent(F.lit(1), F.lit(16)),
        d.fix_lookalikes(F.lit("ATTIKH")),
        d.date_of_vintage(F.lit("2026-09-30T23:00:00+0200")),
        d.date_of_vintage(F.lit("2026-Q1")),
        d.normalise_label(F.lit("East , & west (2)*")),
    )
    assert tuple(one.first()) == (
        1234.0, 0.0, None, 12.3, 6.3, "ΑΤΤΙΚΗ", "2026-09-30", "2026-Q1", "EAST WEST",
    )


def test_cells(spark):
    got = rows(d.strict_cells(spark.range(1), "Q7 1988, P3 1999-2001"))
    assert got == [("P3", "1999"), ("P3", "2000"), ("P3", "2001"), ("Q7", "1988")]


def test_recode(spark):
    """Old codes: one recoded beside an empty current cell, one dropped in the overlap."""
    base = dict.fromkeys(OBSERVATION.fieldNames())
    def obs(geo, period, value):
        return {**base, "geo_code": geo, "period": period, "value": value}
    df = spark.createDataFrame(
        [obs("ZA7", "1994", 5.5), obs("ZAK", "1994", None), obs("ZA2", "1994", 8.0),
         obs("ZA7", "1995", None), obs("ZA70", "1994", None), obs("ZA4", "2003", 0.5)],
        OBSERVATION,
    )
    recodes = values_frame(spark, ("old_code", "new_code"), [("ZA7", "ZAK")])
    current = values_frame(spark, ("geo_code",), [("ZA",), ("ZAJ",), ("ZAK",)])
    out = harmonize.recode_geo(df, recodes, current, "ZA", "1994")
    assert rows(out.select("geo_code", "period", "value")) == [
        ("ZA4", "2003", 0.5), ("ZAK", "1994", 5.5),
    ]


def test_unlisted_variant_is_an_error(spark):
    df = column(spark, ["BSL", "HIGH", "??"], "v")
    out = harmonize.scenario_map(df, "v", "BSL", {"HIGH": "high"})
    with pytest.raises(Exception, match="unknown projection variant"):
        out.collect()
    assert rows(out.where("v <> '??'")) == [
        ("BSL", None, "projected"), ("HIGH", "high", "scenario"),
    ]


def test_year_shift_does_not_bridge_a_gap(spark):
    df = spark.createDataFrame([("a", "2000", 1), ("a", "2001", 2), ("a", "2003", 3)], "g string, period string, v int")
    got = rows(df.select("period", year_shift(F.col("v"), ("g",), -1).alias("b")))
    assert got == [("2000", None), ("2001", 1), ("2003", None)]


def test_lag_in_ranges_is_lag(spark):
    """A key with most of the rows is several ranges."""
    data = [("hot" if i % 5 else "cold", i * 7 % 1000, i % 3) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t int, v int")
    got = lag_in_ranges(df, ("k",), ("t",), "v").collect()
    for key in ("hot", "cold"):
        mine = sorted((r["t"], r["v"], r["previous"]) for r in got if r["k"] == key)
        assert [m[2] for m in mine] == [None, *[m[1] for m in mine[:-1]]]
