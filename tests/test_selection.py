from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import presentation as pr
from vitalgrid.operators import selection

SHARES = [0.0, 0.1, 0.25, 0.5, 0.777, 0.95, 1.0]


def expected(values):
    """Quantiles of a list by the definition: interpolated between the neighbours of the rank."""
    values, out = sorted(values), []
    for share in SHARES:
        place = share * (len(values) - 1)
        low, rest = math.floor(place), place - math.floor(place)
        high = values[math.ceil(place)]
        out.append(values[low] if rest == 0 else values[low] * (1 - rest) + high * rest)
    return out


@pytest.fixture(scope="module")
def mixed():
    """Groups of many kinds; `hot` holds nine tenths of the rows."""
    rng = random.Random(5)
    rows = [("hot", rng.lognormvariate(0, 3) * rng.choice([-1, 1, 1])) for _ in range(18_000)]
    rows += [("ties", float(rng.randrange(4))) for _ in range(1_000)]
    rows += [("near", 1.0 + k * 2.0**-52) for k in range(300)]  # neighbours in the last bits
    rows += [("tiny", rng.choice([5e-324, 1e-310, 0.0, -0.0, -1e-320])) for _ in range(100)]
    rows += [("huge", x) for x in (-1.7e308, 1.7e308, 1e300, 3.0)]
    rows += [("one", 7.5), (None, 1.0), (None, 3.0), ("hot", None), ("nothing", None)]
    rows += [("one", float("nan"))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("few", "buckets"), [(10_000, 4096), (40, 16), (1, 4096)])
def test_quantiles_match_the_definition(spark, mixed, few, buckets):
    df = spark.createDataFrame(mixed, "g string, x double").repartition(8)
    got = selection.exact_quantiles(df, ["g"], "x", SHARES, few=few, buckets=buckets).collect()
    groups = {}
    for g, x in mixed:
        if x is not None and not math.isnan(x):
            groups.setdefault(g, []).append(x)
    assert {r.g: r.n for r in got} == {g: len(v) for g, v in groups.items()}
    for r in got:
        assert r.quantiles == expected(groups[r.g]), r.g
        if r.g != "huge":  # numpy's interpolation overflows there
            assert r.quantiles == pytest.approx(list(np.quantile(groups[r.g], SHARES)), rel=1e-12)


def test_whole_table_infinities_and_no_rows(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (2.0,), (float("-inf"),), (3.0,)], "x double")
    assert selection.exact_quantiles(df, [], "x", [0.0, 0.25, 0.5, 1.0]).first().quantiles == [
        float("-inf"), 1.0, 2.0, float("inf"),
    ]
    none = df.withColumn("g", F.lit("a")).limit(0)
    assert selection.exact_quantiles(none, ["g"], "x", [0.5]).count() == 0
    with pytest.raises(ValueError, match="between 0 and 1"):
        selection.exact_quantiles(df, [], "x", [1.5])


def test_few_rounds_settle_close_values(spark, monkeypatch):
    """Values that differ in their last bits only: the rounds are bounded by the bits of a double."""
    made = []
    plain = selection.written
    monkeypatch.setattr(selection, "written", lambda df, name: made.append(name) or plain(df, name))
    df = spark.createDataFrame([(1.0 + k * 2.0**-52,) for k in range(50)], "x double")
    selection.exact_quantiles(df, [], "x", [0.5], few=1).collect()
    assert made.count("located") <= 1 + selection.rounds_needed()


def test_classes_by_selection_equal_classes_by_percentile(spark):
    rng = random.Random(9)
    rows = [(f"m{i % 3}", f"a{i}", float(rng.randrange(60)) if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "map string, geo string, value double")
    by = {
        m: {(r.map, r.geo): r["class"] for r in pr.classify(df, ("map",), 5, m).collect()}
        for m in ("quantile", "selection")
    }
    assert by["quantile"] == by["selection"]
    assert len(by["quantile"]) == sum(v is not None for *_, v in rows)
