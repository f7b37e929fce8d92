"""Exact quantiles of groups of any size, without a list of a group's values.

A built-in exact percentile keeps all distinct values of a group in one buffer. Here equal values are
first counted together; then histograms narrow each wanted rank down to one bucket, and only the rows of
such buckets are read again:

- The first buckets are the sign and the binary exponent of a value, at most some 4,300 a group. Later
  ones cut the range between a bucket's least and greatest value into ``BUCKETS`` equal parts. Both are
  monotone in the value, so a running count over the buckets tells which one holds a rank.
- A bucket of one value is an answer. Once no open bucket holds more than ``FEW`` distinct values, their
  rows are counted through in order. A double has 52 bits below its exponent and a round settles
  twelve, so five rounds are the most there can be.

The driver sees one number a round. What meets in one task is a histogram or ``FEW`` values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.frames import written

BUCKETS = 4096
FEW = 10_000
EDGE = 1100.0  # beyond every exponent of a double; infinite values end up there


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys; null is a key like any other."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def _exponent(value: Column) -> Column:
    size = F.floor(F.least(F.greatest(F.log2(F.abs(value)), F.lit(-EDGE)), F.lit(EDGE))) + int(EDGE) + 1
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")


def _located(rows: DataFrame, targets: DataFrame, by: Sequence[str], bucket: Column) -> DataFrame:
    """The bucket that holds each target, and the target's rank inside it."""
    key = [*by, "_part"]
    hist = rows.groupBy(*key, bucket.alias("_bucket")).agg(
        F.sum("_n").alias("_held"),
        F.count("*").alias("_distinct"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    )
    upto = F.sum("_held").over(Window.partitionBy(*key).orderBy("_bucket"))
    hist = hist.withColumn("_before", upto - F.col("_held"))
    within = (targets["_rank"] >= hist["_before"]) & (
        targets["_rank"] < hist["_before"] + hist["_held"]
    )
    return targets.join(hist, _same(targets, hist, key) & within).select(
        *[targets[k] for k in by],
        targets["_wanted"],
        (targets["_rank"] - hist["_before"]).alias("_rank"),
        hist["_lo"],
        hist["_hi"],
        hist["_distinct"],
    )


def _inside(rows: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of the buckets that are still open; `_part` is a bucket's least value."""
    parts = found.where("_lo < _hi").select(*by, "_lo", "_hi").distinct()
    between = (rows["_v"] >= parts["_lo"]) & (rows["_v"] <= parts["_hi"])
    return rows.join(parts, _same(rows, parts, by) & between).select(
        *[rows[k] for k in by], parts["_lo"].alias("_part"), parts["_hi"].alias("_end"), "_v", "_n"
    )


def _settled(found: DataFrame, by: Sequence[str]) -> DataFrame:
    return found.where("_lo = _hi").select(*by, "_wanted", F.col("_lo").alias("_v"))


def ranked(
    rows: DataFrame, targets: DataFrame, by: Sequence[str], few: int, buckets: int
) -> DataFrame:
    """(by, _wanted, _v): the value at each wanted rank (from 0) among rows (by, _v, _n)."""
    part = F.lit(None).cast("double")
    rows = rows.withColumn("_part", part)
    targets = targets.withColumn("_rank", F.col("_wanted")).withColumn("_part", part)
    bucket, answers = _exponent(F.col("_v")), None
    while True:
        found = written(_located(rows, targets, by, bucket), "located")
        answers = _settled(found, by) if answers is None else answers.unionAll(_settled(found, by))
        most = found.where("_lo < _hi").agg(F.max("_distinct")).first()[0]
        if most is None:
            return answers
        rows = _inside(rows, found, by)
        targets = found.where("_lo < _hi").withColumn("_part", F.col("_lo"))
        if most <= few:
            break
        rows = written(rows, "inside")
        share = (F.col("_v") - F.col("_part")) / (F.col("_end") - F.col("_part"))
        bucket = F.floor(share * buckets)
    return answers.unionAll(_settled(_located(rows, targets, by, F.col("_v")), by))


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    shares: Sequence[float],
    few: int = FEW,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row a group: its keys, ``n`` (rows with a value) and ``quantiles``, an array with one
    linearly interpolated quantile per share.

    Null values and NaN count nowhere; a group without others has no row. A null key is a group.
    Infinite values are the least and greatest; where interpolation meets one the result is not
    finite. The input is read once.
    """
    if not shares or not all(0 <= s <= 1 for s in shares):
        raise ValueError("shares lie between 0 and 1")
    v = F.col(f"`{value}`").cast("double")
    given = df.select(*by, v.alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    rows = written(given.groupBy(*by, "_v").agg(F.count("*").alias("_n")), "counted")
    totals = rows.groupBy(*by).agg(F.sum("_n").alias("n"))
    place = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    ends = F.array_distinct(F.array(*[f(p) for p in place for f in (F.floor, F.ceil)]))
    targets = totals.select(*by, F.explode(ends).alias("_wanted"))
    answers = ranked(rows, targets, by, few, buckets)
    held = totals.join(answers, _same(totals, answers, by)).select(
        *[totals[k] for k in by], "n", "_wanted", "_v"
    )
    spread = held.groupBy(*by, "n").agg(
        *[
            F.max(F.when(F.col("_wanted") == f(p), F.col("_v"))).alias(f"_{name}{i}")
            for i, p in enumerate(place)
            for name, f in (("low", F.floor), ("high", F.ceil))
        ]
    )

    def between(i: int, p: Column) -> Column:
        low, high, rest = F.col(f"_low{i}"), F.col(f"_high{i}"), p - F.floor(p)
        return F.when(rest == 0, low).otherwise(low * (1 - rest) + high * rest)

    return spread.select(
        *by, "n", F.array(*[between(i, p) for i, p in enumerate(place)]).alias("quantiles")
    )


def rounds_needed(buckets: int = BUCKETS) -> int:
    """Rounds after the first that settle the 52 bits below an exponent."""
    return math.ceil(52 / math.log2(buckets))
