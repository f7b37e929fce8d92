"""Joins that recur in demographic work, in the form that shuffles least."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on keys whose nulls are values (scenario_id, interval). eqNullSafe keys are hash
    keys to Catalyst, so this stays an equi-join."""
    theirs = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on: Column = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(theirs[f"_r_{k}"])
    return left.join(theirs, on, how).drop(*[f"_r_{k}" for k in keys])


def side_by_side(
    ours: DataFrame, official: DataFrame, keys: Sequence[str], alternative: str = "official"
) -> DataFrame:
    """Two tables' values of the same key, where both have one."""
    theirs = official.where("value IS NOT NULL").select(*keys, F.col("value").alias(alternative))
    return ours.where("value IS NOT NULL").join(theirs, list(keys))


def of_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that belong to the listed groups (complete years, members of a group of areas)."""
    return df.join(groups.select(*keys), list(keys), "left_semi")


def flag_known(df: DataFrame, listed: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """A boolean column that says whether the row's key is listed."""
    marks = listed.select(*keys, F.lit(True).alias(name)).distinct()
    return df.join(marks, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def without_unknown_age(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with any person of unknown age left out, and the unknown rows with them. A window over the
    ages of a group decides, so the table is read once."""
    unknown = (F.col("age") == "unknown") & (F.col("value") != 0)
    found = F.max(F.coalesce(unknown, F.lit(False))).over(Window.partitionBy(*keys))
    return df.withColumn("_unknown", found).where("NOT _unknown AND age <> 'unknown'").drop("_unknown")


def with_parent(df: DataFrame, keys: Sequence[str], parent: Column, value: str) -> DataFrame:
    """Each row with the value of the area above it."""
    above = df.select(
        F.col("geo_code").alias("_parent"), *keys, F.col(value).alias("parent_value")
    )
    return df.withColumn("_parent", parent).join(above, ["_parent", *keys]).drop("_parent")


def bands_below_open(df: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """Each open group (``hi`` null) with sums over the closed bands (lo, hi) of its keys that end below
    it: a running sum in the order of ages, so no pairs are made. Open groups above no band are
    left out."""
    closed = F.col("hi").isNotNull()
    below = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    totals = {name: F.sum(F.when(closed, c)).over(below) for name, c in sums.items()}
    rows = df.withColumn("_at", F.coalesce("hi", "lo").cast("long"))
    rows = rows.withColumns(totals | {"_bands": F.count("hi").over(below)})
    return rows.where("hi IS NULL AND _bands > 0").select(*keys, F.col("lo").alias("open"), *sums)


def combine_tables(
    first: DataFrame, others: Sequence[tuple[str, DataFrame]], keys: Sequence[str]
) -> DataFrame:
    """A value per table and key side by side, with flags and dates combined: provisional or
    broken if any is, latest vintage and retrieval."""
    out = first
    for name, other in others:
        theirs = other.select(
            *keys,
            F.col("value").alias(name),
            F.col("provisional").alias("_p"),
            F.col("break_in_series").alias("_b"),
        )
        out = (
            out.join(theirs, list(keys))
            .withColumns(
                {
                    "provisional": F.col("provisional") | F.col("_p"),
                    "break_in_series": F.col("break_in_series") | F.col("_b"),
                }
            )
            .drop("_p", "_b")
        )
    return out
