"""Groups of areas: medians of all members, and members that follow a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.schema import KEY


def members(groups: DataFrame, group: str, version: str) -> DataFrame:
    """Codes of one version of a group."""
    chosen = (F.col("group") == group) & (F.col("version") == version)
    return groups.where(chosen).select("geo_code")


def mixed_definitions(df: DataFrame) -> DataFrame:
    """One row if the values to compare have more than one definition, else none."""
    found = df.agg(F.min("definition_id").alias("first"), F.max("definition_id").alias("last"))
    return found.where("first <> last")


def group_median(
    df: DataFrame, member_codes: DataFrame, n_members: int, geo_code: str, version: str
) -> DataFrame:
    """Median of the members' central values as derived rows, only where every member has
    one. Provisional if any member's value is; a revised value counts as final.

    A group is one value per member, so the exact percentile holds a bounded list.
    """
    key = [k for k in KEY if k != "geo_code"]
    rows = df.where(F.col("value").isNotNull() & F.col("interval").isNull()).join(
        member_codes, "geo_code", "left_semi"
    )
    medians = (
        rows.groupBy(*key)
        .agg(
            F.count("*").alias("_n"),
            F.percentile("value", F.lit(0.5)).alias("value"),
            F.bool_or(F.col("status") == "provisional").alias("_provisional"),
            F.bool_or("break_in_series").alias("break_in_series"),
            F.min("unit").alias("unit"),
            F.min("source_url").alias("source_url"),
            F.max("retrieved_at").alias("retrieved_at"),
        )
        .where(F.col("_n") == n_members)
    )
    return medians.withColumns(
        {
            "geo_code": F.lit(geo_code),
            "nature": F.lit("derived"),
            "transform_version": F.lit(version),
            "status": F.when(F.col("_provisional"), "provisional").otherwise("final"),
        }
    ).drop("_n", "_provisional")


def with_median(df: DataFrame, *args: object) -> DataFrame:
    """The rows and the medians of their group."""
    return df.unionByName(group_median(df, *args).select(*df.columns))


def rule_membership(
    rates: DataFrame, pool: DataFrame, listed: DataFrame, period: str, below: float
) -> DataFrame:
    """Areas of the pool whose rate of ``period`` puts them in the group or not, against the
    listed members: missing a value, unlisted, or listed without following the rule."""
    year = rates.where((F.col("period") == period) & F.col("value").isNotNull()).select(
        "geo_code", "value"
    )
    flags = (
        pool.select("geo_code")
        .join(year, "geo_code", "left")
        .join(listed.select("geo_code", F.lit(True).alias("_listed")), "geo_code", "left")
    )
    follows, is_listed = F.col("value") < below, F.coalesce("_listed", F.lit(False))
    problem = (
        F.when(F.col("value").isNull(), "no value")
        .when(follows & ~is_listed, "not listed")
        .when(~follows & is_listed, "listed against the rule")
    )
    return flags.select("geo_code", problem.alias("problem")).where("problem IS NOT NULL")
