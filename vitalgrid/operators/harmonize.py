"""Harmonisation: area codes of old classifications, definitions, constant breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.decode import map_strict
from vitalgrid.schema import KEY


def recode_geo(
    obs: DataFrame, recodes: DataFrame, current: DataFrame, prefix: str, overlap_period: str
) -> DataFrame:
    """Old area codes recoded or dropped, so that only current codes remain.

    ``recodes`` (old_code, new_code) and ``current`` (geo_code) are reference tables. Old codes
    without a value go; the others are recoded; old codes still left go in the one period in
    which both classifications were published. Where that leaves two rows for a key, the one
    without a value goes. Any other old code stays, for :func:`gates.unknown_codes` to report.
    """
    now = current.select("geo_code", F.lit(True).alias("_current"))

    def marked(df: DataFrame) -> DataFrame:
        old = F.col("geo_code").startswith(prefix) & F.col("_current").isNull()
        return df.join(now, "geo_code", "left").withColumn("_old", old).drop("_current")

    value = F.col("value")
    first = marked(obs).where(~(F.col("_old") & value.isNull())).drop("_old")
    renamed = (
        first.join(recodes, first["geo_code"] == recodes["old_code"], "left")
        .withColumn("geo_code", F.coalesce("new_code", "geo_code"))
        .drop("old_code", "new_code")
    )
    kept = (
        marked(renamed)
        .where(~(F.col("_old") & (F.col("period") == overlap_period)))
        .drop("_old")
        .select(*obs.columns)
    )
    key = [k for k in KEY if k in obs.columns]
    doubled = (
        kept.groupBy(*key)
        .agg(F.count("*").alias("_n"), F.count_if(value.isNull()).alias("_empty"))
        .where("_n > 1 AND _empty > 0")
        .select(*[F.col(k).alias(f"_{k}") for k in key])
    )
    same: Column = kept["value"].isNull()
    for k in key:
        same = same & kept[k].eqNullSafe(doubled[f"_{k}"])
    return kept.join(doubled, same, "left_anti")


def attach_definition(df: DataFrame, definitions: DataFrame) -> DataFrame:
    """Metric and unit of each row's definition."""
    return df.drop("metric", "unit").join(
        definitions.select("definition_id", "metric", "unit"), "definition_id"
    )


def definition_columns(definitions: DataFrame, definition_id: str) -> dict[str, Column]:
    """Id, metric and unit of one definition as columns: scalar subqueries, since a join on a
    constant would be a nested loop."""
    one = definitions.where(F.col("definition_id") == definition_id)
    return {
        "definition_id": F.lit(definition_id),
        "metric": one.select("metric").scalar(),
        "unit": one.select("unit").scalar(),
    }


def with_constants(df: DataFrame, **constants: object) -> DataFrame:
    """Breakdowns and provenance that a source gives in its code instead of a column."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def scenario_map(
    df: DataFrame, variant: str, baseline: str, scenarios: dict[str, str]
) -> DataFrame:
    """Variant codes of a projection: the baseline is projected, each other listed variant a
    scenario with its id; an unlisted variant is an error."""
    code = F.col(variant)
    known = map_strict(code, {baseline: "", **scenarios}, "projection variant")
    return df.withColumns(
        {
            "scenario_id": F.nullif(known, F.lit("")),
            "nature": F.when(known == "", "projected").otherwise("scenario"),
        }
    )
