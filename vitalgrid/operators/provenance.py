"""Provenance of values derived from several tables.

A formula declares its input tables in order, numerator first, and the years it reads of each. The
provenance of a value is that of the input rows behind it, joined once for all formulas:

- sources and dataset codes: the distinct ones in the order of the tables, joined;
- url and area vintage: of the first table;
- vintage and retrieval: the latest;
- provisional, or broken, if any input row is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions.frames import values_frame, year
from vitalgrid.operators.observations import to_observations

PLACE = ("geo_code", "period")
OF_TABLE = ("source", "dataset_code", "source_url", "geo_vintage")


@dataclass(frozen=True)
class Input:
    """A table that a formula reads, in years counted from that of the value, and in fixed years. Without
    either it is read in the year of the value."""

    table: str
    shifts: tuple[int, ...] = ()
    at: tuple[str, ...] = ()


def inputs_frame(spark: SparkSession, formulas: Mapping[str, Sequence[Input]]) -> DataFrame:
    """(formula, position, table_name, shift, at) of every table and year that each formula reads."""
    rows = []
    for formula, inputs in formulas.items():
        for position, one in enumerate(inputs):
            shifts = one.shifts or (() if one.at else (0,))
            rows += [(formula, position, one.table, n, None) for n in shifts]
            rows += [(formula, position, one.table, None, period) for period in one.at]
    return values_frame(spark, ("formula", "position", "table_name", "shift", "at"), rows)


def marks(rows: DataFrame, name: str) -> DataFrame:
    """Provenance of a table by area and period: one row for each source and dataset in it, the flags of
    all its rows. Partial sums meet, so a table of any size costs one shuffle of areas and periods."""
    found = rows.groupBy(*PLACE, *OF_TABLE).agg(
        F.max("vintage").alias("vintage"),
        F.max("retrieved_at").alias("retrieved_at"),
        F.bool_or(F.coalesce(F.col("status") == "provisional", F.lit(False))).alias("provisional"),
        F.bool_or(F.coalesce("break_in_series", F.lit(False))).alias("break_in_series"),
    )
    return found.withColumn("table_name", F.lit(name))


def ordered_set(column: str, position: str = "position") -> Column:
    """Aggregate: the distinct values of a column in the order of their first position; values of one
    position in their own order. Its state holds each pair of position and value once, so it is bounded by
    the tables of a formula and their sources, and it does not depend on the order of rows."""
    pairs = F.array_sort(F.collect_set(F.when(F.col(column).isNotNull(), F.struct(position, column))))
    return F.array_distinct(F.transform(pairs, lambda p: p[column]))


def of_first(column: str, position: str = "position") -> Column:
    """Aggregate: the column's value in the first position that has one; of several the least."""
    return F.min(F.when(F.col(column).isNotNull(), F.struct(position, column)))[column]


def combined(wanted: DataFrame, inputs: DataFrame, all_marks: DataFrame) -> DataFrame:
    """Provenance of each wanted (formula, geo_code, period), and `lacking`, the number of its input
    years that no table has."""
    shifted = F.when(F.col("shift") == 0, F.col("period")).otherwise((year() + F.col("shift")).cast("string"))
    read = wanted.select("formula", *PLACE).distinct().join(inputs, "formula")
    read = read.withColumn("_period", F.coalesce("at", shifted))
    theirs = all_marks.withColumnsRenamed({"period": "_period"}).withColumn("_found", F.lit(True))
    return (
        read.join(theirs, ["table_name", "geo_code", "_period"], "left")
        .groupBy("formula", *PLACE)
        .agg(
            F.array_join(ordered_set("source"), " + ").alias("source"),
            F.array_join(ordered_set("dataset_code"), "+").alias("dataset_code"),
            of_first("source_url").alias("source_url"),
            of_first("geo_vintage").alias("geo_vintage"),
            F.max("vintage").alias("vintage"),
            F.max("retrieved_at").alias("retrieved_at"),
            F.coalesce(F.bool_or("provisional"), F.lit(False)).alias("provisional"),
            F.coalesce(F.bool_or("break_in_series"), F.lit(False)).alias("break_in_series"),
            F.count_if(F.col("_found").isNull()).alias("lacking"),
        )
    )


def derived(
    values: DataFrame, inputs: DataFrame, all_marks: DataFrame, definitions: DataFrame, version: str = "0.1"
) -> DataFrame:
    """Values (formula, definition_id, geo_code, period, sex, age, interval, nature, value) as observations
    with combined provenance. The transform version is the formula's. A value that lacks an input year is
    an error, since its provenance would be silently incomplete."""
    provenance = combined(values, inputs, all_marks)
    complete = F.when(F.col("lacking") > 0, F.raise_error(F.concat(F.lit("input without provenance: "), F.col("formula"))))
    provenance = provenance.withColumn("source", F.coalesce(complete.cast("string"), F.col("source")))
    rows = values.where("value IS NOT NULL").join(provenance.drop("lacking"), ["formula", *PLACE])
    of_formula = F.concat("formula", F.lit(f"@{version}"))
    return to_observations(rows, definitions, of_formula, F.col("nature"))


def lacking(values: DataFrame, inputs: DataFrame, all_marks: DataFrame) -> DataFrame:
    """(formula, geo_code, period, lacking) of the values that :func:`derived` refuses."""
    return combined(values, inputs, all_marks).where("lacking > 0").select("formula", *PLACE, "lacking")
