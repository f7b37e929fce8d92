"""Fertility: decompositions, birth order, reproduction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.frames import year, year_shift

GEO = ("geo_code",)


def class_of(classes: Mapping[str, tuple[int, int]], x: str = "x") -> Column:
    """The age class of a single age; null outside all of them."""
    return F.coalesce(*[F.when(F.col(x).between(*b), c) for c, b in classes.items()])


def _of_class(values: Mapping[str, float]) -> Column:
    pairs = [F.lit(v) for item in values.items() for v in (item[0], float(item[1]))]
    return F.try_element_at(F.create_map(*pairs), F.col("age"))


def mean_women(
    women: DataFrame, classes: Mapping[str, tuple[int, int]], by: Sequence[str] = GEO
) -> DataFrame:
    """Women by age class in the middle of each year, as the average of the two Januaries around it.
    ``women`` has period, x and value; a class that lacks a single age gives no row."""
    width = {c: hi - lo + 1 for c, (lo, hi) in classes.items()}
    january = (
        women.withColumn("age", class_of(classes))
        .where("age IS NOT NULL")
        .groupBy(*by, "period", "age")
        .agg(F.sum("value").alias("value"), F.count("*").alias("_n"))
        .where(F.col("_n") == _of_class(width))
        .drop("_n")
    )
    after = year_shift(F.col("value"), (*by, "age"), 1)
    return january.withColumn("value", (F.col("value") + after) / 2).where("value IS NOT NULL")


def births_change(
    births: DataFrame, women: DataFrame, by: Sequence[str] = GEO
) -> DataFrame:
    """The change in births from the year before by age class and in total, split into the
    part of the number of women and the part of fertility (Kitagawa 1955), long by ``part``.

    ``births`` and ``women`` have period, age and value."""
    row = F.struct("births", "women", "rate")
    now = {c: F.col(c) for c in ("births", "women", "rate")}
    was = {c: F.col(f"b.{c}") for c in ("births", "women", "rate")}
    parts = (
        births.select(*by, "period", "age", F.col("value").alias("births"))
        .join(women.select(*by, "period", "age", F.col("value").alias("women")),
              [*by, "period", "age"])
        .withColumn("rate", F.try_divide("births", "women"))
        .withColumn("b", year_shift(row, (*by, "age"), -1))
        .where("b IS NOT NULL")
        .select(
            *by,
            "period",
            F.explode(F.array("age", F.lit("total"))).alias("age"),
            ((now["women"] - was["women"]) * (now["rate"] + was["rate"]) / 2).alias("part_women"),
            ((now["rate"] - was["rate"]) * (now["women"] + was["women"]) / 2).alias(
                "part_fertility"
            ),
            (now["births"] - was["births"]).alias("change"),
        )
        .groupBy(*by, "period", "age")
        .agg(*[F.sum(c).alias(c) for c in ("part_women", "part_fertility", "change")])
    )
    return parts.withColumnsRenamed({"part_women": "women", "part_fertility": "fertility"}).unpivot(
        [*by, "period", "age", "change"], ["women", "fertility"], "part", "value"
    )


def births_change_gate(parts: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Ages whose parts do not add up to the change."""
    keys = [c for c in parts.columns if c not in ("part", "value", "change")]
    return (
        parts.groupBy(*keys)
        .agg(F.sum("value").alias("parts"), F.max("change").alias("change"))
        .where(F.abs(F.col("parts") - F.col("change")) > tolerance)
    )


def rates_by_order(
    births: DataFrame, rates: DataFrame, n_ages: int, n_orders: int, by: Sequence[str] = GEO
) -> DataFrame:
    """Age-specific rates by birth order: the rate shared out as the births of known order.
    Zero where the rate is zero; a rate without births of known order makes its year
    incomplete, and only years with every age and order are kept.

    ``births`` has period, age, order, value; ``rates`` period, age, rate."""
    at_age = Window.partitionBy(*by, "period", "age")
    in_year = Window.partitionBy(*by, "period")
    known, rate = F.col("known"), F.col("rate")
    value = F.when(known > 0, rate * F.col("births") / known).when(rate == 0, 0.0)
    return (
        births.withColumnRenamed("value", "births")
        .join(rates.select(*by, "period", "age", "rate"), [*by, "period", "age"])
        .withColumn("known", F.sum("births").over(at_age))
        .withColumn("value", value)
        .withColumn("_n", F.count("value").over(in_year))
        .where(F.col("_n") == n_ages * n_orders)
        .select(*by, "period", "age", "order", "value")
    )


def totals_by_order(
    rates: DataFrame,
    widths: Mapping[str, float],
    middles: Mapping[str, float],
    by: Sequence[str] = GEO,
) -> DataFrame:
    """``tfr`` and ``mean_age`` for each order of birth: rates summed over the classes by their widths,
    and the middles of the classes weighted by the same products."""
    weighted = F.col("value") * _of_class(widths)
    return rates.groupBy(*by, "period", "order").agg(
        F.sum(weighted).alias("tfr"),
        F.try_divide(F.sum(weighted * _of_class(middles)), F.sum(weighted)).alias("mean_age"),
    )


def mean_age_gate(orders: DataFrame, official: DataFrame, tolerance: float, by: Sequence[str] = GEO) -> DataFrame:
    """Orders whose mean age differs from the official one by more than its rounding."""
    keys = [*by, "period", "order"]
    rows = orders.join(official.select(*keys, F.col("value").alias("official")), keys)
    return rows.where(F.abs(F.col("mean_age") - F.col("official")) > tolerance)


def reproduction_rates(
    births: DataFrame,
    women: DataFrame,
    rates: DataFrame,
    girls: DataFrame,
    person_years: DataFrame,
    widths: Mapping[str, float],
    fertile: Sequence[str],
    by: Sequence[str] = GEO,
) -> DataFrame:
    """General fertility rate, gross and net reproduction rate, one row per indicator.

    ``births`` (value: all births), ``women`` (age, value: mean women of each class), ``rates``
    (age, rate), ``girls`` (girls: share among births) and ``person_years`` (age, person_years:
    of women) all have ``by`` and period; every age is required."""
    keys = [*by, "period"]
    at_risk = (
        women.where(F.col("age").isin(*fertile))
        .groupBy(*keys)
        .agg(F.sum("value").alias("women"), F.count("*").alias("_n"))
        .where(F.col("_n") == len(fertile))
        .drop("_n")
    )
    general = births.join(at_risk, keys).select(
        *keys,
        F.lit("general_fertility_rate@v1").alias("definition_id"),
        (1000 * F.try_divide("value", "women")).alias("value"),
    )
    weight = F.col("rate") * _of_class(widths)
    sums = (
        rates.where(_of_class(widths).isNotNull())
        .join(person_years, [*keys, "age"], "left")
        .groupBy(*keys)
        .agg(
            F.count("rate").alias("_rates"),
            F.count("person_years").alias("_lived"),
            F.sum(weight).alias("_gross"),
            F.sum(weight * F.col("person_years")).alias("_net"),
        )
        .where(F.col("_rates") == len(widths))
        .join(girls, keys)
    )

    def indicator(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("definition_id"), (value * F.col("girls")).alias("value"))

    complete = F.col("_lived") == len(widths)
    both = F.array(
        indicator("gross_reproduction_rate@v1", F.col("_gross")),
        indicator("net_reproduction_rate@v1", F.when(complete, F.col("_net"))),
    )
    repro = sums.select(*keys, F.inline(both)).where("value IS NOT NULL")
    return general.unionByName(repro)


def by_age_reached(rates: DataFrame, by: Sequence[str], last: int, column: str = "f") -> DataFrame:
    """Rates by completed age as rates by the age reached in the year: the mean of the rates
    at x and x - 1. Each rate gives half of itself to both ages, so one aggregation does."""
    x, half = F.col("x"), F.col(column) / 2
    both = F.array(
        F.struct(x.alias("x"), half.alias(column)), F.struct((x + 1).alias("x"), half.alias(column))
    )
    keys = list(by)
    return (
        rates.select(*keys, F.inline(both))
        .where(F.col("x") <= last)
        .groupBy(*keys, "x")
        .agg(F.sum(column).alias(column))
    )


def economic_dependency(sums: DataFrame, keys: Sequence[str] = ("geo_code", "period")) -> DataFrame:
    """Persons of old age outside the labour force per 100 employed of working age. ``sums`` has one
    row per key with ``old`` in persons, ``active`` (of old age) and ``employed`` in thousands."""
    inactive = F.col("old") - 1000 * F.col("active")
    value = 100 * F.try_divide(inactive, 1000 * F.col("employed"))
    return sums.select(*keys, value.alias("value"))
