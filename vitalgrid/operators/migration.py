"""Cohorts between two 1 Januaries: change along the diagonal and net migration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cohort_change(population: DataFrame, keys: Sequence[str], last: int) -> DataFrame:
    """Change of each cohort from one 1 January to the next, by year ``y`` of the later one
    and age ``x``; the open class ``last`` takes the two oldest classes of the year before.

    Each row appears once as itself and once one year later and older; one aggregation pairs
    them, so there is no self-join.
    """
    now = F.struct(F.col("y"), F.col("x"), F.col("value").alias("now"), _none("before"))
    later = F.struct(
        (F.col("y") + 1).alias("y"),
        F.least(F.col("x") + 1, F.lit(last)).alias("x"),
        _none("now"),
        F.col("value").alias("before"),
    )
    return (
        population.select(*keys, F.inline(F.array(now, later)))
        .groupBy(*keys, "y", "x")
        .agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
        .where("now IS NOT NULL AND before IS NOT NULL")
        .withColumn("change", F.col("now") - F.col("before"))
    )


def _none(name: str) -> Column:
    return F.lit(None).cast("double").alias(name)


def single_ages(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ages as numbers ``x``, the open class among them, and the bound ``k`` of that class.

    A group (keys, period) is left out if it has no open class, or persons of unknown age: their
    cohort is unknown, so no residual by age can be right."""
    x = F.regexp_extract("age", r"^(\d+)\+?$", 1).try_cast("int")
    is_open = F.col("age").endswith("+")
    group = Window.partitionBy(*keys, "period")
    k = F.max(F.when(is_open, x)).over(group)
    unknown = F.max(F.when(F.col("age") == "unknown", F.abs("value"))).over(group)
    return (
        df.withColumns({"x": x, "k": k, "_unknown": unknown})
        .where("x IS NOT NULL AND k IS NOT NULL AND coalesce(_unknown, 0) = 0")
        .select(*keys, F.col("period").cast("int").alias("y"), "x", "k", "value", "provisional",
                "break_in_series")
    )


def net_migration(
    population: DataFrame,
    deaths: DataFrame,
    births: DataFrame,
    keys: Sequence[str] = ("geo_code", "sex"),
) -> DataFrame:
    """Net migration by age reached as the residual of each cohort,

        M(a, t) = P(a, t + 1) - P(a - 1, t) + D(a, t),

    with births in place of P(-1, t) and the open class k+ taking k - 1 and k+ of the year
    before. Only (keys, year) with every age and one open class throughout.

    ``population`` and ``deaths`` come from :func:`single_ages`; ``births`` has keys, y, value.
    The four terms are tagged, stacked and added up by one aggregation.
    """
    flags = ("provisional", "break_in_series")

    def term(df: DataFrame, name: str, y: Column, x: Column, k: Column) -> DataFrame:
        return df.select(
            *keys, y.alias("y"), x.alias("x"), k.cast("int").alias("k"), *flags,
            F.lit(name).alias("term"), "value",
        )

    y, x, k = F.col("y"), F.col("x"), F.col("k")
    terms = (
        term(population, "after", y - 1, x, k)
        .unionByName(term(population, "before", y, F.least(x + 1, k), k))
        .unionByName(term(births, "before", y, F.lit(0), F.lit(None)))
        .unionByName(term(deaths, "deaths", y, x, k))
    )

    def of(name: str) -> Column:
        return F.col("term") == name

    sums = terms.groupBy(*keys, "y", "x").agg(
        *[F.sum(F.when(of(t), F.col("value"))).alias(t) for t in ("after", "before", "deaths")],
        *[F.max(F.when(of(t), k)).alias(f"k_{t}") for t in ("after", "before", "deaths")],
        *[F.bool_or(c).alias(c) for c in flags],
    )
    year = Window.partitionBy(*keys, "y")
    return (
        sums.withColumn("k_before", F.max("k_before").over(year))
        .where("after IS NOT NULL AND before IS NOT NULL AND deaths IS NOT NULL")
        .where("k_after = k_before AND k_after = k_deaths")
        .withColumn("_n", F.count("*").over(year))
        .where(F.col("_n") == F.col("k_after") + 1)
        .select(
            *keys,
            "y",
            "x",
            (F.col("x") == F.col("k_after")).alias("is_open"),
            (F.col("after") - F.col("before") + F.col("deaths")).alias("value"),
            *flags,
        )
    )


def exact_total_gate(
    totals: DataFrame, official: DataFrame, known: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Totals that differ from the official ones and are not listed, and listed ones that
    agree. Both hold ``value``."""
    rows = (
        totals.select(*keys, F.col("value").alias("ours"))
        .join(official.select(*keys, F.col("value").alias("official")), list(keys))
        .join(known.select(*keys, F.lit(True).alias("_known")), list(keys), "left")
    )
    differs = F.col("ours") != F.col("official")
    kind = F.when(differs & F.col("_known").isNull(), "unexplained").when(
        ~differs & F.col("_known"), "gone"
    )
    return rows.select(kind.alias("kind"), *keys, "ours", "official").where("kind IS NOT NULL")
