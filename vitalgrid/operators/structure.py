"""Population structure: age groups, ratios, shares, medians, growth, fertility totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ("geo_code", "period", "sex")
CARRIED = ("source", "dataset_code", "source_url", "geo_vintage")


def carry() -> list[Column]:
    """Aggregates that pass status and provenance from the inputs of a value to it.

    Provisional or broken if any input is. The other columns are constant in a group (one
    table), so ``min`` is any of them and, unlike ``first``, does not depend on row order.
    """
    return [
        F.bool_or(F.col("status") == "provisional").alias("provisional"),
        F.bool_or("break_in_series").alias("break_in_series"),
        *[F.min(c).alias(c) for c in CARRIED],
        F.max("vintage").alias("vintage"),
        F.max("retrieved_at").alias("retrieved_at"),
    ]


def single_age(age: str = "age") -> Column:
    """The age in years of a single year of age; null for total, unknown, bands and n+."""
    return F.col(age).try_cast("int")


def _of_age(label: str) -> Column:
    return F.when(F.col("age") == label, F.col("value"))


def known_age() -> Column:
    """Persons of known age: the total less those of unknown age, who may be absent."""
    return F.max(_of_age("total")) - F.coalesce(F.sum(_of_age("unknown")), F.lit(0.0))


def age_groups(
    population: DataFrame,
    young: int = 15,
    old: int = 65,
    oldest: int = 80,
    by: Sequence[str] = GROUP,
) -> DataFrame:
    """``known``, ``young``, ``working``, ``old`` and ``oldest`` of each population, by one aggregation.

    Sums run over the single ages under a bound; what is at or above it is ``known`` minus that sum, so
    data may close with any open class. A sum short of a single age is null, and so is what uses it.
    """
    age, value = single_age(), F.col("value")

    def under(n: int) -> Column:
        return F.when(F.count_if(age < n) == n, F.sum(F.when(age < n, value)))

    return (
        population.where(value.isNotNull())
        .groupBy(*by)
        .agg(
            *carry(),
            known_age().alias("known"),
            under(young).alias("young"),
            under(old).alias("_below_old"),
            under(oldest).alias("_below_oldest"),
        )
        .withColumns(
            {
                "working": F.col("_below_old") - F.col("young"),
                "old": F.col("known") - F.col("_below_old"),
                "oldest": F.col("known") - F.col("_below_oldest"),
            }
        )
        .drop("_below_old", "_below_oldest")
    )


def broad_groups(
    population: DataFrame, young: str, working: str, old: str, by: Sequence[str] = GROUP
) -> DataFrame:
    """As :func:`age_groups`, from published bands; the oldest group is not known."""
    return (
        population.where(F.col("value").isNotNull())
        .groupBy(*by)
        .agg(
            *carry(),
            known_age().alias("known"),
            F.max(_of_age(young)).alias("young"),
            F.max(_of_age(working)).alias("working"),
            F.max(_of_age(old)).alias("old"),
        )
        .withColumn("oldest", F.lit(None).cast("double"))
    )


def ratio_per_100(groups: DataFrame, numerator: Column, denominator: Column) -> DataFrame:
    """100 x numerator / denominator of each group, for all ages; nulls are left out."""
    value = F.try_divide(numerator, denominator) * 100
    return groups.withColumns({"age": F.lit("total"), "value": value}).where("value IS NOT NULL")


def dependency_ratios(groups: DataFrame) -> DataFrame:
    """The three dependency ratios and the ageing index, one row per indicator."""
    young, working, old = F.col("young"), F.col("working"), F.col("old")

    def ratio(name: str, numerator: Column, denominator: Column) -> Column:
        value = F.try_divide(numerator, denominator) * 100
        return F.struct(F.lit(name).alias("definition_id"), value.alias("value"))

    rows = F.array(
        ratio("old_age_dependency_ratio@v1", old, working),
        ratio("young_age_dependency_ratio@v1", young, working),
        ratio("total_age_dependency_ratio@v1", young + old, working),
        ratio("ageing_index@v1", old, young),
    )
    return (
        groups.select("*", F.inline(rows))
        .where("value IS NOT NULL")
        .withColumn("age", F.lit("total"))
    )


def population_shares(groups: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Each group in % of known age, one row per age label (``labels``: label -> column)."""
    rows = [
        F.struct(
            F.lit(label).alias("age"),
            (F.try_divide(F.col(column), F.col("known")) * 100).alias("value"),
        )
        for label, column in labels.items()
    ]
    return groups.select("*", F.inline(F.array(*rows))).where("value IS NOT NULL")


BandRatios = Mapping[str, tuple[str, str]]  # age label: numerator and denominator, as expressions


def band_ratios(groups: DataFrame, wanted: Sequence[tuple[str, str, BandRatios]]) -> DataFrame:
    """100 x numerator / denominator of all indicators of ``wanted`` (definition, version of the formula, ratios)
    from one row of :func:`age_groups` a population; nulls are left out."""
    rows = [
        F.struct(
            F.lit(definition).alias("definition_id"),
            F.lit(version).alias("transform_version"),
            F.lit(age).alias("age"),
            (F.try_divide(F.expr(above), F.expr(below)) * 100).alias("value"),
        )
        for definition, version, ratios in wanted
        for age, (above, below) in ratios.items()
    ]
    return groups.select("*", F.inline(F.array(*rows))).where("value IS NOT NULL")


def median_age(population: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Age that halves the population of known age, interpolated inside a single year of age;
    only where every age from 0 to it is present.

    Two windows with the same partitioning, so one exchange; a partition is the ages of one
    area, year and sex.
    """
    group = Window.partitionBy(*by)
    running = group.orderBy("a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = population.where(F.col("value").isNotNull()).withColumn("a", single_age())
    known = F.max(_of_age("total")).over(group) - F.coalesce(
        F.sum(_of_age("unknown")).over(group), F.lit(0.0)
    )
    provisional = F.bool_or(F.col("status") == "provisional").over(group)
    below = F.sum("value").over(running) - F.col("value")
    return (
        rows.withColumns(
            {
                "half": known / 2,
                "provisional": provisional,
                "break_in_series": F.bool_or("break_in_series").over(group),
            }
        )
        .where(F.col("a").isNotNull())
        .withColumns({"below": below, "rank": F.row_number().over(group.orderBy("a"))})
        .where(
            (F.col("below") < F.col("half"))
            & (F.col("below") + F.col("value") >= F.col("half"))
            & (F.col("a") == F.col("rank") - 1)
        )
        .withColumns(
            {
                "value": F.col("a") + (F.col("half") - F.col("below")) / F.col("value"),
                "age": F.lit("total"),
            }
        )
        .drop("a", "half", "below", "rank")
    )


def growth_rate(change: DataFrame, average: DataFrame) -> DataFrame:
    """Population change per 1000 of the average population, from two tables of one source."""
    tagged = change.withColumn("input", F.lit("change")).unionByName(
        average.withColumn("input", F.lit("average"))
    )

    def of(name: str) -> Column:
        return F.max(F.when(F.col("input") == name, F.col("value")))

    return (
        tagged.where(F.col("value").isNotNull())
        .groupBy(*GROUP, "age")
        .agg(*carry(), (F.try_divide(of("change"), of("average")) * 1000).alias("value"))
        .where("value IS NOT NULL")
    )


def sex_ratio(population: DataFrame) -> DataFrame:
    """Males per 100 females of all ages."""

    def of(sex: str) -> Column:
        return F.max(F.when(F.col("sex") == sex, F.col("value")))

    return (
        population.where((F.col("age") == "total") & F.col("value").isNotNull())
        .groupBy("geo_code", "period")
        .agg(*carry(), (F.try_divide(of("male"), of("female")) * 100).alias("value"))
        .where("value IS NOT NULL")
        .withColumns({"sex": F.lit("total"), "age": F.lit("total")})
    )


def _width(widths: Mapping[str, float]) -> Column:
    pairs = [F.lit(v) for item in widths.items() for v in (item[0], float(item[1]))]
    return F.try_element_at(F.create_map(*pairs), F.col("age"))


def fertility_widths() -> dict[str, int]:
    """Width in years of the mother's age classes of a total fertility rate."""
    return {"10-14": 5, **{str(a): 1 for a in range(15, 50)}, "50+": 5}


def total_fertility(
    rates: DataFrame, widths: Mapping[str, float], by: Sequence[str] = GROUP
) -> DataFrame:
    """Sum of rate x width over the classes in ``widths``, only where every class has a rate."""
    return (
        rates.withColumn("_w", _width(widths))
        .where(F.col("value").isNotNull() & F.col("_w").isNotNull())
        .groupBy(*by)
        .agg(
            *carry(),
            F.count("*").alias("_n"),
            F.sum(F.col("value") * F.col("_w")).alias("value"),
        )
        .where(F.col("_n") == len(widths))
        .drop("_n")
        .withColumn("age", F.lit("total"))
    )


def complete_groups(df: DataFrame, by: Sequence[str], member: str, n: int) -> DataFrame:
    """Keys of the groups whose ``member`` takes exactly the values 0 to n - 1."""
    m = F.col(member)
    return (
        df.groupBy(*by)
        .agg(
            F.count_distinct(m).alias("_n"), F.min(m).alias("_first"), F.max(m).alias("_last")
        )
        .where((F.col("_n") == n) & (F.col("_first") == 0) & (F.col("_last") == n - 1))
        .select(*by)
    )


def mixed_sources(*inputs: DataFrame) -> DataFrame:
    """One row if the inputs of a formula come from more than one source, else none."""
    sources = inputs[0].select("source")
    for other in inputs[1:]:
        sources = sources.unionByName(other.select("source"))
    found = sources.agg(F.min("source").alias("first"), F.max("source").alias("last"))
    return found.where("first <> last")
