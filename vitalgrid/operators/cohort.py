"""Cohort-component operators: one year ahead, reproduction, momentum, intrinsic growth.

Inputs are long: keys, sex, single age x up to the open age ``last``, with columns by age on
1 January (p) or by age reached in the year (m, g, s, f). Windows hold one population.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.frames import year_shift

KEYS = ("geo_code", "period")


def _sex(name: str) -> Column:
    return F.col("sex") == name


def cohort_step(
    inputs: DataFrame, boys: Column, last: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Population on the next 1 January and the year's births, for every area, scenario and
    year at once.

    ``inputs`` has p, death rate m, net migration g and (for women) fertility f. Survivors
    are (P(x - 1)(1 - m/2) + g) / (1 + m/2), the open class taking the two oldest; births
    meet half of the exposure. One exchange on the keys serves all windows.
    """
    ages = Window.partitionBy(*keys, "sex").orderBy("x")
    population = Window.partitionBy(*keys)
    x, m, g = F.col("x"), F.col("m"), F.col("g")
    before = F.lag("p").over(ages)
    reaching = F.when(x == last, F.col("_before") + F.col("p")).otherwise(F.col("_before"))
    survived = (reaching * (1 - m / 2) + g) / (1 + m / 2)
    women = F.when(_sex("female") & (x > 0), F.col("f") * (F.col("_before") + F.col("_next")) / 2)
    share = F.when(_sex("male"), boys).otherwise(1 - boys)
    born = (F.col("births") * share * (1 - m / 4) + g) / (1 + m / 4)
    return (
        inputs.repartition(*keys)
        .withColumn("_before", before)
        .withColumn("_next", survived)
        .withColumn("births", F.sum(women).over(population))
        .select(*keys, "sex", "x", F.when(x == 0, born).otherwise(F.col("_next")).alias("value"),
                "births")
    )


def boys_share(inputs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of boys among births, from the births of each sex that give the population aged
    0 on the next 1 January (``p_next``) under m and g."""
    m = F.col("m")
    born = F.try_divide(F.col("p_next") * (1 + m / 4) - F.col("g"), 1 - m / 4)
    return (
        inputs.where("x = 0 AND p_next IS NOT NULL")
        .groupBy(*keys)
        .agg(
            F.try_divide(F.sum(F.when(_sex("male"), born)), F.sum(born)).alias("boys"),
            F.count("*").alias("_n"),
        )
        .where("_n = 2")
        .drop("_n")
    )


def projection_gate(
    ours: DataFrame, theirs: DataFrame, keys: Sequence[str], tolerance: float
) -> DataFrame:
    """Cells more than ``tolerance`` persons apart."""
    rows = ours.select(*keys, F.col("value").alias("ours")).join(
        theirs.select(*keys, F.col("value").alias("theirs")), list(keys)
    )
    return rows.where(F.abs(F.col("ours") - F.col("theirs")) > tolerance)


def net_reproduction(inputs: DataFrame, boys: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Daughters per woman in the terms of :func:`cohort_step`: (1 - boys) sum f exposure."""
    value = (1 - boys) * F.col("f") * F.col("exposure")
    return inputs.groupBy(*keys).agg(F.sum(value).alias("value"))


def population_momentum(
    inputs: DataFrame, boys: Column, last: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Size of the population once fertility is at replacement and mortality constant, with no
    migration, as a ratio to the present one, by sex and in all.

    In closed form instead of stepping to stationarity: the women of today are weighted by
    their remaining reproductive value, which gives the ultimate births, and those by the
    survival curve. ``inputs`` has p, survival s by age reached and (for women) f.
    """
    ages = Window.partitionBy(*keys, "sex").orderBy("x")
    upto = ages.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = ages.rowsBetween(1, Window.unboundedFollowing)
    everyone = Window.partitionBy(*keys, "sex")
    x, survival, girls = F.col("x"), F.col("_l"), 1 - boys
    bearing = F.coalesce(F.when(_sex("female"), F.col("f") * (F.col("_l1") + survival) / 2), F.lit(0.0))
    open_class = F.try_divide(F.col("_l1") * F.col("s"), 1 - F.col("s"))
    lived = F.when(x == last, open_class).otherwise(survival)

    def total(sex: str, column: Column) -> Column:
        return F.sum(F.when(_sex(sex), column))

    sums = (
        inputs.withColumn("_l", F.product("s").over(upto))
        .withColumn("_l1", F.lag("_l").over(ages))
        .withColumn("_h", bearing)
        .withColumn("_h", F.try_divide("_h", girls * F.sum("_h").over(everyone)))
        .withColumn("_value", F.try_divide(girls * F.coalesce(F.sum("_h").over(later), F.lit(0.0)), survival))
        .groupBy(*keys)
        .agg(
            total("female", F.col("p") * F.col("_value")).alias("_worth"),
            total("female", x * F.col("_h")).alias("_age"),
            total("female", lived).alias("_f"),
            total("male", lived).alias("_m"),
            total("female", F.col("p")).alias("female"),
            total("male", F.col("p")).alias("male"),
            F.max(boys).alias("_boys"),
        )
        .withColumn("_girls_born", F.try_divide("_worth", (1 - F.col("_boys")) * F.col("_age")))
    )
    women = F.col("_girls_born") * F.col("_f")
    men = F.col("_girls_born") * F.col("_boys") / (1 - F.col("_boys")) * F.col("_m")

    def ratio(sex: str, ultimate: Column, now: Column) -> Column:
        return F.struct(F.lit(sex).alias("sex"), F.try_divide(ultimate, now).alias("value"))

    rows = F.array(
        ratio("female", women, F.col("female")),
        ratio("male", men, F.col("male")),
        ratio("total", women + men, F.col("female") + F.col("male")),
    )
    return sums.select(*keys, F.inline(rows)).where("value IS NOT NULL")


def intrinsic_growth(inputs: DataFrame, boys: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Intrinsic growth rate in % a year: 100 ln(growth) where growth solves the discrete
    Euler-Lotka equation (1 - boys) sum f(x) growth^-x exposure(x) = 1.

    Each population carries its curve as an array of at most a hundred ages and is solved by
    bisection inside one expression, so populations are solved in parallel with no UDF."""
    c = (1 - boys) * F.col("f") * F.col("exposure")
    curve = F.sort_array(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), c.alias("c"))))
    curves = (
        inputs.where((F.col("f") > 0) & (F.col("exposure") > 0))
        .groupBy(*keys)
        .agg(curve.alias("_curve"))
    )

    def daughters(growth: Column) -> Column:
        return F.aggregate(
            "_curve", F.lit(0.0), lambda acc, e: acc + e["c"] * F.pow(growth, -e["x"])
        )

    def halve(bounds: Column, _: Column) -> Column:
        mid = (bounds["low"] + bounds["high"]) / 2
        return F.when(
            daughters(mid) > 1, F.struct(mid.alias("low"), bounds["high"].alias("high"))
        ).otherwise(F.struct(bounds["low"].alias("low"), mid.alias("high")))

    start = F.struct(F.lit(0.5).alias("low"), F.lit(2.0).alias("high"))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, halve)
    growth = (F.col("_root.low") + F.col("_root.high")) / 2
    # few bytes but much arithmetic a row: spread by number, which AQE does not coalesce
    n = int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    solved = curves.repartition(n).withColumn("_root", root)
    return solved.select(*keys, (100 * F.ln(growth)).alias("value"), daughters(growth).alias("daughters"))


def next_january(inputs: DataFrame, keys: Sequence[str] = ("geo_code", "sex", "x")) -> DataFrame:
    """The inputs with the population of the next 1 January, where it is known."""
    return inputs.withColumn("p_next", year_shift(F.col("p"), keys, 1))
