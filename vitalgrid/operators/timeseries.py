"""Series in time: excess over a baseline, nowcasts from part of a year, projection errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.frames import year_shift

# Two-sided interval levels in percent.
LEVELS = (80, 95)


def iso_monday(period: Column) -> Column:
    """Monday of an ISO week 'YYYY-Www'. Week 1 is the week of 4 January."""
    week1 = F.trunc(F.make_date(F.substring(period, 1, 4).cast("int"), F.lit(1), F.lit(4)), "week")
    week = F.split_part(period, F.lit("-W"), F.lit(2)).cast("int")
    return F.date_add(week1, 7 * (week - 1))


def weeks_to_months(weekly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Monthly sums of weekly values; a day counts as a seventh of its week, and a month appears once all
    of its days are there. As a week touches two months at the most, it is split into two rows."""
    monday = iso_monday(F.col("period"))
    here = F.least(F.lit(7), F.datediff(F.last_day(monday), monday) + 1)
    first = F.trunc(monday, "month")
    share = F.col("value") / 7
    rows = F.array(
        F.struct(first.alias("month"), here.alias("days"), (share * here).alias("v")),
        F.struct(
            F.add_months(first, 1).alias("month"),
            (7 - here).alias("days"),
            (share * (7 - here)).alias("v"),
        ),
    )
    return (
        weekly.where("value IS NOT NULL")
        .select(*keys, F.inline(rows))
        .where("days > 0")
        .groupBy(*keys, "month")
        .agg(F.sum("v").alias("value"), F.sum("days").alias("_days"))
        .where(F.col("_days") == F.dayofmonth(F.last_day("month")))
        .drop("_days")
    )


def excess_over_baseline(
    months: DataFrame, keys: Sequence[str], first: int, last: int
) -> DataFrame:
    """Percent above the mean of the same month in the baseline years, all of which must be
    there; only months after them. Window: the same month of all years of one series."""
    year = F.year("month")
    same = Window.partitionBy(*keys, F.month("month"))
    in_base = F.when(year.between(first, last), F.col("value"))
    base = F.avg(in_base).over(same)
    return (
        months.withColumns({"_base": base, "_n": F.count(in_base).over(same)})
        .where((F.col("_n") == last - first + 1) & (year > last))
        .select(
            *keys,
            F.date_format("month", "yyyy-MM").alias("period"),
            (100 * F.try_divide(F.col("value") - F.col("_base"), F.col("_base"))).alias("value"),
        )
    )


def cumulative_months(months: DataFrame, keys: Sequence[str] = ("geo_code",)) -> DataFrame:
    """Running sum of months 1 to k of each year, as long as no month is missing, with the
    year's published total and whether it is clean: all months add up to the total and none
    is unknown. ``months`` has keys, y, month ('M01'-'M12', 'TOTAL', 'UNK') and value."""
    year = Window.partitionBy(*keys, "y")
    k = F.regexp_extract("month", r"^M(\d\d)$", 1).try_cast("int")
    order = year.orderBy("k")
    cum = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def of(code: str) -> Column:
        return F.max(F.when(F.col("month") == code, F.col("value"))).over(year)

    whole = F.max(F.when(F.col("k") == 12, F.col("cum"))).over(year)
    clean = F.coalesce(whole == F.col("total"), F.lit(False)) & (F.col("_unknown") == 0)
    return (
        months.withColumns({"k": k, "total": of("TOTAL"), "_unknown": F.coalesce(of("UNK"), F.lit(0))})
        .where("k IS NOT NULL AND value IS NOT NULL")
        .withColumns({"cum": cum, "_at": F.row_number().over(order)})
        .where(F.col("_at") == F.col("k"))
        .withColumn("clean", clean)
        .select(*keys, "y", "k", "cum", "total", "clean")
    )


def _pairs(cumulative: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each year and k with the same k of the year before."""
    before = year_shift(F.struct("cum", "total", "clean"), (*keys, "k"), -1, F.col("y"))
    return cumulative.withColumn("b", before).where("b.clean")


def _estimate() -> Column:
    return F.try_divide(F.col("b.total") * F.col("cum"), F.col("b.cum"))


def nowcast_backtest(cumulative: DataFrame, keys: Sequence[str] = ("geo_code",)) -> DataFrame:
    """Relative error of the estimate from k months, for past clean pairs of years."""
    error = F.try_divide(_estimate(), F.col("total")) - 1
    return (
        _pairs(cumulative, keys)
        .where("clean AND k <= 11")
        .select(*keys, "y", "k", error.alias("error"))
    )


def nowcast(
    cumulative: DataFrame, min_years: int = 10, keys: Sequence[str] = ("geo_code",)
) -> DataFrame:
    """The latest year without a total, estimated from its first k months by the ratio to
    the year before, with bounds from the absolute backtest errors at k: a central row and
    two rows per level. No rows where there is nothing to estimate or too few past years."""
    spread = (
        nowcast_backtest(cumulative, keys)
        .groupBy(*keys, "k")
        .agg(
            F.percentile(
                F.abs("error"), F.array(*[F.lit(level / 100) for level in LEVELS])
            ).alias("q"),
            F.count("*").alias("_n"),
        )
        .where(F.col("_n") >= min_years)
    )
    series = Window.partitionBy(*keys)
    latest = (
        _pairs(
            cumulative.withColumn("_last", F.max("y").over(series)), keys
        )
        .where("y = _last AND total IS NULL AND k <= 11")
        .withColumn("_k", F.max("k").over(Window.partitionBy(*keys, "y")))
        .where("k = _k")
        .select(*keys, "y", "k", _estimate().alias("central"))
    )
    bounds = [F.struct(F.lit(None).cast("string").alias("interval"), F.col("central").alias("value"))]
    for i, level in enumerate(LEVELS):
        for side, sign in (("lower", -1), ("upper", 1)):
            value = F.col("central") * (1 + sign * F.col("q")[i])
            bounds.append(F.struct(F.lit(f"{level}_{side}").alias("interval"), value.alias("value")))
    return latest.join(spread, [*keys, "k"]).select(*keys, "y", "k", F.inline(F.array(*bounds)))


def nowcast_violations(
    cumulative: DataFrame, min_years: int = 10, keys: Sequence[str] = ("geo_code",)
) -> DataFrame:
    """Latest years that want an estimate and have a year before them, but get none from
    :func:`nowcast`: that year is not clean, or too few past years tell how good the estimate is."""
    past = nowcast_backtest(cumulative, keys).groupBy(*keys, "k").agg(F.count("*").alias("_n"))
    last = F.max("y").over(Window.partitionBy(*keys))
    before = year_shift(F.struct("clean"), (*keys, "k"), -1, F.col("y"))
    wanted = (
        cumulative.withColumns({"_last": last, "_before": before})
        .where("y = _last AND total IS NULL AND k <= 11 AND _before IS NOT NULL")
        .withColumn("_k", F.max("k").over(Window.partitionBy(*keys, "y")))
        .where("k = _k")
    )
    problem = F.when(~F.col("_before.clean"), "previous year not clean").when(
        F.coalesce("_n", F.lit(0)) < min_years, "too few past years"
    )
    rows = wanted.join(past, [*keys, "k"], "left").withColumn("problem", problem)
    return rows.where("problem IS NOT NULL").select(*keys, "y", "k", "problem")


def projection_deviation(projected: DataFrame, observed: DataFrame) -> DataFrame:
    """Deviation of each projection from the observed population, in percent: of the level,
    and of the change since the projection's base year, which is its first. No change row in
    the base year. ``projected`` has source_id, geo_code, period and value; observed values may have
    ``provisional`` and ``break_in_series``, which a level takes from its year and a change from the base
    year, too."""
    first = projected.groupBy("source_id").agg(F.min("period").alias("base"))
    series = Window.partitionBy("source_id", "geo_code")
    p, o = F.col("p"), F.col("o")
    flags = [c for c in ("provisional", "break_in_series") if c in observed.columns]

    def at_base(c: Column) -> Column:
        return F.max(F.when(F.col("period") == F.col("base"), c)).over(series)

    both = (
        projected.select("source_id", "geo_code", "period", F.col("value").alias("p"))
        .join(first, "source_id")
        .join(observed.select("geo_code", "period", F.col("value").alias("o"), *flags),
              ["geo_code", "period"])
        .withColumns({"p0": at_base(p), "o0": at_base(o)} | {f"{c}0": at_base(F.col(c)) for c in flags})
        .where("p0 IS NOT NULL AND o0 IS NOT NULL")
    )
    level = 100 * F.try_divide(p - o, o)
    change = 100 * F.try_divide((p - F.col("p0")) - (o - F.col("o0")), F.col("o0"))
    rows = F.array(
        F.struct(F.lit("projection_deviation_level@v1").alias("definition_id"),
                 level.alias("value"), *[F.col(c).alias(c) for c in flags]),
        F.struct(F.lit("projection_deviation_change@v1").alias("definition_id"),
                 F.when(F.col("period") > F.col("base"), change).alias("value"),
                 *[(F.col(c) | F.col(f"{c}0")).alias(c) for c in flags]),
    )
    return both.select("source_id", "geo_code", "period", F.inline(rows)).where("value IS NOT NULL")
