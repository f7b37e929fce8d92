"""Frames for charts, maps and text: what is drawn, computed for all charts at once.

``series`` are the columns that name one line (area, scenario, ...), ``by`` those that name one
chart or map. Windows hold one series, which has one row per period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.decode import parse_age
from vitalgrid.functions.frames import values_frame
from vitalgrid.operators.selection import exact_quantiles

SERIES = ("geo_code", "scenario_id")
PANEL = (
    "source", "dataset_code", "source_url", "vintage", "retrieved_at", "definition_id",
    "transform_version",
)
# How a nature is drawn (dash, band, colour) and a status (drawn, hollow).
NATURE_STYLE = (
    ("observed", None, False, None),
    ("official_estimate", None, False, None),
    ("derived", None, False, None),
    ("projected", "stroke-dash-projected", True, None),
    ("scenario", "stroke-dash-scenario", False, "color-scenario"),
)
STATUS_STYLE = (
    ("final", True, False),
    ("revised", True, False),
    ("provisional", True, True),
    ("not_available", False, False),
)
# Fixed value: units that are rates, not counts.
RATE_UNIT = r"(^|\s)per\s|%|^years$"


def central(obs: DataFrame) -> DataFrame:
    """Central values only."""
    return obs.where("interval IS NULL")


def facts(obs: DataFrame, requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The one central value, no scenario, of each requested key, with the notes to show; a
    request without exactly one available value says what is wrong.

    Rows are counted per key before they meet the requests, so a repeated key stays one row.
    """
    rows = central(obs).where("scenario_id IS NULL")
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max("value").alias("value"),
        F.max("nature").alias("_nature"),
        F.max("status").alias("_status"),
    )
    n = F.coalesce("n", F.lit(0))
    problem = F.when(n != 1, F.lit("need exactly one value")).when(
        F.col("value").isNull(), F.lit("not available")
    )
    notes = F.array_compact(
        F.array(
            F.when(F.col("_nature") == "projected", "projected"),
            F.when(F.col("_status") == "provisional", "provisional"),
        )
    )
    return (
        requests.select(*keys)
        .join(found, list(keys), "left")
        .withColumns({"n": n, "problem": problem})
        .select(
            *keys,
            "n",
            F.when(F.col("problem").isNull(), F.col("value")).alias("value"),
            F.when(F.col("problem").isNull(), F.array_join(notes, ", ")).alias("note"),
            "problem",
        )
    )


def latest_period(obs: DataFrame, keys: Sequence[str] = ("geo_code", "sex", "age")) -> DataFrame:
    """The latest period with a central value, no scenario."""
    rows = central(obs).where("scenario_id IS NULL AND value IS NOT NULL")
    return rows.groupBy(*keys).agg(F.max("period").alias("period"))


def provenance_panel(obs: DataFrame) -> DataFrame:
    """Distinct provenance of the rows shown."""
    return obs.select(*PANEL).distinct()


def segments(obs: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Central rows as pieces of lines: a piece ends where the nature changes or a break starts.

    A piece of another nature than the one before repeats that one's last value as its ``anchor``, so the
    drawn lines meet; after a break they do not. The first piece of a scenario is anchored at the last
    value that its area has outside of scenarios in an earlier period."""
    whole = Window.partitionBy(*series).orderBy("period")
    unbroken = Window.partitionBy(*series, "_run").orderBy("period")
    # digits of a period order like the period, and a range of them leaves its own period out
    at = F.regexp_replace("period", r"\D", "").try_cast("long")
    area = Window.partitionBy(*[c for c in series if c != "scenario_id"]).orderBy(at)
    changes = ~F.col("nature").eqNullSafe(F.lag("nature").over(whole))
    starts = F.col("break_in_series") | changes
    point = F.struct("period", "value")
    known = F.col("value").isNotNull()
    own = F.last(F.when(known, point), ignorenulls=True).over(
        unbroken.rowsBetween(Window.unboundedPreceding, -1)
    )
    others = F.last(F.when(known & F.col("scenario_id").isNull(), point), ignorenulls=True).over(
        area.rangeBetween(Window.unboundedPreceding, -1)
    )
    opens = F.col("scenario_id").isNotNull() & (F.row_number().over(whole) == 1)
    here = F.struct(
        F.col("period").alias("period"), F.col("value").alias("value"), F.lit(False).alias("anchor")
    )
    there = F.struct(
        F.col("_before.period").alias("period"),
        F.col("_before.value").alias("value"),
        F.lit(True).alias("anchor"),
    )
    anchored = F.col("_new") & ~F.col("break_in_series") & F.col("_before").isNotNull()
    return (
        central(obs)
        .withColumn("_new", starts)
        .withColumn("segment", F.sum(F.col("_new").cast("int")).over(whole))
        .withColumn("_run", F.sum(F.col("break_in_series").cast("int")).over(whole))
        .withColumn("_before", F.when(opens, others).otherwise(own))
        .select(
            *series,
            "segment",
            "nature",
            F.inline(F.when(anchored, F.array(there, here)).otherwise(F.array(here))),
        )
    )


def bands(obs: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Rows (series, level, period, lower, upper) for the shaded areas of both levels. An area begins with
    zero width at the value that precedes the first projected one."""
    value = F.col("value")

    def bound(interval: str) -> Column:
        return F.max(F.when(F.col("interval") == interval, value))

    levels = F.array(
        *[
            F.struct(
                F.lit(level).alias("level"),
                F.col(f"_lower{level}").alias("lower"),
                F.col(f"_upper{level}").alias("upper"),
            )
            for level in ("80", "95")
        ]
    )
    is_central = F.col("interval").isNull()
    wide = obs.groupBy(*series, "period").agg(
        F.max(F.when(is_central, value)).alias("_central"),
        F.max(F.when(is_central, F.col("nature"))).alias("_nature"),
        *[
            bound(f"{level}_{side}").alias(f"_{side}{level}")
            for level in ("80", "95")
            for side in ("lower", "upper")
        ],
    )
    shown = (F.col("_nature") == "projected") & F.col("lower").isNotNull() & F.col("upper").isNotNull()
    band = Window.partitionBy(*series, "level")
    earlier = (F.col("period") < F.col("_first")) & F.col("_central").isNotNull()
    opening = F.max(F.when(earlier, F.struct("period", F.col("_central").alias("v")))).over(band)
    here = F.struct("period", "lower", "upper")
    start = F.struct(
        F.col("_open.period").alias("period"),
        F.col("_open.v").alias("lower"),
        F.col("_open.v").alias("upper"),
    )
    return (
        wide.select(*series, "period", "_central", "_nature", F.inline(levels))
        .withColumn("_shown", F.coalesce(shown, F.lit(False)))
        .withColumn("_first", F.min(F.when(F.col("_shown"), F.col("period"))).over(band))
        .withColumn("_open", opening)
        .where("_shown")
        .select(
            *series,
            "level",
            F.inline(
                F.when(
                    (F.col("period") == F.col("_first")) & F.col("_open").isNotNull(),
                    F.array(start, here),
                ).otherwise(F.array(here))
            ),
        )
    )


def first_last(obs: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """First and last value of each series with their natures, and the 95 % bounds of the
    last. Bounds meet their central value per period first, so no group is collected."""

    def of(interval: str | None, column: str) -> Column:
        same = F.col("interval").eqNullSafe(F.lit(interval).cast("string"))
        return F.max(F.when(same, F.col(column)))

    periods = obs.groupBy(*series, "period").agg(
        of(None, "value").alias("value"),
        of(None, "nature").alias("nature"),
        of("95_lower", "value").alias("lower"),
        of("95_upper", "value").alias("upper"),
    )
    row = F.struct("period", "value", "nature", "lower", "upper")
    ends = periods.where("value IS NOT NULL").groupBy(*series).agg(
        F.min(row).alias("first"), F.max(row).alias("last")
    )
    sides = [F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("first", "last")
             for c in ("period", "value", "nature")]
    return ends.select(*series, *sides, "last.lower", "last.upper")


def last_observed(obs: DataFrame, keys: Sequence[str] = ("geo_code",)) -> DataFrame:
    """The last period before the first projected one, of series that have both."""
    series = Window.partitionBy(*keys)
    first = F.min(F.when(F.col("nature") == "projected", F.col("period"))).over(series)
    return (
        central(obs)
        .where("scenario_id IS NULL AND value IS NOT NULL")
        .withColumn("_first", first)
        .where("period < _first")
        .groupBy(*keys)
        .agg(F.max("period").alias("period"))
    )


def pyramid_rows(obs: DataFrame) -> DataFrame:
    """Rows of population pyramids: men to the left (negative), women to the right."""
    side = F.when(F.col("sex") == "male", -1).when(F.col("sex") == "female", 1)
    rows = central(obs).where("sex <> 'total'").withColumn("age_start", parse_age(F.col("age")).lo)
    return rows.where("age_start IS NOT NULL").withColumn("signed", side * F.col("value"))


def pyramid_violations(obs: DataFrame, by: Sequence[str], profiles: Sequence[str]) -> DataFrame:
    """Charts with a missing value or with more than two profiles."""
    profile = F.xxhash64(*profiles)
    found = pyramid_rows(obs).groupBy(*by).agg(
        F.count_if(F.col("value").isNull()).alias("_missing"),
        F.count_distinct(profile).alias("_profiles"),
    )
    problems = F.array_compact(
        F.array(
            F.when(F.col("_missing") > 0, "needs every age"),
            F.when(F.col("_profiles") > 2, "compares two profiles"),
        )
    )
    return found.select(*by, F.explode(problems).alias("problem"))


def pyramid_summary(obs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Men, women, and the largest age group of both sexes (the youngest of equals)."""
    ages = pyramid_rows(obs).groupBy(*by, "age", "age_start").agg(
        F.sum("value").alias("_n"),
        F.sum(F.when(F.col("sex") == "male", F.col("value"))).alias("_men"),
        F.sum(F.when(F.col("sex") == "female", F.col("value"))).alias("_women"),
    )
    return ages.groupBy(*by).agg(
        F.sum("_men").alias("men"),
        F.sum("_women").alias("women"),
        F.max_by("age", F.struct("_n", -F.col("age_start"))).alias("largest"),
    )


def dumbbell_pairs(obs: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Areas' values in two periods, sorted by the second, largest first; areas without a value
    in either are left out (see :func:`dumbbell_violations`)."""

    def of(period: str) -> Column:
        return F.max(F.when(F.col("period") == period, F.col("value")))

    rows = central(obs).where(F.col("period").isin(first, second))
    pairs = rows.groupBy(*by, "geo_code").agg(of(first).alias("first"), of(second).alias("second"))
    place = F.col("second").desc()
    return pairs.where("first IS NOT NULL AND second IS NOT NULL").orderBy(*by, place, "geo_code")


def dumbbell_violations(
    obs: DataFrame, first: str, second: str, by: Sequence[str] = ()
) -> DataFrame:
    """Areas that do not have exactly one value in each of the two periods."""
    rows = central(obs).where(F.col("period").isin(first, second))
    return (
        rows.groupBy(*by, "geo_code")
        .agg(F.count("value").alias("n"), F.count_distinct("period").alias("periods"))
        .where("n <> 2 OR periods <> 2")
    )


def waterfall_steps(
    parts: DataFrame, order: str, part: str, total: str, keys: Sequence[str], tolerance: float = 0.0
) -> DataFrame:
    """Start and end of each part of a waterfall and the total from zero. ``parts`` holds the
    rows of the parts and of the total (column ``part`` equal to ``total``), ordered by
    ``order``; ``adds_up`` says whether they meet."""
    is_total = F.col(part) == total
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.when(is_total, 0.0).otherwise(F.col("value"))
    end = F.sum(value).over(upto)
    gap = F.sum(value).over(whole) - F.max(F.when(is_total, F.col("value"))).over(whole)
    return (
        parts.withColumns({"_end": end, "adds_up": F.abs(gap) <= tolerance})
        .withColumn("start", F.when(is_total, 0.0).otherwise(F.col("_end") - F.col("value")))
        .withColumn("end", F.when(is_total, F.col("value")).otherwise(F.col("_end")))
        .drop("_end")
    )


def lexis_cells(obs: DataFrame) -> DataFrame:
    """Single ages in calendar years, with the birth cohort of each cell."""
    year, age = F.col("period").try_cast("int"), F.col("age").try_cast("int")
    single = F.col("period").rlike(r"^\d{4}$") & F.col("age").rlike(r"^\d+$")
    rows = central(obs).where(single).withColumns({"year": year, "a": age})
    return rows.withColumn("cohort", F.col("year") - F.col("a"))


def classify(
    rows: DataFrame, by: Sequence[str], n: int, method: str = "quantize", diverging: bool = False
) -> DataFrame:
    """Class (0 to n - 1) of each value in its map: equal intervals between the extremes
    (symmetric about zero if diverging) or quantiles. Equal values share a class.

    The breaks are one aggregate row per map. For quantiles that aggregate holds the map's
    distinct values, i.e. at most its areas; ``selection`` finds the same breaks for maps of
    any number of rows."""
    value = F.col("value")
    steps = F.sequence(F.lit(1), F.lit(n - 1))
    if method == "quantile":
        shares = F.array(*[F.lit(i / n) for i in range(1, n)])
        breaks = rows.groupBy(*by).agg(F.percentile("value", shares).alias("_breaks"))
    elif method == "selection":
        breaks = exact_quantiles(rows, by, "value", [i / n for i in range(1, n)])
        breaks = breaks.select(*by, F.col("quantiles").alias("_breaks"))
    elif method == "quantize":
        low, high = F.min("value"), F.max("value")
        if diverging:
            high = F.max(F.abs(value))
            low = -high
        breaks = (
            rows.groupBy(*by)
            .agg(low.alias("_lo"), high.alias("_hi"))
            .select(
                *by,
                F.transform(
                    steps, lambda i: F.col("_lo") + i * (F.col("_hi") - F.col("_lo")) / n
                ).alias("_breaks"),
            )
        )
    else:
        raise ValueError(f"unknown classification {method!r}")
    passed = F.size(F.filter("_breaks", lambda b: value >= b))
    out = rows.where("value IS NOT NULL").join(breaks, list(by))
    return out.withColumn("class", passed).drop("_breaks")


def extremes(rows: DataFrame, layout: DataFrame, by: Sequence[str]) -> DataFrame:
    """Highest and lowest area of each map (the first code of equals), and how many areas of
    the layout have no value."""
    value, geo = F.col("value"), F.col("geo_code")
    valued = rows.where(value.isNotNull()).join(layout.select("geo_code"), "geo_code", "left_semi")
    found = valued.groupBy(*by).agg(
        F.max("value").alias("highest"),
        F.min("value").alias("lowest"),
        F.count_distinct(geo).alias("_n"),
    )
    sides = (
        valued.join(found, list(by))
        .groupBy(*by, "highest", "lowest", "_n")
        .agg(
            F.min(F.when(value == F.col("highest"), geo)).alias("highest_area"),
            F.min(F.when(value == F.col("lowest"), geo)).alias("lowest_area"),
        )
    )
    areas = layout.agg(F.count("*")).scalar()
    return sides.withColumn("missing", areas - F.col("_n")).drop("_n")


def symbol_sizes(rows: DataFrame, by: Sequence[str], max_radius: float = 28.0) -> DataFrame:
    """Radius with area proportional to the size of a count, and its sign; rates are not drawn
    as symbols and are left out. The largest size per map is a small aggregate, joined."""
    counts = rows.where(~F.col("unit").rlike(RATE_UNIT) & F.col("value").isNotNull())
    size = F.abs("value")
    largest = counts.groupBy(*by).agg(F.max(size).alias("_max"))
    radius = max_radius * F.sqrt(F.try_divide(size, F.col("_max")))
    sign = F.when(F.col("value") < 0, "negative").otherwise("positive")
    return counts.join(largest, list(by)).withColumns({"radius": radius, "sign": sign}).drop("_max")


def tile_join(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """Rows of areas with their place (row, col) on a grid of tiles."""
    return rows.join(layout.select("geo_code", "row", "col"), "geo_code")


def tile_violations(rows: DataFrame, layout: DataFrame, focus: str) -> DataFrame:
    """Cells with two tiles, and areas other than the focus without one."""
    shared = (
        layout.groupBy("row", "col")
        .agg(F.count("*").alias("_n"), F.min("geo_code").alias("geo_code"))
        .where("_n > 1")
        .select("geo_code", F.lit("two tiles share a cell").alias("problem"))
    )
    missing = (
        rows.select("geo_code")
        .where(F.col("geo_code") != focus)
        .distinct()
        .join(layout, "geo_code", "left_anti")
        .select("geo_code", F.lit("no tile").alias("problem"))
    )
    return shared.unionByName(missing)


def with_style(obs: DataFrame) -> DataFrame:
    """Rows with how they are drawn, from two dimensions of fixed size."""
    spark = obs.sparkSession
    natures = values_frame(spark, ("nature", "dash", "band", "color"), NATURE_STYLE)
    statuses = values_frame(spark, ("status", "drawn", "hollow"), STATUS_STYLE)
    return obs.join(natures, "nature").join(statuses, "status")
