"""Queries J: frames for charts, maps and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions.frames import values_frame
from vitalgrid.operators import presentation as pr
from vitalgrid.plans.registry import query
from vitalgrid.plans.structure import r6
from vitalgrid.plans.views import population, sql, table


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of both sexes as a line chart has them: projected from 2000 with bounds, a
    scenario beside the projection, a break in 1998, no value for W2 in 1997."""
    total = population(spark, sf).where("age = 'total' AND sex = 'total'")
    v, projected = F.col("value"), F.col("period") >= "2000"

    def copy(factor: float, interval: str | None, scenario: str | None) -> Column:
        return F.struct(
            (v * factor).alias("value"),
            F.lit(interval).cast("string").alias("interval"),
            F.lit(scenario).cast("string").alias("scenario_id"),
        )

    one = copy(1.0, None, None)
    many = [
        one, copy(0.95, "80_lower", None), copy(1.05, "80_upper", None),
        copy(0.9, "95_lower", None), copy(1.1, "95_upper", None), copy(1.2, None, "high"),
    ]
    hidden = (F.col("geo_code") == "W2") & (F.col("period") == "1997")
    rows = F.when(projected, F.array(*many)).otherwise(F.array(one))
    keep = [c for c in total.columns if c not in ("value", "interval", "scenario_id")]
    return total.select(*keep, F.inline(rows)    ).withColumns(
        {
            "value": F.when(~hidden, v),
            "status": F.when(hidden, "not_available").otherwise(F.col("status")),
            "nature": F.when(F.col("scenario_id").isNotNull(), "scenario")
            .when(projected, "projected")
            .otherwise(F.col("nature")),
        }
    )


SER_SQL = """
ser AS (SELECT geo_code, y, period, sex, age, break_in_series,
    CASE WHEN NOT (geo_code = 'W2' AND y = 1997) THEN value * c.f END AS value,
    CASE WHEN geo_code = 'W2' AND y = 1997 THEN 'not_available' ELSE status END AS status,
    c.i AS interval, c.s AS scenario_id, CASE WHEN c.s IS NOT NULL THEN 'scenario'
      WHEN y >= 2000 THEN 'projected' ELSE 'official_estimate' END AS nature
  FROM (SELECT *, unnest(CASE WHEN y >= 2000 THEN [{f: 1.0::DOUBLE, i: NULL, s: NULL},
      {f: 0.95, i: '80_lower', s: NULL}, {f: 1.05, i: '80_upper', s: NULL},
      {f: 0.9, i: '95_lower', s: NULL}, {f: 1.1, i: '95_upper', s: NULL},
      {f: 1.2, i: NULL, s: 'high'}] ELSE [{f: 1.0::DOUBLE, i: NULL, s: NULL}] END) AS c
    FROM pop WHERE age = 'total' AND sex = 'total')),
cen AS (SELECT * FROM ser WHERE interval IS NULL)
"""


@query(
    "J01_fact",
    sql(
        """SELECT geo_code, period, count(c.geo) AS n,
        CASE WHEN count(c.geo) = 1 THEN max(c.value) END AS value,
        CASE WHEN count(c.geo) = 1 AND max(c.value) IS NOT NULL THEN CASE
          WHEN period = '2001' THEN 'projected, provisional' WHEN period = '2000'
          THEN 'projected' ELSE '' END END AS note,
        CASE WHEN count(c.geo) <> 1 THEN 'need exactly one value'
          WHEN max(c.value) IS NULL THEN 'not available' END AS problem
        FROM (SELECT DISTINCT geo_code, period FROM pop UNION ALL SELECT 'W9', '2000') r
        LEFT JOIN (SELECT geo_code AS geo, period AS p, value FROM cen
                   WHERE scenario_id IS NULL) c ON c.geo = r.geo_code AND c.p = r.period
        GROUP BY geo_code, period""",
        SER_SQL,
    ),
)
def facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = series(spark, sf)
    wanted = rows.select("geo_code", "period").distinct()
    absent = values_frame(spark, ("geo_code", "period"), [("W9", "2000")])
    return pr.facts(rows, wanted.unionByName(absent), ("geo_code", "period"))


@query(
    "J02_latest_period",
    sql("SELECT geo_code, sex, age, max(period) AS period FROM pop GROUP BY ALL"),
)
def latest(spark: SparkSession, sf: str) -> DataFrame:
    return pr.latest_period(population(spark, sf))


@query(
    "J03_provenance_panel",
    sql(
        """SELECT DISTINCT 'Office' AS source, 'pop_cells' AS dataset_code,
        'https://example.org/pop_cells' AS source_url, '2026-01-02' AS vintage,
        'population_1jan@v1' AS definition_id,
        CASE WHEN y = 2001 THEN 'cells@0.2' ELSE 'cells@0.1' END AS transform_version FROM pop"""
    ),
)
def panel(spark: SparkSession, sf: str) -> DataFrame:
    version = F.when(F.col("period") == "2001", "cells@0.2").otherwise(F.col("transform_version"))
    rows = population(spark, sf).withColumn("transform_version", version)
    return pr.provenance_panel(rows).drop("retrieved_at")


@query(
    "J04_segments",
    sql(
        """SELECT geo_code, scenario_id, CASE WHEN y < 1998 THEN 1 WHEN y < 2000 THEN 2 ELSE 3
        END - CASE WHEN scenario_id IS NOT NULL THEN 2 ELSE 0 END AS segment, nature, period,
        round(value, 6) AS value, false AS anchor FROM cen
        UNION ALL SELECT geo_code, scenario_id, 3, 'projected', period, round(value, 6), true
        FROM cen WHERE y = 1999
        UNION ALL SELECT geo_code, 'high', 1, 'scenario', period, round(value, 6), true
        FROM cen WHERE y = 1999""",
        SER_SQL,
    ),
)
def segments(spark: SparkSession, sf: str) -> DataFrame:
    out = pr.segments(series(spark, sf))
    segment = F.col("segment").cast("int").alias("segment")
    return out.select(*pr.SERIES, segment, "nature", "period", r6("value"), "anchor")


@query(
    "J05_bands",
    sql(
        """SELECT geo_code, scenario_id, l AS level, period,
        round(CASE WHEN y = 1999 THEN value WHEN l = '80' THEN value * 0.95 ELSE value * 0.9 END,
          6) AS lower,
        round(CASE WHEN y = 1999 THEN value WHEN l = '80' THEN value * 1.05 ELSE value * 1.1 END,
          6) AS upper
        FROM cen, (SELECT unnest(['80', '95']) AS l) WHERE y >= 1999 AND scenario_id IS NULL""",
        SER_SQL,
    ),
)
def bands(spark: SparkSession, sf: str) -> DataFrame:
    out = pr.bands(series(spark, sf))
    return out.select(*pr.SERIES, "level", "period", r6("lower", "lower"), r6("upper", "upper"))


@query(
    "J06_first_last",
    sql(
        """SELECT geo_code, scenario_id, min(period) AS first_period,
        round(arg_min(value, y), 6) AS first_value, arg_min(nature, y) AS first_nature,
        max(period) AS last_period, round(arg_max(value, y), 6) AS last_value,
        arg_max(nature, y) AS last_nature,
        CASE WHEN scenario_id IS NULL THEN round(arg_max(value, y) * 0.9, 6) END AS lower,
        CASE WHEN scenario_id IS NULL THEN round(arg_max(value, y) * 1.1, 6) END AS upper
        FROM cen WHERE value IS NOT NULL GROUP BY geo_code, scenario_id""",
        SER_SQL,
    ),
)
def first_last(spark: SparkSession, sf: str) -> DataFrame:
    out = pr.first_last(series(spark, sf))
    values = ("first_value", "last_value", "lower", "upper")
    return out.withColumns({c: F.round(c, 6) for c in values})


@query(
    "J07_last_observed",
    sql("SELECT geo_code, max(period) AS period FROM cen WHERE y < 2000 GROUP BY ALL", SER_SQL),
)
def last_observed(spark: SparkSession, sf: str) -> DataFrame:
    return pr.last_observed(series(spark, sf))


BY = ("geo_code", "period")


@query(
    "J08_pyramid_rows",
    sql(
        """SELECT geo_code, period, sex, age, TRY_CAST(rtrim(age, '+') AS INT) AS age_start,
        CASE WHEN sex = 'male' THEN -value ELSE value END AS signed FROM pop
        WHERE sex <> 'total' AND TRY_CAST(rtrim(age, '+') AS INT) IS NOT NULL"""
    ),
)
def pyramid(spark: SparkSession, sf: str) -> DataFrame:
    out = pr.pyramid_rows(population(spark, sf))
    return out.select("geo_code", "period", "sex", "age", "age_start", "signed")


@query(
    "J08_pyramid_summary",
    sql(
        """SELECT geo_code, period, sum(v) FILTER (WHERE sex = 'male') AS men,
        sum(v) FILTER (WHERE sex = 'female') AS women, max(largest) AS largest FROM (
        SELECT geo_code, period, sex, q_known AS v, first_value(
          CASE WHEN a = 49 THEN '49+' ELSE CAST(a AS VARCHAR) END) OVER (
          PARTITION BY geo_code, y ORDER BY t DESC, a) AS largest FROM (
          SELECT *, sum(q_known) OVER (PARTITION BY geo_code, y, a) AS t FROM cells
          WHERE q_known IS NOT NULL)) GROUP BY ALL"""
    ),
)
def pyramid_summary(spark: SparkSession, sf: str) -> DataFrame:
    return pr.pyramid_summary(population(spark, sf), BY)


@query(
    "J08_pyramid_violations",
    sql(
        """SELECT geo_code, 'compares two profiles' AS problem FROM pop
        WHERE TRY_CAST(rtrim(age, '+') AS INT) IS NOT NULL AND sex <> 'total'
        GROUP BY geo_code HAVING count(DISTINCT period) > 2
        UNION ALL SELECT DISTINCT geo_code, 'needs every age' FROM pop
        WHERE sex <> 'total' AND age = '7' AND period = '1999'"""
    ),
)
def pyramid_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = population(spark, sf)
    hidden = (F.col("age") == "7") & (F.col("period") == "1999")
    rows = rows.withColumn("value", F.when(~hidden, F.col("value")))
    return pr.pyramid_violations(rows, ("geo_code",), ("geo_code", "period"))


@query(
    "J09_dumbbell_pairs",
    sql(
        """SELECT geo_code, a.value AS first, b.value AS second FROM cen a
        JOIN cen b USING (geo_code) WHERE a.y = 1997 AND b.y = 1999 AND a.value IS NOT NULL""",
        SER_SQL,
    ),
)
def dumbbell(spark: SparkSession, sf: str) -> DataFrame:
    return pr.dumbbell_pairs(series(spark, sf), "1997", "1999")


@query(
    "J09_dumbbell_violations",
    sql(
        """SELECT geo_code, count(value) AS n, count(DISTINCT period) AS periods FROM cen
        WHERE y IN (1997, 1999) GROUP BY geo_code
        HAVING count(value) <> 2 OR count(DISTINCT period) <> 2""",
        SER_SQL,
    ),
)
def dumbbell_violations(spark: SparkSession, sf: str) -> DataFrame:
    return pr.dumbbell_violations(series(spark, sf), "1997", "1999")


@query(
    "J10_waterfall_steps",
    sql(
        """SELECT geo_code, part, value, CASE WHEN n = 3 THEN 0 ELSE e - value END AS start,
        CASE WHEN n = 3 THEN value ELSE e END AS "end", geo_code <> 'W1' AS adds_up FROM (
        SELECT *, sum(CASE WHEN n < 3 THEN value ELSE 0 END) OVER (
          PARTITION BY geo_code ORDER BY n ROWS UNBOUNDED PRECEDING) AS e FROM (
        SELECT geo_code, 1 AS n, 'births' AS part, CAST(sum(n_n) AS DOUBLE) AS value FROM cells
          GROUP BY geo_code
        UNION ALL SELECT geo_code, 2, 'deaths', CAST(-sum(n_r) AS DOUBLE) FROM cells
          GROUP BY geo_code
        UNION ALL SELECT geo_code, 3, 'change', CAST(sum(n_n) - sum(n_r)
          + CASE WHEN geo_code = 'W1' THEN 2 ELSE 0 END AS DOUBLE) FROM cells
          GROUP BY geo_code))"""
    ),
)
def waterfall(spark: SparkSession, sf: str) -> DataFrame:
    from vitalgrid.plans.views import cells

    sums = cells(spark, sf).groupBy("geo_code").agg(
        F.sum("n_n").cast("double").alias("b"), F.sum("n_r").cast("double").alias("d")
    )
    off = F.when(F.col("geo_code") == "W1", 2.0).otherwise(0.0)
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.lit(p).alias("part"), v.alias("value"))
            for n, p, v in (
                (1, "births", F.col("b")),
                (2, "deaths", -F.col("d")),
                (3, "change", F.col("b") - F.col("d") + off),
            )
        ]
    )
    parts = sums.select("geo_code", F.inline(rows))
    out = pr.waterfall_steps(parts, "n", "part", "change", ("geo_code",), 1e-9)
    return out.select("geo_code", "part", "value", "start", "end", "adds_up")


@query(
    "J11_lexis_cells",
    sql(
        """SELECT geo_code, sex, y AS year, TRY_CAST(age AS INT) AS a,
        y - TRY_CAST(age AS INT) AS cohort, value FROM pop WHERE TRY_CAST(age AS INT) IS NOT NULL"""
    ),
)
def lexis(spark: SparkSession, sf: str) -> DataFrame:
    out = pr.lexis_cells(population(spark, sf))
    return out.select("geo_code", "sex", "year", "a", "cohort", "value")


CLASS_BODY = """SELECT geo_code, period, round(value, 6) AS value,
    CAST(len(list_filter(range(1, 5), lambda i : value >= {at})) AS INT) AS class FROM (
    SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi, max(abs(value)) OVER w AS big,
      {extra} FROM (SELECT geo_code, y, period, value - 5000 AS value FROM cen
      WHERE scenario_id IS NULL AND value IS NOT NULL)
    WINDOW w AS (PARTITION BY y))"""


def shifted(spark: SparkSession, sf: str) -> DataFrame:
    """Totals less 5000, so that some are negative."""
    rows = pr.central(series(spark, sf)).where("scenario_id IS NULL")
    return rows.withColumn("value", F.col("value") - 5000)


def classed(df: DataFrame) -> DataFrame:
    return df.select("geo_code", "period", r6("value"), "class")


@query(
    "J12_classify_quantize",
    sql(CLASS_BODY.format(at="lo + i * (hi - lo) / 5", extra="1 AS one"), SER_SQL),
)
def quantize(spark: SparkSession, sf: str) -> DataFrame:
    return classed(pr.classify(shifted(spark, sf), ("period",), 5))


@query(
    "J12_classify_diverging",
    sql(CLASS_BODY.format(at="-big + i * 2 * big / 5", extra="1 AS one"), SER_SQL),
)
def diverging(spark: SparkSession, sf: str) -> DataFrame:
    return classed(pr.classify(shifted(spark, sf), ("period",), 5, diverging=True))


@query(
    "J12_classify_quantile",
    sql(
        CLASS_BODY.format(
            at="list_extract(qs, i)",
            extra="quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) OVER w AS qs",
        ),
        SER_SQL,
    ),
)
def quantile(spark: SparkSession, sf: str) -> DataFrame:
    return classed(pr.classify(shifted(spark, sf), ("period",), 5, "quantile"))


def layout(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of tiles from the region table, and a tile for an area that does not exist."""
    region = table(spark, sf, "region")
    tiles = region.select(
        F.concat(F.lit("W"), F.col("r_regionkey").cast("string")).alias("geo_code"),
        F.floor(F.col("r_regionkey") / 3).cast("int").alias("row"),
        (F.col("r_regionkey") % 3).cast("int").alias("col"),
    )
    return tiles.unionByName(values_frame(spark, ("geo_code", "row", "col"), [("W9", 1, 1)]))


@query(
    "J13_extremes",
    sql(
        """SELECT period, max(value) AS highest, min(value) AS lowest,
        arg_max(geo_code, value) AS highest_area, arg_min(geo_code, value) AS lowest_area,
        6 - count(*) AS missing FROM cen WHERE scenario_id IS NULL AND length(geo_code) = 2
        AND value IS NOT NULL GROUP BY period""",
        SER_SQL,
    ),
)
def extremes(spark: SparkSession, sf: str) -> DataFrame:
    rows = pr.central(series(spark, sf)).where("scenario_id IS NULL")
    return pr.extremes(rows, layout(spark, sf), ("period",))


@query(
    "J14_symbol_sizes",
    sql(
        """SELECT geo_code, period, round(28 * sqrt(abs(v) / max(abs(v)) OVER
          (PARTITION BY period)), 6) AS radius,
        CASE WHEN v < 0 THEN 'negative' ELSE 'positive' END AS sign FROM (
        SELECT *, value - 5000 AS v FROM cen WHERE scenario_id IS NULL
          AND value IS NOT NULL AND geo_code <> 'W4')""",
        SER_SQL,
    ),
)
def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the areas; those of W4 are given as a rate and left out."""
    unit = F.when(F.col("geo_code") == "W4", "per 1000 persons").otherwise(F.col("unit"))
    out = pr.symbol_sizes(shifted(spark, sf).withColumn("unit", unit), ("period",))
    return out.select("geo_code", "period", r6("radius", "radius"), "sign")


@query(
    "J15_tile_join",
    sql(
        """SELECT geo_code, period, round(value, 6) AS value, CAST(geo_code[2] AS INT) // 3 AS row,
        CAST(geo_code[2] AS INT) % 3 AS col FROM cen WHERE length(geo_code) = 2
        AND scenario_id IS NULL""",
        SER_SQL,
    ),
)
def tiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = pr.central(series(spark, sf)).where("scenario_id IS NULL")
    out = pr.tile_join(rows, layout(spark, sf))
    return out.select("geo_code", "period", r6("value"), "row", "col")


@query(
    "J15_tile_violations",
    sql(
        """SELECT DISTINCT geo_code, 'no tile' AS problem FROM pop WHERE length(geo_code) = 3
        UNION ALL SELECT 'W4', 'two tiles share a cell'"""
    ),
)
def tile_violations(spark: SparkSession, sf: str) -> DataFrame:
    return pr.tile_violations(series(spark, sf), layout(spark, sf), "W")


@query(
    "J16_epistemic_style",
    sql(
        """SELECT nature, status, CASE nature WHEN 'projected' THEN 'stroke-dash-projected'
          WHEN 'scenario' THEN 'stroke-dash-scenario' END AS dash, nature = 'projected' AS band,
        CASE WHEN nature = 'scenario' THEN 'color-scenario' END AS color,
        status <> 'not_available' AS drawn, status = 'provisional' AS hollow, count(*) AS n
        FROM ser GROUP BY nature, status""",
        SER_SQL,
    ),
)
def styles(spark: SparkSession, sf: str) -> DataFrame:
    counts = series(spark, sf).groupBy("nature", "status").agg(F.count("*").alias("n"))
    out = pr.with_style(counts)
    return out.select("nature", "status", "dash", "band", "color", "drawn", "hollow", "n")
