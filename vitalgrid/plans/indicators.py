"""Queries I: series read from cubes, and the registry of indicators, as observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions.frames import written
from vitalgrid.operators import indicators as ind
from vitalgrid.operators.contract import violations
from vitalgrid.operators.observations import Series, catalogue_violations, read_catalogue, read_series
from vitalgrid.plans import structure as ps
from vitalgrid.plans.registry import query
from vitalgrid.plans.sources import CUBE_SQL, DIMS, cube_documents
from vitalgrid.plans.structure import r6
from vitalgrid.plans.timeseries import ORD_SQL, weekly_orders
from vitalgrid.plans.views import population, sql, with_provenance
from vitalgrid.schema import definitions
from vitalgrid.sources.cubes import explode_cube


@query(
    "I01_series_observations",
    sql(
        """SELECT geo AS geo_code, time AS period, 'total' AS sex, 'total' AS age, value,
        'live_births' AS metric, 'persons' AS unit, '2026-01-02' AS vintage,
        'observed' AS nature, CASE WHEN value IS NULL THEN 'not_available'
          WHEN flag = 'p' THEN 'provisional' ELSE 'final' END AS status,
        false AS break_in_series FROM cube WHERE rf = 'N' AND geo LIKE 'W1%'""",
        CUBE_SQL,
    ),
)
def series_observations(spark: SparkSession, sf: str) -> DataFrame:
    series = Series("live_births@v1", "observed", "GRID1", {"rf": "N"}, geo_prefix="W1")
    provenance = {
        "source": "Office",
        "dataset_code": "lines",
        "source_url": "https://example.org/lines",
        "transform_version": "cube@0.1",
    }
    cube = explode_cube(cube_documents(spark, sf), DIMS)
    out = read_series(cube, series, definitions(spark), provenance)
    return out.select(
        "geo_code", "period", "sex", "age", "value", "metric", "unit", "vintage", "nature",
        "status", "break_in_series",
    )


OFFICE = {
    "source": "Office",
    "dataset_code": "lines",
    "source_url": "https://example.org/lines",
    "transform_version": "cube@0.1",
}
FLAG_METRICS = {"A": "population_1jan@v1", "N": "live_births@v1", "R": "net_migration_by_age@v1"}


def catalogue() -> dict[str, Series]:
    """Twenty series: each flag in all areas and in each of five regions, one year of two flags."""
    out = {}
    for flag, metric in FLAG_METRICS.items():
        for region in ("", "0", "1", "2", "3", "4"):
            out[f"{flag}{region}"] = Series(
                metric, "observed", "GRID1", {"rf": flag}, geo_prefix="W" + region
            )
    out["N in 1996"] = Series("live_births@v1", "projected", "GRID2", {"rf": "N", "time": "1996"})
    men = {"period": "1998", "sex": "male", "age": "65+"}
    out["R of men in 1998"] = Series(
        "net_migration_by_age@v1", "observed", "GRID1", {"rf": "R", "time": "1998"}, men
    )
    return out


CATALOGUE_SQL = """metric AS (SELECT unnest(['A', 'N', 'R']) AS flag,
  unnest(['population', 'live_births', 'net_migration']) AS metric,
  unnest(['population_1jan@v1', 'live_births@v1', 'net_migration_by_age@v1']) AS definition_id),
series AS (
  SELECT flag || region AS series, flag, NULL AS only, 'W' || region AS prefix, 'observed' AS nature,
    'GRID1' AS vintage, 'total' AS sex, 'total' AS age
  FROM metric, (SELECT unnest(['', '0', '1', '2', '3', '4']) AS region)
  UNION ALL SELECT 'N in 1996', 'N', '1996', 'W', 'projected', 'GRID2', 'total', 'total'
  UNION ALL SELECT 'R of men in 1998', 'R', '1998', 'W', 'observed', 'GRID1', 'male', '65+')"""


@query(
    "I06_series_catalogue",
    sql(
        """SELECT series, definition_id, metric, 'persons' AS unit, geo AS geo_code,
        vintage AS geo_vintage, time AS period, sex, age, value, nature, '2026-01-02' AS vintage,
        CASE WHEN value IS NULL THEN 'not_available' WHEN given = 'p' THEN 'provisional'
          ELSE 'final' END AS status, 'Office' AS source
        FROM (SELECT cube.geo, cube.rf, cube.time, cube.value, cube.flag AS given,
            s.* EXCLUDE (flag)
          FROM cube JOIN series s ON cube.rf = s.flag AND starts_with(cube.geo, s.prefix)
          AND (s.only IS NULL OR s.only = cube.time)) JOIN metric ON metric.flag = rf""",
        CUBE_SQL,
        CATALOGUE_SQL,
    ),
)
def series_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty series of one cube from one pass over it."""
    cube = explode_cube(cube_documents(spark, sf), DIMS)
    out = read_catalogue(cube, catalogue(), definitions(spark), OFFICE)
    return out.select(
        "series", "definition_id", "metric", "unit", "geo_code", "geo_vintage", "period", "sex", "age",
        "value", "nature", "vintage", "status", "source",
    )


@query(
    "I06_catalogue_violations",
    sql(
        """SELECT 'all flags' AS series, 'several codes of rf' AS problem
        FROM (SELECT count(DISTINCT rf) AS n FROM cube WHERE time = '1996') WHERE n > 1
        UNION ALL SELECT 'flag X', 'no cell' WHERE NOT EXISTS (FROM cube WHERE rf = 'X')
        UNION ALL SELECT 'area V', 'no cell' WHERE NOT EXISTS (FROM cube WHERE geo LIKE 'V%')""",
        CUBE_SQL,
    ),
)
def catalogue_problems(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue with three series that cannot be read beside its twenty sound ones."""
    wrong = {
        "all flags": Series("live_births@v1", "observed", "GRID1", {"time": "1996"}),
        "flag X": Series("live_births@v1", "observed", "GRID1", {"rf": "X"}),
        "area V": Series("live_births@v1", "observed", "GRID1", {"rf": "N"}, geo_prefix="V"),
    }
    cube = explode_cube(cube_documents(spark, sf), DIMS)
    return catalogue_violations(cube, catalogue() | wrong, DIMS)


def tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The inputs of the registry. The population feeds most indicators, so it is written
    once; areas below the whole make the regional table."""
    pop = written(population(spark, sf), "population")
    total = pop.where("age = 'total'")
    after = ps.year_shift(F.col("value"), ("geo_code", "sex", "age"), 1)
    pairs = total.withColumn("after", after).where("after IS NOT NULL")
    change = pairs.withColumn("value", F.col("after") - F.col("value")).drop("after")
    average = pairs.withColumn("value", (F.col("after") + F.col("value")) / 2).drop("after")
    deaths = weekly_orders(spark, sf).withColumns(
        {"sex": F.lit("total"), "age": F.lit("total"), "status": F.lit("final"),
         "break_in_series": F.lit(False)}
    )
    return {
        "population": pop.where("geo_code = 'W'"),
        "population_regional": pop.where("geo_code <> 'W'"),
        "change": change,
        "average": average,
        "rates": ps.fertility_observations(spark, sf),
        "deaths": with_provenance(deaths),
    }


def chosen() -> dict[str, ind.Indicator]:
    return ind.registry((ps.YOUNG, ps.OLD, ps.OLDEST), ps.FERTILITY_WIDTHS, (1996, 1999))


@query(
    "I02_indicators",
    sql(
        """SELECT definition_id, count(*) AS n, round(sum(value), 3) AS total FROM (
        SELECT definition_id, value FROM (
          SELECT 'old_age_dependency_ratio@v1' AS definition_id,
            old / nullif(working, 0) * 100 AS value FROM g
          UNION ALL SELECT 'young_age_dependency_ratio@v1', young / nullif(working, 0) * 100
          FROM g
          UNION ALL SELECT 'total_age_dependency_ratio@v1',
            (young + old) / nullif(working, 0) * 100 FROM g
          UNION ALL SELECT 'ageing_index@v1', old / nullif(young, 0) * 100 FROM g
          UNION ALL SELECT 'population_share@v1', unnest([young, working, old, oldest])
            / known * 100 FROM g
          UNION ALL SELECT 'population_growth_rate@v1',
            (n.value - t.value) / ((n.value + t.value) / 2) * 1000
            FROM pop t JOIN pop n ON t.geo_code = n.geo_code AND t.sex = n.sex AND n.y = t.y + 1
            WHERE t.age = 'total' AND n.age = 'total'
          UNION ALL SELECT 'sex_ratio@v1', m.value / f.value * 100
            FROM pop m JOIN pop f ON m.geo_code = f.geo_code AND m.y = f.y
            WHERE m.sex = 'male' AND f.sex = 'female' AND m.age = 'total' AND f.age = 'total'
          UNION ALL SELECT 'total_fertility_rate@v1', v FROM (SELECT
            sum(f * CASE WHEN x IN (15, 44) THEN 5 ELSE 1 END) AS v FROM fert
            GROUP BY geo_code, y HAVING count(*) = 30)
          UNION ALL SELECT 'median_age@v1', a + (half - below) / value FROM (
            SELECT s.*, h.half, sum(s.value) OVER w - s.value AS below,
              row_number() OVER w - 1 AS rn
            FROM (SELECT geo_code, period, sex, TRY_CAST(age AS INT) AS a, value FROM pop
                  WHERE TRY_CAST(age AS INT) IS NOT NULL) s
            JOIN (SELECT geo_code, period, sex, known / 2 AS half FROM g) h
              USING (geo_code, period, sex)
            WINDOW w AS (PARTITION BY geo_code, period, sex ORDER BY a
                         ROWS UNBOUNDED PRECEDING))
            WHERE below < half AND below + value >= half AND a = rn
          UNION ALL SELECT 'excess_mortality@v1', 100 * (m.v - b.v) / b.v FROM mon m
            JOIN (SELECT geo_code, month(mon) AS mm, avg(v) AS v FROM mon
                  WHERE year(mon) BETWEEN 1996 AND 1999 GROUP BY ALL HAVING count(*) = 4) b
            ON m.geo_code = b.geo_code AND month(m.mon) = b.mm WHERE year(m.mon) > 1999)
        WHERE value IS NOT NULL) GROUP BY definition_id""",
        ps.GROUPS_SQL,
        ORD_SQL,
        """wk AS (SELECT geo_code, isoyear(d) AS iy, week(d) AS iw, count(*) AS n FROM ord
          GROUP BY ALL),
        dy AS (SELECT geo_code, n / 7 AS v, date_trunc('week', make_date(iy, 1, 4))
          + CAST(7 * (iw - 1) + unnest(range(7)) AS INT) * INTERVAL 1 DAY AS day FROM wk),
        mon AS (SELECT geo_code, mon, v FROM (SELECT geo_code, date_trunc('month', day) AS mon,
          sum(v) AS v, count(DISTINCT day) AS days FROM dy GROUP BY ALL)
          WHERE days = day(last_day(mon)))""",
    ),
)
def all_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """All seventeen entries of the registry as one table of observations, summed up by
    definition."""
    rows = ind.compute_all(chosen(), tables(spark, sf), definitions(spark))
    return rows.groupBy("definition_id").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")
    )


@query(
    "I03_indicators_keep_contract",
    sql(
        """SELECT 'geo_code length' AS rule, count(*) AS n FROM g WHERE geo_code = 'W'
        AND old / nullif(working, 0) IS NOT NULL""",
        ps.GROUPS_SQL,
    ),
)
def keep_contract(spark: SparkSession, sf: str) -> DataFrame:
    """The old-age ratio as observations breaks no rule but that W is one letter long."""
    one = {"old": chosen()["old_age_dependency_ratio"]}
    rows = ind.compute_all(one, {"population": population(spark, sf)}, definitions(spark))
    return violations(rows, definitions(spark))


@query(
    "I04_indicator_check",
    sql(
        """SELECT 'gone' AS kind, 'W1' AS geo_code, '1996' AS period, NULL AS sex, NULL AS ours
        UNION ALL SELECT 'unexplained', geo_code, period, sex, round(old / working * 100, 6) FROM g
        WHERE geo_code = 'W0' AND period IN ('1997', '1999') AND old / nullif(working, 0) IS NOT NULL""",
        ps.GROUPS_SQL,
    ),
)
def indicator_check(spark: SparkSession, sf: str) -> DataFrame:
    """The official ratio is ours to one decimal, but off in W0 in three years, of which one is
    listed; W1 1996 is listed and agrees."""
    import dataclasses

    one = dataclasses.replace(
        chosen()["old_age_dependency_ratio"], known_differences="W0 1998, W1 1996"
    )
    pop = {"population": population(spark, sf)}
    ours = ind.compute(one, pop, definitions(spark))
    off = (F.col("geo_code") == "W0") & F.col("period").isin("1997", "1998", "1999")
    printed = F.round("value", 1) + F.when(off, 0.4).otherwise(0.0)
    official = ours.withColumn("value", printed)
    out = ind.check(one, ours, official, pop)
    return out.select("kind", "geo_code", "period", "sex", F.round("ours", 6).alias("ours"))
