"""Queries E: population structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions.frames import year_shift
from vitalgrid.operators import structure as st
from vitalgrid.plans.registry import query
from vitalgrid.plans.views import fertility_rates, population, sql, with_provenance

YOUNG, OLD, OLDEST = 10, 35, 40  # bounds that suit ages 0-49+
BANDS = {"0-9": (0, 9), "10-34": (10, 34), "35+": (35, 999)}
KEYS = ("geo_code", "period", "sex")
FLAGS = ("provisional", "break_in_series")


def r6(c: Column | str, name: str = "value") -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return st.age_groups(population(spark, sf), YOUNG, OLD, OLDEST)


GROUPS_SQL = """
g0 AS (
  SELECT geo_code, period, sex, bool_or(status = 'provisional') AS provisional,
         bool_or(break_in_series) AS break_in_series,
         max(value) FILTER (WHERE age = 'total')
           - coalesce(sum(value) FILTER (WHERE age = 'unknown'), 0) AS known,
         CASE WHEN count(*) FILTER (WHERE TRY_CAST(age AS INT) < 10) = 10
              THEN sum(value) FILTER (WHERE TRY_CAST(age AS INT) < 10) END AS u10,
         CASE WHEN count(*) FILTER (WHERE TRY_CAST(age AS INT) < 35) = 35
              THEN sum(value) FILTER (WHERE TRY_CAST(age AS INT) < 35) END AS u35,
         CASE WHEN count(*) FILTER (WHERE TRY_CAST(age AS INT) < 40) = 40
              THEN sum(value) FILTER (WHERE TRY_CAST(age AS INT) < 40) END AS u40
  FROM pop GROUP BY geo_code, period, sex),
g AS (SELECT *, u10 AS young, u35 - u10 AS working, known - u35 AS old, known - u40 AS oldest
      FROM g0)
"""


@query(
    "E01_carry",
    sql(
        """SELECT geo_code, sex, bool_or(status = 'provisional') AS provisional,
        bool_or(break_in_series) AS break_in_series, 'Office' AS source,
        'pop_cells' AS dataset_code, '2026-01-02' AS vintage, count(*) AS n
        FROM pop GROUP BY geo_code, sex"""
    ),
)
def carry(spark: SparkSession, sf: str) -> DataFrame:
    out = population(spark, sf).groupBy("geo_code", "sex").agg(*st.carry(), F.count("*").alias("n"))
    return out.select("geo_code", "sex", *FLAGS, "source", "dataset_code", "vintage", "n")


@query(
    "E02_age_groups",
    sql(
        """SELECT geo_code, period, sex, provisional, break_in_series, known, young, working,
        old, oldest FROM g""",
        GROUPS_SQL,
    ),
)
def age_groups(spark: SparkSession, sf: str) -> DataFrame:
    return groups(spark, sf).select(*KEYS, *FLAGS, "known", "young", "working", "old", "oldest")


def bands(spark: SparkSession, sf: str) -> DataFrame:
    """The population by broad age band, as a table that publishes only bands gives it."""
    pop = population(spark, sf)
    a = F.regexp_extract("age", r"^(\d+)", 1).try_cast("int")
    label = F.coalesce(*[F.when(a.between(*b), k) for k, b in BANDS.items()], F.col("age"))
    cols = [c for c in pop.columns if c not in ("age", "value")]
    return (
        pop.withColumn("age", label).groupBy(*cols, "age").agg(F.sum("value").alias("value"))
    )


@query(
    "E03_broad_groups",
    sql(
        """SELECT geo_code, period, sex, bool_or(status = 'provisional') AS provisional,
        bool_or(break_in_series) AS break_in_series,
        max(value) FILTER (WHERE age = 'total')
          - coalesce(sum(value) FILTER (WHERE age = 'unknown'), 0) AS known,
        sum(value) FILTER (WHERE a < 10) AS young,
        sum(value) FILTER (WHERE a BETWEEN 10 AND 34) AS working,
        sum(value) FILTER (WHERE a >= 35) AS old, CAST(NULL AS DOUBLE) AS oldest
        FROM (SELECT *, TRY_CAST(rtrim(age, '+') AS INT) AS a FROM pop)
        GROUP BY geo_code, period, sex"""
    ),
)
def broad_groups(spark: SparkSession, sf: str) -> DataFrame:
    out = st.broad_groups(bands(spark, sf), *BANDS)
    return out.select(*KEYS, *FLAGS, "known", "young", "working", "old", "oldest")


@query(
    "E04_ratio_per_100",
    sql(
        """SELECT geo_code, period, sex, definition_id, round(value, 6) AS value, provisional,
        break_in_series FROM (
        SELECT *, 'old_age_dependency_ratio@v1' AS definition_id,
               old / nullif(working, 0) * 100 AS value FROM g
        UNION ALL SELECT *, 'young_age_dependency_ratio@v1', young / nullif(working, 0) * 100
        FROM g
        UNION ALL SELECT *, 'total_age_dependency_ratio@v1',
               (young + old) / nullif(working, 0) * 100 FROM g
        UNION ALL SELECT *, 'ageing_index@v1', old / nullif(young, 0) * 100 FROM g)
        WHERE value IS NOT NULL""",
        GROUPS_SQL,
    ),
)
def ratios(spark: SparkSession, sf: str) -> DataFrame:
    out = st.dependency_ratios(groups(spark, sf))
    return out.select(*KEYS, "definition_id", r6("value"), *FLAGS)


@query(
    "E05_population_shares",
    sql(
        """SELECT geo_code, period, sex, age, round(v / known * 100, 6) AS value FROM (
        UNPIVOT (SELECT geo_code, period, sex, known, young AS "0-9", working AS "10-34",
                 old AS "35+", oldest AS "40+" FROM g)
        ON "0-9", "10-34", "35+", "40+" INTO NAME age VALUE v)""",
        GROUPS_SQL,
    ),
)
def shares(spark: SparkSession, sf: str) -> DataFrame:
    labels = {"0-9": "young", "10-34": "working", "35+": "old", "40+": "oldest"}
    return st.population_shares(groups(spark, sf), labels).select(*KEYS, "age", r6("value"))


def change_and_average(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Change during the year and average of the two 1 January totals, as two tables."""
    total = population(spark, sf).where(F.col("age") == "total")
    after = year_shift(F.col("value"), ("geo_code", "sex", "age"), 1)
    pairs = total.withColumn("after", after).where(F.col("after").isNotNull())
    change = pairs.withColumn("value", F.col("after") - F.col("value")).drop("after")
    average = pairs.withColumn("value", (F.col("after") + F.col("value")) / 2).drop("after")
    return change, average


@query(
    "E06_growth_rate",
    sql(
        """SELECT t.geo_code, t.period, t.sex,
        round((n.value - t.value) / ((n.value + t.value) / 2) * 1000, 6) AS value
        FROM pop t JOIN pop n ON t.geo_code = n.geo_code AND t.sex = n.sex AND n.y = t.y + 1
        WHERE t.age = 'total' AND n.age = 'total'"""
    ),
)
def growth(spark: SparkSession, sf: str) -> DataFrame:
    return st.growth_rate(*change_and_average(spark, sf)).select(*KEYS, r6("value"))


@query(
    "E07_sex_ratio",
    sql(
        """SELECT m.geo_code, m.period, round(m.value / f.value * 100, 6) AS value
        FROM pop m JOIN pop f ON m.geo_code = f.geo_code AND m.y = f.y
        WHERE m.sex = 'male' AND f.sex = 'female' AND m.age = 'total' AND f.age = 'total'"""
    ),
)
def sex_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return st.sex_ratio(population(spark, sf)).select("geo_code", "period", r6("value"))


FERTILITY_WIDTHS = {str(a): 5 if a in (15, 44) else 1 for a in range(15, 45)}


def fertility_observations(spark: SparkSession, sf: str) -> DataFrame:
    rates = fertility_rates(spark, sf).select(
        "geo_code",
        "period",
        F.lit("total").alias("sex"),
        F.col("x").cast("string").alias("age"),
        F.col("f").alias("value"),
        F.when(F.col("period") == "2001", "provisional").otherwise("final").alias("status"),
        F.lit(False).alias("break_in_series"),
    )
    return with_provenance(rates)


@query(
    "E08_total_fertility",
    sql(
        """SELECT geo_code, period,
        round(sum(f * CASE WHEN x IN (15, 44) THEN 5 ELSE 1 END), 6) AS value,
        period = '2001' AS provisional
        FROM fert GROUP BY geo_code, period HAVING count(*) = 30"""
    ),
)
def total_fertility(spark: SparkSession, sf: str) -> DataFrame:
    out = st.total_fertility(fertility_observations(spark, sf), FERTILITY_WIDTHS)
    return out.select("geo_code", "period", r6("value"), "provisional")


@query(
    "E09_complete_groups",
    sql(
        """SELECT geo_code, period, sex FROM cells WHERE q_known IS NOT NULL
        GROUP BY ALL HAVING count(DISTINCT a) = 50 AND max(a) = 49 AND min(a) = 0"""
    ),
)
def complete(spark: SparkSession, sf: str) -> DataFrame:
    pop = population(spark, sf).where(F.col("sex") != "total")
    a = F.regexp_extract("age", r"^(\d+)", 1).try_cast("int")
    return st.complete_groups(pop.withColumn("a", a), KEYS, "a", 50)


@query(
    "F01_median_age",
    sql(
        """SELECT geo_code, period, sex, round(a + (half - below) / value, 6) AS value FROM (
        SELECT s.*, h.half, sum(s.value) OVER w - s.value AS below,
               row_number() OVER w - 1 AS rn
        FROM (SELECT geo_code, period, sex, TRY_CAST(age AS INT) AS a, value FROM pop
              WHERE TRY_CAST(age AS INT) IS NOT NULL) s
        JOIN (SELECT geo_code, period, sex, (max(value) FILTER (WHERE age = 'total')
                - coalesce(sum(value) FILTER (WHERE age = 'unknown'), 0)) / 2 AS half
              FROM pop GROUP BY ALL) h USING (geo_code, period, sex)
        WINDOW w AS (PARTITION BY geo_code, period, sex ORDER BY a
                     ROWS UNBOUNDED PRECEDING))
        WHERE below < half AND below + value >= half AND a = rn"""
    ),
)
def median_age(spark: SparkSession, sf: str) -> DataFrame:
    return st.median_age(population(spark, sf)).select(*KEYS, r6("value"))
