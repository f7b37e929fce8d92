"""Queries C: the contract, on an observations table with known defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.operators import contract as c
from vitalgrid.plans.registry import query
from vitalgrid.plans.views import population, sql
from vitalgrid.schema import COLUMNS, definitions

# column -> (age, period) of the rows that break a rule, and what they hold instead
DEFECTS = {
    "definition_id": ("7", "Bad Id"),
    "source_url": ("8", "http://example.org"),
    "period": ("9", "1995-1"),
    "nature": ("13", "scenario"),
    "scenario_id": ("14", "s1"),
    "unit": ("15", "people"),
    "status": ("12", "not_available"),
}
AGE_DEFECTS = {"10": "15-9", "16": "Y16"}


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """The population with defects in 1995, repeated keys and interval bounds, good and bad."""
    pop = population(spark, sf)
    year, age = F.col("period") == "1995", F.col("age")
    bad = {
        col: F.when(year & (age == a), v).otherwise(F.col(col)) for col, (a, v) in DEFECTS.items()
    }
    bad["value"] = F.when(~(year & (age == "11")), F.col("value"))
    bad["age"] = F.coalesce(*[F.when(year & (age == a), v) for a, v in AGE_DEFECTS.items()], age)

    def copy(interval: str | None, factor: float = 1.0) -> Column:
        return F.struct(
            F.lit(interval).cast("string").alias("interval"), (F.lit(factor) * v).alias("value")
        )

    v = F.col("value")
    both = F.array(copy(None), copy("80_lower", 0.5), copy("80_upper", 1.5))
    copies = (
        F.when(year & (age == "17"), F.array(copy(None), copy(None)))
        .when(year & (age == "18") & (F.col("sex") == "male"), F.slice(both, 1, 2))
        .when(
            year & (age == "18") & (F.col("sex") == "female"),
            F.array(copy(None), copy("95_lower", 1.5), copy("95_upper", 0.5)),
        )
        .when(year & (age == "18"), both)
        .when(year & (age == "19"), F.array(copy("95_lower", 0.5), copy("95_upper", 1.5)))
        .otherwise(F.array(copy(None)))
    )
    keep = [x for x in COLUMNS if x not in ("interval", "value")]
    return pop.select(*keep, F.inline(copies)).withColumns(bad).select(*COLUMNS)


OBS_SQL = """
obs AS (
  SELECT geo_code, sex, status0 AS status, iv.i AS interval,
    CASE WHEN NOT (y = 1995 AND age0 = '11') THEN v * iv.f END AS value,
    CASE WHEN y = 1995 AND age0 = '7' THEN 'Bad Id' ELSE 'population_1jan@v1' END
      AS definition_id,
    CASE WHEN y = 1995 AND age0 = '8' THEN 'http://example.org'
      ELSE 'https://example.org/pop_cells' END AS source_url,
    CASE WHEN y = 1995 AND age0 = '9' THEN '1995-1' ELSE p0 END AS period,
    CASE WHEN y = 1995 AND age0 = '13' THEN 'scenario' ELSE 'official_estimate' END AS nature,
    CASE WHEN y = 1995 AND age0 = '14' THEN 's1' END AS scenario_id,
    CASE WHEN y = 1995 AND age0 = '15' THEN 'people' ELSE 'persons' END AS unit,
    CASE WHEN y = 1995 AND age0 = '10' THEN '15-9' WHEN y = 1995 AND age0 = '16' THEN 'Y16'
      ELSE age0 END AS age
  FROM (SELECT geo_code, y, period AS p0, sex, age AS age0, value AS v,
      CASE WHEN y = 1995 AND age = '12' THEN 'not_available' ELSE status END AS status0,
      unnest(CASE WHEN y = 1995 AND age = '17' THEN [{i: NULL, f: 1.0}, {i: NULL, f: 1.0}]
        WHEN y = 1995 AND age = '18' AND sex = 'male'
          THEN [{i: NULL, f: 1.0}, {i: '80_lower', f: 0.5}]
        WHEN y = 1995 AND age = '18' AND sex = 'female'
          THEN [{i: NULL, f: 1.0}, {i: '95_lower', f: 1.5}, {i: '95_upper', f: 0.5}]
        WHEN y = 1995 AND age = '18'
          THEN [{i: NULL, f: 1.0}, {i: '80_lower', f: 0.5}, {i: '80_upper', f: 1.5}]
        WHEN y = 1995 AND age = '19' THEN [{i: '95_lower', f: 0.5}, {i: '95_upper', f: 1.5}]
        ELSE [{i: NULL, f: 1.0}] END) AS iv FROM pop)),
field AS (
  SELECT 'definition_id format' AS rule, geo_code, period, sex, age FROM obs
    WHERE NOT regexp_full_match(definition_id, '[a-z0-9_]+@v[0-9]+')
  UNION ALL SELECT 'geo_code length', geo_code, period, sex, age FROM obs
    WHERE length(geo_code) < 2
  UNION ALL SELECT 'period format', geo_code, period, sex, age FROM obs
    WHERE NOT regexp_full_match(period, '[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?')
  UNION ALL SELECT 'age format', geo_code, period, sex, age FROM obs
    WHERE NOT regexp_full_match(age, '(total|unknown|[0-9]{1,3}(-[0-9]{1,3}|\\+)?)')
  UNION ALL SELECT 'source_url prefix', geo_code, period, sex, age FROM obs
    WHERE NOT starts_with(source_url, 'https://'))
"""


def _key_rows(df: DataFrame) -> DataFrame:
    return df.select("rule", "geo_code", "period", "sex", "age")


@query(
    "C02_schema",
    sql(
        """SELECT unnest(['missing column unit', 'undeclared column units',
          'value: string instead of double', 'break_in_series: int instead of boolean']) AS problem,
          count(*) AS rows FROM pop"""
    ),
)
def schema(spark: SparkSession, sf: str) -> DataFrame:
    """A delivery with a misspelt column and two of other types, and how many rows it concerns."""
    delivered = (
        population(spark, sf)
        .select(*COLUMNS)
        .withColumnRenamed("unit", "units")
        .withColumns({"value": F.col("value").cast("string"), "break_in_series": F.col("break_in_series").cast("int")})
    )
    problems = F.array(*[F.lit(p) for p in c.schema_violations(delivered)])
    rows = delivered.agg(F.count("*").alias("rows"))
    return rows.select(F.explode(problems).alias("problem"), "rows")


@query("C01_field_rules", sql("SELECT * FROM field", OBS_SQL))
def fields(spark: SparkSession, sf: str) -> DataFrame:
    return _key_rows(c.field_violations(observations(spark, sf)))


AVAILABILITY_SQL = """SELECT 'value null iff not_available' AS rule, geo_code, period, sex, age
    FROM obs WHERE (value IS NULL) <> (status = 'not_available')"""
SCENARIO_SQL = """SELECT 'scenario_id iff scenario' AS rule, geo_code, period, sex, age
    FROM obs WHERE (scenario_id IS NOT NULL) <> (nature = 'scenario')"""
BAND_SQL = """SELECT 'age band order' AS rule, geo_code, period, sex, age FROM obs
    WHERE age LIKE '%-%' AND split_part(age, '-', 1)::INT >= split_part(age, '-', 2)::INT"""
DEFINITION_SQL = """SELECT 'definition match' AS rule, geo_code, period, sex, age FROM obs
    WHERE definition_id <> 'population_1jan@v1' OR unit <> 'persons'"""
INTERVAL_SQL = """SELECT geo_code, period, sex, age, level, n FROM (
    SELECT geo_code, period, sex, age, level, bool_or(interval IS NULL) AS central,
      count(*) FILTER (WHERE interval LIKE level || '%') AS n,
      count(*) FILTER (WHERE interval = level || '_lower') AS nl,
      count(*) FILTER (WHERE interval = level || '_upper') AS nu,
      max(value) FILTER (WHERE interval = level || '_lower') AS lo,
      max(value) FILTER (WHERE interval = level || '_upper') AS hi
    FROM (SELECT *, unnest(['80', '95']) AS level FROM obs)
    GROUP BY geo_code, period, sex, age, level, definition_id, unit, scenario_id)
    WHERE n > 0 AND NOT (central AND nl > 0 AND nu > 0 AND coalesce(lo <= hi, true))"""
DUPLICATE_SQL = """SELECT geo_code, period, sex, age, count(*) AS n FROM obs
    GROUP BY geo_code, period, sex, age, definition_id, scenario_id, interval
    HAVING count(*) > 1"""


@query("C03_value_availability", sql(AVAILABILITY_SQL, OBS_SQL))
def availability(spark: SparkSession, sf: str) -> DataFrame:
    return _key_rows(c.availability_violations(observations(spark, sf)))


@query("C04_scenario_rule", sql(SCENARIO_SQL, OBS_SQL))
def scenario(spark: SparkSession, sf: str) -> DataFrame:
    return _key_rows(c.scenario_violations(observations(spark, sf)))


@query("C05_interval_pairs", sql(INTERVAL_SQL, OBS_SQL))
def intervals(spark: SparkSession, sf: str) -> DataFrame:
    out = c.interval_violations(observations(spark, sf))
    return out.select("geo_code", "period", "sex", "age", "level", "n")


@query("C06_age_band_order", sql(BAND_SQL, OBS_SQL))
def age_bands(spark: SparkSession, sf: str) -> DataFrame:
    return _key_rows(c.age_band_violations(observations(spark, sf)))


@query("C07_definition_match", sql(DEFINITION_SQL, OBS_SQL))
def definition(spark: SparkSession, sf: str) -> DataFrame:
    return _key_rows(c.definition_violations(observations(spark, sf), definitions(spark)))


@query("C08_unique_key", sql(DUPLICATE_SQL, OBS_SQL))
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    out = c.duplicate_keys(observations(spark, sf))
    return out.select("geo_code", "period", "sex", "age", "n")


@query(
    "C09_validate",
    sql(
        f"""SELECT rule, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT rule, count(*) AS n FROM field GROUP BY rule
        UNION ALL SELECT rule, count(*) FROM ({AVAILABILITY_SQL}) GROUP BY rule
        UNION ALL SELECT rule, count(*) FROM ({SCENARIO_SQL}) GROUP BY rule
        UNION ALL SELECT rule, count(*) FROM ({BAND_SQL}) GROUP BY rule
        UNION ALL SELECT rule, count(*) FROM ({DEFINITION_SQL}) GROUP BY rule
        UNION ALL SELECT 'interval pair', sum(n) FROM ({INTERVAL_SQL})
        UNION ALL SELECT 'unique key', sum(n) FROM ({DUPLICATE_SQL})) GROUP BY rule""",
        OBS_SQL,
    ),
)
def all_rules(spark: SparkSession, sf: str) -> DataFrame:
    return c.violations(observations(spark, sf), definitions(spark))


@query(
    "C10_chart_input",
    sql(
        """SELECT period, rule FROM (
        SELECT period, 'one unit' AS rule FROM obs GROUP BY period
        HAVING count(DISTINCT unit) > 1
        UNION ALL SELECT period, 'finite iff available' FROM obs GROUP BY period
        HAVING count(*) FILTER (WHERE (value IS NULL) <> (status = 'not_available')) > 0
        UNION ALL SELECT period, 'focus present' FROM obs GROUP BY period
        HAVING count(*) FILTER (WHERE geo_code = 'W' AND period <> '1995-1') = 0)""",
        OBS_SQL,
    ),
)
def chart_input(spark: SparkSession, sf: str) -> DataFrame:
    rows = observations(spark, sf)
    focus = F.when(F.col("period") == "1995-1", "other").otherwise(F.col("geo_code"))
    return c.chart_input_violations(rows.withColumn("geo_code", focus), ("period",), "W")
