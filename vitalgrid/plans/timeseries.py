"""Queries F12-F16: excess, nowcast, projection deviation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalgrid.operators import timeseries as ts
from vitalgrid.plans.gates import totals
from vitalgrid.plans.registry import query
from vitalgrid.plans.structure import r6
from vitalgrid.plans.views import AREA, ancestors, geo_of_area, order_area, sql

ORD_SQL = """
ord AS (
  SELECT unnest([g[:1], g[:2], g]) AS geo_code, d FROM (
  SELECT 'W' || n_regionkey || chr(65 + n_nationkey) AS g, CAST(o_orderdate AS DATE) AS d
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))
"""


def weekly_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per area and ISO week as an observed series."""
    week = F.concat(
        F.extract(F.lit("yearofweek"), "o_orderdate").cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0"),
    )
    orders = order_area(spark, sf, week.alias("period"))
    return (
        orders.groupBy(*AREA, "period")
        .agg(F.count("*").alias("n"))
        .withColumn("geo_code", F.explode(ancestors(geo_of_area())))
        .groupBy("geo_code", "period")
        .agg(F.sum("n").cast("double").alias("value"))
    )


@query(
    "F12_excess_over_baseline",
    sql(
        """SELECT m.geo_code, strftime(m.mon, '%Y-%m') AS period,
        round(100 * (m.v - b.v) / b.v, 6) AS value FROM mon m
        JOIN (SELECT geo_code, month(mon) AS mm, avg(v) AS v FROM mon
              WHERE year(mon) BETWEEN 1996 AND 1999 GROUP BY ALL HAVING count(*) = 4) b
        ON m.geo_code = b.geo_code AND month(m.mon) = b.mm WHERE year(m.mon) > 1999""",
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
def excess(spark: SparkSession, sf: str) -> DataFrame:
    months = ts.weeks_to_months(weekly_orders(spark, sf), ("geo_code",))
    out = ts.excess_over_baseline(months, ("geo_code",), 1996, 1999)
    return out.select("geo_code", "period", r6("value"))


def monthly_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per area, year and month; the published total of all years but the latest, one too
    high in W3 1997; one of unknown month in W4 1998."""
    geo, y, m = F.col("geo_code"), F.col("y"), F.col("m")
    code = F.concat(F.lit("M"), F.lpad(m.cast("string"), 2, "0"))
    n = F.col("n").cast("double")
    extra = F.when((geo == "W3") & (y == 1997) & (m == 1), 1.0).otherwise(0.0)

    def row(month: Column, value: Column) -> Column:
        return F.struct(month.alias("month"), value.alias("value"))

    rows = F.array_compact(
        F.array(
            row(code, n),
            F.when(y < F.col("latest"), row(F.lit("TOTAL"), n + extra)),
            F.when((geo == "W4") & (y == 1998) & (m == 1), row(F.lit("UNK"), F.lit(1.0))),
        )
    )
    by_month = (
        order_area(
            spark, sf, F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")
        )
        .groupBy(*AREA, "y", "m")
        .agg(F.count("*").alias("n"))
        .withColumn("geo_code", F.explode(ancestors(geo_of_area())))
        .groupBy("geo_code", "y", "m")
        .agg(F.sum("n").alias("n"))
    )
    return (
        by_month.withColumn("latest", F.max("y").over(Window.partitionBy("geo_code")))
        .select("geo_code", "y", F.inline(rows))
        .groupBy("geo_code", "y", "month")
        .agg(F.sum("value").alias("value"))
    )


MONTH_SQL = """
mm AS (SELECT geo_code, CAST(year(d) AS INT) AS y, CAST(month(d) AS INT) AS k, count(*) AS n
  FROM ord GROUP BY ALL),
ct AS (SELECT geo_code, y, sum(n) + CASE WHEN geo_code = 'W3' AND y = 1997 THEN 1 ELSE 0 END
  AS total FROM (SELECT *, max(y) OVER (PARTITION BY geo_code) AS latest FROM mm)
  WHERE y < latest GROUP BY geo_code, y),
cu AS (SELECT m.geo_code, m.y, m.k, m.cum, ct.total, coalesce(m.whole = ct.total, false)
    AND NOT (m.geo_code = 'W4' AND m.y = 1998) AS clean
  FROM (SELECT *, max(CASE WHEN k = 12 AND rn = 12 THEN cum END) OVER (PARTITION BY geo_code, y)
      AS whole FROM (
    SELECT *, sum(n) OVER w AS cum, row_number() OVER w AS rn FROM mm
    WINDOW w AS (PARTITION BY geo_code, y ORDER BY k ROWS UNBOUNDED PRECEDING))) m
  LEFT JOIN ct USING (geo_code, y) WHERE m.rn = m.k),
bt AS (SELECT c.geo_code, c.y, c.k, p.total * c.cum / p.cum / c.total - 1 AS error
  FROM cu c JOIN cu p ON p.geo_code = c.geo_code AND p.k = c.k AND c.y = p.y + 1
  WHERE c.clean AND p.clean AND c.k <= 11)
"""


@query(
    "F13_cumulative_months",
    sql(
        """SELECT geo_code, y, k, CAST(cum AS DOUBLE) AS cum, CAST(total AS DOUBLE) AS total,
        clean FROM cu""",
        ORD_SQL,
        MONTH_SQL,
    ),
)
def cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return ts.cumulative_months(monthly_orders(spark, sf))


@query(
    "F14_nowcast_backtest",
    sql("SELECT geo_code, y, k, round(error, 9) AS error FROM bt", ORD_SQL, MONTH_SQL),
)
def backtest(spark: SparkSession, sf: str) -> DataFrame:
    out = ts.nowcast_backtest(ts.cumulative_months(monthly_orders(spark, sf)))
    return out.select("geo_code", "y", "k", F.round("error", 9).alias("error"))


@query(
    "F15_nowcast",
    sql(
        """SELECT e.geo_code, e.y, e.k, i AS interval, round(central * (1 + sign
          * CASE WHEN lv = 80 THEN q80 ELSE q95 END), 6) AS value FROM (
        SELECT c.geo_code, c.y, c.k, p.total * c.cum / p.cum AS central FROM cu c
        JOIN cu p ON p.geo_code = c.geo_code AND p.k = c.k AND c.y = p.y + 1
        WHERE c.total IS NULL AND p.clean
        QUALIFY c.k = max(c.k) OVER (PARTITION BY c.geo_code)) e
        JOIN (SELECT geo_code, k, quantile_cont(abs(error), 0.8) AS q80,
                quantile_cont(abs(error), 0.95) AS q95 FROM bt GROUP BY ALL
              HAVING count(*) >= 3) s USING (geo_code, k),
        (SELECT unnest([NULL, '80_lower', '80_upper', '95_lower', '95_upper']) AS i,
           unnest([0, -1, 1, -1, 1]) AS sign, unnest([80, 80, 80, 95, 95]) AS lv)""",
        ORD_SQL,
        MONTH_SQL,
    ),
)
def nowcast(spark: SparkSession, sf: str) -> DataFrame:
    out = ts.nowcast(ts.cumulative_months(monthly_orders(spark, sf)), min_years=3)
    return out.select("geo_code", "y", "k", "interval", r6("value"))


@query(
    "F15_nowcast_violations",
    sql(
        """SELECT e.geo_code, e.y, e.k, CASE WHEN NOT e.pclean THEN 'previous year not clean'
          ELSE 'too few past years' END AS problem FROM (
        SELECT c.geo_code, c.y, c.k, p.clean AND c.geo_code <> 'W2' AS pclean FROM cu c
        JOIN cu p ON p.geo_code = c.geo_code AND p.k = c.k AND c.y = p.y + 1
        WHERE c.total IS NULL AND c.k <= 11
        QUALIFY c.k = max(c.k) OVER (PARTITION BY c.geo_code)) e
        LEFT JOIN (SELECT geo_code, k, count(*) AS n FROM bt
          WHERE NOT (geo_code = 'W2' AND y IN (2000, 2001)) GROUP BY ALL) s USING (geo_code, k)
        WHERE NOT e.pclean OR coalesce(n, 0) < 4""",
        ORD_SQL,
        MONTH_SQL,
    ),
)
def nowcast_violations(spark: SparkSession, sf: str) -> DataFrame:
    """One order of unknown month in W2 2000 spoils the year that W2 2001 is estimated from."""
    months = monthly_orders(spark, sf)
    row = F.struct(F.lit("UNK").alias("month"), F.lit(1.0).alias("value"))
    here = F.struct("month", "value")
    spoilt = (F.col("geo_code") == "W2") & (F.col("y") == 2000) & (F.col("month") == "TOTAL")
    rows = F.when(spoilt, F.array(here, row)).otherwise(F.array(here))
    months = months.select("geo_code", "y", F.inline(rows))
    return ts.nowcast_violations(ts.cumulative_months(months), min_years=4)


PROJECTED_FROM = (1995, 1998)  # the series breaks in 1998


@query(
    "F16_projection_deviation",
    sql(
        """SELECT source_id, geo_code, period, definition_id, round(value, 6) AS value,
        provisional, break_in_series FROM (
        SELECT s.source_id, s.geo_code, s.period, 'projection_deviation_level@v1'
          AS definition_id, 100 * (s.p - s.o) / s.o AS value, s.provisional, s.break_in_series FROM pr s
        UNION ALL SELECT s.source_id, s.geo_code, s.period, 'projection_deviation_change@v1',
          100 * ((s.p - b.p) - (s.o - b.o)) / b.o, s.provisional OR b.provisional,
          s.break_in_series OR b.break_in_series
        FROM pr s JOIN pr b ON b.source_id = s.source_id AND b.geo_code = s.geo_code
          AND b.y = b.base WHERE s.y > s.base)""",
        """pr AS (SELECT k.id AS source_id, k.base, geo_code, period, y, value AS o, status = 'provisional' AS provisional,
          break_in_series, value * (1 + 0.01 * (y - k.base)) AS p
          FROM pop, (SELECT unnest(['P1995', 'P1998']) AS id, unnest([1995, 1998]) AS base) k
          WHERE age = 'total' AND sex = 'total' AND y >= k.base)""",
    ),
)
def deviation(spark: SparkSession, sf: str) -> DataFrame:
    """Two projections, each growing one percent a year against the observed population."""
    provisional = (F.col("status") == "provisional").alias("provisional")
    observed = totals(spark, sf).select("geo_code", "period", "value", provisional, "break_in_series")
    vintages = F.array(
        *[
            F.struct(F.lit(f"P{base}").alias("source_id"), F.lit(base).alias("base"))
            for base in PROJECTED_FROM
        ]
    )
    y = F.col("period").cast("int")
    projected = (
        observed.select("*", F.inline(vintages))
        .where(y >= F.col("base"))
        .withColumn("value", F.col("value") * (1 + 0.01 * (y - F.col("base"))))
        .drop("base")
    )
    out = ts.projection_deviation(projected, observed)
    return out.select(
        "source_id", "geo_code", "period", "definition_id", r6("value"), "provisional", "break_in_series"
    )
