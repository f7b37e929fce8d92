"""Adapter views: the driver's star schema read as demographic tables.

The large work of every query is here: lineitem joined with part and with the orders' area
and year, reduced by one aggregation to cells of (area, year, sex, age). There are at most
nations x years x 2 x 50 cells whatever the input size, so what follows is small.

Spark broadcasts a side below its own size threshold; beyond it these are sort-merge joins, whose skewed partitions (an order or a part with a third of all lines) AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.functions.frames import written

FIRST_YEAR, LAST_YEAR = 1995, 2001
LAST_AGE = 49  # ages 0-48 and the open class 49+
PROVENANCE = {
    "metric": "population",
    "definition_id": "population_1jan@v1",
    "geo_vintage": "GRID1",
    "unit": "persons",
    "source": "Office",
    "dataset_code": "pop_cells",
    "source_url": "https://example.org/pop_cells",
    "vintage": "2026-01-02",
    "transform_version": "cells@0.1",
    "nature": "official_estimate",
}


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table. Its schema is read from the files once, so that later queries start
    without a job over the footers."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


AREA = ("n_regionkey", "n_nationkey")


def geo_of_area() -> Column:
    """Code of a nation: W, the region key, a letter. Built after rows are grouped by the two
    integer keys (``AREA``), so that no string is made or hashed per line."""
    region, nation = F.col("n_regionkey"), F.col("n_nationkey")
    return F.concat(F.lit("W"), region.cast("string"), F.chr(nation + 65))


def customer_area(spark: SparkSession, sf: str) -> DataFrame:
    """Customer key with the keys of its nation and region."""
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"))
    nation = table(spark, sf, "nation").select(*AREA).join(region, "n_regionkey")
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")
    )
    return customer.join(nation, "n_nationkey")


def order_area(spark: SparkSession, sf: str, *columns: Column) -> DataFrame:
    """The given columns of orders with the area of their customer. Joined to lineitem as a
    whole, so that a large customer table meets orders and not lineitem."""
    orders = table(spark, sf, "orders")
    return orders.join(customer_area(spark, sf), "o_custkey").select(*AREA, *columns)


def years(spark: SparkSession, sf: str) -> list[int]:
    """The calendar years of the orders, first to last; one row a year reaches the driver."""
    y = F.year("o_orderdate").alias("y")
    found = [r.y for r in table(spark, sf, "orders").select(y).distinct().collect() if r.y]
    return list(range(min(found), max(found) + 1)) if found else []


def base(spark: SparkSession, sf: str) -> DataFrame:
    """One row per lineitem: area, year, whether female, age index, return flag, quantity."""
    key, year = F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("y")
    orders = order_area(spark, sf, key, year)
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), (F.col("p_size") - 1).alias("a")
    )
    return (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_partkey", "l_linestatus", "l_returnflag", "l_quantity")
        .join(part, "l_partkey")
        .join(orders, "l_orderkey")
        .select(
            *AREA,
            "y",
            (F.col("l_linestatus") == "F").alias("female"),
            "a",
            F.col("l_returnflag").alias("rf"),
            F.col("l_quantity").alias("q"),
        )
    )


def ancestors(code: Column | str = "geo_code") -> Column:
    """The area and the areas above it: a code without its last character is the parent."""
    c = F.col(code) if isinstance(code, str) else code
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n))


_SHARED: ContextVar[dict[str, DataFrame]] = ContextVar("shared cells", default={})


@contextmanager
def shared_cells(spark: SparkSession, sf: str) -> Iterator[None]:
    """Inside, all plans over this folder's cells read them from one written table, so that several plans
    in one query scan lineitem once."""
    token = _SHARED.set({sf: written(nation_cells(spark, sf), "nation-cells")})
    try:
        yield
    finally:
        _SHARED.reset(token)


def nation_cells(spark: SparkSession, sf: str) -> DataFrame:
    if sf in _SHARED.get():
        return _SHARED.get()[sf]
    rf, q = F.col("rf"), F.col("q")
    return (
        base(spark, sf)
        .groupBy(*AREA, "y", "female", "a")
        .agg(
            F.sum(F.when(rf != "R", q)).alias("q_known"),
            F.sum(F.when(rf == "R", q)).alias("q_unknown"),
            F.count("*").alias("n_all"),
            F.count_if(rf == "R").alias("n_r"),
            F.count_if(rf == "N").alias("n_n"),
        )
        .withColumns(
            {
                "geo_code": geo_of_area(),
                "sex": F.when(F.col("female"), "female").otherwise("male"),
            }
        )
        .drop(*AREA, "female")
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cells at the three levels of the hierarchy: W, W{region}, W{region}{nation}."""
    up = nation_cells(spark, sf).withColumn("geo_code", F.explode(ancestors()))
    return (
        up.groupBy("geo_code", "y", "sex", "a")
        .agg(*[F.sum(c).alias(c) for c in ("q_known", "q_unknown", "n_all", "n_r", "n_n")])
        .withColumn("period", F.col("y").cast("string"))
    )


def cells_table(spark: SparkSession, sf: str) -> DataFrame:
    """The cells written once, for queries that read them in several ways: their filters and
    columns differ, so Spark could not share the exchange and would scan lineitem each time."""
    return written(cells(spark, sf), "cells")


def age_label(a: Column | str = "a") -> Column:
    c = F.col(a) if isinstance(a, str) else a
    return F.concat(c.cast("string"), F.when(c == LAST_AGE, "+").otherwise(""))


def status_of(y: Column) -> Column:
    return F.when(y == LAST_YEAR, "provisional").otherwise("final")


def with_provenance(df: DataFrame, **over: object) -> DataFrame:
    """Constant contract columns the rows lack."""
    constants = {k: F.lit(v) for k, v in {**PROVENANCE, **over}.items()}
    constants |= {
        "retrieved_at": F.lit("2026-01-03 04:05:06").cast("timestamp"),
        "scenario_id": F.lit(None).cast("string"),
        "interval": F.lit(None).cast("string"),
    }
    return df.withColumns({k: v for k, v in constants.items() if k not in df.columns})


def population(spark: SparkSession, sf: str) -> DataFrame:
    """Population on 1 January as observations: single ages, 49+, unknown and total age, by
    sex and for both, at every level."""
    parts = F.array(
        F.struct(age_label().alias("age"), F.col("q_known").alias("value")),
        F.struct(F.lit("unknown").alias("age"), F.col("q_unknown").alias("value")),
        F.struct(F.lit("total").alias("age"), F.col("q_known").alias("value")),
        F.struct(F.lit("total").alias("age"), F.col("q_unknown").alias("value")),
    )
    rows = (
        nation_cells(spark, sf)
        .select("geo_code", "y", F.array("sex", F.lit("total")).alias("sex"), F.inline(parts))
        .where(F.col("value").isNotNull())
        .withColumn("geo_code", F.explode(ancestors()))
        .withColumn("sex", F.explode("sex"))
        .groupBy("geo_code", "y", "sex", "age")
        .agg(F.sum("value").alias("value"))
    )
    return with_provenance(
        rows.select(
            "geo_code",
            F.col("y").cast("string").alias("period"),
            "sex",
            "age",
            "value",
            status_of(F.col("y")).alias("status"),
            (F.col("y") == 1998).alias("break_in_series"),
        )
    )


def death_rates(spark: SparkSession, sf: str) -> DataFrame:
    return death_rates_of(cells(spark, sf))


def death_rates_of(cells: DataFrame) -> DataFrame:
    """Death rates by area, year, sex and age index, only where every age is present."""
    m = 0.0009 * F.exp(0.14 * F.col("a")) * (F.col("n_r") + 0.5) / (F.col("n_all") + 1)
    rates = cells.select("geo_code", "period", "sex", F.col("a").alias("x"), m.alias("m"))
    return complete_ages(rates, ("geo_code", "period", "sex"), LAST_AGE + 1)


def complete_ages(df: DataFrame, group: tuple[str, ...], n: int) -> DataFrame:
    """Groups whose x runs over n ages. One window over at most n rows each."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group)
    return df.withColumn("_n", F.count("x").over(w)).where(F.col("_n") == n).drop("_n")


def fertility_rates(spark: SparkSession, sf: str) -> DataFrame:
    return fertility_rates_of(cells(spark, sf))


def fertility_rates_of(cells: DataFrame) -> DataFrame:
    """Fertility rate by area, year and age 15-44, both sexes' lines together."""
    return (
        cells.where(F.col("a").between(15, 44))
        .groupBy("geo_code", "period", F.col("a").alias("x"))
        .agg((0.05 * F.sum("n_n") / (F.sum("n_all") + 1)).alias("f"))
    )


# The same views for the SQL counterparts.
SQL = """
base AS (
  SELECT 'W' || n.n_regionkey || chr(65 + n.n_nationkey) AS geo, CAST(year(o.o_orderdate) AS INT) AS y,
         CASE WHEN l.l_linestatus = 'F' THEN 'female' ELSE 'male' END AS sex,
         p.p_size - 1 AS a, l.l_returnflag AS rf, l.l_quantity AS q
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey),
up AS (SELECT unnest([geo[:1], geo[:2], geo]) AS geo_code, * FROM base),
cells AS (
  SELECT geo_code, y, CAST(y AS VARCHAR) AS period, sex, a,
         sum(q) FILTER (WHERE rf <> 'R') AS q_known, sum(q) FILTER (WHERE rf = 'R') AS q_unknown,
         count(*) AS n_all, count(*) FILTER (WHERE rf = 'R') AS n_r,
         count(*) FILTER (WHERE rf = 'N') AS n_n
  FROM up GROUP BY ALL),
pop0 AS (
  SELECT geo_code, y, sex, CASE WHEN a = 49 THEN '49+' ELSE CAST(a AS VARCHAR) END AS age,
         q_known AS value FROM cells WHERE q_known IS NOT NULL
  UNION ALL SELECT geo_code, y, sex, 'unknown', q_unknown FROM cells WHERE q_unknown IS NOT NULL
  UNION ALL SELECT geo_code, y, sex, 'total', coalesce(q_known, 0) + coalesce(q_unknown, 0)
  FROM cells),
pop AS (
  SELECT geo_code, y, CAST(y AS VARCHAR) AS period, s AS sex, age, sum(value) AS value,
         CASE WHEN y = 2001 THEN 'provisional' ELSE 'final' END AS status,
         y = 1998 AS break_in_series
  FROM (SELECT *, unnest([sex, 'total']) AS s FROM pop0) GROUP BY geo_code, y, s, age),
rates AS (
  SELECT geo_code, y, period, sex, a AS x, m FROM (
    SELECT *, 0.0009 * exp(0.14 * a) * (n_r + 0.5) / (n_all + 1) AS m,
           count(*) OVER (PARTITION BY geo_code, y, sex) AS n FROM cells) WHERE n = 50),
fert AS (
  SELECT geo_code, y, period, a AS x, 0.05 * sum(n_n) / (sum(n_all) + 1) AS f
  FROM cells WHERE a BETWEEN 15 AND 44 GROUP BY ALL)
"""


def sql(body: str, *ctes: str) -> str:
    """``body`` with the shared views and the given further CTEs in front of it."""
    return "WITH " + ",\n".join([SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()
