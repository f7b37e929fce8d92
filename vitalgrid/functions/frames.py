"""Small DataFrame helpers: constant tables, calendar-year neighbours, shared scratch space."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def values_frame(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A constant table written in code. Catalyst knows the size of a VALUES relation, so it
    broadcasts the table in joins without a hint."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def year(period: Column | str = "period") -> Column:
    """Calendar year of an annual period; null for other grains."""
    c = F.col(period) if isinstance(period, str) else period
    return c.try_cast("int")


def year_shift(value: Column, keys: Sequence[str], years: int, by: Column | None = None) -> Column:
    """``value`` of the same keys ``years`` calendar years away; null where that year is absent.

    A RANGE frame of exactly one value matches the year itself, so a gap in the series never
    pairs neighbours that are two years apart, and one sort replaces a self-join. The keys
    must leave one row per year.
    """
    order = by if by is not None else year()
    frame = Window.partitionBy(*keys).orderBy(order).rangeBetween(years, years)
    return F.first(value).over(frame)


def lag_in_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "previous"
) -> DataFrame:
    """``lag(value)`` over ``keys`` in ``order`` (which must leave no ties), without putting a hot key,
    or a hot stretch of its order, in one task.

    Rows are dealt by ranges of (keys, order), so a key with most of the rows is many ranges. They
    are lagged inside a range; the first row of a key in a range takes the key's last value of the
    ranges before, from an aggregate with one row per key and range. The ranges come from a sample, so
    they are written before they are used twice.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id())
    rows = written(dealt, "ranges")
    last = F.max_by(F.struct(value), F.struct(*order)).alias("_last")
    ends = rows.groupBy(*keys, "_range").agg(last)
    carried = ends.withColumn(
        "_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range"))
    ).drop("_last")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        rows.withColumn("_near", F.lag(F.struct(value)).over(inside))
        .join(carried, [*keys, "_range"])
        .withColumn(out, F.coalesce("_near", "_carry")[value])
        .drop("_range", "_near", "_carry")
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names in ``spark.checkpoint.dir``, or in
    the warehouse, which executors share as well."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: its lineage is cut, it
    survives lost executors, and Catalyst sees its real size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
