"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"


def saved(df: DataFrame) -> DataFrame:
    """The rows of `df`, written to the shared folder once and read from there.

    Cuts the lineage: a lost executor costs a read, and several uses cost one computation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/vitalgrid-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, nulls included: rows that are equal in all columns share it."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def lowest(df: DataFrame, by: str, key: Column, size: int) -> DataFrame:
    """A sample of at most `size` rows of each value of `by`: those whose hash `key` is lowest.

    The number of rows of a value sets a bound on the hash under which four times `size` are expected;
    only these meet in the window, however many rows the value has.
    """
    span = 1 << 31
    place = F.pmod(key, F.lit(span))
    # written first: its size is then known, and the rows need no shuffle to meet it
    counts = saved(df.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n")))
    bound = F.least(F.lit(1.0), F.lit(4.0 * size) / F.col("__n")) * span
    few = df.join(counts, F.col(by) == F.col("__by")).where(place < bound)
    order = Window.partitionBy(by).orderBy(place, key, *[c for c in df.columns if c != by])
    few = few.withColumn("__nr", F.row_number().over(order)).where(F.col("__nr") <= size)
    return few.select(*df.columns)


def ordered(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """Adds `row` (1, 2, ... in the given total order) and inclusive running sums of `sums`.

    Rows are dealt by range and numbered inside each range; only one row per range meets in one
    task, to give each range its offset. The ranges are written first, since range bounds come from
    a sample and must not change between the two uses.
    """
    sums = sums or {}
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    totals = {f"_s{i}": c for i, c in enumerate(sums.values())}
    own = df.columns
    dealt = df.withColumns(keys | totals)
    count = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionByRange(count, *keys).withColumn("_part", F.spark_partition_id())
    dealt = saved(dealt)
    parts = dealt.groupBy("_part").agg(
        F.count("*").alias("_n"), *[F.sum(t).alias(f"_t{t}") for t in totals]
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        *[F.coalesce(F.sum(f"_t{t}").over(before), F.lit(0)).alias(f"_t{t}") for t in totals],
    )
    inside = Window.partitionBy("_part").orderBy(*keys)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(parts), "_part").select(
        *own,
        (F.col("_n") + F.row_number().over(inside)).alias("row"),
        *[
            (F.col(f"_t{t}") + F.sum(t).over(running)).alias(name)
            for t, name in zip(totals, sums)
        ],
    )
