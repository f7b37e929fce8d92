"""Downloads and their append-only ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions.frames import lag_in_ranges

LEDGER = ("source_id", "sha256", "retrieved_at")


def scan_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Raw files of a folder whose names are digests: name, content, digest and size."""
    files = spark.read.format("binaryFile").load(path)
    return with_digest(files.select(F.col("_metadata.file_name").alias("name"), "content"))


def with_digest(files: DataFrame) -> DataFrame:
    """Adds digest and size to stored files (name, binary content)."""
    size = F.octet_length("content").cast("long")
    return files.select("name", "content", F.sha2("content", 256).alias("sha256"), size.alias("size"))


def corrupt_snapshots(files: DataFrame) -> DataFrame:
    """Files whose content no longer matches the digest they are named by."""
    return files.where(F.col("name") != F.col("sha256")).select("name", "sha256", "size")


def _by(*order: str) -> Column:
    return F.struct(*order)


def ledger_append(
    ledger: DataFrame, downloads: DataFrame, order: tuple[str, ...] = ("retrieved_at",)
) -> DataFrame:
    """The downloads to append: those whose digest differs from the version before them of
    the same source, in the ledger or among the downloads. A digest that comes back after
    another one is appended again.

    The ledger enters as its latest row per source (an aggregate, not a window). The downloads
    are compared in ranges of source and time, so neither a source nor an hour with most of all
    downloads is one task.
    """
    latest = F.max_by(F.struct("sha256", *order), _by(*order)).alias("_r")
    heads = ledger.groupBy("source_id").agg(latest).select("source_id", "_r.*")
    rows = heads.withColumn("_new", F.lit(False)).unionByName(
        downloads.select("source_id", "sha256", *order).withColumn("_new", F.lit(True))
    )
    lagged = lag_in_ranges(rows, ("source_id",), order, "sha256")
    return lagged.where(
        F.col("_new") & ~F.col("sha256").eqNullSafe(F.col("previous"))
    ).drop("_new", "previous")


def latest_snapshot(
    ledger: DataFrame, pins: DataFrame | None = None, order: tuple[str, ...] = ("retrieved_at",)
) -> DataFrame:
    """The last version of each source, optionally only among pinned digests."""
    rows = ledger if pins is None else ledger.join(pins.select("sha256"), "sha256", "left_semi")
    latest = F.max_by(F.struct("sha256", *order), _by(*order)).alias("_r")
    return rows.groupBy("source_id").agg(latest).select("source_id", "_r.*")


def missing_sources(required: DataFrame, latest: DataFrame) -> DataFrame:
    """Required sources without a version."""
    return required.select("source_id").join(latest, "source_id", "left_anti")


def snapshot_history(
    ledger: DataFrame, order: tuple[str, ...] = ("retrieved_at",)
) -> DataFrame:
    """Every version with the digest before it; ``revised`` where the content changed."""
    out = lag_in_ranges(ledger, ("source_id",), order, "sha256")
    revised = F.col("previous").isNotNull() & (F.col("previous") != F.col("sha256"))
    return out.withColumn("revised", revised)
