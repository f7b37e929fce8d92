"""Data products: writing, manifests, and what may be published."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vitalgrid.operators.contract import (
    ContractError,
    key_rules_of_row,
    row_rules,
    schema_violations,
    with_known,
)
from vitalgrid.schema import COLUMNS, KEY


def key_range() -> Column:
    """The range of keys that a row is stored in: its definition and the first two characters of its area.
    It depends on the row alone, not on a sample of all, so two builds deal their rows alike."""
    return F.concat_ws("/", "definition_id", F.substring("geo_code", 1, 2))


def checked_write(
    obs: DataFrame, definitions: DataFrame, path: str, partitions: int = 16, range_of: Column | None = None
) -> dict[str, int]:
    """Write in key order as Parquet and return every broken rule with its number of rows.

    One pass: rows are dealt by ranges of keys, the rules on keys are windows inside the ranges, all rules
    are counted while the files are written. A task that is run again can only count a broken row twice.
    """
    rules = row_rules() | key_rules_of_row(("_range",))
    dealt = with_known(obs.select(*COLUMNS), definitions).withColumn("_range", key_range() if range_of is None else range_of)
    dealt = dealt.repartition(partitions, "_range")
    broken = {f"_rule{i}": ~F.coalesce(ok, F.lit(False)) for i, ok in enumerate(rules.values())}
    counts = Observation()
    rows = dealt.withColumns(broken).observe(counts, *[F.count_if(c).alias(c) for c in broken])
    # rows of one key may still differ if the key rule is broken; otherwise the order is total
    order = [F.col(k).asc_nulls_last() for k in (*KEY, *[c for c in COLUMNS if c not in KEY])]
    rows.select(*COLUMNS).sortWithinPartitions(*order).write.parquet(path)
    found = counts.get
    return {name: found[c] for name, c in zip(rules, broken) if found[c]}


def write_product(obs: DataFrame, definitions: DataFrame, path: str, partitions: int = 16) -> None:
    """Validate, order by key (nulls last) and write as Parquet and CSV; publish all or nothing.

    The input is computed once: its rules are counted while it is written to a staging folder, which takes
    its name only if none is broken, and is deleted otherwise. Each file holds whole ranges of keys in
    order, so Parquet statistics prune it. The CSV is made from the Parquet files."""
    problems = schema_violations(obs.select(*COLUMNS))
    if problems:
        raise ContractError("; ".join(problems))
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    session = obs.sparkSession
    try:
        broken = checked_write(obs, definitions, f"{staged}/parquet", partitions)
        if broken:
            raise ContractError("; ".join(f"{rule}: {n} rows" for rule, n in sorted(broken.items())))
        stored = session.read.schema(obs.select(*COLUMNS).schema).parquet(f"{staged}/parquet")
        stamp = F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        csv = stored.withColumn("retrieved_at", stamp)
        csv.write.csv(f"{staged}/csv", header=True, nullValue="", emptyValue='""')
        _move(session, staged, path)
    finally:
        _remove(session, staged)


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    """Path and file system of a path, on whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _move(spark: SparkSession, source: str, target: str) -> None:
    (old, files), (new, _) = _files(spark, source), _files(spark, target)
    if files.exists(new):
        raise FileExistsError(target)
    if not files.rename(old, new):
        raise OSError(f"cannot publish {target}")


def _remove(spark: SparkSession, path: str) -> None:
    place, files = _files(spark, path)
    files.delete(place, True)


def manifest(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows and content digest of every product in one table (``by`` names the product).

    The digest does not depend on row order or partitioning: an xor and a sum of row hashes,
    combined map-side, so a product with most of the rows costs no more than its scan."""
    row = F.xxhash64(*columns)
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.bit_xor(row).alias("digest"),
        F.sum(row.cast("decimal(20,0)")).alias("checksum"),
    )


def changed_products(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """Products added, removed, changed or unchanged between two manifests; an unchanged one
    need not be built again."""
    a = old.select(*by, F.struct("rows", "digest", "checksum").alias("_old"))
    b = new.select(*by, F.struct("rows", "digest", "checksum").alias("_new"))
    state = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") == F.col("_new"), "unchanged")
        .otherwise("changed")
    )
    joined = a.join(b, list(by), "full")
    return joined.select(*by, state.alias("state"), F.col("_new.rows").alias("rows"))


def licence_filter(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Products (rows of product, source_id) all of whose sources allow commercial reuse; a
    source without a verified licence does not."""
    reuse = registry.select("source_id", "commercial_reuse")
    return (
        entries.select("product", "source_id")
        .join(reuse, "source_id", "left")
        .groupBy("product")
        .agg(F.bool_and(F.coalesce("commercial_reuse", F.lit(False))).alias("_open"))
        .where("_open")
        .select("product")
    )


def sources_used(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows used by the products that :func:`licence_filter` keeps, with their credit line filled in.

    One pass over the entries: a product's sources, at most the registry's, are gathered in the
    aggregation that decides whether it is kept."""
    reuse = registry.select("source_id", "commercial_reuse")
    used = (
        entries.select("product", "source_id")
        .join(reuse, "source_id", "left")
        .groupBy("product")
        .agg(
            F.bool_and(F.coalesce("commercial_reuse", F.lit(False))).alias("_open"),
            F.collect_set("source_id").alias("_sources"),
        )
        .where("_open")
        .select(F.explode("_sources").alias("source_id"))
        .distinct()
    )
    credit = F.replace("attribution", F.lit("{dataset_code}"), F.col("dataset_code"))
    return registry.join(used, "source_id", "left_semi").withColumn("credit", credit)


def snapshots_used(entries: DataFrame) -> DataFrame:
    """Digests of every file read, each once, in order."""
    return entries.select("sha256").distinct().orderBy("sha256")
