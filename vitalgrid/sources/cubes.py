"""Statistical cubes (JSON-stat 2.0 documents) as long tables, many documents at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The parts of a document. ``value``, ``status`` and ``index`` come in several JSON forms, so
# they are read as text first and parsed by the form found.
DOCUMENT = """
  class STRING, label STRING, updated STRING, id ARRAY<STRING>, size ARRAY<INT>,
  dimension MAP<STRING, STRUCT<category: STRUCT<index: STRING, label: STRING>>>,
  value STRING, status STRING
"""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Cube files of a folder, one document a row: (doc_id, json)."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("json"))


def _codes(category: Column) -> Column:
    """Codes of a dimension in order of position: from an object code -> position, from a
    list, or, where there is no index, from the keys of the labels."""
    index = category["index"]
    placed = F.map_entries(F.from_json(index, "MAP<STRING, INT>"))
    by_place = F.array_sort(
        F.transform(placed, lambda e: F.struct(e["value"].alias("at"), e["key"].alias("code")))
    )
    return (
        F.when(index.startswith("{"), F.transform(by_place, lambda e: e["code"]))
        .when(index.startswith("["), F.from_json(index, "ARRAY<STRING>"))
        .otherwise(F.map_keys(F.from_json(category["label"], "MAP<STRING, STRING>")))
    )


def _product(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(1).cast("long"), lambda acc, n: acc * n)


def _parsed(docs: DataFrame) -> DataFrame:
    doc = docs.select("doc_id", F.from_json("json", DOCUMENT).alias("d")).select("doc_id", "d.*")
    return doc.withColumns(
        {
            "codes": F.transform("id", lambda d: _codes(F.col("dimension")[d]["category"])),
            "n": _product(F.col("size")),
        }
    )


def _entries(text: Column, field: str, other: str) -> Column:
    """A dense list or a sparse object as an array of (flat index, text)."""
    sparse = F.map_entries(F.from_json(text, "MAP<STRING, STRING>"))
    null = F.lit(None).cast("string").alias(other)

    def cell(flat: Column, value: Column) -> Column:
        pair = {field: value.cast("string").alias(field), other: null}
        return F.struct(flat.cast("long").alias("flat"), pair["value"], pair["flag"])

    empty = F.transform(F.array().cast("array<string>"), lambda x: cell(F.lit(0), x))
    listed = F.transform(F.from_json(text, "ARRAY<STRING>"), lambda v, i: cell(i, v))
    keyed = F.transform(sparse, lambda e: cell(e["key"].try_cast("long"), e["value"]))
    return F.when(text.startswith("["), listed).when(text.startswith("{"), keyed).otherwise(empty)


def _problem() -> Column:
    """What is wrong with a parsed document, or null."""

    def outside(text: str) -> Column:
        entries = _entries(F.col(text), "value", "flag")
        bad = F.exists(
            entries, lambda e: e["flat"].isNull() | (e["flat"] < 0) | (e["flat"] >= F.col("n"))
        )
        return F.col(text).startswith("{") & bad

    def length(text: str) -> Column:
        items = F.size(F.from_json(text, "ARRAY<STRING>"))
        return F.col(text).startswith("[") & ~items.eqNullSafe(F.col("n").cast("int"))

    counts = F.transform("codes", lambda c: F.size(c))
    true = F.lit(True)
    return (
        F.when(F.col("id").isNull() & F.col("class").isNull(), "not a document")
        .when(~F.col("class").eqNullSafe("dataset"), "not a dataset")
        .when(~counts.eqNullSafe(F.col("size")), "category counts do not match size")
        .when(F.coalesce(length("value"), true) | F.coalesce(length("status"), ~true), "list of another length")
        .when(F.coalesce(outside("value"), ~true) | F.coalesce(outside("status"), ~true), "cell outside the cube")
    )


BLOCK = 100_000  # cells of a document that one task lays out at once


def explode_cube(docs: DataFrame, dims: Sequence[str]) -> DataFrame:
    """One row per cell of each document: doc_id, updated, the named dimensions, value, flag.

    A document with a problem (see :func:`cube_violations`) is an error. A cell the document leaves
    out is a row without a value. The grid is laid out by blocks of cells, dealt over the cluster, and
    meets the values and flags in one aggregation on (document, flat index), so no row carries its
    document along. The last dimension varies fastest.
    """
    doc = _parsed(docs).withColumn("_problem", _problem())
    message = F.concat("doc_id", F.lit(": "), "_problem")
    n = F.when(F.col("_problem").isNull(), F.col("n")).otherwise(F.raise_error(message))
    blank = F.lit(None).cast("string")
    last = F.least(F.col("lo") + BLOCK, F.col("cells")) - 1
    grid = (
        doc.select("doc_id", n.cast("long").alias("cells"))
        .where("cells > 0")
        .select("doc_id", "cells", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1, F.lit(BLOCK).cast("long"))).alias("lo"))
        .repartition("doc_id", "lo")
        .select("doc_id", F.explode(F.sequence("lo", last)).alias("flat"), blank.alias("value"), blank.alias("flag"))
    )
    given = doc.select(
        "doc_id",
        F.inline(
            F.concat(
                _entries(F.col("value"), "value", "flag"), _entries(F.col("status"), "flag", "value")
            )
        ),
    )
    cells = (
        grid.unionByName(given)
        .groupBy("doc_id", "flat")
        .agg(F.max("value").try_cast("double").alias("value"), F.max("flag").alias("flag"))
    )
    sizes = F.col("size")
    strides = F.transform(
        F.sequence(F.lit(2), F.size(sizes) + 1),
        lambda i: _product(F.slice(sizes, i, F.size(sizes))),
    )
    layout = doc.select("doc_id", "updated", "id", "size", "codes", strides.alias("strides"))

    def code(dim: str) -> Column:
        at = F.array_position("id", dim).cast("int") - 1
        step, width = F.get(F.col("strides"), at), F.get(F.col("size"), at)
        place = F.floor(F.col("flat") / step) % width
        return F.get(F.get(F.col("codes"), at), place.cast("int"))

    return cells.join(layout, "doc_id").select(
        "doc_id", "updated", *[code(d).alias(d) for d in dims], "value", "flag"
    )


def cube_violations(docs: DataFrame) -> DataFrame:
    """Documents that cannot be read as cubes: no JSON document, of another class, categories that do
    not match the sizes, lists of another length than the cube, or cells outside of it."""
    found = _parsed(docs).select("doc_id", _problem().alias("problem"))
    return found.where("problem IS NOT NULL")


def cube_summary(docs: DataFrame) -> DataFrame:
    """Label, update stamp, size of each dimension, and number of values given."""
    doc = _parsed(docs)
    n_values = F.size(_entries(F.col("value"), "value", "flag"))
    return doc.select(
        "doc_id", "label", "updated", F.map_from_arrays("id", "size").alias("dimensions"),
        n_values.alias("n_values"),
    )


def select_slice(cube: DataFrame, chosen: Mapping[str, str]) -> DataFrame:
    """Each named dimension fixed at one code and dropped. Plain filters, so they reach the
    scan of a stored cube table."""
    out = cube
    for dim, code in chosen.items():
        out = out.where(F.col(dim) == code)
    return out.drop(*chosen)


def slice_violations(
    cube: DataFrame, *slices: tuple[Mapping[str, str], Sequence[str]]
) -> DataFrame:
    """Of each slice (chosen codes, further dimensions): chosen codes the cube does not have, and further
    dimensions left with several codes. All slices are checked in one pass over the cube."""
    aggs, problems = [], []
    for i, (chosen, extra) in enumerate(slices):
        inside = F.lit(True)
        for dim, code in chosen.items():
            inside = inside & (F.col(dim) == code)
            aggs.append(F.count_if(F.col(dim) == code).alias(f"_has{i}_{dim}"))
            problems.append(F.when(F.col(f"_has{i}_{dim}") == 0, F.lit(f"{code} is not a code of {dim}")))
        for dim in extra:
            here = F.when(inside, F.col(dim))
            aggs += [F.min(here).alias(f"_lo{i}_{dim}"), F.max(here).alias(f"_hi{i}_{dim}")]
            several = F.col(f"_lo{i}_{dim}") != F.col(f"_hi{i}_{dim}")
            problems.append(F.when(several, F.lit(f"select a single {dim}")))
    return cube.agg(*aggs).select(F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def prefix_filter(df: DataFrame, prefix: str, column: str = "geo") -> DataFrame:
    """Rows whose code starts with a prefix, before anything is decoded; it pushes down."""
    return df.where(F.col(column).startswith(prefix))
