"""Contamination of documents by benchmark items: exact windows found by a prefix-filtered set join.

An item's windows are its runs of WINDOW consecutive words (the whole item if it has fewer). A window
is a set of placed SHINGLE-word shingles; a document that contains the window contains all of them, so
at full containment the necessary prefix of a window is one shingle: its rarest, by counts over all
documents. Only those shingles are joined. A shingle's place in the window and in the document gives
the place of the whole window (positional bound), which must lie inside the document (length bound) and is
compared word by word.

Documents are read twice, once to count the shingles that items have and once to find the prefix
shingles. Both filter by a bitmap of fixed size, whatever the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.common import row_hash, saved
from vitalgrid.llm.text import ALNUM, Words, chunks, mixed

WINDOW, SHINGLE = 13, 5  # words
BITMAP_BITS = 26  # 2**26 bits, 8 MB, are broadcast


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of `size` word hashes."""
    n = max(0, len(words) - size + 1)
    found = np.full(n, size, np.uint64)
    for i in range(size):
        found = found * np.uint64(0x100000001B3) + words[i : i + n]
    return mixed(found)


def item_windows(items: DataFrame) -> DataFrame:
    """(item, window, size, shingles) of every window of every item; shingles: (hash, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"), ALNUM)
                hashes, data = words.hashes(), words.data.tobytes()
                rows: list[dict] = []
                names = part.column("item").to_pylist()
                for name, first, count in zip(names, words.first.tolist(), words.counts.tolist()):
                    size = min(count, WINDOW)
                    width = min(size, SHINGLE)
                    if not size:
                        continue
                    own = shingle_hashes(hashes[first : first + count], width).view(np.int64).tolist()
                    spans = zip(words.starts[first:].tolist(), words.ends[first : first + count].tolist())
                    text = [data[s:e].decode() for s, e in spans]
                    for at in range(count - size + 1):
                        tokens = [{"hash": own[at + i], "place": i} for i in range(size - width + 1)]
                        window = " ".join(text[at : at + size])
                        rows.append({"item": name, "window": window, "size": size, "shingles": tokens})
                yield pa.RecordBatch.from_pylist(rows, schema)

    kind = items.schema["item_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    token = pa.struct([("hash", pa.int64()), ("place", pa.int32())])
    schema = pa.schema(
        [("item", arrow), ("window", pa.string()), ("size", pa.int32()), ("shingles", pa.list_(token))]
    )
    narrow = items.select(F.col("item_id").alias("item"), "text")
    return narrow.mapInArrow(
        run, f"item {kind}, window string, size int, shingles array<struct<hash: bigint, place: int>>"
    )


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the low BITMAP_BITS bits of the column `hash`: at most 2**20 numbers are collected."""
    low = F.col("hash").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(hash & 63 as int))")
    cells = hashes.groupBy(F.shiftright(low, 6).alias("cell")).agg(F.bit_or(bit).alias("bits"))
    found = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for row in cells.collect():
        found[row.cell] = row.bits
    return found.view(np.uint64)


def member(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that the bitmap has."""
    low = hashes & np.uint64((1 << BITMAP_BITS) - 1)
    return np.flatnonzero(bits[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1))


def shingles_of(words: Words, hashes: np.ndarray, size: int, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """First words, hashes and texts of the shingles that the bitmap has and one text holds."""
    found = shingle_hashes(hashes, size)
    at = member(bits, found)
    text = np.searchsorted(words.first, at, "right") - 1
    inside = at + size <= words.first[text + 1]
    return at[inside], found[at[inside]], text[inside]


def shingle_counts(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """(hash, times) of the shingles that the bitmap has, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"), ALNUM)
                hashes = words.hashes()
                found = [shingles_of(words, hashes, size, shared.value)[1] for size in sizes]
                values, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], ["hash", "times"]
                )

    found = docs.select("text").mapInArrow(run, "hash long, times long")
    return found.groupBy("hash").agg(F.sum("times").alias("times"))


def candidates(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """One row (at = -1) of each document with its number of words n, and one of each shingle that the
    bitmap has, with the words around it that a window could cover, from word `base` on."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"), ALNUM)
                hashes, data = words.hashes(), words.data.tobytes()
                every = np.arange(len(part))
                none = np.full(len(part), -1)
                parts = [(every, none, none, none, pa.nulls(len(part), pa.string()))]
                for size in sizes:
                    at, found, text = shingles_of(words, hashes, size, shared.value)
                    first = words.first[text]
                    base = np.maximum(first, at - WINDOW + size)
                    stop = np.minimum(words.first[text + 1], at + WINDOW)
                    around = [
                        " ".join([data[s:e].decode() for s, e in zip(*span)])
                        for span in (
                            (words.starts[a:b].tolist(), words.ends[a:b].tolist())
                            for a, b in zip(base.tolist(), stop.tolist())
                        )
                    ]
                    place = (text, at - first, found.view(np.int64), base - first)
                    parts.append((*place, pa.array(around, pa.string())))
                text = np.concatenate([p[0] for p in parts])
                kept = [part.column(c).take(pa.array(text)) for c in ("id", "key")]
                numbers = [pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) for i in (1, 2, 3)]
                around = pa.concat_arrays([p[4] for p in parts])
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(words.counts[text].astype(np.int64)), *numbers, around],
                    ["id", "key", "n", "at", "hash", "base", "around"],
                )

    schema = T.StructType(
        [docs.schema["id"], docs.schema["key"]]
        + [T.StructField(c, T.LongType()) for c in ("n", "at", "hash", "base")]
        + [T.StructField("around", T.StringType())]
    )
    return docs.select("id", "key", "text").mapInArrow(run, schema)


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, size, hash, place) of each distinct window that may occur: its rarest shingle."""
    tokens = windows.select("window", "size", "shingles").distinct()
    tokens = tokens.select("window", "size", F.explode("shingles").alias("token"))
    rated = tokens.join(counts, F.col("token.hash") == counts["hash"], "left")
    order = F.struct(F.coalesce("times", F.lit(0)).alias("times"), "token.place", "token.hash")
    rarest = rated.groupBy("window", "size").agg(F.min(order).alias("rarest"))
    return rarest.where("rarest.times > 0").select("window", "size", "rarest.hash", "rarest.place")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, key, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs.

    key is a hash of all columns: rows equal in all columns share their result. Null and wordless texts
    have no words and are never contaminated; items without words match nothing; no items leave all
    documents clean. Repeated items count by their id. Texts of any length are taken whole.
    """
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        row_hash(docs).alias("key"),
        F.col(f"`{text_col}`").alias("text"),
    )
    windows = saved(item_windows(items))
    hashes = windows.select(F.explode("shingles.hash").alias("hash"))
    sizes = windows.select(F.least("size", F.lit(SHINGLE)).alias("size")).distinct()
    sizes = sorted(r.size for r in sizes.collect()) or [SHINGLE]  # SHINGLE numbers at most
    chosen = saved(prefixes(windows, shingle_counts(narrow, sizes, bitmap(hashes))))
    found = saved(candidates(narrow, sizes, bitmap(chosen.select("hash"))))

    start = F.col("at") - F.col("place")
    words = F.slice(F.split("around", " "), (start - F.col("base") + 1).cast("int"), F.col("size"))
    placed = found.where("at >= 0").join(chosen, "hash")
    fits = (start >= F.col("base")) & (start + F.col("size") <= F.col("n"))
    placed = placed.where(fits & (F.array_join(words, " ") == F.col("window")))
    placed = placed.select("id", "key", "window", start.alias("start"), (start + F.col("size")).alias("stop"))
    placed = saved(placed)

    doc = ["id", "key"]
    before = Window.partitionBy(*doc).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.select(*doc, "start", "stop").distinct()
    runs = runs.withColumn("done", F.coalesce(F.max("stop").over(before), F.lit(0)))
    new = F.greatest(F.col("stop") - F.greatest("start", "done"), F.lit(0))
    hits = runs.groupBy(*doc).agg(F.sum(new).alias("n_hit"))
    matched = placed.select(*doc, "window").distinct().join(windows.select("item", "window").distinct(), "window")
    matched = matched.groupBy(*doc).agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    both = saved(hits.join(matched, (hits["id"].eqNullSafe(matched["id"])) & (hits["key"] == matched["key"])).select(
        hits["id"].alias("i"), hits["key"].alias("k"), "n_hit", "items"
    ))
    every = found.where("at < 0").select("id", "key", F.col("n").alias("n_words"))
    joined = every.join(both, every["id"].eqNullSafe(both["i"]) & (every["key"] == both["k"]), "left")
    names = F.array_join(F.array_sort(F.coalesce("items", F.array().cast("array<string>"))), ",")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "id",
        "key",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no benchmark item contaminates."""
    found = contamination(docs, items, id_col, text_col).where("contaminated")
    bad = found.select(F.col("key").alias("__key")).distinct()  # the hash covers the id
    # they follow the input, so they are merged and never broadcast
    return docs.join(bad.hint("merge"), row_hash(docs) == F.col("__key"), "left_anti")


ORACLE = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(words[i:i + k - 1], ' ') AS w FROM (
    SELECT *, unnest(range(1, len(words) - k + 2)) AS i FROM (
      SELECT item_id, words, least(13, len(words)) AS k FROM items WHERE len(words) > 0))),
places AS (
  SELECT doc_id, i, k, array_to_string(words[i:i + k - 1], ' ') AS w FROM (
    SELECT *, unnest(range(1, len(words) - k + 2)) AS i FROM folded
    JOIN (SELECT DISTINCT k FROM windows) ON len(words) >= k)),
found AS (SELECT doc_id, item_id, i, p.k FROM places p JOIN windows USING (w)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + k)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
  SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT f.doc_id, len(f.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(f.words), false) AS contaminated
FROM folded f LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
