"""Mixing sources to target weights by hash thresholds.

A source takes every document `base` times and the documents below a hash threshold once more. The
threshold comes from nested histograms: words by source and leading hash bits, then by the next bits
inside the one bucket in which the budget ends, until that bucket holds one hash. No document is ever
sorted; a histogram has at most 2**STEP buckets a source, summed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import ordered, saved

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3  # times that a document or a source is taken at most
HASH_BITS, STEP = 60, 12  # bits of a document's hash, and of one histogram


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(id_: Column, text: Column) -> Column:
    """Hash in [0, 2**HASH_BITS) of a document's id, or of its text where the id is null."""
    name = F.coalesce(id_.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) of every source.

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ... and share all words; a target
    stops at MOST times its source's size and the excess goes to the others by weight, until none is
    above. Sources in the order of size by weight reach that stop first, so one running sum tells
    which do.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ordered(sources, [F.col("source").isNull(), F.col("source")])
    sources = sources.select(
        "source", "source_size", (F.pmod(F.col("row") - 1, F.lit(3)) + 1).cast("long").alias("w")
    )
    sources = saved(sources)
    everything = sources.agg(F.sum("source_size"), F.sum("w")).first()
    total, weight = (F.lit(x or 0).cast("decimal(38,0)") for x in everything)
    stop = F.col("source_size") * MOST
    fullness = F.col("source_size") * 6 / F.col("w")
    run = ordered(
        sources,
        [fullness, F.col("source").isNull(), F.col("source")],
        {"stops": stop, "weights": F.col("w")},
    )
    left, shared = total - (F.col("stops") - stop), weight - (F.col("weights") - F.col("w"))
    run = saved(run.withColumn("full", stop * shared <= F.col("w") * left))
    ends = run.where("full").agg(F.sum(stop), F.sum("w")).first()
    left = (everything[0] or 0) - (ends[0] or 0)
    shared = (everything[1] or 0) - (ends[1] or 0)
    share = (F.lit(left).cast("long") * F.col("w")).cast("double") / F.lit(float(shared))
    return run.select(
        "source", "source_size", F.when(F.col("full"), stop.cast("double")).otherwise(share).alias("target")
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, base, below): take all documents of a source `base` times, and
    those with a hash under `below` once more.

    The document at which the budget ends is taken if that brings the sum nearer to the target.
    Documents that share one hash (repeated rows) are taken together.
    """
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    plan = goals.withColumn("base", F.coalesce(base, F.lit(1)).cast("long")).withColumn(
        "rest", F.col("target") - F.col("base") * F.col("source_size")
    )
    plan = saved(plan)
    # open: sources whose budget ends inside the bucket `prefix`, with the words before that bucket
    opened = plan.where("rest > 0").select("source", "rest", F.lit(0).alias("prefix"), F.lit(0).alias("before"))
    found: list[DataFrame] = []
    for shift in range(HASH_BITS - STEP, -1, -STEP):
        inside = sized.join(
            opened.withColumnRenamed("source", "of"),
            F.col("source").eqNullSafe(F.col("of"))
            & (F.shiftright("hash", shift + STEP) == F.col("prefix")),
        )
        buckets = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("n"),
            F.min("hash").alias("least"),
            F.max("hash").alias("largest"),
            F.first("rest").alias("rest"),
            F.first("before").alias("before"),
        )
        upto = Window.partitionBy("source").orderBy("bucket")
        buckets = buckets.withColumn("before", F.col("before") + F.sum("n").over(upto) - F.col("n"))
        ends = saved(buckets.where("before < rest and rest <= before + n"))
        single = F.when(2 * (F.col("rest") - F.col("before")) > F.col("n"), F.col("least") + 1)
        found.append(
            ends.where("least = largest").select("source", F.coalesce(single, "least").alias("below"))
        )
        opened = ends.where("least < largest").select(
            "source", "rest", F.col("bucket").alias("prefix"), "before"
        )
        if opened.isEmpty():
            break
    closed = found[0]
    for more in found[1:]:
        closed = closed.unionAll(more)
    closed = closed.withColumnRenamed("source", "of")
    joined = plan.join(closed, F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.select(
        "source", "source_size", "target", "base", F.coalesce("below", F.lit(0)).alias("below")
    )


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash) of every document, written once."""
    return saved(
        docs.select(
            "doc_id",
            "source",
            words(F.col("text")).alias("size"),
            place(F.col("doc_id"), F.col("text")).alias("hash"),
        )
    )


def copies(hashed: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and `copies`, how often the mix takes a row, to rows with source and
    hash."""
    plan = plan.withColumnRenamed("source", "__of")
    joined = hashed.join(plan, F.col("source").eqNullSafe(F.col("__of")))
    taken = F.col("base") + (F.col("hash") < F.col("below")).cast("long")
    return joined.withColumn("copies", taken).drop("__of", "base", "below")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    Null texts have no words; null sources are one source, the last; null ids are told apart by
    their text; empty input gives no rows.
    """
    sized = sizes(docs)
    found = copies(sized, saved(thresholds(sized, targets(sized))))
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as the mix reads them: each row as often as it is taken, with the number `copy`
    (1, 2, ...) after its columns (an existing column of that name is replaced)."""
    sized = sizes(docs)
    plan = saved(thresholds(sized, targets(sized)))
    names = [c for c in docs.columns if c != "copy"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"),
        "source",
        place(F.col("doc_id"), F.col("text")).alias("hash"),
    )
    taken = copies(rows, plan).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(
        "__row.*", "copy"
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
run AS (
  SELECT *, 3 * source_size AS stop, sum(source_size) OVER () AS total, sum(w) OVER () AS weight,
         sum(3 * source_size) OVER o AS stops, sum(w) OVER o AS weights
  FROM sources WINDOW o AS (ORDER BY source_size * 6 / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
full_ AS (SELECT *, stop * (weight - weights + w) <= w * (total - stops + stop) AS is_full FROM run),
goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN stop::DOUBLE ELSE
    ((total - coalesce(sum(stop) FILTER (is_full) OVER (), 0)) * w)::DOUBLE
    / (weight - coalesce(sum(w) FILTER (is_full) OVER (), 0))::DOUBLE END AS target
  FROM full_),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END AS base FROM goals),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.base, p.target - p.base * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS unit,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (base + CASE WHEN 2 * (rest - (upto - unit)) > unit AND rest > upto - unit THEN 1 ELSE 0 END))::BIGINT
         AS taken
FROM placed
"""
