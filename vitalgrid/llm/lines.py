"""Removal of repeated runs of lines by a suffix array over line ids.

A line is removed if it lies in a run of consecutive lines of its document, of at least `least` words
in all, that also begins at an earlier place (smaller id, then smaller line number). Runs are compared
as sequences of line ids.

Every such run is a union of shortest runs: those that begin at a line, or end at one, and just reach
`least` words. A shortest run has at most `least` lines, so suffixes need to be told apart by that many
lines and no more. Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines: the rank by 2h
lines is the place of the pair (rank by h at the line, rank by h at h lines below) among all distinct
pairs in order. Suffixes with a common prefix of a given length are an interval of that order, named by
two overlapping ranks; its first member in the order of documents stays, the others are later copies.

Only lines that occur twice take part, and of these only stretches of at least `least` words. Pairs
are summed before they are shuffled, so a run that a third of all documents hold is one pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import ordered, row_hash, saved
from vitalgrid.llm.mixing import words

LEAST = 50  # words of a run that is worth removing
DOC = ["none", "doc", "key"]  # whether the id is null, the id (0 then), a hash of all columns


def _with_key(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").isNull().alias("none"),
        F.coalesce(f"`{id_col}`", F.lit(0).cast(docs.schema[id_col].dataType)).alias("doc"),
        row_hash(docs).alias("key"),
    )


def _filled(text: Column) -> Column:
    """The lines of a text that have words."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def stretches(keyed: DataFrame, text: Column, least: int) -> DataFrame:
    """Lines (none, doc, key, stretch, pos, n, rank) that occur more than once, in stretches of
    consecutive lines with at least `least` words; rank is the place of the line among such lines."""
    lines = keyed.select(*DOC, F.posexplode(_filled(text)).alias("pos", "line")).select(
        *DOC,
        "pos",
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"),
        words(F.col("line")).alias("n"),
    )
    lines = saved(lines)
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1")
    ids = ordered(often.drop("times"), [F.col("h1"), F.col("h2")]).withColumnRenamed("row", "rank")
    own = Window.partitionBy(*DOC).orderBy("pos")
    found = (
        lines.join(ids, ["h1", "h2"])
        .repartition(*DOC)
        .dropDuplicates([*DOC, "pos"])  # wholly equal rows count as one document
        .withColumn("stretch", F.col("pos") - F.row_number().over(own))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*DOC, "stretch")))
        .where(F.col("total") >= least)
    )
    return saved(found.select(*DOC, "stretch", "pos", "n", "rank"))


def shortest_runs(found: DataFrame, least: int) -> DataFrame:
    """(none, doc, key, pos, lines): the shortest runs of at least `least` words that begin or end at
    each line."""
    own = Window.partitionBy(*DOC, "stretch")
    placed = found.withColumn("upto", F.sum("n").over(own.orderBy("pos")))
    placed = placed.withColumn("before", F.col("upto") - F.col("n"))
    down = own.orderBy("before").rangeBetween(Window.currentRow, least - 1)
    up = own.orderBy("upto").rangeBetween(-(least - 1), Window.currentRow)
    placed = placed.select(
        *DOC,
        "pos",
        F.when(F.sum("n").over(down) >= least, F.count("*").over(down)).alias("down"),
        F.when(F.sum("n").over(up) >= least, F.count("*").over(up)).alias("up"),
    )
    first = F.struct("pos", F.col("down").alias("lines"))
    last = F.struct((F.col("pos") - F.col("up") + 1).cast("int").alias("pos"), F.col("up").alias("lines"))
    runs = placed.select(*DOC, F.explode(F.array(first, last)).alias("run")).select(*DOC, "run.*")
    return runs.where("lines is not null").distinct()


def repeated(found: DataFrame, least: int) -> DataFrame:
    """(none, doc, key, pos, end) of shortest runs that occur at an earlier place."""
    runs = saved(shortest_runs(found, least))
    own = Window.partitionBy(*DOC, "stretch").orderBy("pos")
    later: DataFrame | None = None
    size = 1
    while True:
        # runs of size to 2 * size - 1 lines: an interval of suffixes is named by the ranks of its
        # first and of its last `size` lines
        some = runs.where(F.col("lines").between(size, 2 * size - 1))
        ranks = found.select(*DOC, "pos", "rank").where("rank is not null")
        head = some.join(ranks.withColumnRenamed("rank", "head"), [*DOC, "pos"])
        head = head.withColumn("at", (F.col("pos") + F.col("lines") - size).cast("int"))
        tail = ranks.select(*DOC, F.col("pos").alias("at"), F.col("rank").alias("tail"))
        named = saved(head.join(tail, [*DOC, "at"]).drop("at"))
        interval = ["lines", "head", "tail"]
        place = F.struct(*DOC, "pos")
        firsts = named.groupBy(*interval).agg(F.min(place).alias("first"), F.count("*").alias("times"))
        copies = named.join(firsts.where("times > 1").drop("times"), interval).where(place > F.col("first"))
        copies = copies.select(*DOC, "pos", (F.col("pos") + F.col("lines")).alias("end"))
        later = copies if later is None else later.unionAll(copies)
        size *= 2
        if size > least:
            return later
        pairs = found.withColumn("next", F.lead("rank", size // 2).over(own))
        often = pairs.where("rank is not null and next is not null").groupBy("rank", "next")
        often = often.agg(F.count("*").alias("times")).where("times > 1").drop("times")
        new = ordered(often, [F.col("rank"), F.col("next")])
        found = saved(pairs.join(new, ["rank", "next"], "left").drop("rank", "next").withColumnRenamed("row", "rank"))
        if found.where("rank is not null").isEmpty():
            return later


def removed_lines(keyed: DataFrame, text: Column, least: int) -> DataFrame:
    """(none, doc, key, gone): the numbers, among lines with words, of the lines to remove."""
    found = stretches(keyed, text, least)
    ends = repeated(found, least).groupBy(*DOC, "pos").agg(F.max("end").alias("end"))
    upto = Window.partitionBy(*DOC).orderBy("pos")
    covered = found.join(ends, [*DOC, "pos"], "left").withColumn("end", F.max("end").over(upto))
    return covered.where("end > pos").groupBy(*DOC).agg(F.collect_set("pos").alias("gone"))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, counts: bool = True
) -> DataFrame:
    """The documents without repeated runs, and with `counts` also `n_lines` and `n_removed` (existing
    columns of those names are replaced). Without it, a column `n_chars` follows the text where that
    changed.

    A document that loses lines is joined anew from its other lines with words; others keep their
    text as it is. Lines without words take no part. Null and empty texts stay. A null id comes after
    all ids; rows that are equal in all columns are treated alike, as one document. One document's
    lines are ordered in one task.
    """
    if least < 1:
        raise ValueError("a run has at least one word")
    keyed = _with_key(docs, id_col)
    text = F.col("row").getField(text_col)
    gone = saved(removed_lines(keyed, text, least))
    right = gone.select(*[F.col(c).alias(f"g_{c}") for c in DOC], "gone")
    same = (F.col("none") == F.col("g_none")) & (F.col("doc") == F.col("g_doc")) & (F.col("key") == F.col("g_key"))
    # merged at every size: which documents lose lines follows the input, so it is never broadcast
    joined = keyed.join(right.hint("merge"), same, "left")
    lines = _filled(text)
    rest = F.filter(lines, lambda x, i: ~F.array_contains("gone", i))
    new = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(rest, "\n"))
    if not counts:
        size = F.when(F.col("gone").isNull(), F.col("row").getField("n_chars") if "n_chars" in docs.columns else None)
        changed = {text_col: new, "n_chars": size.otherwise(F.length(new))}
        return joined.select(
            *[
                changed.get(c, F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c)
                for c in docs.columns
            ]
        )
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in own],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, text, list_filter(string_split(text, chr(10)),
         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
l AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs)),
c AS (
  SELECT *, sum(n) OVER o AS upto, sum(n) OVER o - n AS before
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
w AS (
  SELECT *, sum(n) OVER d AS dw, count(*) OVER d AS dl, sum(n) OVER u AS uw, count(*) OVER u AS ul FROM c
  WINDOW d AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
         u AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
runs AS (
  SELECT doc_id, pos, dl AS k FROM w WHERE dw >= 50
  UNION SELECT doc_id, pos - ul + 1, ul FROM w WHERE uw >= 50),
named AS (
  SELECT r.doc_id, r.pos, r.k, md5(array_to_string(d.lines[r.pos:r.pos + r.k - 1], chr(10))) AS run
  FROM runs r JOIN docs d USING (doc_id)),
later AS (
  SELECT doc_id, pos, pos + k AS stop FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS i FROM named) WHERE i > 1),
ends AS (SELECT doc_id, pos, max(stop) AS stop FROM later GROUP BY ALL),
marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(max(e.stop) OVER (PARTITION BY l.doc_id ORDER BY l.pos) > l.pos, false) AS gone
  FROM l LEFT JOIN ends e USING (doc_id, pos)),
sums AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS rest
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_lines, 0)::BIGINT AS n_lines, coalesce(s.n_removed, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN coalesce(s.n_removed, 0) > 0 THEN s.rest ELSE coalesce(d.text, '') END) AS text_sha256
FROM documents d LEFT JOIN sums s USING (doc_id)
"""
