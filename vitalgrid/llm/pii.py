"""Personal data: fixed patterns, and terms that reveal whom the patterns protect.

The matches of the patterns are the protected entities. A term (a word near an entity) discloses it if
knowing the term makes the entity likely: of the documents that hold the term, the share that hold it
beside the entity is at least SHARE, that is at least BITS above chance (pointwise mutual information),
and the two meet in at least CONTEXTS different surroundings, so that copies of one passage are one
piece of evidence. Disclosing terms are generalised to a placeholder, or removed at a share of REMOVE and
above, wherever they occur.

Counts cover all documents. Words are exploded twice, once to count the terms seen beside entities and
once to find the disclosing ones; both times a bitmap of fixed size, broadcast as a table of at most
2**18 rows, drops the other words before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import row_hash, saved

# fixed values: the patterns of the base kinds, in the order of the kinds; possessive forms and the
# guards before a run find the same matches without backtracking
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SURROUNDING = 80  # characters on either side of an entity
SHORTEST = 3  # characters of a term
CONTEXTS, SHARE, BITS, REMOVE = 3, 0.5, 1.0, 0.9
BITMAP_BITS = 24
DOC = ["id", "key"]


def _hint(kind: str, text: Column) -> Column:
    """A cheap condition that every text with such a match meets."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][0-9 -]{12,}[0-9]")


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2 - 1) % 9 + 1),
    )
    luhn = F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0
    return (
        F.when(kind == "ip", match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
        .when(kind == "card", n.between(14, 19) & luhn)
        .when(kind == "phone", n.between(10, 15))
        .otherwise(True)
    )


def _located(found: DataFrame) -> DataFrame:
    """Adds start and end (code points) to matches that follow `gap` characters after the last one."""
    upto = Window.partitionBy(*DOC, "kind").orderBy("nr")
    size = F.length("match")
    return (
        found.repartition(*DOC)
        .dropDuplicates([*DOC, "kind", "nr"])  # wholly equal rows share their matches
        .withColumn("end", F.sum(F.col("gap") + size).over(upto).cast("long"))
        .withColumn("start", F.col("end") - size)
    )


def _matches(text: Column, pattern: str) -> Column:
    """Array of (gap, before, after, match) over the matches of a pattern."""
    pieces = F.transform(
        F.split(text, pattern, -1),
        lambda p: F.struct(
            F.length(p).alias("n"),
            F.substring(p, 1, SURROUNDING).alias("head"),
            F.when(F.length(p) > SURROUNDING, F.substring(p, -SURROUNDING, SURROUNDING))
            .otherwise(p)
            .alias("tail"),
        ),
    )
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(
        F.zip_with(
            F.slice(pieces, 1, F.size(found)),
            F.slice(pieces, 2, F.size(found)),
            lambda a, b: F.struct(a["n"].alias("gap"), a["tail"].alias("before"), b["head"].alias("after")),
        ),
        found,
        lambda p, m: F.struct(p["gap"].alias("gap"), p["before"].alias("before"), p["after"].alias("after"), m.alias("match")),
    )


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text); key is a hash of all columns, so only wholly equal rows share both."""
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        row_hash(docs).alias("key"),
        F.col(f"`{text_col}`").alias("text"),
    )


def base_spans(texts: DataFrame) -> DataFrame:
    """(id, key, kind, start, end, match, before, after) of the valid matches of all patterns."""
    text = F.col("text")
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.when(_hint(k, text), _matches(text, PATTERNS[k])).alias("m"))
            for k in KINDS
        ]
    )
    found = texts.select(*DOC, F.explode(kinds).alias("k")).where("k.m is not null and size(k.m) > 0")
    found = found.select(*DOC, "k.kind", F.posexplode("k.m").alias("nr", "m"))
    found = found.select(*DOC, "kind", "nr", "m.*")
    # validity after location: gaps run over failing matches too
    return _located(found).where(_valid(F.col("kind"), F.col("match"))).drop("nr", "gap")


def beside(spans: DataFrame) -> DataFrame:
    """(id, key, entity, term, around): the distinct words near each entity."""
    cut = F.length("before") == SURROUNDING
    before = F.when(cut, F.regexp_replace("before", rf"^{WORD}", "")).otherwise(F.col("before"))
    after = F.when(
        F.length("after") == SURROUNDING, F.regexp_replace("after", rf"{WORD}$", "")
    ).otherwise(F.col("after"))
    around = F.lower(F.concat_ws(" ", before, after))
    entity = F.concat_ws(":", "kind", F.when(F.col("kind") == "email", F.lower("match")).otherwise(F.regexp_replace("match", r"[^0-9.]", "")))
    words = F.array_distinct(F.split(around, BETWEEN))
    found = spans.select(*DOC, entity.alias("entity"), F.xxhash64(around).alias("around"), F.explode(words).alias("term"))
    return found.where(_is_term(F.col("term")))


def _is_term(term: Column) -> Column:
    return (F.length(term) >= SHORTEST) & ~term.rlike("^[0-9]+$")


def _low(term: str) -> Column:
    return F.xxhash64(term).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))


def terms_among(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, key, term) of the distinct words of every text that a bitmap of the chosen terms has: all
    occurrences of these, and few others."""
    cell, place = F.shiftright(_low("term"), 6), _low("term").bitwiseAND(F.lit(63)).cast("int")
    bit = F.expr("shiftleft(1L, cast(xxhash64(term) & 63 as int))")
    cells = chosen.groupBy(cell.alias("cell")).agg(F.bit_or(bit).alias("bits"))
    words = texts.select(*DOC, F.explode(F.array_distinct(F.split(F.lower("text"), BETWEEN))).alias("term"))
    words = words.withColumn("cell", cell).join(F.broadcast(cells), "cell")
    return words.where(F.expr("shiftright(bits, cast(xxhash64(term) & 63 as int)) & 1") == 1).select(*DOC, "term")


def disclosing_terms(texts: DataFrame, near: DataFrame) -> DataFrame:
    """(term, share, bits): the terms that disclose an entity, with their largest share."""
    seen = near.distinct().groupBy("entity", "term", "around").agg(F.count("*").alias("n"))
    pairs = seen.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("contexts"))
    # a term is in at least as many documents as hold it beside any entity: a share above this bound
    # can't be reached, whatever the rest of the corpus holds
    anywhere = near.select(*DOC, "term").distinct().groupBy("term").agg(F.count("*").alias("least"))
    pairs = pairs.where(F.col("contexts") >= CONTEXTS).join(anywhere, "term")
    pairs = saved(pairs.where(F.col("both") >= SHARE * F.col("least")).drop("least"))
    entities = near.select(*DOC, "entity").distinct().groupBy("entity").agg(F.count("*").alias("of_entity"))
    counts = terms_among(texts, pairs.select("term").distinct()).groupBy("term").agg(
        F.count("*").alias("of_term")
    )
    everything = texts.count()
    share = F.least(F.lit(1.0), F.col("both") / F.col("of_term"))
    bits = F.log2(share * everything / F.col("of_entity"))
    rated = pairs.join(counts, "term").join(entities, "entity").select("term", share.alias("share"), bits.alias("bits"))
    rated = rated.where((F.col("share") >= SHARE) & (F.col("bits") >= BITS))
    return rated.groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits"))


def term_spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, key, kind, start, end, match) of every occurrence of the terms; kind: term or removed."""
    held = terms_among(texts, terms.select("term")).join(terms, "term")
    held = held.groupBy(*DOC).agg(F.collect_set(F.struct("term", "share")).alias("held"))
    held = held.select(F.col("id").alias("i"), F.col("key").alias("k"), "held")
    same = texts["id"].eqNullSafe(held["i"]) & (texts["key"] == held["k"])
    found = texts.join(held, same).select(*DOC, "held", F.posexplode(_matches(F.col("text"), WORD)).alias("nr", "m"))
    found = _located(found.select(*DOC, F.lit("term").alias("kind"), "nr", "m.gap", "m.match", "held"))
    hit = F.filter("held", lambda t: t["term"] == F.lower("match"))
    found = found.withColumn("hit", F.get(hit, 0)).where("hit is not null")
    kind = F.when(F.col("hit.share") >= REMOVE, "removed").otherwise("term")
    return found.select(*DOC, kind.alias("kind"), "start", "end", "match")


def spans(texts: DataFrame) -> DataFrame:
    """(id, key, kind, start, end) of base matches and of disclosing terms outside of them."""
    base = saved(base_spans(texts))
    terms = saved(disclosing_terms(texts, beside(base)))
    added = term_spans(texts, terms)
    both = base.select(*DOC, "kind", "start", "end").unionAll(added.select(*DOC, "kind", "start", "end"))
    own = Window.partitionBy(*DOC).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*DOC).orderBy(F.col("start").desc(), F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    is_base = ~F.col("kind").isin("term", "removed")
    edge = both.withColumn("done", F.max(F.when(is_base, F.col("end"))).over(own)).withColumn(
        "next", F.min(F.when(is_base, F.col("start"))).over(later)
    )
    free = F.coalesce(F.col("done") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    return edge.where(is_base | free).select(*DOC, "kind", "start", "end")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, spans) of every row of docs: its spans (start, rank of kind, end, kind), sorted.

    Null texts are empty. Rows equal in all columns share their spans. Texts of any length are taken
    whole; no entities or terms give empty arrays.
    """
    texts = narrow(docs, id_col, text_col)
    rank = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "term", "removed")]), F.col("kind"))
    listed = spans(texts).groupBy(*DOC).agg(
        F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans")
    )
    listed = listed.select(F.col("id").alias("i"), F.col("key").alias("k"), "spans")
    every = texts.select(*DOC)
    same = every["id"].eqNullSafe(listed["i"]) & (every["key"] == listed["k"])
    none = F.array().cast("array<struct<start: bigint, rank: bigint, end: bigint, kind: string>>")
    return every.join(listed, same, "left").select(*DOC, F.coalesce("spans", none).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span generalised to its kind in brackets, or removed."""
    found = find(docs, id_col, text_col).where(F.size("spans") > 0).distinct()
    found = found.select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    text = F.col(f"`{text_col}`")
    joined = docs.join(found, row_hash(docs) == F.col("__key"), "left")  # the hash covers the id
    mark = lambda s: F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
    # base kinds may overlap each other: a span starts where the one before has ended at the earliest
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
        F.struct(
            F.concat(
                a["out"],
                F.substring(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")),
                mark(s),
            ).alias("out"),
            s["end"].alias("at"),
        )
    )
    whole = F.aggregate(
        "__spans", state, step,
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    new = F.when(F.col("__spans").isNull(), text).otherwise(whole)
    return joined.select(*[new.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns])
