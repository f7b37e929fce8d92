"""Periodic runs of words by maximal pairs of an LCP-interval tree, and texts with their repeats cut.

A run is a stretch of consecutive words with smallest period q, of at least max(LEAST, FACTOR * q) words,
which no neighbouring word extends keeping the period. Its words from the start and from q words later
are a maximal pair: they agree for length - q words, the words before them differ and so do those after.
Conversely a maximal pair that agrees for at least max(LEAST - q, (FACTOR - 1) * q) words is a run, so
nothing has to be extended. Where one stretch has several periods, its smallest divides the others.

Pairs are found bottom-up in the tree of LCP intervals. An interval holds the places of its suffixes in
one sorted list and in a list for each word on their left. When a child joins, the smaller side looks up
places of other left words within (common length) / (FACTOR - 1) in the larger one, and is merged into it.
Occurrences that close to each other are an arithmetic progression and all but its first have the same
left word, so looking up either the window or the other classes, whichever is fewer, stays cheap.

Trees are built only where runs can be: each word of a run but the last few begins a sequence of WIDTH
words that occurs again within a distance that its stretch of such words must exceed FACTOR - 1 times.
A stretch is extended far enough to hold every run in it and the word that ends it, so nothing is lost.

A text is one row and is handled in one task, whatever its length. There is no shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.text import SPACED, Words, chunks, mixed, text_bytes

LEAST = 6  # words of a run
FACTOR = 4  # times that the period fits into a run
RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
WORD = r"[^\x20\x09-\x0D]+"
STEPS = np.random.default_rng(12).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_width(least: int, factor: int) -> int:
    """Words that the two parts of any run have in common at least."""
    return min(max(least - q, (factor - 1) * q) for q in range(1, max(2, least)))


def next_distance(ids: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Distance from each word to the next place of the `width` words that begin there; 0 without one."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.flatnonzero(np.arange(len(ids)) + width <= first[1:][text])
    grams = text[whole].astype(np.uint64) * STEPS[-1]
    for j in range(width):
        grams = mixed(grams + ids[whole + j] * STEPS[j % 63])
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    found = np.zeros(len(ids), np.int64)
    found[whole[order[:-1][same]]] = (whole[order[1:]] - whole[order[:-1]])[same]
    return found


def stretches(marked: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of marked words; no stretch crosses the edge of a text."""
    begins, ends = marked.copy(), marked.copy()
    begins[1:] &= ~marked[:-1]
    ends[:-1] &= ~marked[1:]
    edges = first[(first > 0) & (first < len(marked))]
    begins[edges] = marked[edges]
    ends[edges - 1] = marked[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def regions(ids: np.ndarray, first: np.ndarray, least: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of parts of texts: every run, and the word after it, lies within one of them."""
    width = gram_width(least, factor)
    distance = next_distance(ids, first, width)
    marked = distance > 0
    while True:
        begin, end = stretches(marked, first)
        # the longest common part that a run in this stretch can have
        common = np.zeros(len(ids), np.int64)
        common[marked] = np.repeat(end - begin + width - 1, end - begin)
        kept = marked & (distance * (factor - 1) <= common)
        if (kept == marked).all():
            break
        marked = kept
    common = end - begin + width - 1
    text_end = first[np.searchsorted(first, begin, "right")]
    stop = np.minimum(text_end, end + width + common // (factor - 1) + 1)
    # stretches that overlap are one
    upto = np.maximum.accumulate(stop) if len(stop) else stop
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] >= upto[:-1]
    heads = np.flatnonzero(new)
    return begin[heads], upto[np.concatenate((heads[1:], [len(begin)])) - 1] if len(heads) else upto[:0]


def suffixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and, for each of its entries, the words it has in common with the one before.

    Ranks by the first 1, 2, 4, ... symbols until all differ; the last symbol occurs nowhere else.
    """
    ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
    size, count = 1, len(symbols)
    while ranks[-1].max() + 1 < count:
        after = np.zeros(count, np.int64)
        after[: count - size] = ranks[-1][size:] + 1
        ranks.append(np.unique(ranks[-1] * (count + 1) + after, return_inverse=True)[1].astype(np.int64))
        size *= 2
    order = np.argsort(ranks[-1])
    one, other = order[:-1].copy(), order[1:].copy()
    common = np.zeros(count, np.int64)
    for level in range(len(ranks) - 2, -1, -1):
        rank = np.append(ranks[level], [-1])
        same = rank[np.minimum(one, count)] == rank[np.minimum(other, count)]
        same &= np.maximum(one, other) < count
        step = np.where(same, 1 << level, 0)
        common[1:] += step
        one += step
        other += step
    return order, common


class Places:
    """Places of suffixes: all of them, and by the word on their left."""

    __slots__ = ("all", "classes")

    def __init__(self, place: int, left: int) -> None:
        self.all, self.classes = [place], {left: [place]}


def joined(one: Places, other: Places, common: int, left: list[int], least: int, factor: int, found: dict) -> Places:
    """Both sets as one, after the maximal pairs between them that are runs were noted in `found`
    (start, length) -> period."""
    if len(one.all) < len(other.all):
        one, other = other, one
    reach, short = common // (factor - 1), least - common
    for place in other.all:
        own = left[place]
        low, high = bisect_left(one.all, place - reach), bisect_right(one.all, place + reach)
        if low == high:
            continue
        if high - low <= len(one.classes):
            near = [p for p in one.all[low:high] if left[p] != own]
        else:
            near = [
                p
                for word, places in one.classes.items()
                if word != own
                for p in places[bisect_left(places, place - reach) : bisect_right(places, place + reach)]
            ]
        for p in near:
            period = abs(p - place)
            if period >= short:
                key = min(p, place), common + period
                found[key] = min(period, found.get(key, period))
    for place in other.all:
        insort(one.all, place)
    for word, places in other.classes.items():
        mine = one.classes.setdefault(word, [])
        for place in places:
            insort(mine, place)
    return one


def maximal_pairs(order: list[int], common: list[int], left: list[int], least: int, factor: int) -> dict:
    """(start, length) -> smallest period of all runs, from a suffix array and its common lengths."""
    found: dict[tuple[int, int], int] = {}
    width = gram_width(least, factor)
    stack: list[tuple[int, Places]] = []
    for nr, place in enumerate(order):
        ahead = common[nr + 1] if nr + 1 < len(order) else 0
        if ahead < width and not stack:
            continue
        child = Places(place, left[place])
        while stack and stack[-1][0] > ahead:
            shared, places = stack.pop()
            child = joined(places, child, shared, left, least, factor, found)
        if ahead < width:
            # the intervals that are open have fewer words in common than any run needs
            stack.clear()
        elif stack and stack[-1][0] == ahead:
            stack[-1] = ahead, joined(stack[-1][1], child, ahead, left, least, factor, found)
        else:
            stack.append((ahead, child))
    return found


def runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST, factor: int = FACTOR) -> np.ndarray:
    """(start, length, period) of all runs of words, starts counted over all texts, sorted by start and
    period. ids: a number for each word; first: where texts begin, and the number of words."""
    begin, end = regions(ids, first, least, factor)
    if not len(begin):
        return np.zeros((0, 3), np.int64)
    sizes = end - begin + 1  # one place more for a symbol that ends the region
    starts = np.cumsum(sizes) - sizes
    region = np.repeat(np.arange(len(begin)), sizes)
    place = np.arange(sizes.sum()) - starts[region] + begin[region]
    last = place == end[region]
    words = np.unique(ids[np.where(last, 0, place)], return_inverse=True)[1] + 1
    kinds = int(words.max()) + 1
    # equal numbers for equal words of one region only; the ends are all different
    symbols = region * kinds + np.where(last, 0, words)
    order, common = suffixes(symbols)
    # numbers of the words on the left; the first word of a text has none, unlike any other
    before = np.concatenate(([-1], np.unique(ids, return_inverse=True)[1]))[:-1]
    before[first[:-1][np.diff(first) > 0]] = -1
    left = np.where(last, -2, before[np.minimum(place, len(ids) - 1)])
    found = maximal_pairs(order.tolist(), common.tolist(), left.tolist(), least, factor)
    if not found:
        return np.zeros((0, 3), np.int64)
    table = np.array([(start, length, period) for (start, length), period in found.items()], np.int64)
    table[:, 0] = place[table[:, 0]]
    return table[np.lexsort((table[:, 2], table[:, 0]))]


def collapsed(words: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts without the words that runs repeat, the rest joined by one space."""
    change = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(change, table[:, 0] + table[:, 2], 1)
    np.add.at(change, table[:, 0] + table[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    text = np.repeat(np.arange(len(words.counts)), words.counts)[kept]
    starts, ends = words.starts[kept], words.ends[kept]
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.cumsum(edge)[:-1].astype(bool)
    followed = np.zeros(len(text), bool)
    followed[:-1] = text[1:] == text[:-1]
    spaces = ends[followed]
    inside[spaces] = True
    data = words.data.copy()
    data[spaces] = 0x20
    upto = np.concatenate(([0], np.cumsum(inside)))
    return data[inside], upto[words.offsets]


def with_runs(
    docs: DataFrame, keep: list[str], text_col: str = "text", least: int = LEAST, factor: int = FACTOR
) -> DataFrame:
    """The columns `keep` of every row, with n_words, runs (array of start, length, period, by start, then
    period; starts are word numbers from 0) and collapsed, the text without the words that a run holds
    after its first period, words joined by one space.

    Null and empty texts, and texts without separators, are texts of no or one word and have no runs. Case
    matters. Rows are handled one by one, so ids may be null or repeated; columns of `keep` that bear the
    names of results are replaced by these.
    """
    if factor < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    added = [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ]
    keep = [c for c in keep if c not in {f.name for f in added}]
    struct = pa.struct([(f.name, pa.int64()) for f in RUN.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                words = Words(part.column("__text"), SPACED)
                words.data = text_bytes(part.column("__text"))[0]  # as written
                table = runs(words.hashes(), words.first, least, factor)
                data, offsets = collapsed(words, table)
                edges = np.searchsorted(table[:, 0], words.first).astype(np.int32)
                table[:, 0] -= np.repeat(words.first[:-1], np.diff(edges))
                columns = [pa.array(np.ascontiguousarray(c)) for c in table.T]
                values = pa.StructArray.from_arrays(columns, fields=list(struct))
                texts = pa.StringArray.from_buffers(
                    len(part), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())
                )
                results = [pa.array(words.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(edges), values), texts]
                kept = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *results], [*keep, *[f.name for f in added]])

    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    return narrow.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added))


def with_planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, where one in ten (by the checksum of its id) repeats a part of its words up to its end.

    Of these, the words from a on become the p words from a on, over and over: with h the checksum and
    g = h div 10, a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null id, a null text and a text
    without words stay.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string"))
    g = F.floor(h / 10)
    words = F.col("__words")
    n = F.size("__words")
    a = F.pmod(g, n)
    p = F.floor((n - F.col("__a")) / (3 + F.pmod(g, F.lit(8)))) + 1
    unit = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    times = F.ceil((n - F.col("__a")) / F.col("__p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), n - F.col("__a"))
    new = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), tail), " ")
    found = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(WORD), F.lit(0))
    changed = docs.withColumn("__words", F.when(h % 10 == 0, found))
    changed = changed.withColumn("__a", F.when(n > 0, a).cast("int")).withColumn("__p", p.cast("int"))
    text = F.when(words.isNotNull() & (n > 0), new).otherwise(F.col(f"`{text_col}`"))
    return changed.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def strongest(of: Column) -> Column:
    """The run of greatest length / period (exactly; ties: smallest start, then period); null without runs."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    # runs come by start, then period, so only a greater one takes the place
    return F.aggregate(of, F.get(of, 0), lambda best, x: F.when(better(x, best), x).otherwise(best))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS given,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
             lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                 lambda c, bit: xor(c >> 1, 3988292384 * (c & 1))))) AS h
  FROM documents),
planted AS (
  SELECT doc_id, given, h, len(given) AS n, h // 10 AS g,
         CASE WHEN len(given) > 0 THEN (h // 10) % len(given) END AS a FROM texts),
texts2 AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n),
           lambda i: CASE WHEN i < a THEN given[i + 1]
                          ELSE given[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END)
         ELSE given END AS words
  FROM planted),
grams AS (
  SELECT doc_id, n, i, array_to_string(words[i + 1:i + 5], ' ') AS gram
  FROM (SELECT *, unnest(range(n - 4)) AS i FROM texts2 WHERE n >= 6)),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y
  ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
parts AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 4 AS common FROM islands GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, common + q AS length, min(q) AS period FROM parts
  WHERE common >= greatest(6 - q, 3 * q) GROUP BY ALL),
listed AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listing
  FROM runs GROUP BY doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, period) AS nr FROM runs),
best AS (
  SELECT r.doc_id, r.start, r.length, r.period FROM ranked r
  WHERE NOT EXISTS (SELECT 1 FROM ranked o WHERE o.doc_id = r.doc_id AND
    (o.length * r.period > r.length * o.period OR (o.length * r.period = r.length * o.period AND o.nr < r.nr)))),
edges AS (
  SELECT doc_id, start + period AS pos, 1 AS change FROM runs
  UNION ALL SELECT doc_id, start + length, -1 FROM runs),
spread AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM texts2),
covered AS (
  SELECT doc_id, pos, NULL::VARCHAR AS word, change FROM edges
  UNION ALL SELECT doc_id, pos, word, 0 FROM spread),
opened AS (
  SELECT doc_id, pos, word, sum(change) OVER (PARTITION BY doc_id ORDER BY pos
         RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM covered),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM opened WHERE word IS NOT NULL AND depth = 0 GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length,
       b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
       sha256(coalesce(l.listing, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM texts2 d LEFT JOIN listed l USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
