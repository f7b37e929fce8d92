"""Secrets in texts: fixed patterns, and strings that look drawn at random rather than written.

Two Markov chains over characters are trained on samples that the patterns label: values that a pattern
matches are random strings, all other identifiers of the corpus are ordinary. A string is a secret if the
log-likelihood ratio of the chains exceeds THRESHOLD, and MEAN for each of its characters: words of a
language that the corpus hardly holds add up to a high ratio, too, but slowly. The chain of random strings is mixed evenly with
draws of equal probability, so that alphabets which no pattern knows (mixed case, base64) are recognised.

Training counts pairs of characters over all texts, whatever their number; the counts are one row a pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.text import chunks, text_bytes

# fixed values: the patterns of the base kinds, in the order of the kinds, and their least lengths
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
KEYWORDS = ("password", "passwd", "secret", "token", "api")
VALUE, ACCESS, HEX = 12, re.compile("AKIA[A-Z0-9]{14,}"), re.compile("[0-9a-f]{16,}")

ADDED = "random"  # kind of the spans that the chains add
IDENTIFIER = 6  # characters of an ordinary identifier that is counted
SHORTEST = 16  # characters of a string that is judged
DISTINCT = 6  # different characters that it has at least
THRESHOLD = 12.0  # log-likelihood ratio, in nats
MEAN = 0.9  # the same, for each character
SMOOTHING = 0.5  # added to the count of each pair

# characters of identifiers, numbered; 0 stands before the first one
LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SYMBOLS = len(LETTERS) + 1
SYMBOL = np.zeros(256, np.int64)
SYMBOL[np.frombuffer(LETTERS, np.uint8)] = np.arange(1, SYMBOLS)
SPAN = T.StructType(
    [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]
)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the matches of the patterns, by start, then kind as listed; the value of
    an assignment is what it assigns.

    A match consumes its text even if it is too short to count. A run of the characters of the other two
    kinds is matched whole, so there their least length can be part of the pattern.
    """
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(*m.span(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE]
    if "AKIA" in text:
        found += [(*m.span(), 1, m[0]) for m in ACCESS.finditer(text)]
    found += [(*m.span(), 2, m[0]) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], s[2], s[1]))
    return [(start, end, KINDS[kind], value) for start, end, kind, value in found]


def identifiers(data: np.ndarray, offsets: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the longest strings of LETTERS in each text that have `shortest` characters or more and
    no letter beyond ASCII beside them."""
    inside = SYMBOL[data] > 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    start, end = start[end - start >= shortest], end[end - start >= shortest]
    wide = np.concatenate((data >= 0x80, [False]))
    first, last = np.isin(start, offsets), np.isin(end, offsets)
    alone = (first | ~wide[start - 1]) & (last | ~wide[end])
    return start[alone], end[alone]


def pairs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all characters of the strings in a row: number of the pair with the one before, and the string."""
    sizes = end - start
    heads = np.cumsum(sizes) - sizes
    string = np.repeat(np.arange(len(start)), sizes)
    symbols = SYMBOL[data[np.arange(sizes.sum()) - heads[string] + start[string]]]
    before = np.concatenate(([0], symbols[:-1])) if len(symbols) else symbols
    before[heads[sizes > 0]] = 0
    return before * SYMBOLS + symbols, string


def counted(texts: pa.Array, shortest: int) -> np.ndarray:
    """Number of each pair of characters in the identifiers of the texts."""
    data, offsets = text_bytes(texts)
    return np.bincount(pairs(data, *identifiers(data, offsets, shortest))[0], minlength=SYMBOLS * SYMBOLS)


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The log-likelihood ratio (random to ordinary) of each character after each other.

    Random strings are the values of base spans, ordinary ones the identifiers of IDENTIFIER characters or
    more in the rest of the texts, each as often as it occurs. Null and empty texts add nothing; without any
    text both chains draw evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
        for batch in batches:
            for part in chunks(batch, "__text"):
                rest, values = part.column("__text").to_pylist(), []
                for i, text in enumerate(rest):
                    for start, end, _, value in base_spans(text) if text else ():
                        values.append(value)
                        rest[i] = rest[i][:start] + " " * (end - start) + rest[i][end:]
                counts[0] += counted(pa.array(values, pa.string()), 1)
                counts[1] += counted(pa.array(rest, pa.string()), IDENTIFIER)
        kind, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(pair), pa.array(counts[kind, pair])], ["kind", "pair", "n"]
        )

    parts = docs.select(F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, "kind long, pair long, n long")
    # at most two rows a pair of characters
    rows = parts.groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.full((2, SYMBOLS * SYMBOLS), SMOOTHING)
    for r in rows:
        counts[r.kind, r.pair] += r.n
    counts = counts.reshape(2, SYMBOLS, SYMBOLS)[:, :, 1:]
    drawn, written = counts / counts.sum(axis=2, keepdims=True)
    ratio = np.log((drawn + 1 / (SYMBOLS - 1)) / 2) - np.log(written)
    return np.hstack((np.zeros((SYMBOLS, 1)), ratio)).ravel()


def random_strings(data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges and ratios of the strings that exceed THRESHOLD and MEAN, with up to two signs = that pad them."""
    start, end = identifiers(data, offsets, SHORTEST)
    pair, string = pairs(data, start, end)
    total = np.bincount(string, ratio[pair], len(start))
    high = (total > THRESHOLD) & (total > MEAN * (end - start))
    start, end, total = start[high], end[high], total[high]
    few = [len(np.unique(data[a:b])) >= DISTINCT for a, b in zip(start.tolist(), end.tolist())]
    start, end, total = start[few], end[few], total[few]
    padded = np.concatenate((data == ord("="), [False]))
    for _ in range(2):
        end = end + (padded[end] & ~np.isin(end, offsets))
    return start, end, total


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; what overlaps an earlier one joins it."""
    out, at = [], 0
    for start, end, kind in spans:
        if end > at:
            out.append(text[at:start])
            if start >= at:
                out.append(f"[{kind}]")
            at = end
    return "".join(out) + text[at:]


def with_secrets(docs: DataFrame, ratio: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row, with spans (array of start, end, kind; code points, end exclusive; by
    start, then kind as listed) and redacted, the text with its spans replaced by their kinds.

    Base spans always stay, also where those of two kinds overlap; strings that the chains find are added
    where they overlap none. A null text is empty. Rows are handled one by one, so ids may be null or
    repeated; columns of `keep` that bear the names of results are replaced by these.
    """
    keep = [c for c in keep if c not in ("spans", "redacted")]
    model = docs.sparkSession.sparkContext.broadcast(ratio)  # one number a pair of characters
    struct = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                texts = [t or "" for t in part.column("__text").to_pylist()]
                found = [[(a, b, kind) for a, b, kind, _ in base_spans(t)] for t in texts]
                data, offsets = text_bytes(part.column("__text"))
                start, end, _ = random_strings(data, offsets, model.value)
                upto = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                owner = np.searchsorted(offsets, start, "right") - 1
                for i, a, b in zip(owner.tolist(), upto[start].tolist(), upto[end].tolist()):
                    a, b = a - int(upto[offsets[i]]), b - int(upto[offsets[i]])
                    if all(b <= s or e <= a for s, e, k in found[i] if k != ADDED):
                        found[i].append((a, b, ADDED))
                rank = {k: nr for nr, k in enumerate((*KINDS, ADDED))}
                for spans in found:
                    spans.sort(key=lambda s: (s[0], rank[s[2]], s[1]))
                edges = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = pa.array([dict(zip(("start", "end", "kind"), s)) for spans in found for s in spans], struct)
                clean = pa.array([redacted(t, s) for t, s in zip(texts, found)], pa.string())
                kept = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.ListArray.from_arrays(pa.array(edges), flat), clean], [*keep, "spans", "redacted"]
                )

    added = [T.StructField("spans", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())]
    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    return narrow.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added))
