"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language accepts exactly the substrings of that text. A document
is parsed against each automaton into the fewest phrases that are substrings, each as long as it can
be. The number of phrases times log2 of the training length, by symbol, estimates the cross entropy; the
language with the least wins.

The automata come from a bounded sample: at most SAMPLE documents a language with at most PIECE characters of
each, and CHARS symbols a language and TABLE symbols for all languages together, which bounds the
broadcast tables. Whole texts are parsed, in segments of SEGMENT symbols that advance side by side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.common import lowest
from vitalgrid.llm.text import chunks

SAMPLE, PIECE = 40, 1000  # training documents a language, and characters of each
CHARS, TABLE = 24_000, 480_000  # training symbols a language, and for all
SYMBOLS = 64  # the commonest letters; 0: other letters, 1: a run of anything else
SEGMENT = 512
UNDETERMINED = "und"


@dataclass
class Model:
    """Automata of all languages in one table.

    step: next state (times SYMBOLS) by state and symbol, -1 where no substring goes on so;
    root: first state of each language; again: state after a phrase that begins with a symbol;
    bits: log2 of each training length; code: symbol of each code point.
    """

    names: list[str]
    step: np.ndarray
    root: np.ndarray
    again: np.ndarray
    bits: np.ndarray
    code: np.ndarray


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the start."""
    after: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return after


def symbols_of(texts: list[str], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, and the offset of each text; runs of non-letters are one symbol."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = code[points]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in lowered])))
    keep = symbols != 1
    keep[1:] |= symbols[:-1] != 1
    begins = offsets[:-1][offsets[:-1] < len(symbols)]
    keep[begins] = True
    places = np.concatenate(([0], np.cumsum(keep)))
    return symbols[keep], places[offsets]


def fit(samples: dict[str, list[str]]) -> Model:
    """Automata from texts by language."""
    letters = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
    code = np.ones(0x110000, np.uint8)
    code[[i for i in range(0x110000) if chr(i).isalpha()]] = 0
    for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - 2]):
        code[ord(c)] = i + 2
    room = min(CHARS, TABLE // max(1, len(samples)))
    names, tables, roots, again, bits = [], [], [], [], []
    size = 0
    for name in sorted(samples):
        symbols, _ = symbols_of([" ".join(samples[name])], code)
        symbols = symbols[:room]
        if not (symbols > 1).any():
            continue
        states = suffix_automaton([int(c) for c in symbols])
        table = np.full((len(states), SYMBOLS), -1, np.int32)
        for state, after in enumerate(states):
            for c, to in after.items():
                table[state, c] = (size + to) * SYMBOLS
        names.append(name)
        tables.append(table)
        roots.append(size * SYMBOLS)
        again.append(np.where(table[0] < 0, size * SYMBOLS, table[0]))
        bits.append(np.log2(len(symbols) + 1))
        size += len(states)
    empty = np.zeros((0, SYMBOLS), np.int32)
    return Model(
        names,
        np.concatenate([empty, *tables]).ravel(),
        np.array(roots, np.int32),
        np.array([*again], np.int32).reshape(len(names), SYMBOLS),
        np.array(bits),
        code,
    )


def phrases(model: Model, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of phrases of each text (rows) against each language (columns)."""
    counts = np.zeros((len(offsets) - 1, len(model.names)), np.int64)
    sizes = np.diff(offsets)
    pieces = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), pieces)
    nr = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[text] + nr * SEGMENT
    length = np.minimum(SEGMENT, offsets[text + 1] - start)
    order = np.argsort(-length, kind="stable")
    start, length, text = start[order], length[order], text[order]
    state = np.repeat(model.root[:, None], len(start), axis=1)
    begun = np.zeros(state.shape, np.int32)
    for i in range(int(length[0]) if len(length) else 0):
        active = int(np.searchsorted(-length, -i, "left"))
        c = symbols[start[:active] + i]
        before = state[:, :active]
        now = model.step[before + c]
        missed = now < 0
        # a phrase begins where the last cannot go on, and after a symbol that no substring has
        begun[:, :active] += missed | (before == model.root[:, None])
        state[:, :active] = np.where(missed, model.again[:, c], now)
    for language in range(len(model.names)):
        counts[:, language] = np.bincount(text, begun[language], len(sizes))
    return counts


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1: by how much the best parse beats the second) of each text."""
    symbols, offsets = symbols_of(texts, model.code)
    lettered = np.zeros(len(texts), bool)
    where = np.flatnonzero(symbols != 1)
    lettered[np.searchsorted(offsets, where, "right") - 1] = True
    if not model.names:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    cost = phrases(model, symbols, offsets) * model.bits
    best = np.argmin(cost, axis=1)
    least = np.sort(cost, axis=1)
    second = least[:, 1] if len(model.names) > 1 else least[:, 0] * np.inf
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.where(lettered, np.clip(1 - least[:, 0] / second, 0, 1), 0.0)
    return [model.names[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)], score


def held_out(id_: Column) -> Column:
    """Whether a document is kept from training; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame) -> Model:
    """Automata from the labelled documents (doc_id, text, lang) that are not held out: SAMPLE of each
    language, those whose id and text hash lowest."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    pieces = known.select(
        "lang", F.substring("text", 1, PIECE).alias("piece"), F.xxhash64("doc_id", "text").alias("hash")
    )
    samples: dict[str, list[str]] = {}
    for row in lowest(pieces, "lang", F.col("hash"), SAMPLE).collect():  # SAMPLE pieces a language
        samples.setdefault(row.lang, []).append(row.piece)
    return fit({name: sorted(texts) for name, texts in samples.items()})


def language_id(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row, its lang_pred and score.

    Null texts and texts without letters are `und` with score 0, and so is all if nothing was learned.
    Ties go to the language first in order. Empty input gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                texts = [t or "" for t in part.column("__text").to_pylist()]
                names, score = predict(shared.value, texts)
                kept = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"]
                )

    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    return narrow.mapInArrow(run, schema)


def recognised(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told; those without letters go."""
    model = train(docs)
    if not model.names:  # nothing to learn from: a text needs letters, no more
        return docs.where(F.col("text").rlike(r"\p{L}"))
    columns = docs.columns
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col("text")
    )
    found = language_id(keyed, model, ["__row"])
    return found.where(F.col("lang_pred") != UNDETERMINED).select("__row.*")
