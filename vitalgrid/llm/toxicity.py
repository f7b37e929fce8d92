"""Toxicity by a support vector machine over a gapped subsequence kernel.

The kernel of two tokens counts the ordered triples of symbols that both contain, with gaps, each weighted
by DECAY to the number of symbols it spans (at most SPAN): "id*iot" and "idiiot" share most triples with
"idiot". Tokens are compared through landmarks (Nyström): the kernel to the landmarks, whitened by the
kernel among them, gives features in which a linear machine with squared hinge loss is trained.

A labelled document is a bag of sentences: each sentence of a clean document is clean, and of a toxic
document only the sentences with its strongest evidence count as toxic. A sentence is as toxic as its
worst token, and a document as its worst sentence; a logistic curve fitted to the sample turns that
into a score.

Since the kernel is a product of triple counts, the trained machine is one weight for each triple of symbols:
scoring needs a table of SYMBOLS**3 numbers and no landmark, whatever the number of landmarks.
The sample is bounded: BAGS documents of either label, of at most LONGEST characters each.
"""

from __future__ import annotations

import re
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

BAGS, LONGEST = 2000, 20_000
SYMBOLS = 64  # 1 to 62: the commonest letters; 63: a token's start; all else is 0 and only widens gaps
START = "^"
SPAN, DECAY = 5, 0.7
TOXIC_MARKS, CLEAN_MARKS = 160, 160  # landmarks
ROUNDS = 3  # of choosing the toxic sentences' evidence and the hardest clean words anew
TIMES, MORE = 3, 5  # evidence: a word in so many toxic documents, so many times likelier there
CLEAN_WORDS, HARD_WORDS = 6000, 3000  # of clean documents: the commonest, and those misjudged most
TOKEN = 32  # symbols of a token that are compared at once; longer ones in overlapping windows
THRESHOLD = 0.3
SPACED_OUT = re.compile(r"(?<!\S)(?:\S[ \t]+){3,}\S(?!\S)")  # letters set apart
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”„‘’…*#%&$~_-+=/|\\"

# offsets of the second and third symbol of a triple, and the triple's weight
TRIPLES = [
    (a, b, DECAY ** (b + 1)) for b in range(2, SPAN) for a in range(1, b)
]


@dataclass
class Model:
    """code: symbol of each code point; weight: of each triple; bias; slope and shift of the curve."""

    code: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float


def tokens(text: str) -> list[str]:
    """Lower-cased tokens between white space, and letters set apart read as one token."""
    low = text.lower()
    return low.split() + ["".join(m[0].split()) for m in SPACED_OUT.finditer(low)]


def marked(word: str) -> str:
    """A token as the kernel sees it: without punctuation around it, after a mark of its start."""
    return START + word.strip(PUNCTUATION)


def triples(words: list[str], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight) of every triple of known symbols in which neighbours differ; without the
    last condition, repeated letters would outweigh all else."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = code[points].astype(np.int32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    found = []
    for a, b, weight in TRIPLES:
        n = max(0, len(symbols) - b)
        x, y, z = symbols[:n], symbols[a : n + a], symbols[b : n + b]
        at = np.flatnonzero((owner[:n] == owner[b : n + b]) & (x > 0) & (y > 0) & (z > 0) & (x != y) & (y != z))
        key = (x[at] * SYMBOLS + y[at]) * SYMBOLS + z[at]
        found.append((owner[at], key, np.full(len(at), weight, np.float32)))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def windows(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Pieces of at most TOKEN symbols, and the word of each."""
    pieces, owner = [], []
    for i, word in enumerate(words):
        stops = range(0, max(1, len(word) - TOKEN // 2), TOKEN // 2) if len(word) > TOKEN else (0,)
        for at in stops:
            pieces.append(word[at : at + TOKEN])
            owner.append(i)
    return pieces, np.array(owner, np.int64)


def raw_scores(model: Model, words: list[str]) -> np.ndarray:
    """The machine's value for each word: over its windows, the largest."""
    if not words:
        return np.zeros(0)
    pieces, owner = windows([marked(w) for w in words])
    of, key, weight = triples(pieces, model.code)
    value = np.bincount(of, weight * model.weight[key], len(pieces))
    norm = np.sqrt(np.bincount(of, weight * weight, len(pieces)))
    value = np.divide(value, norm, out=np.zeros(len(pieces)), where=norm > 0) + model.bias
    found = np.full(len(words), -np.inf)
    np.maximum.at(found, owner, value)
    return found


def _kernel(words: list[str], code: np.ndarray, columns: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Normalised kernel of each word to each landmark; marks: weights of the landmarks' triples."""
    found = np.zeros((len(words), marks.shape[1]))
    for at in range(0, len(words), 1000):
        some = words[at : at + 1000]
        of, key, weight = triples(some, code)
        norm = np.sqrt(np.bincount(of, weight * weight, len(some)))
        order = np.flatnonzero(columns[key] >= 0)
        order = order[np.argsort(of[order], kind="stable")]
        if len(order):
            first = np.flatnonzero(np.diff(of[order], prepend=-1))
            rows = weight[order, None] * marks[columns[key[order]]]
            found[at + of[order][first]] = np.add.reduceat(rows, first, axis=0)
        found[at : at + len(some)] /= np.where(norm > 0, norm, 1)[:, None]
    return found


def _machine(features: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> np.ndarray:
    """Weights of the squared-hinge machine, by Newton steps over its active rows; last: bias."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):
        active = labels * (x @ w) < 1
        xa = x[active] * importance[active, None]
        new = np.linalg.solve(xa.T @ x[active] + np.diag(ridge), xa.T @ labels[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _cut(words: list[str]) -> list[str]:
    return [marked(w)[:TOKEN] for w in words]


def fit(bags: list[tuple[str, int]]) -> Model:
    """A model from (text, label) documents; without both labels it scores all alike."""
    bags = sorted(bags)
    letters = Counter(c for text, _ in bags for c in text.lower() if c.isalpha())
    code = np.zeros(0x110000, np.uint8)
    for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - 2]):
        code[ord(c)] = i + 1
    code[ord(START)] = SYMBOLS - 1
    blank = Model(code, np.zeros(SYMBOLS**3, np.float32), 0.0, 0.0, 0.0)
    sides = {y: [t for t, label in bags if label == y] for y in (0, 1)}
    if not sides[0] or not sides[1]:
        rate = np.log((len(sides[1]) + 0.1) / (len(sides[0]) + 10.0))
        return blank if not bags else Model(code, blank.weight, 0.0, 0.0, float(rate))
    # a third of either side fits the curve: the machine has not seen it
    curve = {y: texts[::3] for y, texts in sides.items()}
    train = {y: [t for i, t in enumerate(texts) if i % 3] or texts for y, texts in sides.items()}
    held = {y: Counter(w for t in texts for w in set(_cut(tokens(t)))) for y, texts in train.items()}
    n = {y: len(texts) for y, texts in train.items()}
    lettered = re.compile(r"[^\W\d_].*[^\W\d_].*[^\W\d_]")

    def evidence(word: str) -> float:
        """How much likelier the word is in toxic documents, with half a clean document as prior; 0
        below what counts as evidence."""
        if held[1][word] < TIMES or not lettered.search(word):
            return 0.0
        ratio = (held[1][word] / n[1]) / ((held[0][word] + 0.5) / n[0])
        return ratio if ratio >= MORE else 0.0

    toxic = [w for w in held[1] if evidence(w)]
    toxic.sort(key=lambda w: (-evidence(w), w))
    clean = [w for w, _ in sorted(held[0].items(), key=lambda x: (-x[1], x[0])) if lettered.search(w)]
    suspect = set(toxic)
    marks = toxic[:TOXIC_MARKS] + [w for w in clean if w not in suspect][:CLEAN_MARKS]
    if not marks:
        return blank
    of, key, weight = triples(marks, code)
    norm = np.sqrt(np.bincount(of, weight * weight, len(marks)))
    used, row = np.unique(key, return_inverse=True)
    table = np.zeros((len(used), len(marks)))
    np.add.at(table, (row, of), weight / norm[of])
    columns = np.full(SYMBOLS**3, -1, np.int64)
    columns[used] = np.arange(len(used))

    among = _kernel(marks, code, columns, table)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])

    rest = [w for w in clean if w not in suspect]
    chosen = rest[:CLEAN_WORDS]
    sentences = [s for t in train[1] for s in SENTENCE.split(t) if s]
    lists = [_cut(tokens(s)) for s in sentences]
    strength = {w: evidence(w) for words in lists for w in words}
    model = blank
    for _ in range(ROUNDS):
        witness: Counter = Counter()
        for words in lists:
            best = max(words, key=lambda w: (strength[w], w), default=None)
            if best is not None and strength[best] > 0:
                witness[best] += 1
        if not witness:
            return blank
        positive = sorted(witness)
        features = _kernel([*chosen, *positive], code, columns, table) @ whiten
        labels = np.concatenate([-np.ones(len(chosen)), np.ones(len(positive))])
        # a word counts as often as documents or sentences hold it, dampened
        importance = np.sqrt([held[0][w] for w in chosen] + [witness[w] for w in positive])
        w = _machine(features, labels, importance)
        dense = np.zeros(SYMBOLS**3, np.float32)
        dense[used] = table @ (whiten @ w[:-1])
        model = Model(code, dense, float(w[-1]), 0.0, 0.0)
        raw = raw_scores(model, [x[len(START) :] for x in rest])
        hard = np.argsort(-raw, kind="stable")[:HARD_WORDS]
        chosen = sorted({*chosen, *(rest[i] for i in hard)})
        names = sorted(strength)
        raw = raw_scores(model, [x[len(START) :] for x in names])
        # evidence of a later round: the machine's own value, where it is positive
        strength = {x: float(r) if held[1][x] >= TIMES and not held[0][x] else 0.0 for x, r in zip(names, raw)}

    rest_of = [(t, y) for y in (0, 1) for t in curve[y]]
    worst = np.array([max(raw_scores(model, tokens(t)), default=-9.0) for t, _ in rest_of])
    label = np.array([y for _, y in rest_of])
    model.slope, model.shift = _curve(worst, label)
    return model


def _curve(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of a bag's label over its worst value."""
    weight = np.ones(len(label))
    middle = np.median(value[label == 1]) / 2 + np.quantile(value[label == 0], 0.99) / 2
    x = np.stack([value - middle, np.ones(len(value))], axis=1)
    # targets short of 0 and 1 keep the curve finite where the sides separate
    target = np.where(label == 1, 0.995, 0.005)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-6 * w
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1] - max(w[0], 1e-3) * middle)


def score_texts(model: Model, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
    """Score of each text; `known` keeps the values of words seen before."""
    lists = [tokens(t or "") for t in texts]
    new = list({w for words in lists for w in words if w not in known})
    for at in range(0, len(new), 50_000):
        some = new[at : at + 50_000]
        known.update(zip(some, raw_scores(model, some).tolist()))
    worst = np.array([max(map(known.__getitem__, words), default=-np.inf) for words in lists])
    if model.slope == 0:
        worst = np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(model.slope * worst + model.shift, -700, 700)))


def held_out(id_: Column) -> Column:
    """Whether a document's label is kept from training; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labels (doc_id, toxic) that are not held out: of either label the BAGS documents
    whose id hashes lowest. A document that is labelled both ways is toxic; null labels are none."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = lowest(known, "toxic", F.xxhash64("doc_id"), BAGS)
    texts = docs.where(F.length("text") <= LONGEST).select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")  # 2 * BAGS rows at most
    return fit([(r.text, r.toxic) for r in rows.dropDuplicates(["doc_id"]).select("text", "toxic").collect()])


def toxicity(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row and its score.

    Null and empty texts have no token and get score 0, or the rate of toxic labels if the sample has one
    label only. Texts of any length are taken whole. Empty input gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for part in chunks(batch, "__text"):
                if len(known) > MEMORY:
                    known.clear()
                score = score_texts(shared.value, part.column("__text").to_pylist(), known)
                kept = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], [*keep, "score"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    return narrow.mapInArrow(run, schema)


MEMORY = 500_000  # words whose values a task keeps
