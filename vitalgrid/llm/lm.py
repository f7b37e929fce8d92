"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts each token from the REACH tokens on either side: one embedding table for each place of
the window, a tanh layer, and a softmax in two steps, the class of the token and the token in its class.
A document's score is the sum of the log-probabilities of all its words, each given both sides.

Words are lower-cased. The FREQUENT commonest words of the whole corpus are tokens of their own; the others
share BUCKETS tokens by hash. The probability of such a word is its bucket's, from the network, times its own
in the bucket: its occurrences in all documents over those of the bucket. So every word has a probability of
its own, and what is gathered, the table of word counts, grows with the vocabulary; it stays a table and
meets the documents' words in a join, where a document sends each distinct word once.

Counts and training cover all documents. The biases start at the logarithms of the tokens' shares. Documents
are dealt by a hash of their text into FOLDS, one after the other: each task trains a copy on every
token of its partition that is of the fold, and the copies are averaged by token count. What is
shuffled for that grows with the number of partitions; what reaches the driver is one set of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.common import saved
from vitalgrid.llm.text import SPACED, Words, chunks

CLASSES, MEMBERS = 32, 32
FREQUENT, BUCKETS = 768, 256  # together CLASSES * MEMBERS
SIZE = CLASSES * MEMBERS
PAD = SIZE  # beyond either end of a document
REACH, WIDTH = 2, 16
PLACES = [o for o in range(-REACH, REACH + 1) if o]
STEP, BATCH, EPSILON = 0.05, 8192, 1e-6
MIN_BATCH, STEPS = 128, 64  # a short slice is cut into up to STEPS batches
FOLDS = (0, 1, 4, 8)  # eighths of the hash range where the folds begin and end
SHAPES = {
    "embed": (len(PLACES), SIZE + 1, WIDTH),
    "hidden": (WIDTH,),
    "class_w": (WIDTH, CLASSES),
    "class_b": (CLASSES,),
    "word_w": (CLASSES, WIDTH, MEMBERS),
    "word_b": (CLASSES, MEMBERS),
}

Weights = dict[str, np.ndarray]


def initial(times: np.ndarray | None = None) -> Weights:
    """Random weights; with the occurrences of every token, biases that give each token its share."""
    rng = np.random.default_rng(7)
    found = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    found["embed"] = rng.normal(0, 0.1, SHAPES["embed"]).astype(np.float32)
    found["class_w"] = rng.normal(0, 0.1, SHAPES["class_w"]).astype(np.float32)
    found["word_w"] = rng.normal(0, 0.1, SHAPES["word_w"]).astype(np.float32)
    if times is not None:
        shares = (times + 1).reshape(CLASSES, MEMBERS)
        found["class_b"] = np.log(shares.sum(axis=1) / shares.sum()).astype(np.float32)
        found["word_b"] = np.log(shares / shares.sum(axis=1, keepdims=True)).astype(np.float32)
    return found


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> Weights:
    found, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        found[name] = np.array(values[at : at + size], np.float32).reshape(shape)
        at += size
    return found


def token_ids(hashes: np.ndarray, vocabulary: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Token of each word hash; vocabulary: sorted hashes of the frequent words, rank: their tokens."""
    bucket = FREQUENT + (hashes % np.uint64(BUCKETS)).astype(np.int64)
    if not len(vocabulary):
        return bucket
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, rank[at], bucket)


def contexts(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The tokens around each token (rows: PLACES), PAD beyond its text; first: where texts begin."""
    found = np.full((len(PLACES), len(tokens)), PAD, tokens.dtype)
    for i, offset in enumerate(PLACES):
        if offset < 0:
            found[i, -offset:] = tokens[:offset]
        else:
            found[i, :-offset] = tokens[offset:]
        # the shift crossed the edges of texts: what lies within its reach of them has no neighbour
        for k in range(abs(offset)):
            edge = first + k if offset < 0 else first - 1 - k
            found[i, edge[(edge >= 0) & (edge < len(tokens))]] = PAD
    return found


def _lowered(x: np.ndarray) -> np.ndarray:
    """Takes from each row its maximum, in place; numpy is slow along short rows, so these are turned."""
    x -= np.ascontiguousarray(x.T).max(axis=0)[:, None]
    return x


def _softmax(x: np.ndarray) -> np.ndarray:
    """The softmax of each row, in place."""
    _lowered(x)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return np.exp(x, out=x)


def _log_softmax_at(x: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The logarithm of each row's softmax at one column; changes x."""
    _lowered(x)
    own = x[np.arange(len(x)), column]
    return own - np.log(np.exp(x, out=x).sum(axis=1))


def _hidden(weights: Weights, around: np.ndarray) -> np.ndarray:
    total = np.repeat(weights["hidden"][None, :], around.shape[1], axis=0)
    for i in range(len(PLACES)):
        total += weights["embed"][i].take(around[i], axis=0)
    return np.tanh(total, out=total)


def _by_class(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of rows by class, and (class, first, end) of the rows of each class found in it."""
    order = np.argsort(kind.astype(np.uint8), kind="stable")  # small integers: a radix sort
    edges = np.concatenate(([0], np.cumsum(np.bincount(kind, minlength=CLASSES)))).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


def _in_class(weights: Weights, hidden: np.ndarray, groups: list[tuple[int, int, int]]) -> np.ndarray:
    """Inputs of the second softmax, of rows in the order of their classes."""
    found = np.empty((len(hidden), MEMBERS), hidden.dtype)
    for c, a, b in groups:
        np.matmul(hidden[a:b], weights["word_w"][c], out=found[a:b])
        found[a:b] += weights["word_b"][c]
    return found


def log_probabilities(weights: Weights, tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of each token given the tokens around it."""
    found = np.empty(len(tokens))
    for at in range(0, len(tokens), BATCH):
        own, near = tokens[at : at + BATCH], around[:, at : at + BATCH]
        hidden, kind, member = _hidden(weights, near), own // MEMBERS, own % MEMBERS
        logs = _log_softmax_at(hidden @ weights["class_w"] + weights["class_b"], kind)
        order, groups = _by_class(kind)
        words = _in_class(weights, hidden.take(order, axis=0), groups)
        logs[order] += _log_softmax_at(words, member[order])
        found[at : at + BATCH] = logs
    return found


def train_on(weights: Weights, squares: Weights, tokens: np.ndarray, around: np.ndarray) -> None:
    """One pass of Adagrad over the tokens, changing the weights and the sums of squared gradients."""

    def move(name: str, gradient: np.ndarray) -> None:
        squares[name] += gradient * gradient
        weights[name] -= STEP * gradient / (np.sqrt(squares[name]) + EPSILON)

    size = min(BATCH, max(MIN_BATCH, len(tokens) // STEPS))
    for at in range(0, len(tokens), size):
        own, near = tokens[at : at + size], around[:, at : at + size]
        n = len(own)
        hidden, kind, member = _hidden(weights, near), own // MEMBERS, own % MEMBERS
        error = _softmax(hidden @ weights["class_w"] + weights["class_b"])
        error[np.arange(n), kind] -= 1
        error /= n
        back = error @ weights["class_w"].T
        steps = {k: np.zeros_like(v) for k, v in weights.items()}
        steps["class_w"], steps["class_b"] = hidden.T @ error, error.sum(axis=0)
        # the rows in the order of their classes, so that only the products go class by class
        order, groups = _by_class(kind)
        mine = hidden.take(order, axis=0)
        error = _softmax(_in_class(weights, mine, groups))
        error[np.arange(n), member[order]] -= 1
        error /= n
        backs = np.empty_like(back)
        for c, a, b in groups:
            np.matmul(error[a:b], weights["word_w"][c].T, out=backs[a:b])
            steps["word_w"][c], steps["word_b"][c] = mine[a:b].T @ error[a:b], error[a:b].sum(axis=0)
        back[order] += backs
        back *= 1 - hidden * hidden
        steps["hidden"] = back.sum(axis=0)
        columns = np.ascontiguousarray(back.T, np.float64)
        for i in range(len(PLACES)):
            place = near[i].astype(np.int64)
            for k, column in enumerate(columns):
                steps["embed"][i][:, k] = np.bincount(place, column, SIZE + 1)
        for name, gradient in steps.items():
            move(name, gradient)


def batches_of(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, rank: np.ndarray) -> Iterator:
    """(slice, word hashes, tokens, first token of each text, tokens around each) of consecutive slices."""
    for batch in batches:
        for part in chunks(batch, "__text"):
            words = Words(part.column("__text"), SPACED)
            hashes = words.hashes()
            tokens = token_ids(hashes, vocabulary, rank)
            yield part, hashes, tokens, words.first, contexts(tokens, words.first)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, times) of each word hash of all documents, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                hashes = Words(part.column("__text"), SPACED).hashes()
                found, times = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], ["word", "times"]
                )

    counts = texts.mapInArrow(run, "word long, times long")
    return saved(counts.groupBy("word").agg(F.sum("times").alias("times")))


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the FREQUENT commonest words, the token of each, and the occurrences of every
    token; of equally common words the lower hash is the more frequent."""
    rows = counts.orderBy(F.desc("times"), "word").limit(FREQUENT).collect()
    words = np.array([r.word for r in rows], np.int64).view(np.uint64)
    times = np.zeros(SIZE)
    times[: len(rows)] = [r.times for r in rows]
    # the bits of an unsigned hash: BUCKETS is a power of two, so the remainder is the same
    bucket = F.pmod("word", F.lit(BUCKETS))
    for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum("times").alias("times")).collect():
        times[FREQUENT + r.bucket] = r.times
    for word, n in zip(words, times[: len(rows)].copy()):
        times[FREQUENT + int(word % np.uint64(BUCKETS))] -= n
    order = np.argsort(words)
    return words[order], order.astype(np.int64), times


@dataclass(frozen=True)
class Model:
    """Weights of the network, the vocabulary with its tokens, occurrences of every token, and the table
    of the occurrences of every word."""

    weights: Weights
    known: np.ndarray
    rank: np.ndarray
    times: np.ndarray
    counts: DataFrame


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """A model of all documents."""
    texts = docs.select(F.col(f"`{text_col}`").alias("__text"))
    counts = word_counts(texts)
    known, rank, times = vocabulary(counts)
    weights = initial(times)
    squares = {k: np.zeros_like(v) for k, v in weights.items()}
    eighth = F.pmod(F.xxhash64("__text"), F.lit(8))
    for low, high in zip(FOLDS, FOLDS[1:]):
        fold = texts.where((eighth >= low) & (eighth < high))
        weights, squares = _round(fold, weights, squares, known, rank)
    return Model(weights, known, rank, times, counts)


def _round(
    texts: DataFrame, weights: Weights, squares: Weights, known: np.ndarray, rank: np.ndarray
) -> tuple[Weights, Weights]:
    """Weights and squares after the texts: the mean of all copies, by tokens seen."""
    shared = texts.sparkSession.sparkContext.broadcast((flat(weights), flat(squares), known, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, past, words, order = shared.value
        mine, sums, seen = shaped(start), shaped(past), 0
        for _, _, tokens, _, around in batches_of(batches, words, order):
            train_on(mine, sums, tokens, around)
            seen += len(tokens)
        values = pa.array([np.concatenate((flat(mine), flat(sums))).astype(np.float64)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([seen]), values], ["seen", "weights"])

    copies = texts.mapInArrow(run, "seen long, weights array<double>").where("seen > 0")
    each = saved(copies).select("seen", F.posexplode("weights").alias("at", "value"))
    mean = F.sum(F.col("value") * F.col("seen")) / F.sum("seen")
    rows = each.groupBy("at").agg(mean.alias("mean")).toArrow().to_pydict()
    if not rows["at"]:
        return weights, squares
    found = np.zeros(len(rows["at"]))
    found[rows["at"]] = rows["mean"]
    half = len(found) // 2
    return shaped(found[:half]), shaped(found[half:])


def lm_scores(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row, n_tokens and log_likelihood, after training on all rows.

    Null and blank texts have no tokens and log-likelihood 0. Texts of any length are scored whole;
    repeated rows are scored alike. Of equally common words at the end of the vocabulary the lower hash has
    a token of its own. Empty input gives no rows.
    """
    return scored(docs, train(docs, text_col), keep, text_col)


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """`lm_scores` under a model that was trained on these documents."""
    shares = np.log(np.maximum(model.times[FREQUENT:], 1.0))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.known, model.rank, shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known, rank, bucket_logs = shared.value
        for part, hashes, tokens, first, around in batches_of(batches, known, rank):
            logs = log_probabilities(weights, tokens, around)
            rare = np.flatnonzero(tokens >= FREQUENT)
            logs[rare] -= bucket_logs[tokens[rare] - FREQUENT]
            sums = np.concatenate(([0.0], np.cumsum(logs)))
            # each distinct word of a text that shares a bucket, and how often it is there
            text = (np.searchsorted(first, rare, "right") - 1).astype(np.int64)
            own = hashes[rare]
            # by text, then word; equal words of a text are alike, so only the sort by text need be stable
            order = np.argsort(own)
            small = np.uint16 if len(first) <= 1 << 16 else np.int64  # short integers: a radix sort
            order = order[np.argsort(text[order].astype(small), kind="stable")]
            text, own = text[order], own[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(own)))
            edges = pa.array(np.searchsorted(text[at], np.arange(len(first))).astype(np.int32))
            columns = [
                pa.array(np.diff(first).astype(np.int64)),
                pa.array(np.diff(sums[first])),
                pa.ListArray.from_arrays(edges, pa.array(own[at].view(np.int64))),
                pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int32))),
            ]
            kept = [part.column(i) for i in range(len(keep) + 1)]
            names = [*keep, "__row", "n_tokens", "log_likelihood", "__words", "__times"]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names)

    narrow = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.monotonically_increasing_id().alias("__row"),
        F.col(f"`{text_col}`").alias("__text"),
    )
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [
            T.StructField("__row", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("log_likelihood", T.DoubleType()),
            T.StructField("__words", T.ArrayType(T.LongType())),
            T.StructField("__times", T.ArrayType(T.IntegerType())),
        ]
    )
    rows = saved(narrow.mapInArrow(run, schema))  # written, so that row numbers stay
    words = rows.select("__row", F.explode(F.arrays_zip("__words", "__times")).alias("w"))
    words = words.select("__row", F.col("w.__words").alias("word"), F.col("w.__times").alias("here"))
    # a word that occurs once adds the logarithm of 1
    often = model.counts.where("times > 1").select("word", F.log("times").alias("log_times"))
    # the table of counts follows the vocabulary, so neither side is broadcast
    met = words.hint("merge").join(often, "word")
    added = met.groupBy("__row").agg(F.sum(F.col("here") * F.col("log_times")).alias("__added"))
    total = F.col("log_likelihood") + F.coalesce("__added", F.lit(0.0))
    return (
        rows.drop("__words", "__times").hint("merge").join(added, "__row", "left")
        .select(*[F.col(f"`{c}`") for c in keep], "n_tokens", total.alias("log_likelihood"))
    )
