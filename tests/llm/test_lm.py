from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from vitalgrid.llm import lm, queries
from vitalgrid.llm.common import table
from vitalgrid.llm.text import BASE, RUN, SPACED, Words, mixed, powers


def test_probabilities_sum_to_one():
    weights = lm.initial()
    around = np.array([[3], [lm.PAD], [700], [1000]])
    every = np.repeat(around, lm.SIZE, axis=1)
    logs = lm.log_probabilities(weights, np.arange(lm.SIZE), every)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_contexts_stay_inside_texts():
    around = lm.contexts(np.array([5, 6, 7, 8]), np.array([0, 3, 3, 4]))
    p = lm.PAD
    assert around.T.tolist() == [[p, p, 6, 7], [p, 5, 7, p], [5, 6, p, p], [p, p, p, p]]


def test_training_steps_follow_the_gradient():
    rng = np.random.default_rng(0)
    weights = lm.initial()
    tokens = rng.integers(0, lm.SIZE, 50)
    around = lm.contexts(tokens, np.array([0, 20, 50]))
    seen = {}

    class Record(dict):
        def __getitem__(self, key):
            return super().__getitem__(key)

    squares = Record({k: np.zeros_like(v) for k, v in weights.items()})
    before = {k: v.copy() for k, v in weights.items()}
    lm.train_on(weights, squares, tokens, around)
    for name, at in (("class_w", (3, 5)), ("embed", (1, int(around[1][7]), 2)), ("word_b", (int(tokens[0]) // 32, int(tokens[0]) % 32))):
        low, high = ({k: v.astype(np.float64) for k, v in before.items()} for _ in range(2))
        low[name][at] -= 1e-4
        high[name][at] += 1e-4
        slope = -(lm.log_probabilities(high, tokens, around).mean() - lm.log_probabilities(low, tokens, around).mean()) / 2e-4
        assert squares[name][at] == pytest.approx(slope**2, rel=0.05), name
        seen[name] = slope
    assert any(abs(s) > 1e-6 for s in seen.values())


def plain_log_softmax(x):
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def plain_train(weights, squares, tokens, around):
    """One step of Adagrad, class after class, each with its own softmax and update."""

    def move(target, past, gradient):
        past += gradient * gradient
        target -= lm.STEP * gradient / (np.sqrt(past) + lm.EPSILON)

    n, kind, member = len(tokens), tokens // lm.MEMBERS, tokens % lm.MEMBERS
    hidden = np.repeat(weights["hidden"][None, :], n, axis=0)
    for place, near in enumerate(around):
        hidden += weights["embed"][place][near]
    hidden = np.tanh(hidden)
    error = np.exp(plain_log_softmax(hidden @ weights["class_w"] + weights["class_b"]))
    error[np.arange(n), kind] -= 1
    error /= n
    back = error @ weights["class_w"].T
    steps = [("class_w", hidden.T @ error, ...), ("class_b", error.sum(axis=0), ...)]
    for c in np.unique(kind):
        rows = np.flatnonzero(kind == c)
        error = np.exp(plain_log_softmax(hidden[rows] @ weights["word_w"][c] + weights["word_b"][c]))
        error[np.arange(len(rows)), member[rows]] -= 1
        error /= n
        back[rows] += error @ weights["word_w"][c].T
        steps += [("word_w", hidden[rows].T @ error, c), ("word_b", error.sum(axis=0), c)]
    back *= 1 - hidden * hidden
    steps.append(("hidden", back.sum(axis=0), ...))
    for place, near in enumerate(around):
        sums = [np.bincount(near, column.astype(float), lm.SIZE + 1) for column in back.T]
        steps.append(("embed", np.stack(sums, axis=1).astype(np.float32), place))
    for name, gradient, where in steps:
        move(weights[name][where], squares[name][where], gradient)


def trained(step, tokens, around):
    """Weights and squares after some steps from the same start."""
    weights = lm.initial()
    squares = {k: np.zeros_like(v) for k, v in weights.items()}
    for _ in range(5):
        step(weights, squares, tokens, around)
    return np.concatenate((lm.flat(weights), lm.flat(squares)))


@pytest.mark.parametrize("n", [1, 3, 128, lm.BATCH])
def test_a_training_step_equals_one_class_after_the_other(n, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 1)  # one step over all tokens
    tokens = np.minimum(np.random.default_rng(n).zipf(1.3, n), lm.SIZE) - 1
    around = lm.contexts(tokens, np.array([0, n // 2, n]))
    assert np.allclose(trained(lm.train_on, tokens, around), trained(plain_train, tokens, around), rtol=1e-4, atol=1e-6)


def test_softmaxes_of_a_batch_cover_all_its_classes_at_once(monkeypatch):
    """A batch of every class takes as many exponentials and square roots as a batch of one."""
    calls = []
    for name in ("exp", "sqrt"):
        plain = getattr(np, name)
        monkeypatch.setattr(lm.np, name, lambda *a, plain=plain, **k: calls.append(1) or plain(*a, **k))

    def count(tokens):
        calls.clear()
        around = lm.contexts(tokens, np.array([0, len(tokens)]))
        trained(lm.train_on, tokens, around)
        lm.log_probabilities(lm.initial(), tokens, around)
        return len(calls)

    assert count(np.arange(100) * 10) == count(np.arange(100) % lm.MEMBERS)


def test_contexts_of_random_texts():
    rng = np.random.default_rng(6)
    for _ in range(50):
        lengths = rng.integers(0, 5, rng.integers(1, 8))
        first = np.concatenate(([0], np.cumsum(lengths)))
        tokens = rng.integers(0, lm.SIZE, first[-1])
        plain = []
        for a, b in zip(first, first[1:]):
            plain += [[int(tokens[i + o]) if a <= i + o < b else lm.PAD for o in lm.PLACES] for i in range(a, b)]
        assert lm.contexts(tokens, first).T.tolist() == plain


def test_hashes_of_words_are_those_of_their_bytes_anywhere():
    """Words around the ends of the runs that the powers of the hash are taken in."""
    texts = [" " * pad + "straße x" + " y" * 3000 + " straße" for pad in (0, 1, 4089, 4090, 4095, 4096, 8187)]
    texts += ["a" * 4095 + " b", "a" * 4096 + " b", "a" * 4097 + " b", "a" * 9000, ""]

    def plain(word):
        base, total = int(BASE), 0
        for i, byte in enumerate(word.encode()):
            total += (byte + 1) * pow(base, i, 1 << 64)
        total = total * pow(base, -len(word.encode()), 1 << 64) % (1 << 64)
        return int(mixed(np.array([total], np.uint64))[0])

    low, high = powers(BASE, 3 * RUN)
    for i in (0, 1, RUN - 1, RUN, 2 * RUN + 5, 3 * RUN):
        assert int(low[i % RUN]) * int(high[i // RUN]) % (1 << 64) == pow(int(BASE), i, 1 << 64)
    for some in (texts, texts[:1], texts[-1:]):
        expected = [plain(w) for text in some for w in text.split()]
        assert Words(pa.array(some), SPACED).hashes().tolist() == expected


def test_order_of_words_matters(frame):
    rng = random.Random(2)
    chain = {w: [f"w{(i * 7 + k) % 30}" for k in range(2)] for i, w in enumerate(f"w{i}" for i in range(30))}

    def walk():
        out = ["w0"]
        for _ in range(200):
            out.append(rng.choice(chain[out[-1]]))
        return out

    docs = [(i, " ".join(walk())) for i in range(60)]
    shuffled = []
    for i in range(60, 70):
        words = walk()
        rng.shuffle(words)
        shuffled.append((i, " ".join(words)))
    found = {r.doc_id: r for r in lm.lm_scores(frame(docs + shuffled), ["doc_id"]).collect()}
    mean = lambda ids: np.mean([found[i].log_likelihood / found[i].n_tokens for i in ids])
    assert mean(range(60)) > mean(range(60, 70)) + 0.3


def plain_score(text, model, times):
    """The log-likelihood of a text word by word, with explicit softmaxes."""
    words = text.lower().split()
    if not words:
        return 0.0
    hashes = Words(pa.array([text]), SPACED).hashes()
    tokens = lm.token_ids(hashes, model.known, model.rank)
    in_bucket = {}
    for h, n in times.items():
        token = int(lm.token_ids(np.array([h], np.uint64), model.known, model.rank)[0])
        in_bucket[token] = in_bucket.get(token, 0) + n
    w, total = {k: v.astype(np.float64) for k, v in model.weights.items()}, 0.0
    for i, token in enumerate(tokens):
        hidden = w["hidden"].copy()
        for place, offset in enumerate(lm.PLACES):
            near = tokens[i + offset] if 0 <= i + offset < len(tokens) else lm.PAD
            hidden += w["embed"][place][near]
        hidden = np.tanh(hidden)
        kind, member = divmod(int(token), lm.MEMBERS)
        first = np.exp(hidden @ w["class_w"] + w["class_b"])
        second = np.exp(hidden @ w["word_w"][kind] + w["word_b"][kind])
        total += np.log(first[kind] / first.sum()) + np.log(second[member] / second.sum())
        if token >= lm.FREQUENT:
            total += np.log(times[int(hashes[i])] / in_bucket[int(token)])
    return total


def test_scores_equal_a_plain_loop(frame):
    rng = random.Random(5)
    docs = [(i, " ".join(f"W{rng.choice((rng.randrange(20), rng.randrange(4000)))}" for _ in range(rng.randint(0, 120)))) for i in range(150)]
    docs += [(150, docs[0][1]), (151, "solo"), (152, "rare rare " + "rare " * 50)]
    df = frame(docs)
    model = lm.train(df)
    times = {r.word % (1 << 64): r.times for r in model.counts.collect()}
    found = {r.doc_id: r for r in lm.scored(df, model, ["doc_id"]).collect()}
    assert len(times) > lm.FREQUENT + 100
    assert model.times.sum() == sum(times.values()) == sum(r.n_tokens for r in found.values())
    for i, text in docs:
        assert found[i].n_tokens == len(text.split())
        assert found[i].log_likelihood == pytest.approx(plain_score(text, model, times), rel=1e-4, abs=1e-4)


def test_what_is_gathered_grows_with_the_vocabulary(frame):
    sizes = []
    for n in (50, 200):
        docs = [(i, " ".join(f"w{i}x{j}" for j in range(20)) + " the end") for i in range(n)]
        sizes.append(lm.train(frame(docs)).counts.count())
    assert sizes == [50 * 20 + 2, 200 * 20 + 2]


def test_words_seen_twice_score_higher(frame):
    """Documents that occur twice have words of twice the probability, whatever their bucket."""
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))) for i in range(200)]
    docs += [(200 + i, docs[i][1]) for i in range(20)]
    found = {r.doc_id: r.log_likelihood / r.n_tokens for r in lm.lm_scores(frame(docs), ["doc_id"]).collect()}
    twice, once = [found[i] for i in range(20)], [found[i] for i in range(20, 200)]
    assert np.mean(twice) > np.mean(once) + 0.3


def test_table(spark, sf):
    """The words' likelihood under both sides exceeds that under their shares of the corpus alone."""
    rows = queries.QUERIES["op7_lm_scores"](spark, sf).collect()
    total = sum(r.n_tokens for r in rows)
    counts = lm.word_counts(table(spark, sf, "documents", "text").withColumnRenamed("text", "__text"))
    times = np.array(counts.toArrow()["times"], float)
    alone = (times * np.log(times / times.sum())).sum() / total
    assert times.sum() == total and all(r.log_likelihood <= 0 for r in rows)
    assert sum(r.log_likelihood for r in rows) / total > alone + 0.3


def test_odd_rows(frame):
    docs = frame([(None, None), (1, ""), (2, " \n"), (3, "one"), (3, "one"), (4, "a b " * 20000)])
    docs = docs.withColumnRenamed("n_chars", "n_tokens")
    found = sorted(lm.lm_scores(docs, ["doc_id"]).collect(), key=lambda r: r.n_tokens)
    assert [r.n_tokens for r in found] == [0, 0, 0, 1, 1, 40000]
    assert [r.log_likelihood for r in found[:3]] == [0, 0, 0] and found[3].log_likelihood == found[4].log_likelihood
    assert lm.lm_scores(docs.limit(0), ["doc_id"]).count() == 0
