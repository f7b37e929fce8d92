from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from vitalgrid.llm import queries, toxicity


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    syllables = ["ta", "ri", "mo", "len", "bus", "ke", "no", "wal"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    bags = []
    for i in range(400):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            words[rng.randrange(60)] = rng.choice(["zwixel", "grumpf"])
        bags.append((" ".join(words), int(i % 4 == 0)))
    return toxicity.fit(bags)


def test_gaps_and_inserted_characters(model):
    bad = ["you zwixel", "a zw*ixel here", "grum-pf", "grruumpf", "so z w i x e l it is", "(ZWIXEL!)", "zwi1xel"]
    good = ["tari mo len", "", None, "buske no wal", "x y", "talen rimo"]
    assert (toxicity.score_texts(model, bad, {}) >= toxicity.THRESHOLD).all()
    assert (toxicity.score_texts(model, good, {}) < toxicity.THRESHOLD).all()


def test_scores_are_the_kernel_machine(model):
    """The table of triples gives the sum over explicit triples."""
    for word in ("zwixel", "tarimo", "aabbcc", "a", "m.o.l"):
        marked = toxicity.marked(word)
        value = norm = 0.0
        for i, j, k in itertools.combinations(range(len(marked)), 3):
            x, y, z = (int(model.code[ord(marked[n])]) for n in (i, j, k))
            if k - i < toxicity.SPAN and min(x, y, z) > 0 and x != y and y != z:
                weight = toxicity.DECAY ** (k - i + 1)
                value += weight * float(model.weight[(x * toxicity.SYMBOLS + y) * toxicity.SYMBOLS + z])
                norm += weight**2
        expected = (value / norm**0.5 if norm else 0.0) + model.bias
        assert toxicity.raw_scores(model, [word])[0] == pytest.approx(expected, rel=1e-4, abs=1e-5)


def test_long_texts_are_read_whole(model):
    texts = ["ta ri " * 20_000 + "zwixel", "x" * 100_000 + "zwixel", "tari" * 10_000]
    assert (toxicity.score_texts(model, texts, {}) >= toxicity.THRESHOLD).tolist() == [True, True, False]


def test_one_label_only():
    for label in (0, 1):
        some = toxicity.fit([("a b c", label)] * 3)
        found = toxicity.score_texts(some, ["a", None, "zzz"], {})
        assert len(set(found.tolist())) == 1 and 0 <= found[0] <= 1
    assert toxicity.score_texts(toxicity.fit([]), ["a"], {}).shape == (1,)


def test_held_out_documents(spark, sf):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op8_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.9


def test_odd_rows(spark, frame, model):
    docs = frame([(None, None), (1, ""), (2, "zwixel"), (2, "zwixel"), (3, "ta " * 50_000)])
    docs = docs.withColumnRenamed("n_chars", "score")
    found = toxicity.toxicity(docs, model, ["doc_id"]).collect()
    assert [r.score >= 0.3 for r in found] == [False, False, True, True, False]
    assert toxicity.toxicity(docs.limit(0), model, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([(2, 1), (2, 0), (1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).weight.shape == (toxicity.SYMBOLS**3,)
    assert toxicity.train(docs, labels.limit(0)).slope == 0
