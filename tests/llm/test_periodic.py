from __future__ import annotations

import random

import numpy as np
import pytest

from vitalgrid.llm import periodic


def plain_runs(words, least=6, factor=4):
    """Every stretch with a smallest period, by trying all."""
    n, found = len(words), {}
    for q in range(1, n // factor + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, factor * q):
                found.setdefault((i, length), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def numbered(texts):
    first = np.cumsum([0, *map(len, texts)])
    ids = np.array([hash((w, 7)) & (2**64 - 1) for t in texts for w in t], np.uint64)
    return ids, first


def shifted(texts, first, least=6, factor=4):
    return [(s + int(a), n, q) for t, a in zip(texts, first) for s, n, q in plain_runs(t, least, factor)]


@pytest.mark.parametrize("least, factor", [(6, 4), (2, 2), (9, 3), (4, 5)])
def test_runs_match_brute_force(least, factor):
    rng = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            alphabet = rng.choice(["a", "ab", "ab", "abc", "abcdefgh"])
            words = []
            while len(words) < rng.randrange(80):
                part = [rng.choice(alphabet) for _ in range(rng.randrange(1, 9))]
                words += part * rng.choice([1, 1, 2, 5, 9])
            texts.append(words[: rng.randrange(100)])
        ids, first = numbered(texts)
        got = list(map(tuple, periodic.runs(ids, first, least, factor).tolist()))
        assert got == shifted(texts, first, least, factor)


def test_long_texts_of_few_words():
    rng = random.Random(1)
    texts = [["x"] * 20_000, list("ab") * 5_000, [*"abcde" * 400, "z"] * 9]
    texts.append([w for _ in range(300) for w in (f"l{rng.random()}", *["a"] * rng.randrange(40))])
    ids, first = numbered(texts)
    got = list(map(tuple, periodic.runs(ids, first).tolist()))
    assert got[:2] == [(0, 20_000, 1), (20_000, 10_000, 2)]
    assert got == shifted(texts[:2], first) + [
        (s + int(first[i]), n, q) for i in (2, 3) for s, n, q in plain_runs(texts[i])
    ]


def test_collapsed_texts_and_odd_rows(spark, frame):
    rows = [
        (1, "A b\tA b  A b A b\nend"), (2, None), (3, ""), (4, " \n"), (5, "one"), (None, "x x x x x x"),
        (6, "a a a a a"), (6, "é é é é é é é ß"), (7, "Q q Q q Q q"), (8, " w" * 7 + " u v" * 4),
    ]
    docs = frame(rows).withColumnRenamed("source", "runs").withColumnRenamed("lang", "collapsed")
    found = periodic.with_runs(docs, ["doc_id", "runs", "collapsed"])
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, 9, [(0, 8, 2)], "A b end"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 1, [], "one"),
            (None, 6, [(0, 6, 1)], "x"), (6, 5, [], "a a a a a"), (6, 8, [(0, 7, 1)], "é ß"),
            (7, 6, [], "Q q Q q Q q"), (8, 15, [(0, 7, 1), (7, 8, 2)], "w u v"),
        ],
        key=str,
    )
    assert periodic.with_runs(frame([]), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        periodic.with_runs(frame([]), ["doc_id"], factor=1)


def test_strongest(spark):
    runs = [(9, 12, 3), (30, 40, 10), (50, 21, 5), (80, 42, 10)]
    df = spark.createDataFrame([(runs,), ([],), (None,)], "runs array<struct<start: long, length: long, period: long>>")
    got = [r.best for r in df.select(periodic.strongest(df["runs"]).alias("best")).collect()]
    assert got == [(50, 21, 5), None, None]


def test_planted_rows(spark, frame):
    import zlib

    rows = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(300)] + [(None, "a b c"), (301, None)]
    for r in periodic.with_planted(frame(rows)).collect():
        if r.doc_id is None or r.text is None:
            assert (r.doc_id, r.text) in ((None, "a b c"), (301, None))
            continue
        words = [f"w{j}" for j in range(r.doc_id % 40)]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert r.text == " ".join(words)
