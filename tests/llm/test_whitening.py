from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from vitalgrid.llm import queries, whitening

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("x", T.IntegerType())]
)


def plain(rows, components=8):
    """n, deviations, projections without a sign, shares of variance; all by loops over Python's integers."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in r] for r in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    return n, deviation, centred @ directions / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def compare(found, ids, rows, components=8):
    n, deviation, z, share = plain(rows, components)
    at = {i: k for k, i in enumerate(ids)}
    assert len(found) == len(rows) * z.shape[1]
    sign = {}
    for r in found:
        k, c = at[r[0]], r.component - 1
        assert (r.n, r.deviation) == (n, deviation[k])
        assert r.explained == pytest.approx(share[c], rel=1e-9) and r.identity_error < 1e-8
        if abs(z[k, c]) > 0.01:
            assert sign.setdefault(c, np.sign(r.whitened * z[k, c])) == np.sign(r.whitened * z[k, c])
        assert abs(r.whitened) == pytest.approx(abs(z[k, c]), rel=1e-6, abs=1e-8)


def test_whole_table_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    found = queries.QUERIES["op11_whitening"](spark, sf).collect()
    compare(found, [r.vec_id for r in rows], [r.embedding for r in rows])


def test_copies_count_and_ones(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 5)) * [5, 4, 3, 2, 1]
    # two thirds are copies of one vector; entries that differ by less than 1/1024 can be equal after scaling
    rows = [*base, *[base[0]] * 80, *np.floor(base[:5] * 1024) / 1024]
    rows = [[float(np.float32(v)) for v in r] for r in rows]
    df = spark.createDataFrame([(i, r, 0) for i, r in enumerate(rows)], SCHEMA)
    compare(whitening.whitening(df, components=3).collect(), range(len(rows)), rows, 3)
    once, seen = {}, set()
    for i, r in enumerate(rows):
        key = tuple(math.floor(1024 * c) for c in r)
        if key not in seen:
            seen.add(key)
            once[i] = r
    found = whitening.whitening(df, components=3, weights="ones").collect()
    assert len(found) == 3 * len(rows)
    compare([r for r in found if r.id in once], list(once), list(once.values()), 3)
    assert len({r.deviation for r in found if r.id == 0 or 40 <= r.id < 120}) == 1


def test_hot_and_other_vectors_are_joined_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(-3, 4, size=(30, 3)).astype(float)
    rows = [base[int(i)].tolist() for i in rng.integers(0, 30, 400) ** 2 // 30]
    df = spark.createDataFrame([(i, r, 0) for i, r in enumerate(rows)], SCHEMA)
    for common in (1, 20, 400):  # none, some and all vectors are hot
        monkeypatch.setattr(whitening, "COMMON", common)
        compare(whitening.whitening(df).collect(), range(400), rows)


def test_exact_beyond_doubles():
    x = np.array([[1 << 52, 3], [-(1 << 52), 5]], np.int64)
    moved = whitening.deviations(x, 1 << 20, [7, 1])
    assert moved.tolist() == [[(1 << 72) - 7, (3 << 20) - 1], [-(1 << 72) - 7, (5 << 20) - 1]]
    assert whitening.squared_length(moved) == [None, None]
    some = np.array([[3_000_000_000, 1], [2, 1]], np.int64)
    assert whitening.squared_length(some) == [9 * 10**18 + 1, 5]


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, None, 0), (2, [nan, 1.0], 0), (3, [inf, 1.0], 0), (4, [None, 1.0], 0), (5, [], 0),
        (6, [0.0, 0.0], 0), (7, [1.0, 0.0], 0), (7, [1.0, 0.0], 0), (None, [0.5, 0.0], 0), (8, [3e38, 1.0, -3e38], 0),
    ]
    found = whitening.whitening(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {}
    for r in found:
        got.setdefault(r.id, []).append(r)
    assert set(got) == {6, 7, 8, None} and [len(got[k]) for k in (6, 7, 8, None)] == [2, 4, 3, 2]
    # the second dimension does not vary, the single vector of three dimensions not at all
    assert all((r.whitened is None) == (r.component == 2) for k in (6, 7, None) for r in got[k])
    assert all(r.n == 4 and r.identity_error < 1e-9 for k in (6, 7, None) for r in got[k])
    assert all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in got[8])
    assert sorted(r.explained for r in got[6]) == [0.0, 1.0]
    assert whitening.whitening(spark.createDataFrame(rows[:5], SCHEMA)).count() == 0
    assert whitening.whitening(spark.createDataFrame([], SCHEMA)).columns == found[0].__fields__
    with pytest.raises(ValueError):
        whitening.whitening(spark.createDataFrame([], SCHEMA), weights="twos")
