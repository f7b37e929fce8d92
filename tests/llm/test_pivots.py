from __future__ import annotations

import math

import numpy as np
from pyspark.sql import types as T

from vitalgrid.llm import pivots, queries

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
)


def brute(ids, rows):
    """Links and components over all pairs."""
    x = np.array(rows, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    label = np.array(ids)
    while True:
        least = np.minimum(label, np.where(close, label[None, :], label.max() + 1).min(axis=1))
        if (least == label).all():
            return dict(zip(ids, close.sum(axis=1).tolist())), dict(zip(ids, label.tolist()))
        label = least


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 8)  # the large groups are dealt to pairs of blocks
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 24))
    rows = [*base]
    rows += [base[0] + rng.normal(size=24) * 0.08 for _ in range(60)]
    rows += [base[1] * k for k in (1, 1, 1, 2, 0.5)]
    rows += [base[i] + rng.normal(size=24) * 0.1 for i in range(2, 40)]
    rows = [[float(np.float32(v)) for v in r] for r in rows]
    df = spark.createDataFrame([(i, r, 0) for i, r in enumerate(rows)], SCHEMA)
    found = pivots.near_duplicates(df).collect()
    links, label = brute(list(range(len(rows))), rows)
    got = sum(r.n_links for r in found)
    assert 0.97 * sum(links.values()) <= got <= sum(links.values())
    assert all(r.n_links <= links[r.id] for r in found)
    assert sum(r.component == label[r.id] for r in found) >= 0.97 * len(rows)
    assert all(r.kept == (r.id == r.component) for r in found)


def test_links_planted_in_the_table(spark, sf, tmp_path):
    """The table holds no link by itself: every third vector gets a partner at 0.9 to 1."""
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rng = np.random.default_rng(8)
    for i, vector, label in rows[::3]:
        x = np.array(vector, float)
        x /= np.linalg.norm(x)
        aside = rng.normal(size=len(x))
        aside -= x * (aside @ x)
        cosine = rng.uniform(0.901, 1)
        partner = cosine * x + math.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)
        rows.append((i + 10**6, [float(np.float32(v)) for v in partner], label))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    links, label = brute([r[0] for r in rows], [r[1] for r in rows])
    found = queries.QUERIES["op5_pivot_neighbours"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and sum(links.values()) > 300
    assert all(r.n_links <= links[r.vec_id] for r in found)
    assert sum(r.n_links for r in found) >= 0.93 * sum(links.values())
    assert sum(r.component_id == label[r.vec_id] for r in found) >= 0.93 * len(rows)


def test_index_follows_the_number_of_rows():
    """Chance company stays flat from ten thousand to a billion rows, isotropic and in a cone."""
    for mean, counts in ((0.0, (10_000, 200_000, 10**9)), (0.5, (10_000, 200_000))):
        rng = np.random.default_rng(1)
        axis = np.eye(64)[0] * math.sqrt(mean)
        rows = pivots.unit(axis + math.sqrt(1 - mean) * rng.normal(size=(2048, 64)) * (np.arange(64) > 0) / 8)
        company = []
        for count in counts:
            index = pivots.choose_index(rows, count)
            sets, size = index.sets.shape[:2]
            company.append(sets * count * pivots.by_chance(size, index.nearest, index.shared))
            # what the formula says is what other vectors of the kind meet
            if count == 200_000:
                other = axis + math.sqrt(1 - mean) * rng.normal(size=(600, 64)) * (np.arange(64) > 0) / 8
                other = pivots.unit(other) - index.centre
                met = 0
                for p in index.sets:
                    held = pivots.nearest_pivots(other @ p.T, index.nearest)
                    flags = np.zeros((600, size), np.float32)
                    np.put_along_axis(flags, held, 1, axis=1)
                    met += ((flags @ flags.T >= index.shared).sum() - 600) / 600
                assert met / 599 * count < 20 * company[-1]
        assert max(company) <= 40, company


def test_recall_near_the_threshold(spark):
    for nr, mean in enumerate((0.0, 0.5, 0.8)):  # isotropic, and in cones
        rng = np.random.default_rng(nr)
        axis = np.zeros(64)
        axis[0] = np.sqrt(mean)
        side = lambda n: rng.normal(size=(n, 64)) * (np.arange(64) > 0) / math.sqrt(63)
        base = axis + math.sqrt(1 - mean) * side(800)
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        aside = side(300)
        aside -= base[:300] * (aside * base[:300]).sum(axis=1, keepdims=True)
        aside /= np.linalg.norm(aside, axis=1, keepdims=True)
        cosine = np.linspace(0.901, 0.93, 300)[:, None]  # close to the threshold
        planted = cosine * base[:300] + np.sqrt(1 - cosine**2) * aside
        rows = [[float(np.float32(v)) for v in r] for r in (*base, *planted)]
        links, _ = brute(list(range(len(rows))), rows)
        df = spark.createDataFrame([(i, r, 0) for i, r in enumerate(rows)], SCHEMA)
        got = {r.id: r.n_links for r in pivots.near_duplicates(df).collect()}
        assert all(got[i] <= links[i] for i in got), mean
        assert sum(got.values()) >= 0.9 * sum(links.values()) > 0, mean


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, None, 0), (2, [0.0, 0.0], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [None, 1.0], 0), (6, [], 0),
        (7, [1.0, 0.0], 0), (8, [1e-30, 0.0], 0), (9, [3e38, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (None, [1.0, -0.0], 0),
        (11, [-1.0, 0.0], 0), (11, [-1.0, 0.0], 0),
    ]
    found = pivots.near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "node")).collect()
    got = sorted(((r.id, r.n_links, r.component, r.kept) for r in found), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10)]
    linked = [(i, 3, 7, i == 7) for i in (7, 8, 9)] + [(None, 3, 7, False)]
    assert got == sorted([*alone, *linked, (11, 1, 11, True), (11, 1, 11, True)], key=str)
    assert pivots.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.component for r in pivots.near_duplicates(spark.createDataFrame(rows[:1], SCHEMA)).collect()] == [1]
