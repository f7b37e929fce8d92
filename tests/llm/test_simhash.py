from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from vitalgrid.llm import simhash
from vitalgrid.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


TEXTS = [
    None, "", " \t\n", "One", "one TWO", "a b c", "A  B\tc", "ÄÖ ü x y z w", "a b c d " * 500,
    " lead and trail ", "x\x0by\x0cz w", "a\x1fb c d e", "word " * 3000 + "end",
]


def test_fingerprints_match_plain_loop():
    found = simhash.fingerprints(pa.array(TEXTS))
    assert found.tolist() == [plain_fingerprint(t) for t in TEXTS]


def test_shingles_in_several_parts(monkeypatch):
    monkeypatch.setattr(simhash, "HASHED_AT_ONCE", 7)
    found = simhash.fingerprints(pa.array(TEXTS).slice(4))
    assert found.tolist() == [plain_fingerprint(t) for t in TEXTS[4:]]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 180)] + [(7, 7)] + [(500, i) for i in range(501, 560)]
    pairs += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, 3)], "u long, v long")
    found = {r.node: r.root for r in components(df).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert found == plain_components([p for p in pairs if p[0] != p[1]], nodes)
    assert components(df.limit(0)).count() == 0


def test_groups_match_brute_force(frame):
    rng = random.Random(3)
    base = [rng.choices("abcdefghij", k=300) for _ in range(4)]
    rows = []
    for i in range(80):
        words = list(base[i % 4])
        for _ in range(rng.randrange(6)):
            words[rng.randrange(300)] = rng.choice("klm")
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (None, ""), (3, rows[3][1]), (None, "only here"), (900, "only  here")]
    fps = [plain_fingerprint(t) for _, t in rows]
    pairs = [(a, b) for a in set(fps) for b in set(fps) if (a ^ b).bit_count() <= 2]
    roots = plain_components(pairs, set(fps))
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    expected = sorted(((i, f, least[roots[f]]) for (i, _), f in zip(rows, fps)), key=str)
    found = [(r.id, r.fp % (1 << 64), r.component) for r in simhash.groups(frame(rows)).collect()]
    assert sorted(found, key=str) == expected
    assert len({c for _, _, c in expected}) > 3


def test_index_reaches_every_pair(spark):
    rng = random.Random(9)
    fps = set()
    for _ in range(20):
        f = rng.getrandbits(64)
        fps |= {f} | {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(30)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(df).collect()]
    pairs = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    assert plain_components(found, fps) == plain_components(pairs, fps)


def test_keep_one(spark, frame):
    text = "the same words in every copy of this text " * 5
    docs = frame([(5, text, "en"), (2, text, "de"), (2, text, "de"), (9, "other"), (None, text), (None, "alone")])
    docs = docs.withColumnRenamed("n_chars", "fp")  # a clashing name
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.lang) for r in kept.collect()), key=str) == [(2, "de"), (9, None), (None, None)]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_wide_votes_match_single_shingles():
    rng = np.random.default_rng(2)
    sizes = [1, 5, 255, 256, 257, 40_000, 3, 700]
    first = np.concatenate(([0], np.cumsum(sizes)))
    found = rng.integers(0, 1 << 63, first[-1], np.uint64)
    votes = simhash.wide_votes(found, first)
    for k, seed in enumerate(simhash.WIDE_SEEDS):
        own = simhash.mixed(found ^ seed).view(np.uint8).reshape(-1, 8)[:, [0, 2, 4, 6, 1, 3, 5, 7]].astype(np.int64)
        plain = [(2 * own[a:b] - 255).sum(axis=0) for a, b in zip(first[:-1], first[1:])]
        assert (votes[:, 8 * k : 8 * k + 8] == plain).all()


def test_keys_are_pairs_of_bytes_with_the_weakest_votes_either_way():
    rng = np.random.default_rng(3)
    found, first = rng.integers(0, 1 << 63, 600, np.uint64), np.array([0, 30, 600])
    votes, (words, keys) = simhash.wide_votes(found, first), simhash.wide_entries(found, first)
    for t in range(2):
        pairs = words[t].view(np.uint16)
        assert [int(w) >> i & 1 for w in words[t] for i in range(64)] == (votes[t] > 0).astype(int).tolist()
        of_place = {}
        for key in keys[t].tolist():
            of_place.setdefault(key >> 16, set()).add(key & 0xFFFF)
        assert len(of_place) == simhash.LISTED
        for place, listed in of_place.items():
            weak = np.argsort(np.abs(votes[t, 16 * place : 16 * place + 16]))[: simhash.FLIPS].tolist()
            flips = [sum(1 << i for i, on in zip(weak, [n & 1, n >> 1]) if on) for n in range(4)]
            assert listed == {int(pairs[place]) ^ f for f in flips}


def test_near_lists_match_brute_force(monkeypatch):
    rng = np.random.default_rng(4)
    bases = rng.integers(0, 1 << 63, 12, np.uint64)

    def edited(base, count):
        flips = [sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 9), False)) for _ in range(count)]
        return base ^ np.array(flips, np.uint64)

    lists = [edited(b, n) for b, n in zip(bases, (1, 2, 70, 400))]
    lists += [np.concatenate([edited(b, 60) for b in bases]), rng.integers(0, 1 << 63, 300, np.uint64)]
    lists = [rng.permutation(x) for x in lists]
    values, edges = np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    expected = []
    for at, own in zip(edges, lists):
        near = np.argwhere(np.bitwise_count(own[:, None] ^ own) <= simhash.NEAR).tolist()
        root = plain_components([(a, b) for a, b in near if a < b], set(range(len(own))))
        expected += [at + root[i] for i in range(len(own))]
    for short, links in ((128, 1 << 22), (16, 100), (1, 1)):
        monkeypatch.setattr(simhash, "SHORT", short)
        monkeypatch.setattr(simhash, "LINKS", links)
        assert simhash.near_lists(values, edges).tolist() == expected


def test_index_links_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in range(1, 400):  # 8 n of 10 n shingles in common: 0.8 for each of the forms
        n = n % 12 + 1
        whole = rng.integers(0, 1 << 63, 10 * n, np.uint64)
        pair = (whole[: 9 * n], whole[n:]) if len(rows) % 4 else (whole, whole[: 8 * n])
        for part in pair:
            words, keys = simhash.wide_entries(part, np.array([0, len(part)]))
            rows.append((len(rows), keys[0].tolist(), words[0].view(np.int64).tolist()))
    nodes = spark.createDataFrame(rows, "node long, keys array<int>, words array<long>")
    linked = {(r.v, r.u) for r in simhash.similar(nodes).collect()}
    assert linked == {(i, i + 1) for i in range(0, len(rows), 2)}
