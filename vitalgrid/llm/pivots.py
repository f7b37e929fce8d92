"""Near-duplicate embeddings through a pivot-permutation index.

A vector is described by its nearest pivots, in order of nearness, out of a set of reference vectors; several
sets are used. Near vectors share most of them. The inverted lists are keyed by some shared pivots of a
set at a time, so two vectors meet in a list exactly if they share at least so many of their nearest pivots;
lists of single pivots would hold a fixed share of all rows each. Every pair that meets is verified by its
cosine in double precision, in blocks of a matrix product. A pair counts only in the list of its lowest
common pivots, in the first set where it meets, so no pair is counted twice and no pair is ever emitted: a
list yields the number of links of each member and one star of links per linked set.

The index follows the number of rows: a set has as many pivots as leave a given number of unrelated vectors,
CHANCE at first, in the lists of a vector, so lists stay short however many rows there are. Which number of
nearest and of shared pivots to use, how many sets and how much chance company, is chosen on a sample:
partners made at exactly the threshold must be found at a rate of RECALL, and of the choices that do so the
one that sends least is taken. If none does, all rows meet in one list, where no pair is missed.

Equal vectors are collapsed first, with their multiplicity. Long lists are dealt to pairs of blocks of
BLOCK members, so a hot group is many tasks. Pivots come from a bounded sample, the SAMPLE distinct vectors
that hash lowest: each next pivot is the vector farthest from those chosen, so that a dense group does not
draw several. Pivots are compared with vectors less the mean of the sample, so that vectors in a cone spread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.blocks import least_reached, whole_groups
from vitalgrid.llm.common import saved
from vitalgrid.llm.components import components

CHOICES = ((4, 3), (5, 3), (6, 3), (6, 4), (8, 4), (8, 5))  # nearest pivots, and of these shared
SET_COUNTS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48)
PIVOTS = 1 << 10  # most pivots of a set; five of them and the set fit a long
CHANCE = 4.0  # unrelated vectors that meet a vector, over all sets, at the least; then eight times as many, ...
RECALL = 0.95  # wanted share of pairs at the threshold
COSINE = 0.9
BLOCK = 1024
SAMPLE = 4096  # vectors that pivots are chosen from
PROBES = 256  # vectors of the sample that get partners
ENTRY = 40  # bytes of an index entry, to compare choices


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component is scaled first, so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spread(rows: np.ndarray) -> np.ndarray:
    """Up to PIVOTS of the rows, each the farthest from those before; none links with another."""
    nearest = rows @ rows[0]
    chosen = [0]
    while len(chosen) < PIVOTS and nearest.min() < COSINE:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    return rows[chosen]


def nearest_pivots(products: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the nearest pivots of each row, rising; of equally near ones the first."""
    nearest = min(nearest, products.shape[1])
    return np.sort(np.argsort(-products, axis=1, kind="stable")[:, :nearest], axis=1)


def in_common(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each pivot of a row of `one`, whether the same row of `other` has it, too."""
    return (one[:, :, None] == other[:, None, :]).any(axis=2)


def by_chance(pivots: int, nearest: int, shared: int) -> float:
    """Probability that two random choices of `nearest` of the pivots share at least `shared`."""
    if pivots <= nearest:
        return 1.0
    every = math.comb(pivots, nearest)
    some = sum(math.comb(nearest, k) * math.comb(pivots - nearest, nearest - k) for k in range(shared, nearest + 1))
    return some / every


def pivots_for(rate: float, nearest: int, shared: int) -> int:
    """The least number of pivots at which no more than that rate of vectors meet by chance."""
    low, high = nearest, 1 << 20
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if by_chance(middle, nearest, shared) <= rate else (middle + 1, high)
    return low


def pairs_at_threshold(rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Partners of each row at a cosine of COSINE, in any direction and towards another row."""
    found = []
    for other in (rng.normal(size=rows.shape), rows[rng.permutation(len(rows))] + rng.normal(size=rows.shape) * 1e-9):
        aside = other - rows * (rows * other).sum(axis=1, keepdims=True)
        length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
        found.append(COSINE * rows + np.sqrt(1 - COSINE * COSINE) * aside / np.where(length > 0, length, 1))
    return found


@dataclass(frozen=True)
class Index:
    """Centre, sets of pivots, and how many nearest pivots describe a vector and how many make a list."""

    centre: np.ndarray
    sets: np.ndarray
    nearest: int
    shared: int


def choose_index(rows: np.ndarray, count: int) -> Index:
    """The index for `count` vectors, from unit rows of a sample of them."""
    rng = np.random.default_rng(5)
    centre = rows.mean(axis=0)
    moved = rows - centre
    length = np.sqrt((moved * moved).sum(axis=1))
    moved = moved[length > 1e-6]
    everything = Index(centre, rows[None, :1], 1, 1)
    if len(moved) < 2:  # no direction from the centre to tell vectors by
        return everything
    moved = unit(moved)
    own = rows[rng.permutation(len(rows))[:PROBES]]
    partners = pairs_at_threshold(own, rng)
    sets: list[np.ndarray] = []
    products: list[list[np.ndarray]] = []

    def found(n: int, pivots: int, nearest: int, shared: int) -> float:
        """Share of partners that the first n sets find."""
        while len(sets) < n:
            sets.append(spread(moved[rng.permutation(len(moved))[: (len(moved) + 1) // 2]]))
            products.append([(y - centre) @ sets[-1].T for y in (own, *partners)])
        hit = np.zeros((len(partners), len(own)), bool)
        for one, *others in ([x[:, :pivots] for x in p] for p in products[:n]):
            held = nearest_pivots(one, nearest)
            for k, other in enumerate(others):
                hit[k] |= in_common(held, nearest_pivots(other, nearest)).sum(axis=1) >= shared
        return float(hit.mean(axis=1).min())

    best: tuple[float, Index] | None = None
    vector = 8 * rows.shape[1]
    chance = CHANCE
    while chance < count and (best is None or chance * vector < best[0]):
        for nearest, shared in CHOICES:
            for n in SET_COUNTS:
                pivots = pivots_for(chance / n / count, nearest, shared)
                cost = n * math.comb(nearest, shared) * ENTRY + chance * (vector + 2 * n * nearest)
                if best and cost >= best[0]:
                    break
                if nearest < pivots <= PIVOTS and found(n, pivots, nearest, shared) >= RECALL:
                    # a sample of few directions yields fewer pivots
                    least = min(pivots, *[len(p) for p in sets[:n]])
                    if least > nearest:
                        best = cost, Index(centre, np.stack([p[:least] for p in sets[:n]]), nearest, shared)
                    break
        chance *= 8
    return best[1] if best else everything


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, node, vector) of every row; node is a hash of the vector, null if it links with nothing."""
    given = F.col(f"`{vector_col}`")
    vector = given.cast("array<double>")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vector.isNotNull() & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)
    # adding zero turns a negative zero into zero, so that equal vectors hash alike; single precision is
    # exact as it comes and half as long
    kind = "float" if vectors.schema[vector_col].dataType.elementType == T.FloatType() else "double"
    vector = F.when(good, F.transform(given.cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind)))
    found = vectors.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector"))
    return found.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))


def described(distinct: DataFrame, index: Index) -> DataFrame:
    """Adds `held`, the nearest pivots of each set, one set after the other."""
    broadcast = distinct.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = broadcast.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unit(matrix(batch.column("vector"))) - one.centre
            held = np.hstack([nearest_pivots(rows @ p.T, one.nearest) for p in one.sets])
            ends = np.arange(len(rows) + 1, dtype=np.int32) * held.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(held.ravel().astype(np.int16)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "held"])

    added = T.StructField("held", T.ArrayType(T.ShortType()))
    return distinct.mapInArrow(run, T.StructType([*distinct.schema.fields, added]))


def list_keys(chosen: np.ndarray, nr: int) -> np.ndarray:
    """Key of the list of a set for each row of chosen pivots."""
    key = np.full(len(chosen), nr, np.int64)
    for column in chosen.T:
        key = key << 10 | column.astype(np.int64)
    return key


def postings(rows: DataFrame, nearest: int, shared: int) -> DataFrame:
    """(node, list) of every set and each choice of `shared` of a vector's nearest pivots."""
    subsets = np.array(list(combinations(range(nearest), shared)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column("held").flatten().to_numpy().reshape(len(batch), -1, nearest)
            nodes = batch.column("node").to_numpy()
            for nr in range(held.shape[1]):
                lists = list_keys(held[:, nr][:, subsets].reshape(-1, shared), nr)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, len(subsets))), pa.array(lists)], ["node", "list"])

    return rows.select("node", "held").mapInArrow(run, "node long, list long")


def verified(
    rows: np.ndarray, held: np.ndarray, block: np.ndarray, weight: np.ndarray, key: int, first: int, second: int, shared: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member of a pair of blocks, counted by weight, and the least member of its set; pairs
    that meet in a set of pivots before the list's are left to it."""
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    links = np.zeros(len(rows), np.int64)
    close = rows[left] @ rows[right].T >= COSINE
    i, j = np.nonzero(close)
    i, j = left[i], right[j]
    keep = i < j if first == second else i != j
    i, j = i[keep], j[keep]
    nr = key >> (10 * shared)
    for earlier in range(nr):
        apart = in_common(held[i, earlier], held[j, earlier]).sum(axis=1) < shared
        i, j = i[apart], j[apart]
    common = in_common(held[i, nr], held[j, nr])
    lowest = common & (np.cumsum(common, axis=1) <= shared)
    own = list_keys(held[i, nr][lowest].reshape(-1, shared), nr) == key
    i, j = i[own], j[own]
    links += np.bincount(i, weight[j], len(rows)).astype(np.int64)
    links += np.bincount(j, weight[i], len(rows)).astype(np.int64)
    return links, least_reached(len(rows), i, j)


def list_links(members: DataFrame, shapes: dict[int, tuple[int, int]]) -> DataFrame:
    """(node, links, other) from the members of lists, sorted and kept together by length, list and blocks;
    other: a member that the node is linked to, itself if it is the least of its set. shapes: the nearest
    and shared pivots of vectors of each length."""
    keys = ["dims", "list", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches, keys):
            nodes, weight, block = (batch.column(c).to_numpy() for c in ("node", "weight", "block"))
            dims, key, one, two = (batch.column(c).to_numpy() for c in keys)
            parts = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if b - a < 2:
                    continue
                nearest, shared = shapes[int(dims[a])]
                rows = unit(matrix(batch.column("vector").slice(a, b - a)))
                held = batch.column("held").slice(a, b - a).flatten().to_numpy().reshape(b - a, -1, nearest)
                links, label = verified(rows, held, block[a:b], weight[a:b], int(key[a]), int(one[a]), int(two[a]), shared)
                hit = np.flatnonzero(links)
                parts.append((nodes[a + hit], links[hit], nodes[a + label[hit]]))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p[i] for p in parts])) for i in range(3)], ["node", "links", "other"]
                )

    return members.mapInArrow(run, "node long, links long, other long")


def candidate_lists(distinct: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """(dims, list, one, two, block, node, vector, held, weight): members of lists of two or more, dealt to
    pairs of blocks; and the nearest and shared pivots of each length."""
    lengths = distinct.groupBy("dims").agg(F.count("*").alias("rows"))
    entries: DataFrame | None = None
    rows: DataFrame | None = None
    shapes = {}
    for length in lengths.collect():  # one row a length of vectors
        some = distinct.where(F.col("dims") == length.dims)
        sample = some.orderBy(F.hash("node"), "node").limit(SAMPLE).select("vector").collect()
        index = choose_index(unit(np.array([r.vector for r in sample], np.float64)), length.rows)
        shapes[length.dims] = index.nearest, index.shared
        part = saved(described(some, index))
        lists = postings(part, index.nearest, index.shared).withColumn("dims", F.lit(length.dims))
        entries = lists if entries is None else entries.unionAll(lists)
        rows = part if rows is None else rows.unionAll(part)
    entries = saved(entries)
    sizes = entries.groupBy("dims", "list").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK)
    dealt = entries.join(sizes.hint("merge"), ["dims", "list"]).withColumn("blocks", blocks)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pair = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.withColumn("with", pair).select(
        "dims", "list", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "node"
    )
    return dealt.join(rows.drop("dims").hint("merge"), "node"), shapes


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component, kept) of every row.

    n_links counts the other rows with a cosine of COSINE or more to this one, as far as the index finds
    them; component is the smallest id reachable over links. Vectors that are null, empty or zero, or hold
    null or non-finite components, and vectors of other lengths, link with nothing. Equal rows are rows
    of their own and link each other. A row without an id never names a component of rows with one.
    """
    found = saved(usable(vectors, id_col, vector_col))
    good = found.where("node is not null")
    distinct = good.groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("weight"))
    distinct = saved(distinct.withColumn("dims", F.size("vector")))
    if distinct.isEmpty():
        return found.select(
            "id",
            F.lit(0).cast("long").alias("n_links"),
            F.col("id").alias("component"),
            F.lit(True).alias("kept"),
        )
    members, shapes = candidate_lists(distinct)
    members = members.repartition("dims", "list", "one", "two").sortWithinPartitions("dims", "list", "one", "two")
    linked = saved(list_links(members, shapes))
    roots = components(linked.select(F.col("node").alias("u"), F.col("other").alias("v")))
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = distinct.select("node", "weight").join(counts, "node", "left").join(roots, "node", "left")
    known = known.select(
        "node",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root"),
    )
    rows = saved(found.select("id", "node").join(known, "node", "left"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    rows = rows.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least"))
    return rows.select(
        "id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component"),
        F.coalesce(component == F.col("id"), F.col("root").isNull()).alias("kept"),
    )
