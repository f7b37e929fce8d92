"""Whitening of embeddings by a covariance of distinct vectors with multiplicities.

Entries become whole numbers x, and equal x-vectors are one vector with its number of copies. The fit
takes each as often as it occurs (or once): sums of x are exact, the covariance is a product of centred
matrices, one a task, whose sums meet entry by entry. The driver holds one matrix of dimension times
dimension and decomposes it. Each distinct vector is whitened once and joined back to its rows.

Vectors that hold at least one in COMMON of all rows are joined by a broadcast table, so a hot vector
does not meet in one task; there can be no more than COMMON such vectors. All others are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import saved

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 53  # entries beyond are taken as this, so that every x is exact as a double, too
COMPONENTS = 8
COMMON = 256
# an eigenvalue below this share of all variance has no direction of its own in double precision
NEGLIGIBLE = 1e-13


def whole_numbers(vector: Column) -> Column:
    """x = floor(SCALE * c) + SHIFT of every entry; null if the vector or an entry is null or not finite."""
    vector = vector.cast("array<double>")
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = float(LARGEST - 2 * SHIFT)
    scaled = lambda c: F.greatest(F.lit(-bound), F.least(F.lit(bound), c * F.lit(float(SCALE))))
    return F.when(good, F.transform(vector, lambda c: F.floor(scaled(c)) + F.lit(SHIFT)))


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, weights: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h1, h2) and distinct vectors (h1, h2, dims, x, copies, weight); h1 and h2 are 128 bits that
    stand for a vector where its rows are joined back."""
    x = vectors.select(F.col(f"`{id_col}`").alias("id"), whole_numbers(F.col(f"`{vector_col}`")).alias("x"))
    x = x.where("x is not null and size(x) > 0")
    keyed = x.select("id", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(11), F.reverse("x")).alias("h2"), "x")
    distinct = keyed.groupBy("h1", "h2", "x").agg(F.count("*").alias("copies"))
    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("long")
    distinct = distinct.select("h1", "h2", F.size("x").alias("dims"), "x", "copies", weight.alias("weight"))
    return keyed.select("id", "h1", "h2"), saved(distinct)


def integers(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def totals(distinct: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors of the fit list, and the sum of each dimension; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                weight, x = batch.column("weight").to_numpy(), integers(batch.column("x"))
                # both halves of x stay far from the range of a long
                high, low = x >> 26, x & ((1 << 26) - 1)
                part = (weight @ high).astype(object) * (1 << 26) + (weight @ low).astype(object)
                count, sums = count + int(weight.sum()), part if sums is None else sums + part
        if sums is not None:
            values = [str(v) for v in [count, *sums]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["dim", "total"])

    parts = distinct.select("weight", "x").mapInArrow(run, "dim int, total string")
    total = F.sum(F.col("total").cast("decimal(38,0)"))
    # one row a dimension
    rows = sorted(parts.groupBy("dim").agg(total.alias("total")).collect())
    return int(rows[0].total), [int(r.total) for r in rows[1:]]


def deviations(x: np.ndarray, count: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where they fit, else as Python's integers."""
    most = max(count * int(max(abs(int(x.max())), abs(int(x.min())))), max(abs(s) for s in sums))
    if most < 1 << 62:
        return x * np.int64(count) - np.array(sums, np.int64)
    return x.astype(object) * count - np.array(sums, object)


def squared_length(moved: np.ndarray) -> np.ndarray:
    """Sum of squares of each row as a long; null beyond the range of one."""
    if moved.dtype != object and float(np.abs(moved).max()) ** 2 * moved.shape[1] < 2.0**62:
        return (moved * moved).sum(axis=1).tolist()
    exact = moved.astype(object)
    return [v if v < 1 << 63 else None for v in (exact * exact).sum(axis=1)]


def covariance(distinct: DataFrame, count: int, sums: list[int]) -> np.ndarray:
    """Covariance of x over the fit list, divisor n: centred before multiplying."""
    dims = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                centred = deviations(integers(batch.column("x")), count, sums).astype(np.float64) / count
                total += centred.T @ (centred * batch.column("weight").to_numpy()[:, None])
        rows, columns = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array(total[rows, columns])], ["i", "j", "v"]
        )

    parts = distinct.select("weight", "x").mapInArrow(run, "i int, j int, v double")
    # half a matrix of dims x dims, whatever the number of vectors
    half = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    found = np.zeros((dims, dims))
    found[half["i"], half["j"]] = half["v"] / count
    found[half["j"], half["i"]] = half["v"] / count
    return found


def with_whitened(distinct: DataFrame, count: int, sums: list[int], components: int) -> DataFrame:
    """Adds deviation and an array of (component, whitened, explained) to the distinct vectors."""
    cov = covariance(distinct, count, sums)
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    trace = float(np.trace(cov))
    good = values > NEGLIGIBLE * trace
    scale = np.where(good, 1 / np.sqrt(np.where(good, values, 1)), np.nan)
    share = [float(v) / trace if trace > 0 else None for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            moved = deviations(integers(batch.column("x")), count, sums)
            z = (moved.astype(np.float64) / count) @ directions * scale
            flat = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
            ends = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("h1", "h2", "copies", "weight")],
                    pa.array(squared_length(moved), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), flat),
                ],
                ["h1", "h2", "copies", "weight", "deviation", "z"],
            )

    schema = "h1 long, h2 long, copies long, weight long, deviation long, z array<double>"
    white = distinct.select("h1", "h2", "copies", "weight", "x").mapInArrow(run, schema)
    return white.withColumn("explained", F.array(*[F.lit(s).cast("double") for s in share])).withColumn(
        "n", F.lit(count).cast("long")
    )


def identity_error(white: DataFrame, count: int, components: int) -> DataFrame:
    """One row: the largest absolute entry of the covariance of z minus the identity, over components that
    have variance; null without any."""
    means = [(F.sum(F.col("z")[i] * F.col("weight")) / count).alias(f"m{i}") for i in range(components)]
    # one row
    mean = white.agg(*means).first()
    used = [i for i in range(components) if mean[i] is not None]
    entry = lambda i: F.col("z")[i] - mean[i]
    errors = [
        F.abs(F.sum(entry(i) * entry(j) * F.col("weight")) / count - (1.0 if i == j else 0.0)).alias(f"e{i}_{j}")
        for i in used
        for j in used
        if i <= j
    ]
    if not errors:
        return white.sparkSession.range(1).select(F.lit(None).cast("double").alias("identity_error"))
    found = white.agg(*errors)
    return found.select(F.array_max(F.array(*found.columns)).alias("identity_error"))


def whitening(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    weights: str = "counts",
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and each of
    the first components, numbered from 1 by falling variance.

    Rows whose vector is null or empty or holds a null or an entry that is not finite are left out;
    others stay, ids repeated or null included. With `weights` "counts" the fit takes all rows, with
    "ones" each distinct vector once, and n and deviation follow. There are as many components as
    dimensions at most. Vectors of different lengths are fitted apart, each length on its own. A
    component without variance has null for whitened, and explained is null if no entry varies at all. A
    deviation beyond the range of a long is null; entries beyond 2**53 are taken as that.
    """
    if weights not in ("counts", "ones") or components < 1:
        raise ValueError("weights are counts or ones, and there is one component or more")
    rows, distinct = distinct_vectors(vectors, id_col, vector_col, weights)
    lengths = sorted(r.dims for r in distinct.select("dims").distinct().collect())  # one row a length
    parts: DataFrame | None = None
    for dims in lengths:
        some = distinct.where(F.col("dims") == dims)
        count, sums = totals(some)
        few = min(components, dims)
        white = saved(with_whitened(some, count, sums, few))
        error = identity_error(white, count, few).first().identity_error
        white = white.withColumn("identity_error", F.lit(error).cast("double"))
        parts = white if parts is None else parts.unionAll(white)
    if parts is None:
        return rows.select(
            "id",
            F.lit(1).alias("component"),
            F.lit(0).cast("long").alias("n"),
            F.lit(0).cast("long").alias("deviation"),
            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")],
        ).where(F.lit(False))
    every = distinct.agg(F.sum("copies")).first()[0]
    often = F.col("copies") * COMMON >= every
    values = ["n", "deviation", "z", "explained", "identity_error"]
    hot = parts.where(often).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), *values)
    is_hot = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    # at most COMMON rows by the definition of hot
    near = rows.join(F.broadcast(hot), is_hot).select("id", *values)
    far = rows.join(F.broadcast(hot.select("g1", "g2")), is_hot, "left_anti")
    far = far.join(parts.where(~often).hint("merge"), ["h1", "h2"]).select("id", *values)
    found = near.unionAll(far).select("*", F.posexplode("z").alias("at", "whitened"))
    return found.select(
        "id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("explained", F.col("at")).alias("explained"),
        "identity_error",
    )
