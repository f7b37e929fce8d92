"""SimHash near-duplicate groups through an inverted index of positional bytes.

Two 64-bit fingerprints that differ in at most 2 bits differ in at most 2 of their 8 bytes, so they
share at least MATCHES = 6 positional bytes. A posting list of one positional byte holds 1/256 of all
fingerprints, and tallying its pairs would grow with the square of the input. The index here is keyed
by MATCHES positional bytes at a time: two fingerprints meet in one of the 28 lists of their six-byte
combinations exactly if their tally of shared positional bytes reaches 6. The members of a list
differ in two bytes only, so a list has at most 65,536 distinct members whatever the input, and a
hot group of copies is one member. Each list is verified by exact bit counts and yields a star of links
per linked set instead of all pairs.

Texts of a given similarity (`similar`) have wider fingerprints, of PLACES positional byte pairs. They differ
in many bits, so no number of shared bytes is certain: a list is keyed by one pair of bytes, which is also listed
with its FLIPS weakest votes flipped, since those are the bits in which similar texts differ, and a text is listed
at the LISTED places whose other votes are strongest. An entry carries another word of the fingerprint, and
members of a list link at NEAR differing bits of it or fewer. At a Jaccard similarity of 0.8 (cosine of 0.889
between the sets, 0.15 of the bits differ) a pair links at 13 places on average.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.blocks import least_reached, whole_groups
from vitalgrid.llm.common import row_hash, saved
from vitalgrid.llm.components import components
from vitalgrid.llm.text import SPACED, Words, chunks, mixed

WIDTH = 3  # words of a shingle
SEED = 42
BITS = 2  # fingerprints link at so many differing bits or fewer
MATCHES = 8 - BITS  # positional bytes that such a pair shares at least
HASHED_AT_ONCE = 100_000  # shingles

WIDE = 12  # 64-bit words of a wide fingerprint
PLACES, LISTED = 4 * WIDE, 36  # pairs of positional bytes, and those that a text is listed at
FLIPS = 2  # weakest votes of a pair of bytes that are listed either way
ENTRIES = LISTED << FLIPS  # index entries of a text
NEAR = 14  # members of a list link at so many differing bits of 64 or fewer
SUMMED, TILE = 256, 1 << 14  # shingles whose bytes add up in 16 bits, and shingles voted at once
SHORT = 128  # members up to which lists are compared together
LINKS = 1 << 22  # links that are held at once
WIDE_SEEDS = np.random.default_rng(43).integers(0, 1 << 63, 8 * WIDE, np.uint64)


def fingerprints(texts: pa.Array, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """Fingerprint (uint64) of each text: majority of the bits of its shingles' XXH64."""
    words = Words(texts, SPACED)
    # one space between the words of a text: keep word bytes and the first separator after a word
    keep = words.inside.copy()
    keep[words.ends[words.ends < len(keep)]] = True
    moved = np.concatenate(([0], np.cumsum(keep)))
    joined = np.where(words.inside, words.data, np.uint8(0x20))[keep].tobytes()
    starts, ends = moved[words.starts], moved[words.ends]
    size = np.minimum(words.counts, width)
    shingles = words.counts - size + (words.counts > 0)
    text = np.repeat(np.arange(len(texts)), shingles)
    place = np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    head = words.first[:-1][text] + place
    tail = head + size[text] - 1
    votes = np.zeros((len(texts), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(head), HASHED_AT_ONCE):
        some = slice(at, at + HASHED_AT_ONCE)
        pairs = zip(starts[head[some]].tolist(), ends[tail[some]].tolist())
        found = np.array([digest(joined[s:e], seed) for s, e in pairs], np.uint64)
        bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.flatnonzero(np.diff(text[some], prepend=-1))
        votes[text[some][edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    major = (2 * votes > shingles[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprint(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row and its fingerprint `fp` as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                fp = pa.array(fingerprints(part.column("__text")).view(np.int64))
                kept = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, fp], [*keep, "fp"])

    narrow = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])
    return narrow.mapInArrow(run, schema)


def linked_sets(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each of distinct values, the index of the first value of its linked set.

    Values link at `bits` differing bits or fewer; sets are closed under links.
    """
    differing = np.bitwise_or.reduce(values ^ values[0])
    places = [i for i in range(64) if int(differing) >> i & 1]
    flips = [
        np.uint64(sum(1 << i for i in some))
        for n in range(1, bits + 1)
        for some in combinations(places, n)
    ]
    order = np.argsort(values)
    ordered, label = values[order], np.arange(len(values))
    links = []
    for flip in flips:
        at = np.minimum(np.searchsorted(ordered, ordered ^ flip), len(ordered) - 1)
        hit = np.flatnonzero(ordered[at] == ordered ^ flip)
        links.append(np.stack([order[hit], order[at[hit]]]))
    one, other = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
    while True:
        least = label.copy()
        np.minimum.at(least, one, label[other])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp`: stars whose closure is that of all pairs
    within BITS differing bits."""
    masks = [sum(255 << (8 * i) for i in kept) for kept in combinations(range(8), MATCHES)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    index = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("kept"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                for i, m in enumerate(signed)
            ]
        )
    )
    # a fingerprint is 8 bytes here and 28 rows below: dealt by number, which AQE does not coalesce
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = (
        distinct.repartition(tasks)
        .select("fp", index.alias("at"))
        .groupBy("at.kept", "at.key")
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            flat, sizes = members.flatten().to_numpy(), members.value_lengths().to_pylist()
            u, v, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            for size in sizes:
                own = flat[at : at + size]
                label = linked_sets(own.view(np.uint64))
                moved = np.flatnonzero(label != np.arange(size))
                u.append(own[moved])
                v.append(own[label[moved]])
                at += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"]
            )

    return lists.mapInArrow(verify, "u long, v long")


def with_root(found: DataFrame) -> DataFrame:
    """Adds `root`, the least fingerprint that the row's `fp` reaches over links."""
    distinct = saved(found.select("fp").distinct())
    roots = components(links(distinct))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    return found.join(named.select("fp", F.coalesce("root", "fp").alias("root")), "fp")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) of every row; component is the smallest id reachable over links.

    Null or wordless texts have fingerprint zero and link like any other. Repeated rows stay rows of
    their own. A null id never names a component, unless none of its rows has an id. Texts of any
    length are taken whole. Empty input gives no rows.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = with_root(saved(with_fingerprint(narrow, ["id"])))
    found = saved(found)
    least = found.groupBy("root").agg(F.min("id").alias("component"))
    return found.join(least, "root").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group, with all its columns: the row of the smallest id (null
    ids last); among rows of that id the one whose columns hash lowest; of equal rows, one."""
    columns = docs.columns
    keyed = docs.withColumn("__id", F.col(f"`{id_col}`")).withColumn("__hash", row_hash(docs))
    found = with_root(saved(with_fingerprint(keyed, ["__id", "__hash"], f"`{text_col}`")))
    key = F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash")
    winners = found.groupBy("root").agg(F.min(key).alias("key")).select(F.col("key.__hash").alias("h"))
    # the hash covers the id; merged, since the winners follow the input, and the rows stay dealt by hash
    kept = keyed.join(winners.hint("merge"), keyed["__hash"] == winners["h"], "left_semi")
    return kept.dropDuplicates(["__hash"]).select(*[F.col(f"`{c}`") for c in columns])


def wide_votes(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The 64 * WIDE votes of each text; found, first: hashes of its shingles, one at least, and where texts begin.

    A shingle's vote on a bit is a byte of its hash around its middle, so that few shingles hardly tie.
    """
    sizes = np.diff(first)
    parts = -(-sizes // SUMMED)  # a text is summed in parts
    nr = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    heads = np.repeat(first[:-1], parts) + nr * SUMMED
    ends = np.append(heads, first[-1])
    sums = np.zeros((len(heads), 64 * WIDE), np.uint16)
    low = np.uint64(0x00FF00FF00FF00FF)
    at = 0
    while at < len(heads):
        last = max(at + 1, int(np.searchsorted(ends, ends[at] + TILE, "right")) - 1)
        own, edges = found[ends[at] : ends[last]], heads[at:last] - ends[at]
        for k, seed in enumerate(WIDE_SEEDS):
            hashes = mixed(own ^ seed)
            even = np.add.reduceat(hashes & low, edges)
            odd = np.add.reduceat((hashes >> np.uint64(8)) & low, edges)
            sums[at:last, 8 * k : 8 * k + 4] = even.view(np.uint16).reshape(-1, 4)
            sums[at:last, 8 * k + 4 : 8 * k + 8] = odd.view(np.uint16).reshape(-1, 4)
        at = last
    total = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    return 2 * total - 255 * sizes[:, None]


def wide_entries(found: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """WIDE words of each text's fingerprint and its ENTRIES keys (place, two bytes); arguments as of wide_votes."""
    votes = wide_votes(found, first)
    count = len(votes)
    bits = np.packbits(votes > 0, axis=1, bitorder="little")
    pairs = bits.view("<u2").reshape(count, PLACES).astype(np.int32)
    strength = np.abs(votes).reshape(count, PLACES, 16)
    weak = np.argpartition(strength, FLIPS - 1, axis=2)[:, :, :FLIPS]
    # a vote's chance to differ in a similar text falls with its strength in standard deviations
    doubt = np.exp(-2.2 * strength / np.sqrt(np.diff(first) * 65535 / 3)[:, None, None])
    np.put_along_axis(doubt, weak, 0, axis=2)
    best = np.argpartition(doubt.sum(axis=2), LISTED - 1, axis=1)[:, :LISTED]
    keys = (np.arange(PLACES, dtype=np.int32) << 16 | pairs)[:, :, None]
    for i in range(FLIPS):
        flipped = keys ^ (np.int32(1) << weak[:, :, i, None].astype(np.int32))
        keys = np.concatenate((keys, flipped), axis=2)
    keys = np.take_along_axis(keys, best[:, :, None], axis=1)
    return bits.view("<u8").reshape(count, WIDE), keys.reshape(count, ENTRIES)


def near_sets(values: np.ndarray, bits: int = NEAR) -> np.ndarray:
    """For each of many values the first of its linked set: values link at `bits` differing bits or fewer."""
    label, rest = np.arange(len(values)), np.arange(len(values))
    # sets that hold much of the list, each reached from one of its members
    before = 2 * len(rest)
    while len(rest) > SHORT and len(rest) < before - before // 16:
        before = len(rest)
        for lead in rest[:: max(1, len(rest) // 8)][:8]:
            left = np.flatnonzero(rest == lead)
            front, rest = rest[left], np.delete(rest, left)
            while len(front) and len(rest):
                some, front = front[:64], front[64:]
                near = np.bitwise_count(values[some][:, None] ^ values[rest]).min(axis=0) <= bits
                label[rest[near]] = lead
                front = np.append(front, rest[near])
                rest = rest[~near]
    # what remains, by strips
    i, j, held = [np.arange(len(values))], [label], 0
    for at in range(0, len(rest), 64):
        some = rest[at : at + 64]
        a, b = np.nonzero(np.bitwise_count(values[some][:, None] ^ values[rest[at:]]) <= bits)
        i.append(some[a[a < b]])
        j.append(rest[at:][b[a < b]])
        held += len(i[-1])
        if held > LINKS:
            label = least_reached(len(values), np.concatenate(i), np.concatenate(j))
            i, j, held = [np.arange(len(values))], [label], 0
    return least_reached(len(values), np.concatenate(i), np.concatenate(j))


def near_lists(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each value of lists that begin at `edges` the first of its linked set in its list."""
    sizes = np.diff(edges)
    start, size = np.repeat(edges[:-1], sizes), np.repeat(sizes, sizes)
    i, j = [], []
    left = np.flatnonzero((size > 1) & (size <= SHORT))
    for apart in range(1, SHORT):
        left = left[left + apart < start[left] + size[left]]
        if not len(left):
            break
        near = left[np.bitwise_count(values[left] ^ values[left + apart]) <= NEAR]
        i.append(near)
        j.append(near + apart)
    label = np.arange(len(values))
    if i:
        label = least_reached(len(values), np.concatenate(i), np.concatenate(j))
    for nr in np.flatnonzero(sizes > SHORT):
        own = slice(edges[nr], edges[nr + 1])
        label[own] = edges[nr] + near_sets(values[own])
    return label


def similar(nodes: DataFrame) -> DataFrame:
    """Links (u, v) between texts that the wide fingerprints show as similar, as stars; nodes: (node, keys,
    words), a row each, with the columns of wide_entries as arrays. Whether they are is for the caller to decide."""
    place = F.expr("shiftright(key, 16)")
    # another word than that of the place, a different one for each place of a word
    word = F.pmod(F.expr("shiftright(key, 18)") + 1 + F.pmod(place, F.lit(4)), F.lit(WIDE))
    entries = nodes.select("node", "words", F.explode("keys").alias("key"))
    entries = entries.select("key", "node", F.get("words", word).alias("word"))
    # by node as well, so that the lists of a set of texts name the same least ones
    lists = entries.repartition("key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches, ["key"]):
            node = batch.column("node").to_numpy()
            label = near_lists(batch.column("word").to_numpy().view(np.uint64), edges)
            hit = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(node[label[hit]])], ["u", "v"])

    stars = lists.mapInArrow(run, "u long, v long")
    # a text has ENTRIES centres at most: all of them link to their least, and few links remain of a large set
    centres = stars.groupBy("u").agg(F.collect_set("v").alias("centres"))
    ends = F.explode(F.array_union(F.array("u"), "centres"))
    return centres.select(ends.alias("u"), F.array_min("centres").alias("v")).where("u != v").distinct()
