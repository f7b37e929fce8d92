"""Whole batches of text as byte arrays: words, lower case and hashes without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20  # text handled at once; longer single texts are one chunk


def byte_set(separators: bytes) -> np.ndarray:
    """Table over bytes: whether a byte belongs to words."""
    word = np.ones(256, bool)
    word[np.frombuffer(separators, np.uint8)] = False
    return word


# \x20 \x09-\x0D separate; all else, so every byte of a multi-byte character, is part of words
SPACED = byte_set(bytes([0x20, *range(0x09, 0x0E)]))
# letters a-z (after lower-casing), digits and every byte of non-ASCII characters
ALNUM = byte_set(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about CHUNK_BYTES of text each."""
    texts = batch.column(column)
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and the offset of each text; null is empty."""
    texts = pa.compute.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    if len(offsets) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """The words of a batch of texts.

    data: lower-cased bytes; starts, ends: byte range of each word; counts: words of each text;
    first: index of each text's first word, and the number of all words at the end.
    """

    def __init__(self, texts: pa.Array, member: np.ndarray) -> None:
        raw, offsets = text_bytes(texts)
        self.data, self.offsets = LOWER[raw], offsets
        inside = member[self.data]
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(raw))]
        begins[edges] = inside[edges]
        finishes[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.first[-1] = len(self.starts)
        self.counts = np.diff(self.first)
        self.inside = inside

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes (polynomial, then mixed); equal words agree anywhere."""
        n = len(self.data)
        low, high = powers(BASE, n)
        total = np.zeros(n + 1, np.uint64)
        terms = total[1:]
        np.add(self.data, 1, out=terms, dtype=np.uint64)
        whole = n // RUN * RUN
        runs = terms[:whole].reshape(-1, RUN)
        runs *= low
        runs *= high[: len(runs), None]
        terms[whole:] *= low[: n - whole] * high[-1]
        np.cumsum(terms, out=terms)
        # dividing by the power at the word's end makes the hash independent of its place
        low, high = powers(INVERSE, n)
        inverse = low[self.ends % RUN] * high[self.ends // RUN]
        return mixed((total[self.ends] - total[self.starts]) * inverse)


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
RUN = 4096


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two short tables: low[i % RUN] * high[i // RUN] is base to the power of i, for i up to n."""
    low = np.full(RUN + 1, base, np.uint64)
    low[0] = 1
    low = np.multiply.accumulate(low)
    high = np.full(n // RUN + 1, low[RUN], np.uint64)
    high[0] = 1
    return low[:RUN], np.multiply.accumulate(high)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))
