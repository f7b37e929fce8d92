"""Groups of rows that lie together in Arrow batches, and links inside a block as stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut so that no group of equal keys (numbers, never null) is divided, each with the places
    where its groups begin and its number of rows. The rows of a group follow each other."""

    def edges(batch: pa.RecordBatch) -> np.ndarray:
        key = np.stack([batch.column(k).to_numpy() for k in keys])
        return np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True])))

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = edges(batch)[1:-1]
        if rest:
            last = rest[-1]
            if any(last.column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
                cuts = np.concatenate(([0], cuts))
        if len(cuts):
            done = pa.concat_batches([*rest, batch.slice(0, cuts[-1])])
            yield done, edges(done)
            rest = [batch.slice(cuts[-1])]
        else:
            rest.append(batch)
    if rest:
        done = pa.concat_batches(rest)
        yield done, edges(done)


def least_reached(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of `count` members the least one that it reaches over the links i, j."""
    label = np.arange(count)
    while len(i):
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            break
        label = least
    return label
