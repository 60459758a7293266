"""Pairs of rows that meet in groups, inside a task: streaming over groups, links as stars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Groups up to this size are compared many at a time.
SMALL = 64


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the first row of each, from a stream sorted by integer keys.

    A group that spans batches is held back until it is complete; nothing else is.
    """
    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if not held.num_rows:
            continue
        key = np.stack([held.column(k).to_numpy() for k in keys])
        starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        if len(starts) > 1:
            yield held.slice(0, starts[-1]), starts[:-1]
            held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0])


def labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows over the links (x, y)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def stars(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what (x, y) connect: each row with the smallest of its component."""
    label = labels(n, x, y)
    leaves = np.flatnonzero(label != np.arange(n))
    return leaves, label[leaves]


def meetings(starts: np.ndarray, n: int, own: np.ndarray, left: np.ndarray, right: np.ndarray,
             near: Callable[[np.ndarray, np.ndarray], np.ndarray], at_once: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) rows of near pairs, each pair of a group once, a bounded number of comparisons at a time.

    ``near`` compares index arrays that broadcast against each other. Blocks as ``blocked_pairs``
    deals them: with left == right all pairs of the group, else those between the two blocks.
    """
    sizes = np.r_[starts[1:], n] - starts
    for size in np.unique(sizes[sizes > 1]):
        at = starts[sizes == size]
        if size <= SMALL:
            i, j = np.triu_indices(size, 1)
            for some in np.array_split(at, max(1, len(at) * len(i) // at_once)):
                x, y = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                ok = ((left[x] == right[x]) | (own[x] != own[y])) & near(x, y)
                yield x[ok], y[ok]
            continue
        for s in at:
            every = np.arange(s, s + size)
            a, b = (every[own[every] == side[s]] for side in (left, right))
            step = max(1, at_once // max(1, len(b)))
            for k in range(0, len(a), step):
                ok = near(a[k:k + step, None], b[None, :])
                x, y = np.nonzero(ok)
                x, y = a[k + x], b[y]
                if left[s] == right[s]:
                    x, y = x[x < y], y[x < y]
                yield x, y
