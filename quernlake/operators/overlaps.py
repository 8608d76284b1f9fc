"""Overlaps of the sets of two blocks in Arrow tables: all pairs of both at once, by dense products and counts, memory bounded by the blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Columns of one dense product, and pairs counted at a time.
WIDTH, STEP = 1_024, 4_000_000
#: A shingle is dense if it makes more than one of so many pairs of the two blocks.
DENSE = 300


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every element, and none of nulls."""
    array = lists.combine_chunks()
    array = array if isinstance(array, pa.Array) else pa.concat_arrays(array.chunks)
    sizes = np.nan_to_num(array.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), array.flatten().to_numpy(zero_copy_only=False)


def shared(left: pa.ChunkedArray, right: pa.ChunkedArray) -> np.ndarray:
    """How many elements each list of left shares with each of right."""
    (x, u), (y, v) = _flat(left), _flat(right)
    shape = len(left), len(right)
    known = np.intersect1d(u, v)
    found = np.zeros(shape, np.int64)
    if not len(known):
        return found
    at = lambda rows, values: (lambda k: (rows[ok := known[k] == values], k[ok]))(np.minimum(np.searchsorted(known, values), len(known) - 1))
    (x, u), (y, v) = at(x, u), at(y, v)
    p, q = np.bincount(u, minlength=len(known)), np.bincount(v, minlength=len(known))
    dense = p * q > shape[0] * shape[1] / DENSE
    columns = np.cumsum(dense) - 1
    for start in range(0, int(dense.sum()), WIDTH):
        sides = []
        for n, rows, values in ((shape[0], x, u), (shape[1], y, v)):
            here = dense[values] & (columns[values] >= start) & (columns[values] < start + WIDTH)
            sides.append(np.zeros((n, WIDTH), np.float32))
            sides[-1][rows[here], columns[values[here]] - start] = 1
        found += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    x, u = x[sparse := ~dense[u]], u[sparse]
    y, v = y[sparse := ~dense[v]], v[sparse]
    y = y[np.argsort(v, kind="stable")]
    q = np.where(dense, 0, q)
    first, times = np.cumsum(q) - q, q[u]
    ends = np.cumsum(times)
    low = 0
    while low < len(u):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + STEP, side="right")))
        some = times[low:high]
        place = np.repeat(first[u[low:high]] - (ends[low:high] - some - done), some) + np.arange(int(some.sum()))
        found += np.bincount(np.repeat(x[low:high], some) * shape[1] + y[place], minlength=shape[0] * shape[1]).reshape(shape)
        low = high
    return found


def pairs(left: pa.Table, right: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of left, row of right, shared, jaccard) of the pairs (n, shingles) that share an element and have a Jaccard of threshold or more."""
    both = shared(left["shingles"], right["shingles"])
    m, n = left["n"].to_numpy().astype(np.int64), right["n"].to_numpy().astype(np.int64)
    x, y = np.nonzero(both)
    both = both[x, y]
    jaccard = both / (m[x] + n[y] - both)
    near = jaccard >= threshold
    return x[near], y[near], both[near], jaccard[near]


def jaccard_of(left: pa.ChunkedArray, right: pa.ChunkedArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The Jaccard of the stated pairs of lists; 0 if either is empty."""
    both = shared(left, right)[x, y]
    m, n = (np.nan_to_num(s.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) for s in (left, right))
    return np.where((m[x] > 0) & (n[y] > 0), both / np.maximum(m[x] + n[y] - both, 1), 0.0)


def equal_rows(left: pa.ChunkedArray, right: pa.ChunkedArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For the stated pairs of signatures of one length a bit for each of the first 63 rows that are equal."""
    a, b = (_flat(s)[1].reshape(len(s), -1) for s in (left, right))
    found = np.zeros(len(x), np.int64)
    for k in range(min(a.shape[1], 63)):
        found |= (a[x, k] == b[y, k]).astype(np.int64) << k
    return found


def equal_share(left: pa.ChunkedArray, right: pa.ChunkedArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For the stated pairs of signatures of one length the share of equal rows."""
    a, b = (_flat(s)[1].reshape(len(s), -1) for s in (left, right))
    step = max(1, STEP // a.shape[1])
    return np.concatenate([(a[x[k : k + step]] == b[y[k : k + step]]).sum(axis=1) for k in range(0, len(x), step)]) / a.shape[1]
