"""Vectorised cutting of many texts at once, for the operators that run in Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of a batch handles: bounds memory, whatever the number of rows in an Arrow batch.
STEP_BYTES = 4_000_000


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most step_bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + step_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces between ASCII white space: the distinct ones, for each piece its place among them, and each text's first piece."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at either end leaves empty pieces
        offsets = np.concatenate([[0], np.cumsum(full)]).astype(np.int64)[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


def spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the runs values[starts[k] : starts[k] + lengths[k]] for k in `which`; offsets of texts over pieces become offsets over values."""
    sizes = lengths[which]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    index = np.repeat(starts[which] - ends[:-1], sizes) + np.arange(ends[-1])
    return values[index], ends[offsets]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def rolled(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every `size` successive words inside a text; of all its words, if it has fewer."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - offsets[:-1][owner]
    left = n[owner] - place
    total = np.zeros(len(words), np.uint64)
    for k in range(size):
        part = mix(words[k:] + ODD[k]) * ODD[k]
        total[: len(part)] += np.where(left[: len(part)] > k, part, np.uint64(0))
    whole = (left >= size) | (place == 0)
    return owner[whole], mix(total[whole])


def release() -> None:
    """Gives memory that is no longer in use back to the machine: workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """State of an operator that its tasks in one worker share. A worker holds one such state: that of another operator goes first."""
    found = _held.get(name)
    if found is None:
        _held.clear()
        release()
        found = _held[name] = make()
    return found


#: Characters of a piece that is remembered, at most.
LONGEST = 64


class Remembered:
    """What was computed for a piece. Two generations of `limit` pieces of up to LONGEST characters: a full one ages, and the aged one goes, so memory is bounded and what is in use stays."""

    def __init__(self, compute: Callable[[str], object], limit: int = 100_000):
        self.compute, self.limit, self.young, self.old = compute, limit, {}, {}

    def one(self, piece: str):
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                found = self.compute(piece)
            self.put(piece, found)
        return found

    def put(self, piece: str, value: object) -> None:
        if len(piece) > LONGEST:
            return
        if len(self.young) >= self.limit and piece not in self.young:
            self.old, self.young = self.young, {}
        self.young[piece] = value

    def all(self, pieces: list[str]) -> list:
        young, one = self.young, self.one
        return [found if (found := young.get(x)) is not None else one(x) for x in pieces]

