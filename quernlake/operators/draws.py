"""How often rows are drawn in resamples: the MD5 of key, resample and seed against the limits of a count, many keys at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that are drawn together, and the longest text that MD5 takes in one block.
ROWS, LONGEST = 65_536, 55
_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def words_of(keys: list[bytes]) -> list[np.ndarray]:
    """The little-endian words of keys of one length."""
    width = -(-len(keys[0]) // 4) * 4
    return list(np.ascontiguousarray(np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), "<u4").reshape(len(keys), -1).T))


def first_words(words: list[np.ndarray], length: int, suffix: bytes) -> np.ndarray:
    """The first four bytes, as a big-endian number, of the MD5 of each key with the suffix; at most LONGEST bytes together."""
    whole = length + len(suffix)
    tail = np.frombuffer((b"\0" * length + suffix + b"\x80").ljust(56, b"\0") + (8 * whole).to_bytes(8, "little"), "<u4")
    mixed = [w | tail[k] if tail[k] else w for k, w in enumerate(words)]
    a, b, c, d = (np.full(len(words[0]), x, np.uint32) for x in _START)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        g = (i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16
        f += a
        if g < len(mixed):
            f += mixed[g]
            f += np.uint32(_K[i])
        else:
            f += np.uint32((_K[i] + int(tail[g])) % 2**32)
        by = _TURNS[kind][i % 4]
        np.left_shift(f, np.uint32(by), out=turned)
        f >>= np.uint32(32 - by)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    return a.byteswap()


def tally(resamples: int, seed: int, steps: list[int]):
    """For mapInArrow over (key, score, positive): (resample, score, p, n), how many positives and negatives each resample draws at a score."""
    limits = np.array(steps, np.int64)

    def some(key: pa.Array, score: np.ndarray, positive: np.ndarray) -> pa.RecordBatch:
        keys = [k.encode() for k in key.to_pylist()]
        lengths = np.array([len(k) for k in keys])
        values, at = np.unique(score, return_inverse=True)
        at = 2 * at + positive
        drawn = np.zeros((resamples, 2 * len(values)), np.int64)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            chosen = [keys[k] for k in rows]
            words = words_of(chosen) if length else []
            for r in range(resamples):
                suffix = f":{r}:{seed}".encode()
                if words and length + len(suffix) <= LONGEST:
                    u = first_words(words, int(length), suffix)
                else:
                    u = np.array([int.from_bytes(hashlib.md5(k + suffix).digest()[:4], "big") for k in chosen])
                drawn[r] += np.bincount(at[rows], np.searchsorted(limits, u.astype(np.int64), side="right"), 2 * len(values)).astype(np.int64)
        made = [np.repeat(np.arange(resamples, dtype=np.int32), len(values)), np.tile(values, resamples), drawn[:, 1::2].ravel(), drawn[:, ::2].ravel()]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["resample", "score", "p", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= ROWS:
                yield drawn_of(held)
                held = []
        if any(x.num_rows for x in held):
            yield drawn_of(held)

    def drawn_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        key, score, positive = (pa.concat_arrays(table[c].chunks) for c in ("key", "score", "positive"))
        return some(key, score.to_numpy(zero_copy_only=False), positive.to_numpy(zero_copy_only=False).astype(np.int64))

    return run
