"""Draws of resamples against hashlib."""

import hashlib

import numpy as np
import pytest

from quernlake.operators import draws, evaluate


@pytest.mark.parametrize("length", [1, 3, 4, 11, 16, 40, 49])
def test_md5_of_many_keys(length):
    rng = np.random.default_rng(length)
    keys = [bytes(rng.integers(33, 127, length, dtype=np.uint8)) for _ in range(50)]
    for suffix in (b":0:7", b":199:7", b""):
        want = [int(hashlib.md5(k + suffix).hexdigest()[:8], 16) for k in keys]
        assert draws.first_words(draws.words_of(keys), length, suffix).tolist() == want


def test_draws_follow_the_hash_of_each_row(spark):
    """Keys of several lengths, also beyond one block and empty; counts by resample and score as of a loop over rows and resamples."""
    keys = ["", "1:2", "10:200", "é:3", "k" * 52, "k" * 90, *[f"{k}:{k * k}" for k in range(60)]]
    rows = [(key, (k % 4) / 4, k % 3 == 0) for k, key in enumerate(keys)]
    frame = spark.createDataFrame(rows, "key string, score double, positive boolean")
    steps = evaluate._poisson_steps()
    want = {}
    for key, score, positive in rows:
        for r in range(9):
            u = int(hashlib.md5(f"{key}:{r}:7".encode()).hexdigest()[:8], 16)
            at = want.setdefault((r, score), [0, 0])
            at[0 if positive else 1] += sum(u >= x for x in steps)
    got = {}
    for r in frame.mapInArrow(draws.tally(9, 7, steps), "resample int, score double, p long, n long").collect():
        at = got.setdefault((r.resample, r.score), [0, 0])
        at[0] += r.p
        at[1] += r.n
    assert got == want
