"""License scans: winnowed fingerprints of the templates pick candidates, a banded alignment measures them.

Of each template's hashes of GRAM successive words, winnowing keeps the smallest of every WINNOW neighbours (all, if the
template is short); these are an inverted index. All hashes of every whole document are looked up. Hits of a template
near one alignment give a region of the document, which is aligned with the template inside a band of BAND words: the
longest common subsequence with gaps charged. The matched share of the template's words is its coverage; matches from
COVERAGE up are reported with the words of the document they span. Of overlapping matches the one that explains most
words stays. A template's index and alignment are bounded by the template list; documents are never joined with each
other, and nothing is shuffled.

Cases: null and empty texts match nothing. A document may have many matches, of one licence too. Rows are neither
merged nor dropped; a row without a match gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quernlake.llm.bag_minhash import normal
from quernlake.llm.license_texts import TEMPLATES
from quernlake.llm.rows import id_and_text
from quernlake.llm.words import chunks, mix, steps

GRAM = 3
WINNOW = 4
BAND = 6
COVERAGE = 0.8


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's first word."""
    distinct, which, offsets = chunks(normal(texts))
    if not len(distinct):
        return np.empty(0, np.uint64), offsets
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[which], offsets


def _grams(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(offsets[1:][owner] - np.arange(len(owner)) >= GRAM)
    total = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        total = mix(total + words[at + k])
    return owner[at], at, total


def winnow(hashes: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Places of the smallest hash (the last of equals) of every `window` neighbours."""
    if len(hashes) <= window:
        return np.arange(len(hashes))
    seen = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(seen)) + window - 1 - np.argmin(seen[:, ::-1], axis=1))


class Index:
    """The inverted index of the templates."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        self.words, self.offsets = _words(pa.array([text for _, text in templates], pa.string()))
        owner, at, hashes = _grams(self.words, self.offsets)
        kept = np.concatenate([np.flatnonzero(owner == t)[winnow(hashes[owner == t])] if (owner == t).sum() > 12 else np.flatnonzero(owner == t) for t in range(len(templates))]) if templates else np.empty(0, np.int64)
        order = kept[np.argsort(hashes[kept], kind="stable")]
        self.hashes, self.owner, self.at = hashes[order], owner[order], at[order] - self.offsets[:-1][owner[order]]

    def template(self, t: int) -> list[int]:
        return self.words[self.offsets[t] : self.offsets[t + 1]].tolist()


def align(template: list[int], region: list[int], shift: int, band: int = BAND) -> tuple[int, int, int, int]:
    """(score, matched, first, end) of the best local alignment within `band` of the diagonal place = template's place + shift.

    A match scores 2, a skipped word of either side -1.
    """
    best = (0, 0, 0, 0)
    before: dict[int, tuple[int, int, int]] = {}  # region's place -> (score, matched, first)
    for i, word in enumerate(template):
        now: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(region), i + shift + band + 1)):
            options = []
            if region[j] == word:
                s, m, f = before.get(j - 1, (0, 0, j))
                options.append((s + 2, m + 1, f if m else j))
            if j in before:
                s, m, f = before[j]
                options.append((s - 1, m, f))
            if j - 1 in now:
                s, m, f = now[j - 1]
                options.append((s - 1, m, f))
            if options and (top := max(options, key=lambda x: (x[0], x[1], -x[2])))[0] > 0:
                now[j] = top
                if (top[0], top[1]) > best[:2]:
                    best = (top[0], top[1], top[2], j + 1)
        before = now
    return best


def matches(texts: pa.Array, index: Index, coverage: float = COVERAGE) -> Iterator[tuple[int, int, int, float, int, int]]:
    """(text, template, matched words, coverage, first word, end) of what each text has."""
    words, offsets = _words(texts)
    owner, at, hashes = _grams(words, offsets)
    low, high = np.searchsorted(index.hashes, hashes, "left"), np.searchsorted(index.hashes, hashes, "right")
    hit = np.flatnonzero(high > low)
    count = (high - low)[hit]
    entry = np.repeat(low[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    text, place, template = np.repeat(owner[hit], count), np.repeat(at[hit], count), index.owner[entry]
    start = place - index.at[entry]
    order = np.lexsort((start, template, text))
    found: list[tuple[int, int, int, int, int, int]] = []
    last = None
    for d, t, s in zip(text[order].tolist(), template[order].tolist(), start[order].tolist(), strict=True):
        if last is not None and last[:2] == (d, t) and s - last[2] <= BAND:
            continue  # inside the band of the alignment that begins at last
        last = (d, t, s)
        pattern = index.template(t)
        a, b = max(int(offsets[d]), s - BAND), min(int(offsets[d + 1]), s + len(pattern) + 2 * BAND)
        score, matched, first, end = align(pattern, words[a:b].tolist(), s - a + BAND // 2, BAND + BAND // 2)
        if matched >= coverage * len(pattern):
            found.append((d, -score, a + first, a + end, t, matched))
    found.sort()
    taken: dict[int, list[tuple[int, int]]] = {}
    for d, _, first, end, t, matched in found:
        spans = taken.setdefault(d, [])
        if all(end <= x or first >= y for x, y in spans):
            spans.append((first, end))
            base = int(offsets[d])
            yield d, t, matched, matched / len(index.template(t)), first - base, end - base


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, template (its number), matched_words, coverage, first_word and end_word of each match."""
    index = Index(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = list(matches(batch.column("text"), index, coverage))
            ids = batch.column("doc_id").to_pylist()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d in columns[0]], pa.int64()), pa.array([index.names[t] for t in columns[1]], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.int32())],
                ["doc_id", "license", "template", "matched_words", "coverage", "first_word", "end_word"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, license string, template int, matched_words int, coverage double, first_word int, end_word int")
