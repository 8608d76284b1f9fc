"""BPE by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens that accepts exactly the correct
tokenizations. It begins as one state with a loop for every base symbol. The gadget of a merge (u, v) -> uv
  * copies the state that u leads to, without the arcs that the merge forbids (v; for u = v also uv), and leads u there,
  * adds to every state with an arc u an arc uv, which leads where v leads (for u = v: where u led before).
All arcs of a token lead to one state, so the automaton is two tables: the state of each token, and for each token the
chain of copies that its merges made, each with its parent, the merge at which it was copied and the arcs it lost.
Whether a state has an arc for a token is read from these by stepping from the later of the two to what it was made
from, whole chains at a time, and remembered.

A pre-split word has exactly one accepted path. Encoding walks the table over the word, longest token first, and
returns from dead ends; which path leads from a state over the rest of a word is remembered, as words share endings.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quernlake.llm.rows import id_and_text
from quernlake.llm.library_ids import WordTable, keeps_white_space_apart
from quernlake.llm.words import held, steps


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class MergeAutomaton:
    """The compiled merges of a vocabulary: `step` is a transition, `encode` the path of a word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "", memo: int = 250_000):
        made = {a + b: k for k, (a, b) in enumerate(merges, 1)}
        if len(made) < len(merges) or any(x not in vocab or made.get(x, 0) >= k for k, pair in enumerate(merges, 1) for x in pair):
            raise ValueError("each merge must make a token of its own, of symbols or of tokens that earlier merges make")
        self.vocab, self.memo = vocab, memo
        self.born = {t: made.get(s, 0) for s, t in vocab.items()}
        self.left = {vocab[a + b]: vocab[a] for a, b in merges}
        self.since, self.owner, self.first_parent = [0], [-1], {}
        self.copies: dict[int, list[int]] = {}  # of the state that a token leads to, and the merge of each
        self.merged: dict[int, list[int]] = {}
        self.lost: dict[int, dict[int, int]] = {}  # arcs that went with the copies, and at which merge
        self.state = dict.fromkeys(vocab.values(), 0)
        self.arcs: dict[int, bool] = {}
        self.paths: dict[tuple[int, str], tuple[int, ...] | None] = {}
        #: Tokens of a word's end, without its mark.
        self.final = {s[: len(s) - len(end)]: i for s, i in vocab.items() if s.endswith(end)}
        for k, (a, b) in enumerate(merges, 1):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if not self.step(self.state[u], v):
                continue
            old, new = self.state[u], len(self.since)
            self.since.append(k)
            self.owner.append(u)
            self.first_parent.setdefault(u, old)
            self.copies.setdefault(u, []).append(new)
            self.merged.setdefault(u, []).append(k)
            self.lost.setdefault(u, {}).update(dict.fromkeys((u, uv) if u == v else (v,), k))
            self.state[u] = new
            self.state[uv] = old if u == v else self.state[v]
        self.arcs.clear()
        self.most = max(map(len, vocab), default=1)
        #: The longest token that goes on after its first HEAD symbols, by these.
        self.reach: dict[str, int] = {}
        for s in vocab:
            if len(s) > HEAD and not (end and s.endswith(end)):
                self.reach[s[:HEAD]] = max(self.reach.get(s[:HEAD], 0), len(s))
        self.ends = frozenset(self.final.values())
        self.heads: dict[str, tuple[int, list[tuple[int, int]]]] = {}

    def step(self, state: int, token: int) -> bool:
        """Whether `state` has an arc for `token`."""
        key = state << 32 | token
        known = self.arcs.get(key)
        if known is None:
            q, t, known = state, token, True
            while q:  # every base symbol loops at the first state, 0
                born = self.born[t]
                if born > self.since[q]:  # the gadget gave q this arc because q had one for the left part
                    t = self.left[t]
                    continue
                u = self.owner[q]
                if self.lost[u].get(t, self.since[q] + 1) <= self.since[q]:
                    known = False
                    break
                before = bisect_left(self.merged[u], born)
                q = self.copies[u][before - 1] if before else self.first_parent[u]
            if len(self.arcs) >= self.memo:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def encode(self, symbols: str) -> tuple[int, ...]:
        """Ids of a word: its symbols, of which the last carries the mark of the word's end."""
        if len(symbols) > LONG_WORD:
            return self._walk(symbols)
        found = self._path(0, symbols)
        if found is None:
            raise ValueError(f"{symbols!r} has a symbol that the vocabulary lacks")
        return found

    def _arcs(self, q: int, symbols: str, at: int, most: int) -> Iterator[tuple[int, int]]:
        """(size, token) of the arcs of q that go on with the symbols at `at`, longest first."""
        n, arcs, last = len(symbols), self.arcs, len(symbols) - at
        vocab, base = self.vocab, q << 32
        for size in range(min(most, last, self.most), 0, -1):
            token = self.final.get(symbols[at:n]) if size == last else vocab.get(symbols[at : at + size])
            if token is not None:
                allowed = arcs.get(base | token)
                if allowed or allowed is None and self.step(q, token):
                    yield size, token

    def _path(self, q: int, rest: str) -> tuple[int, ...] | None:
        """The accepted path from q over the rest of a word; None if there is none."""
        paths, state = self.paths, self.state
        n, arcs, base = len(rest), self.arcs, q << 32
        heads = self.heads.get(rest[:HEAD]) or self._head(rest[:HEAD])
        for size, token in ((n, self.final.get(rest)), *((k, self.vocab.get(rest[:k])) for k in range(min(n - 1, heads[0]), HEAD, -1)), *heads[1]):
            if token is None or size >= n and token not in self.ends:
                continue
            allowed = arcs.get(base | token)
            if not (allowed or allowed is None and self.step(q, token)):
                continue
            if size == n:
                return (token,)
            key = (state[token], rest[size:])
            found = paths.get(key, 0)
            if found == 0:
                found = self._path(*key)
                if len(paths) >= self.memo:
                    paths.clear()
                paths[key] = found
            if found is not None:
                return (token, *found)
        return None

    def _head(self, head: str) -> tuple[int, list[tuple[int, int]]]:
        """Of what begins with `head`: the size of its longest token, and the tokens inside `head`, longest first."""
        if len(self.heads) >= self.memo:
            self.heads.clear()
        inside = [(k, self.vocab[head[:k]]) for k in range(len(head), 0, -1) if head[:k] in self.vocab]
        self.heads[head] = found = (self.reach.get(head, 0) if len(head) == HEAD else 0, inside)
        return found

    def _walk(self, symbols: str) -> tuple[int, ...]:
        """The same path by a loop, in memory linear in the word."""
        n, ids, path, dead = len(symbols), [], [], set()
        at, q, most = 0, 0, n
        while at < n:
            for size, token in self._arcs(q, symbols, at, most):
                if (at + size, token) not in dead:
                    path.append((at, size))
                    ids.append(token)
                    at, q, most = at + size, self.state[token], n
                    break
            else:
                if not path:
                    raise ValueError("the word has a symbol that the vocabulary lacks")
                dead.add((at, ids.pop()))
                at, size = path.pop()
                most, q = size - 1, self.state[ids[-1]] if ids else 0
        return tuple(ids)


#: Bytes of text that are encoded at once: the more, the fewer words are looked up again.
STEP_BYTES = 8_000_000
#: Symbols of a word beyond which its rests are no longer remembered.
LONG_WORD = 48
#: Symbols by which the tokens that may come next are looked up at once.
HEAD = 4


def _in_a_row(runs: Iterable[Iterable[int]]) -> tuple[np.ndarray, np.ndarray]:
    ids, bounds = array("I"), array("q", [0])
    for run in runs:
        ids.extend(run)
        bounds.append(len(ids))
    return np.frombuffer(ids, np.uint32) if ids else np.empty(0, np.uint32), np.frombuffer(bounds, np.int64)


class WordBpe(WordTable):
    """A vocabulary file of word-end BPE: pre-splits as its file says, then runs the automaton on each word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # for the normaliser and pre-splitter on unusual characters only
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        # words are cut here only if the file has the form for it; else the library's own normaliser and pre-splitter see each text whole
        super().__init__(keeps_white_space_apart(spec), [x["content"] for x in spec["added_tokens"]])
        self.automaton = MergeAutomaton(model["vocab"], [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]], self.end)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = byte_symbols()
        labels = model["vocab"] | self.special
        self.labels = [""] * (max(labels.values()) + 1)
        for s, i in labels.items():
            self.labels[i] = s
        self.arrow_labels = pa.array(self.labels, pa.string())

    def split(self, text: str) -> list[str]:
        """Words of a text without added tokens, as byte symbols."""
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def whole(self, text: str) -> list[int]:
        """Ids of a text or a piece of one."""
        parts = self.specials.split(text) if self.specials else [text]
        return [i for part in parts if part for i in ([self.special[part]] if part in self.special else (i for w in self.split(part) for i in self.automaton.encode(w)))]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _in_a_row(map(self.whole, texts))

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        symbols, encode = self.symbols, self.automaton.encode
        return _in_a_row(encode(w if w.isascii() else "".join([symbols[b] for b in w.lower().encode()])) for w in words)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts that the arcs' labels spell, joined by a space as a vocabulary without decoder has it."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.arrow_labels.take(pa.array(ids))), " ")


def word_bpe(path: str) -> WordBpe:
    """The compiled vocabulary, once for each Python worker that is busy with it."""
    return held(f"automaton:{path}", lambda: WordBpe(path))


def encoded_steps(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice of rows with the ids of its texts and each text's first place."""
    bpe = word_bpe(path)
    for batch in steps(batches, step_bytes=STEP_BYTES):
        yield batch, *bpe.encode(batch.column("text"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text. Null and empty texts have no ids; rows are neither merged nor ordered."""

    def run(batches):
        for batch, ids, offsets in encoded_steps(batches, path):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the labels of the arcs."""

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), bpe.decode(lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0])], ["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def transcode(docs: DataFrame, path: str, summary: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array], pa.RecordBatch], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes the ids, and hands both to `summary` in the same task: neither is shuffled or stored."""

    def run(batches):
        bpe = word_bpe(path)
        for batch, ids, offsets in encoded_steps(batches, path):
            yield summary(batch, ids, offsets, bpe.decode(ids, offsets))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def transcode_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decoded (the labels of the ids) of every whole text."""

    def rows(batch: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray, decoded: pa.Array) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), lists, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return transcode(docs, path, rows, "doc_id long, n_tokens long, ids array<int>, decoded string", id_col, text_col)
