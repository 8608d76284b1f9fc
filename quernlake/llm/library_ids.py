"""Ids of many texts at once, as the tokenizers library gives them or as another encoder of words does.

A word-end vocabulary whose pre-splitter keeps words inside white space gives a text the ids of its words in a row. So each
step's distinct words are found by Arrow, those of earlier steps are looked up in a table of at most LIMIT words, and only new
ones are encoded. The library gets many in one call: each word ends with a token that carries the mark of the word's end. Texts
that hold an added token, pieces of unusual characters, and all texts under a file of another form are encoded as they are.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quernlake.llm.words import chunks, held, spread

LIMIT = 300_000
#: Words of one call's text.
JOINED = 1_000
#: The pre-splitter for which words are cut here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Composed letters of one form in either case: what is left to normalise is case alone.
PLAIN = r"^[!-~À-ÖØ-öø-ÿĀ-įĲ-ž]*$"


def keeps_white_space_apart(spec: dict) -> bool:
    """Whether the file has the form that this module and the automaton cut words for."""
    normal = spec.get("normalizer") or {}
    split = spec.get("pre_tokenizer") or {}
    patterns = [p.get("pattern", {}).get("Regex") for p in split.get("pretokenizers", []) if p["type"] == "Split"]
    return [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and patterns == [PATTERN] and bool(spec["model"].get("end_of_word_suffix"))


class WordTable:
    """A table of words that have been encoded, in front of what encodes them: `_plain` for words of plain letters or marks, `_whole` for anything else."""

    def __init__(self, by_words: bool, added: list[str]):
        self.by_words, self.added = by_words, added
        self.words = pa.array([], pa.string())
        self.starts = self.lengths = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each begins and the last ends."""
        raise NotImplementedError

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts or pieces as they are."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts with add_special_tokens=False, and each text's first place."""
        whole = np.full(len(texts), not self.by_words)
        for token in self.added if self.by_words else ():
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_words(pc.ascii_lower(texts))  # the form has a normaliser to lower case
        ids, offsets = self._by_words(pc.ascii_lower(texts.filter(pa.array(~whole)))) if not whole.all() else (np.empty(0, np.uint32), np.zeros(1, np.int64))
        own, bounds = self._whole(texts.filter(pa.array(whole)).to_pylist())
        lengths, starts = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        lengths[~whole], lengths[whole] = np.diff(offsets), np.diff(bounds)
        starts[~whole], starts[whole] = offsets[:-1], bounds[:-1] + len(ids)
        return spread(np.concatenate([ids, own]), starts, lengths, np.arange(len(texts)), np.arange(len(texts) + 1))

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, which, offsets = chunks(texts)
        plain = pc.match_substring_regex(pieces, PLAIN)
        cut, word_of, bounds = chunks(pc.if_else(plain, pc.replace_substring_regex(pieces, f"({PATTERN})", r"\1 "), pieces))
        # an unusual piece has no white space, so it is one entry among the words, encoded by itself
        usual = pc.match_substring_regex(cut, PLAIN).to_numpy(zero_copy_only=False)
        starts, lengths = self._known(cut, usual)
        words, at = spread(word_of, bounds[:-1], np.diff(bounds), which, offsets)
        return spread(self.ids, starts, lengths, words, at)

    def _known(self, words: pa.Array, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids are in the table, and how many, after adding those that it lacks."""
        at = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        joined, alone = words.take(pa.array(new[usual[new]])), words.take(pa.array(new[~usual[new]])).to_pylist()
        ids, bounds = self._plain(joined.to_pylist())
        more, own = self._whole(alone)
        lengths = np.empty(len(words), np.int64)
        lengths[at >= 0] = self.lengths[at[at >= 0]]
        lengths[new[usual[new]]], lengths[new[~usual[new]]] = np.diff(bounds), np.diff(own)
        starts = np.empty(len(words), np.int64)
        starts[at >= 0] = self.starts[at[at >= 0]]
        base = len(self.ids)
        starts[new[usual[new]]], starts[new[~usual[new]]] = base + bounds[:-1], base + len(ids) + own[:-1]
        # this step's words come first; of the earlier ones as many as there is room for
        values, ends = spread(np.concatenate([self.ids, ids, more]), starts, lengths, np.arange(len(words)), np.arange(len(words) + 1))
        used = np.zeros(len(self.words), bool)
        used[at[at >= 0]] = True
        kept = np.flatnonzero(~used)[: max(0, LIMIT - len(words))]
        old, old_ends = spread(self.ids, self.starts, self.lengths, kept, np.arange(len(kept) + 1))
        self.words = pa.concat_arrays([words, self.words.take(pa.array(kept))])
        self.ids = np.concatenate([values, old])
        self.lengths = np.concatenate([lengths, np.diff(old_ends)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        return self.starts[: len(words)], self.lengths[: len(words)]


class LibraryIds(WordTable):
    """The tokenizers library's own tokenizer behind a table of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        super().__init__(keeps_white_space_apart(spec), [x["content"] for x in spec["added_tokens"]])
        labels = spec["model"]["vocab"]
        self.ends = np.zeros(max(labels.values()) + 1, bool)
        if self.by_words:
            self.ends[[i for s, i in labels.items() if s.endswith(spec["model"]["end_of_word_suffix"])]] = True

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found) if found else np.empty(0, np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, _ = self._whole([" ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)])
        bounds = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        if len(bounds) - 1 != len(words) or bounds[-1] != len(ids):  # a word was cut in two after all
            return self._whole(words)
        return ids, bounds


def library_ids(path: str) -> LibraryIds:
    return held(f"library:{path}", lambda: LibraryIds(path))
