"""BPE by automaton, binary records: against the tokenizers library itself."""

import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quernlake.llm import framed_ids, merge_automaton, queries

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


TEXTS = [None, "", " ", "Hello, World!", "don't STOP 1234", "straße ÉCOLE naïve", "日本語のテキスト", "a" * 500, "<|endoftext|> mid <|startoftext|>x", " non breaking", "emoji 😀👩‍👩‍👧", "x_y--z...", "İstanbul ﬁ ǅ", "tab\tnew\nline\r\n", "é combining", "ａｂｃ", "\x00\x01"]


def test_automaton_agrees_with_the_library_on_texts_and_random_words(library):
    bpe = merge_automaton.word_bpe(PATH)
    rng = random.Random(7)
    words = ["".join(rng.choice("aeiounrstlmdé'-19") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    import pyarrow as pa

    texts = [t or "" for t in TEXTS] + [" ".join(words)] + words[:500]
    ids, offsets = bpe.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == expected(library, text), text[:80]
    decoded = bpe.decode(ids, offsets).to_pylist()
    assert decoded == [library.decode(expected(library, t), skip_special_tokens=False) for t in texts]


def test_automaton_of_small_merges_is_the_merge_order():
    """Against the textbook loop: the earliest merge that applies, first place first."""
    merges = [("a", "a"), ("aa", "a"), ("b", "c"), ("a", "bc"), ("aa", "bc")]
    vocab = {s: k for k, s in enumerate(["a", "b", "c", *(x + y for x, y in merges)])}
    automaton = merge_automaton.MergeAutomaton(vocab, merges)
    rank = {m: k for k, m in enumerate(merges)}
    rng = random.Random(1)
    for _ in range(2000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        parts = list(word)
        while True:
            found = min(((rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank), default=None)
            if found is None:
                break
            k = found[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert [*automaton.encode(word)] == [vocab[p] for p in parts], word


def test_a_merge_of_unknown_parts_is_refused():
    with pytest.raises(ValueError):
        merge_automaton.MergeAutomaton({"a": 0, "xa": 1}, [("x", "a")])


def test_encode_and_decode_rows(odd, nothing, library):
    rows = merge_automaton.encode_documents(odd, PATH)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows.collect()) == Counter((r.doc_id, tuple(expected(library, r.text))) for r in odd.collect())
    back = merge_automaton.decode_documents(rows, PATH).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, library.decode(expected(library, r.text), skip_special_tokens=False)) for r in odd.collect())
    assert merge_automaton.transcode_rows(nothing, PATH).count() == 0


def test_frames_are_checked():
    data = [b"", b"abc", bytes(1000)]
    file = io.BytesIO(b"".join(map(framed_ids.frame, data)))
    assert [framed_ids.read_frame(file) for _ in range(4)] == [*data, None]
    for at in (3, 9, 20):
        damaged = bytearray(framed_ids.frame(b"some data here"))
        damaged[at] ^= 1
        with pytest.raises(ValueError):
            framed_ids.read_frame(io.BytesIO(bytes(damaged)))


def test_records_round_trip(odd, nothing, library):
    files = framed_ids.write_records(odd, PATH)
    got = framed_ids.read_records(files).collect()
    want = Counter((r.doc_id, (*expected(library, r.text), 1)) for r in odd.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id or -1 for r in ordered] == sorted(r.doc_id or -1 for r in ordered)
    at = 0
    for r in ordered:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    assert framed_ids.write_records(nothing, PATH).count() == 0
    assert framed_ids.crc32_of(np.array([1, 2], "<u4")) == zlib.crc32(b"\1\0\0\0\2\0\0\0")


def test_queries_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    three = {r.doc_id: r for r in queries.op3_bpe_automaton(spark, sf).collect()}
    ten = {r.doc_id: r for r in queries.op10_framed_ids(spark, sf).collect()}
    assert set(three) == set(ten) == set(docs)
    start = 0
    import hashlib

    for i in sorted(docs):
        ids = expected(library, docs[i])
        raw = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (three[i].n_tokens, three[i].ids_sha256, three[i].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (ten[i].start, ten[i].n_tokens, ten[i].ids_crc32) == (start, len(ids) + 1, zlib.crc32(raw + b"\1\0\0\0"))
        start += len(ids) + 1
