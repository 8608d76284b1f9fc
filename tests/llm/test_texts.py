"""Quality, line templates, licences, leaks and language model."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernlake.llm import class_lm, license_spans, line_templates, queries, site_quality, template_leaks
from quernlake.llm.license_texts import TEMPLATES

# --- quality classifier


def labelled(spark, documents, n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        kind = rng.choice(["good", "good", "good", "bad", "toxic"])
        words = [rng.choice(["river", "garden", "theory", "music", "table", "winter"]) for _ in range(40)]
        if kind == "bad":
            words = [w + "$$$" for w in words]
        if kind == "toxic":
            for _ in range(4):
                words[rng.randrange(40)] = rng.choice(["slurone", "slurtwo", "slurthree"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(kind != "bad"), int(kind == "toxic")))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_labels(spark, documents):
    docs, labels = labelled(spark, documents)
    got = {r.doc_id: r.kept for r in site_quality.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [r for r in labels.collect() if r.doc_id % 2]
    right = sum(got[r.doc_id] == bool(r.quality and not r.toxic) for r in held)
    assert right / len(held) > 0.97


def test_rates_shrink_towards_what_is_above(spark, documents):
    docs, labels = labelled(spark, documents)
    some = docs.where("doc_id >= 3").selectExpr("doc_id", "text", "CASE WHEN doc_id < 300 THEN 'a' ELSE 'b' END AS source", "'p' AS lang").unionByName(docs.where("doc_id < 3").selectExpr("doc_id", "text", "'sparse' AS source", "'p' AS lang"))
    rates = {r.host: r for r in site_quality.classify(some, labels).collect()}
    overall = sum(r.quality for r in labels.collect()) / 600
    assert abs(rates["sparse"].host_quality - overall) < 0.1
    assert all(0 < r.path_toxic < 1 and 0 < r.host_quality < 1 for r in rates.values())


def test_without_labels_all_is_kept(spark, documents, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = site_quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(r.kept for r in got)
    assert site_quality.classify(nothing, labels).count() == 0


# --- line templates


def lines_by_hand(rows):
    """The rules in plain Python, for rows of different ids."""
    docs = []
    for i, t in rows:
        lines = (t or "").split("\n")
        masked = [" ".join("<*>" if re.search(r"[0-9@]|://", w) else w for w in x.split()) or "" for x in lines]
        tokens = [m.split(" ") for m in masked]
        docs.append((i, t or "", lines, tokens))
    leaf = lambda w: (len(w), *w[:3])
    found, members, texts_of = [], {}, {}
    for i, t, lines, tokens in docs:
        for p, w in enumerate(tokens):
            if len(w) >= 3:
                beside = (leaf(tokens[p - 1]) if p else 0, leaf(tokens[p + 1]) if p + 1 < len(tokens) else 0)
                found.append((i, t, p, leaf(w), tuple(w), beside))
                members.setdefault(leaf(w), set()).add(tuple(w))
    groups = {}
    for i, t, p, lf, w, beside in found:
        general = False
        if len(members[lf]) > 1:
            usual = [Counter(x[k] for x in members[lf]).most_common(1)[0][0] for k in range(len(w))]
            general = sum(a == b for a, b in zip(w, usual, strict=True)) >= 0.7 * len(w)
        groups.setdefault(lf if general else (lf, w), []).append((i, p, t, beside))
    dropped = set()
    for key, rows_of in groups.items():
        need = 2 if len(rows_of) and (key[0][0] if isinstance(key[0], tuple) else key[0]) > 50 else 3
        if len({x[3] for x in rows_of}) >= need and len({x[2] for x in rows_of}) > 1:
            dropped |= {(i, p) for i, p, _, _ in sorted(rows_of, key=lambda x: (x[0], x[1]))[1:]}
    return {i: "\n".join(x for p, x in enumerate(lines) if (i, p) not in dropped) for i, _, lines, _ in docs}


def test_recurring_templates_go(documents):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = lambda: " ".join(word() for _ in range(rng.randint(4, 9)))
    notice = lambda k: f"Posted on 2024-01-{k % 28 + 1:02d} by user{k}@mail.com at the desk"
    long = " ".join(word() for _ in range(60))
    rows = []
    for k in range(40):
        lines = [own() for _ in range(4)]
        if k % 3 == 0:
            lines.insert(rng.randint(0, 4), notice(k))
        if k % 7 == 0:
            lines.insert(rng.randint(0, 4), "All rights reserved here.")
        if k in (5, 6):
            lines.insert(2, long)
        rows.append((k, "\n".join(lines)))
    rows += [(100 + k, rows[1][1]) for k in range(6)]  # copies: no line of theirs goes for that
    got = {r.row.doc_id: (r.row.text, r.n_dropped) for r in line_templates.drop_recurring(documents(rows)).collect()}
    want = lines_by_hand(rows)
    assert {i: t for i, (t, _) in got.items()} == want
    assert got[100][1] == 0 and got[3][1] >= 1 and got[6][1] == 2 and got[5][1] == 0
    assert sum("Posted on" in t for t, _ in got.values()) == 1


def test_blocks_of_lines_go_whole_and_near_copies_stay(documents):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = lambda: " ".join(word() for _ in range(8))
    block = [own() for _ in range(5)]
    rows = [(k, "\n".join([own(), own(), "", *block, "", own(), own(), own(), own()])) for k in range(10)]
    base = [own() for _ in range(30)]
    for k in range(6):
        at = 3 + 4 * k
        rows.append((100 + k, "\n".join([*base[:at], own(), *base[at + 1 :]])))
    got = {r.row.doc_id: (r.row.text, r.n_dropped) for r in line_templates.drop_recurring(documents(rows)).collect()}
    assert got[0] == (rows[0][1], 0)
    for k, text in rows[1:10]:
        assert got[k] == ("\n".join(x for x in text.split("\n") if x not in block), 5)
    assert all(got[i] == (text, 0) for i, text in rows[10:])


def test_line_rows_keep_their_columns(odd, nothing):
    got = line_templates.drop_recurring(odd)
    assert Counter((r.row.doc_id, r.row.text, r.row.key, r.row.items) for r in got.collect()) == Counter((r.doc_id, r.text, r.key, r["items"]) for r in odd.collect())
    assert got.schema["row"].dataType.fieldNames() == odd.columns
    assert line_templates.drop_recurring(nothing).count() == 0


# --- benchmark leaks

ITEM = "A train leaves Paris at 9 in the morning and travels 120 km towards Lyon, how many km does it travel in 3 hours?"
OTHER = "In the laboratory of Anna there are 14 bottles of acid and 5 bottles of base on the long shelf."


@pytest.mark.parametrize(("text", "leaks"), [
    (ITEM, [1]),
    ("Before. " + ITEM.replace("Paris", "Rome").replace("120", "95").replace("Lyon", "Milan") + " After.", [1]),
    (ITEM.upper(), [1]),
    ("A train leaves Paris at 9 in the night", []),
    ("Quite another text about Paris and 120 km of nothing in particular at all.", []),
    (ITEM + " " + OTHER, [1, 2]),
    (None, []),
    ("", []),
])
def test_leaks(spark, documents, text, leaks):
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, "two words"), (None, ITEM)], "item_id long, text string")
    got = template_leaks.leaked_items(documents([(7, text)]), bench).first()
    assert (got["items"], got.contaminated, got.kept) == (leaks, bool(leaks), not leaks)


def test_slots_must_be_consistent(spark, documents):
    item = "When Tom meets Tom he tells Tom about the 7 apples that Eva gave away last night"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    same = "so When Bob meets Bob he tells Bob about the 9 apples that Ina gave away last night"
    mixed = "so When Bob meets Ina he tells Pit about the 9 apples that Bob gave away last night"
    got = {r.doc_id: r["items"] for r in template_leaks.leaked_items(documents([(1, same), (2, mixed)]), bench).collect()}
    assert got == {1: [1], 2: []}


@pytest.mark.parametrize("tokens", [40, 500_000])
def test_every_item_of_tokens_is_found_verbatim(spark, documents, tokens):
    items = ["Anna Berta Clara Dora Emil Franz Gustav Hans Ida", "12 13 14 15 16 17", "two words", "What is 15 + 27 * 3?", ITEM, OTHER, "Yes."]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(k, x) for k, x in enumerate(items)] + [(50, "Yes. two words of no item"), (51, "Some clean text of thirteen words that has nothing to do with it.")]
    docs += [(60, "A car covers 60 km in the first hour and 90 km in the next hour of the long trip"), (61, "A car covers 50 km in the first hour and 50 km in the next hour of the long trip")]
    bench = bench.unionByName(spark.createDataFrame([(60, docs[-2][1])], "item_id long, text string"))
    frame = template_leaks.leaked_items(documents(docs), bench, block_tokens=tokens)
    assert frame._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: r["items"] for r in frame.collect()}
    assert got == {**{k: [k] for k in range(len(items))}, 50: [], 51: [], 60: [60], 61: [60]}


def test_leaks_after_headings_and_with_other_names_at_sentence_starts(spark, documents):
    short = "Which of the seven rivers flows through the old northern town?"
    apples = "Tom has 3 apples. Tom buys 5 more apples. How many apples does Tom have?"
    bench = spark.createDataFrame([(1, short), (2, apples)], "item_id long, text string")
    rows = [
        (1, "Question 5\n" + short),
        (2, "Question 5 " + short),
        (3, apples.replace("Tom", "Ann").replace("3", "4")),
        (4, "So Ann has 3 apples. Ann buys 5 more apples, how many apples does Ann have?"),
        (5, "Ann has 3 apples. Bob buys 5 more apples. How many apples does Eva have?"),
    ]
    got = {r.doc_id: r["items"] for r in template_leaks.leaked_items(documents(rows), bench).collect()}
    assert got == {1: [1], 2: [1], 3: [2], 4: [2], 5: []}


def test_leaks_of_items_with_few_plain_words(spark, documents):
    sums, names = "What is 15 + 27 * 3?", "Ann Bob 3 Eva 4 Tom 5 Kim 6 Lea 7"
    bench = spark.createDataFrame([(1, sums), (2, names)], "item_id long, text string")
    rows = [(1, "Now: " + sums), (2, sums.lower()), (3, "What is 16 + 27 * 3?"), (4, f"So {names} it is"), (5, names.replace("Eva", "Ina"))]
    got = {r.doc_id: r["items"] for r in template_leaks.leaked_items(documents(rows), bench).collect()}
    assert got == {1: [1], 2: [1], 3: [], 4: [2], 5: []}


def test_leak_query_against_searching_every_document(spark):
    sf = "/root/testdata/sf0.001"
    plain = lambda t: re.sub(r"\W+", " ", t.lower()).strip()
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r.doc_id: set(r["items"]) for r in queries.op5_template_leaks(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        assert got[i] >= {k for k, item in items.items() if len(item.split()) >= 8 and item in text}
    assert sum(map(bool, got.values())) < len(docs) / 4


def test_leaks_in_blocks_and_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(k, f"{ITEM} and then {k} birds of kind{k} sing") for k in range(5)], "item_id long, text string")
    got = template_leaks.with_leaks(odd, bench, block_tokens=30)
    assert got.count() == odd.count() and got.schema["row"].dataType.fieldNames() == odd.columns
    assert template_leaks.leaked_items(nothing, bench).count() == 0
    assert not template_leaks.leaked_items(odd, bench.where("false")).where("contaminated").count()


# --- licences


def test_licences_with_edits_and_spans(documents, odd, nothing):
    apache, mit = TEMPLATES[4][1], TEMPLATES[2][1]
    edited = mit.replace("free of charge, ", "").replace("sublicense", "sub-license")
    half = " ".join(apache.split()[: len(apache.split()) // 2])
    rows = [(1, "Intro words here. " + apache + " Outro."), (2, edited), (3, half), (4, "no licence at all"), (5, f"{mit}\n\n{mit}")]
    got = license_spans.license_spans(documents(rows)).collect()
    by = Counter((r.doc_id, r.license) for r in got)
    assert by[1, "Apache-2.0"] >= 1 and by[2, "MIT"] == 1 and by[5, "MIT"] == 2 and not by[4, "MIT"]
    first = next(r for r in got if r.doc_id == 1 and r.template == 4)
    assert first.coverage == 1.0 and first.first_word == 3 and all(r.coverage >= 0.8 for r in got)
    assert not [r for r in got if r.doc_id == 3 and r.template == 4]
    assert license_spans.license_spans(odd).count() == 0 and license_spans.license_spans(nothing).count() == 0


def test_alignment_against_the_full_table():
    rng = random.Random(3)
    for _ in range(60):
        template = [rng.randint(0, 9) for _ in range(12)]
        region = [x for x in template if rng.random() > 0.1]
        region.insert(rng.randint(0, len(region)), 99)
        best = 0
        score = [[0] * (len(region) + 1) for _ in range(len(template) + 1)]
        for i, a in enumerate(template, 1):
            for j, b in enumerate(region, 1):
                score[i][j] = max(0, score[i - 1][j] - 1, score[i][j - 1] - 1, score[i - 1][j - 1] + 2 if a == b else 0)
                best = max(best, score[i][j])
        assert license_spans.align(template, region, 0, 20)[0] == best


# --- language model


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), " "]


def test_contract_columns_by_hand(documents):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["The", "the", "cat", "É", "dog\tran", "x\x1cy"]) for _ in range(rng.randint(0, 30))) for _ in range(120)] + [None, "", "unseen words"]
    rows = list(enumerate(texts))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    total, types = sum(count.values()), len(count)
    got = {r.doc_id: r for r in class_lm.score_documents(documents(rows), dealt_limit=4, seed=3, classes=2, least=1).collect()}
    for i, t in rows:
        base = sum(math.log10((count[w] + 1) / (total + types + 1)) for w in tokens(t))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_the_model_sums_to_one(documents):
    """Over every continuation: each known word, the end and one unknown word."""
    texts = ["a b a b c", "a b d", "b a", "c a b e f"] * 5
    rows = list(enumerate(texts))
    train = documents(rows)
    model, counts = class_lm.train_model(train.select("doc_id", "text"), seed=3, classes=2, least=1)
    known = sorted(w for w in {w for t in texts for w in t.split()})
    probe = documents([(0, "a"), *[(k + 1, f"a {w}") for k, w in enumerate([*known, "zzz"])]]).selectExpr("doc_id", "text", "false AS held_out")
    got = {r.doc_id: r.score for r in class_lm.score(probe, model, counts).collect()}
    # P(a) P(x | a) P(end | x) / P(a), summed with the end, must be below one; without the last factor it is one
    of = {w: int(model.dealt.class_of(pa.array([w]))[0]) for w in known}
    def start(w):  # noqa: E306
        c = of.get(w, class_lm._RARE)
        return got[0] - model.transitions[of["a"], class_lm._BOUND], model.transitions[c, class_lm._BOUND]
    total = 10 ** model.transitions[of["a"], class_lm._BOUND]
    for k, w in enumerate([*known, "zzz"]):
        prefix, end = start(w)
        total += 10 ** (got[k + 1] - end - prefix)
    assert math.isclose(total, 1, abs_tol=0.05)


def test_classes_beat_the_base_on_held_out_text(documents):
    rng = random.Random(8)
    det, noun, verb = ["the", "a", "one"], [f"n{k}" for k in range(12)], [f"v{k}" for k in range(12)]
    sentence = lambda: f"{rng.choice(det)} {rng.choice(noun)} {rng.choice(verb)}"
    rows = [(k, " ".join(sentence() for _ in range(12))) for k in range(300)]
    got = class_lm.score_documents(documents(rows), seed=27, classes=3, least=2).where("held_out").collect()
    assert sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got)


def test_all_frequent_words_are_dealt_and_the_score_is_the_models(documents):
    rng = random.Random(8)
    det, noun, verb = ["the", "a", "one"], [f"n{k}" for k in range(12)], [f"v{k}" for k in range(12)]
    rows = [(k, " ".join(f"{rng.choice(det)} {rng.choice(noun)} {rng.choice(verb)}" for _ in range(12))) for k in range(300)] + [(300 + k, f"the n1 once{k} v2 pair{k // 2}") for k in range(12)] + [(320, "")]
    docs = documents(rows).withColumn("held_out", class_lm.held_out(F.col("doc_id")))
    model, counts = class_lm.train_model(docs.where("NOT held_out"), seed=12, classes=3, least=3)
    of = lambda w: int(model.dealt.class_of(pa.array([w]))[0])
    assert class_lm._RARE not in map(of, det + noun + verb) and len({of(w) for w in noun}) == 1 and len({of(w) for w in verb}) == 1 and of(noun[0]) != of(verb[0])
    known = {r.word: r.n for r in counts.collect()}
    held = {r.doc_id: r.held_out for r in docs.collect()}
    pairs = Counter()
    for i, t in rows:
        path = [0, *map(of, t.split()), 0]
        if not held[i]:
            pairs.update(zip(path, path[1:], strict=False))
    into, total = Counter(), sum(pairs.values())
    for (_, b), n in pairs.items():
        into[b] += n
    out = Counter()
    for (a, _), n in pairs.items():
        out[a] += n
    move = lambda a, b: math.log10((pairs[a, b] + 4 * (into[b] + 1) / (total + 5)) / (out[a] + 4))
    rare = {w: n for w, n in known.items() if w != " " and n < 3}
    once, twice = (sum(n == k for n in known.values()) for k in (1, 2))
    discount = min(once / (once + 2 * twice), 0.99)
    in_class = Counter()
    for w, n in known.items():
        in_class[of(w)] += n

    def emit(w):
        if of(w) != class_lm._RARE:
            return math.log10(known[w] / in_class[of(w)])
        return math.log10(((known[w] - discount) if w in known else discount * len(rare) + 1) / (sum(rare.values()) + 1))

    got = {r.doc_id: r.score for r in class_lm.score(docs.select("doc_id", "text", "held_out"), model, counts).collect()}
    for i, t in rows:
        path = [0, *map(of, t.split()), 0]
        assert math.isclose(got[i], sum(move(a, b) for a, b in zip(path, path[1:], strict=False)) + sum(map(emit, t.split())), rel_tol=1e-9), i


def test_words_beyond_the_workers_table_are_dealt_too(documents):
    """A table of 20 or of 9 words gives the classes and scores of one that holds all; with equal counts, too, it is filled to its limit."""
    rng = random.Random(8)
    det, noun, verb = ["the", "a", "one"], [f"n{k}" for k in range(12)], [f"v{k}" for k in range(12)]
    rows = [(k, " ".join(f"{rng.choice(det)} {rng.choice(noun)} {rng.choice(verb)}" for _ in range(12))) for k in range(300)] + [(300 + k, f"the n1 once{k} v2 v3 v4 pair{k // 2}") for k in range(12)] + [(320, ""), (321, None)]
    docs = documents(rows)
    whole, middle, small = ({r.doc_id: r for r in class_lm.score_documents(docs, dealt_limit=limit, seed=9, classes=3, least=3).collect()} for limit in (1000, 20, 9))
    for i, r in whole.items():
        for other in (middle[i], small[i]):
            assert (r.n_tokens, r.n_known, r.train_tokens) == (other.n_tokens, other.n_known, other.train_tokens)
            assert math.isclose(r.score, other.score, rel_tol=1e-9) and math.isclose(r.base_score, other.base_score, rel_tol=1e-9)
    model, counts = class_lm.train_model(docs.selectExpr("doc_id", "coalesce(text, '') AS text"), dealt_limit=9, seed=9, classes=3, least=3)
    assert len(model.dealt.hashes) == 9 and counts.where("class >= 2").count() == 27 - 9 and counts.where("class IS NOT NULL AND n < 3").count() == 0
    even = documents([(k, " ".join(f"w{(k + j) % 50}" for j in range(50))) for k in range(10)])
    model, counts = class_lm.train_model(even.select("doc_id", "text"), dealt_limit=20, seed=5, classes=3, least=3)
    assert 0 < len(model.dealt.hashes) <= 20 and len(model.dealt.hashes) + counts.where("class >= 2").count() == 50


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    m = rng.poisson(3, (22, 22)).astype(float)
    m[2:12, 12:22] += 40

    def likelihood(of):
        pairs = np.zeros((6, 6))
        np.add.at(pairs, (of[:, None], of[None, :]), m)
        f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0).sum()
        return f(pairs) - f(pairs.sum(0)) - f(pairs.sum(1))

    start = class_lm.exchange(m, 4, sweeps=0)
    found = class_lm.exchange(m, 4)
    assert likelihood(found) > likelihood(start)
    for w in range(2, 22):  # no single move raises it: the gains are those of the likelihood
        assert all(likelihood(np.where(np.arange(22) == w, c, found)) <= likelihood(found) + 1e-6 for c in range(2, 6))


def test_gains_of_rare_words_are_those_of_the_exchange():
    rng = np.random.default_rng(3)
    pairs = rng.poisson(200, (9, 9)).astype(float)
    for _ in range(20):
        right, left = rng.poisson(0.7, 9).astype(float), rng.poisson(0.7, 9).astype(float)
        without = pairs.copy()
        without[class_lm._RARE] -= right
        without[:, class_lm._RARE] -= left
        want = class_lm._gains(without, right, left, 0.0)[2:]
        assert np.allclose(class_lm._gains_of_rare(pairs, right, left)[2:] - want, 0, atol=1e-6)


def test_lm_odd_rows(odd, nothing):
    got = class_lm.score_documents(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)
    assert class_lm.score_documents(nothing).count() == 0
