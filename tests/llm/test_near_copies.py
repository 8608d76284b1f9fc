"""BagMinHash near-duplicates against comparing all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quernlake.llm import bag_minhash


def shingles(text):
    words = re.sub(r"[^\w]+|_", " ", (text or "").lower()).split()
    if not words:
        return Counter()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def weighted(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def classes_by_hand(rows):
    """Components of all pairs of rows with a similarity of 0.8 or more, or of the same id."""
    n = len(rows)
    bags = [shingles(t) for _, t in rows]
    of = list(range(n))

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(n):
        for j in range(i):
            if rows[i][0] == rows[j][0] or weighted(bags[i], bags[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                of[b] = a
    groups = {}
    for k in range(n):
        groups.setdefault(top(k), []).append(k)
    return {frozenset(rows[k][0] for k in g) for g in groups.values()}


def family(rng, size, edits, words):
    base = [rng.choice(words) for _ in range(100)]
    out = []
    for _ in range(size):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append(" ".join(text))
    return out


def test_classes_are_those_of_all_pairs(documents):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    texts = [t for _ in range(8) for t in family(rng, 8, 6, words)]
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    texts += ["same " * 40, "same " * 41, "same " * 80, "A, b; c!", "a b C", None, "", "..."]
    rows = list(enumerate(texts))
    got = {}
    for r in bag_minhash.near_duplicates(documents(rows)).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    found = set(map(frozenset, got.values()))
    want = classes_by_hand(rows)
    # pairs at the very edge may miss every band: no more than a few of the true classes are split
    assert sum(c not in found for c in want) <= 1
    truth = {i: c for c in want for i in c}
    assert all(c <= truth[min(c)] for c in found)
    assert all(min(c) == k for k, c in got.items())


def test_prefix_pairs_miss_no_pair(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(50)]
    texts = [t for _ in range(4) for t in family(rng, 6, 8, words)] + ["same " * 40, "same " * 42]
    heads = bag_minhash.prefix_tokens(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 0.8)
    apart = spark.createDataFrame([], "node long, component long")
    got = {tuple(r) for r in bag_minhash.prefix_pairs(heads, apart, 0.8).collect()}
    assert {tuple(r) for r in bag_minhash.prefix_pairs(heads, apart, 0.8, everyone=False).collect()} <= got
    bags = [shingles(t) for t in texts]
    assert got >= {(i, j) for j in range(len(texts)) for i in range(j) if weighted(bags[i], bags[j]) >= 0.8}


def test_near_copies_far_from_all_their_leaders(documents):
    """Two near copies share passages with many smaller ids, which lead all their buckets and are like neither."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    passage = lambda: [rng.choice(words) for _ in range(20)]
    shared = [passage() for _ in range(10)]
    flat = lambda passages: [w for p in passages for w in p]
    rows = []
    for k in range(200):
        own = set(rng.sample(range(10), 3))
        rows.append((k, " ".join(flat([passage() if j in own else shared[j] for j in range(10)]))))
    one = flat(shared)
    two = [*one[:70], "x", *one[71:150], "y", *one[151:]]
    rows += [(1000, " ".join(one)), (1001, " ".join(two))]
    bags = {i: shingles(t) for i, t in rows}
    assert weighted(bags[1000], bags[1001]) >= 0.8 and all(weighted(bags[k], bags[j]) < 0.6 for k in range(200) for j in (1000, 1001))
    got = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(documents(rows)).collect()}
    assert got[1000] == got[1001] == 1000


def test_a_large_family_of_copies_and_near_copies(documents):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(k, " ".join(base)) for k in range(200)] + [(1000 + k, " ".join([*base[:60], f"x{k}", *base[61:]])) for k in range(200)]
    got = bag_minhash.near_duplicates(documents(rows)).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1
    assert {r.copy_of for r in got if r.doc_id < 200} == {0}


def test_signatures_estimate_the_weighted_similarity():
    a, b = "x y z v w " * 8 + "p q r s t u", "x y z v w " * 5 + "p q r s t u k l m"
    owner, shingle, weight = bag_minhash.shingles(pa.array([a, b]))
    first = bag_minhash.signatures(owner, shingle, weight, 2, components=4096)
    assert abs((first[0] == first[1]).mean() - weighted(shingles(a), shingles(b))) < 0.04
    assert np.isfinite(first).all()


def test_exact_similarity():
    texts = ["a b c d e f", "a b c d e g", "", "a b", "a b c d e f a b c d e f"]
    n = len(texts)
    left = pa.array([texts[i] for i in range(n) for _ in range(n)])
    right = pa.array([texts[j] for _ in range(n) for j in range(n)])
    got = bag_minhash.multiset_jaccard(left, right)
    assert np.allclose(got, [weighted(shingles(texts[i]), shingles(texts[j])) for i in range(n) for j in range(n)])


def test_odd_rows(odd, nothing):
    got = bag_minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.class_id)
    assert all(by.values()) and by[5] == {5} and by[6] == {6}
    assert by[1] == by[2] == by[3]  # no words
    assert bag_minhash.near_duplicates(nothing).count() == 0
