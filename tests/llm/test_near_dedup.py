import random
import re
from collections import Counter

import numpy as np
import pytest

from allotau.llm import near_dedup as N

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def bag(text):
    w = WORD.findall(text.lower())
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else Counter()


def similarity(a, b):
    shared = sum(min(n, b[k]) for k, n in a.items())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


def brute(docs):
    par = {i: i for i, _ in docs if i is not None}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    bags = [(i, t, bag(t)) for i, t in docs if i is not None and t]
    for n, (i, t, a) in enumerate(bags):
        for j, u, b in bags[:n]:
            if find(i) != find(j) and (t == u or similarity(a, b) >= 0.8):
                x, y = find(i), find(j)
                par[max(x, y)] = min(x, y)
    return {i: find(i) for i in par}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, base = [], [" ".join(rng.choices(vocabulary, k=rng.randint(3, 220))) for _ in range(25)]
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, max(1, len(words) // 20))):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
        docs.append((i, " ".join(words)))
    return docs + [(n + i, docs[3][1]) for i in range(30)]


def classes(spark, docs):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, class_id string")
    return [(r["doc_id"], r["class_id"]) for r in N.near_duplicates(df).collect()]


def test_counts_equal_plain_shingling():
    texts = ["a b c d e f", "", "A-b!", "é ü x y z é ü x y z é ü", "same same same same same same same", "x" * 50, "\n. ."] + [t for _, t in corpus(1, 20)]
    doc, h, n = N.shingle_counts(texts)
    for i, t in enumerate(texts):
        assert sorted(n[doc == i].tolist()) == sorted(bag(t).values())
    again, h2, _ = N.shingle_counts([texts[0]])
    assert set(h2.tolist()) == set(h[doc == 0].tolist())


def test_texts_over_a_batch_give_the_same_counts(monkeypatch):
    texts = [" ".join(f"w{i % 97}" for i in range(3000)), "a b c d e f g", "a b " + "q" * 12_000 + " c d e f " + "z" * 5000 + " g h", "y" * 20_000, "y" * 19_999]
    whole = N.shingle_counts(texts)
    monkeypatch.setattr(N, "BATCH_BYTES", 5000)
    cut = N.shingle_counts(texts)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


@pytest.mark.parametrize("weights", [(1, 1), (3, 1), (40, 25)])
def test_signatures_estimate_weighted_jaccard(weights):
    rng = np.random.default_rng(0)
    m, n = 4096, 200
    shingles = N.mix(np.arange(n, dtype=np.uint64) + np.uint64(77))
    a, b = np.full(n, weights[0]), np.where(np.arange(n) < 150, rng.integers(1, weights[0] + weights[1], n), 0)
    doc = np.concatenate([np.zeros(n, int), np.ones((b > 0).sum(), int)])
    s = N.bag_signatures(2, doc, np.concatenate([shingles, shingles[b > 0]]), np.concatenate([a, b[b > 0]]), m)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 4.5 * np.sqrt(true * (1 - true) / m) + 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_classes_equal_brute_force(spark, seed):
    docs = corpus(seed)
    assert dict(classes(spark, docs)) == brute(docs)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(11)
    base, docs = [f"b{i}" for i in range(120)], []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = f"u{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    assert dict(classes(spark, docs)) == brute(docs)


def test_edges(spark):
    long = " ".join(f"w{i % 5003}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, ""), (4, "!!"), (5, "!!"), (6, "one two"), (7, "One, two."), (8, "one two three"), (None, "one two"), (9, long), (10, long + " end"), (11, long), (6, "one two")]
    got = classes(spark, docs)
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (6, 6), (7, 6), (8, 8), (None, None), (9, 9), (10, 9), (11, 9)], key=str)
    assert classes(spark, []) == []


def test_texts_of_one_id_are_linked(spark):
    texts = [" ".join(f"{p}{i}" for i in range(40)) for p in "abcdef"]
    docs = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (7, texts[1]), (7, texts[1]), (3, texts[2] + " end"), (9, texts[2]), (9, texts[3]), (2, texts[4]), (2, None)]
    got = classes(spark, docs)
    assert len(got) == len(docs)
    assert dict(got) == brute(docs) == {1: 1, 5: 1, 7: 1, 3: 3, 9: 3, 2: 2}


def test_one_id_with_many_rows(spark):
    near = [" ".join(f"w{i}" for i in range(60 + k)) for k in range(4)]
    docs = [(5, near[0])] * 300 + [(6, near[1]), (4, near[2])] + [(8, near[3])] * 100
    got = classes(spark, docs)
    assert len(got) == len(docs) and set(got) == {(5, 4), (6, 4), (4, 4), (8, 4)}


def test_texts_of_one_id_stay_classes_of_their_own(spark):
    texts = [" ".join(f"{p}{i}" for i in range(40)) for p in "abc"]
    docs = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (7, texts[1] + " end"), (5, texts[2]), (5, texts[2] + " end")]
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {1} and len({r["text_class"] for r in got}) == 3
    kept = [(r["doc_id"], r["text_class"]) for r in got if r["kept"]]
    assert sorted(i for i, _ in kept) == [1, 5, 5] and len(set(kept)) == 3


def test_query_equals_brute_force(spark):
    from conftest import SF

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = N.op9_near_dedup(spark, SF).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(docs) and len(got) == len(docs)
    assert all(r["kept"] for r in got if r["doc_id"] == r["class_id"])


def test_extra_columns_of_helpers_names_change_nothing(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine ten" if i < 3 else f"other {i} words here and there for row {i}") for i in range(6)], "doc_id long, text string")
    odd = docs.select("*", *[F.lit(1).alias(c) for c in ("sum", "bands", "id", "bucket", "class_id", "kept", "weight", "n")])
    want, got = (sorted(map(tuple, N.near_duplicates(df).collect())) for df in (docs, odd))
    assert got == want
