from collections import defaultdict

import numpy as np
from conftest import SF

from allotau.llm import packing as P


def brute_best_fit(lengths, openings):
    """By looking at every bin."""
    rooms, where = [], []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            best = min(r for r, _ in fits)
            i = max(i for r, i in fits if r == best)
        else:
            i = len(rooms)
            rooms.append(openings[n])
        rooms[i] -= n
        where.append(i)
    return rooms, where


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = sorted(rng.integers(1, 65, 60).tolist(), reverse=True)
        openings = P.opening_rule((16, 32, 64), 64, P.default_cost)
        where, offsets, fills = P.best_fit(lengths, openings)
        rooms, plain = brute_best_fit(lengths, openings)
        sizes = defaultdict(list)
        for n, b, o in zip(lengths, where, offsets, strict=True):
            sizes[b].append((o, n))
        for b, parts in sizes.items():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at == fills[b] <= 64
        assert len(fills) == len(rooms) and sum(fills) == sum(lengths)
        assert sorted(fills) == sorted(sum(n for n, i in zip(lengths, plain, strict=True) if i == b) for b in range(len(rooms)))


def test_least_cost_rule_wins_and_bins_are_downsized():
    lengths = np.array([16] * 10)
    where, _, size, _ = P.pack_block(lengths, (16, 64), lambda c: float(c))
    assert set(size.tolist()) <= {16, 64} and size.sum() >= 160
    _, _, dear, _ = P.pack_block(lengths, (16, 64), lambda c: c**2)
    assert set(dear.tolist()) == {16}
    _, _, cheap, _ = P.pack_block(lengths, (16, 64), lambda c: c + 100)
    assert set(cheap.tolist()) <= {16, 32, 64} and len(set(cheap.tolist())) >= 1
    _, _, last, fill = P.pack_block(np.array([60, 5]), (8, 64), lambda c: c + 1)
    assert last.tolist() == [64, 8] and fill.tolist() == [60, 5]


def test_everything_is_packed_once(spark):
    texts = [None, "", "  ", "w " * 20_000, "é b"] + ["w " * (i % 700) for i in range(300)] + ["same text"] * 40
    df = spark.createDataFrame([(i if i != 4 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, bin_id int").repartition(3)
    got = P.pack(df).collect()
    words = defaultdict(int)
    bins = defaultdict(list)
    for r in got:
        words[r["doc_id"]] += r["length"]
        if r["length"]:
            bins[r["bin_id"]].append((r["offset"], r["length"], r["capacity"], r["bin_fill"]))
        else:
            assert r["bin_id"] is None and r["capacity"] is None
    assert words == {(i if i != 4 else None): len((t or "").split()) for i, t in enumerate(texts)}
    for parts in bins.values():
        at = 0
        for o, n, capacity, fill in sorted(parts):
            assert o == at
            at += n
        assert at == fill <= capacity and capacity == min(c for c in P.CAPACITIES if c >= fill)
    assert sorted(map(tuple, P.pack(df).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_texts_of_bins(spark):
    df = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(i * 7)), 0) for i in range(60)], "doc_id long, text string, capacity int").repartition(2)
    got = P.bin_texts(P.pack(df, (64, 128)), df).collect()
    assert all(len(r["text"].split()) <= r["capacity"] for r in got)
    assert sorted(w for r in got for w in r["text"].split()) == sorted(f"d{i}w{k}" for i in range(60) for k in range(i * 7))


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_of_any_size_beside_a_null(spark):
    ids = [None, (1 << 60) + 1, (1 << 60) + 2, -5, 0]
    df = spark.createDataFrame([(i, "a b " * (k + 1)) for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["length"] for r in P.pack(df).collect()} == {i: 2 * (k + 1) for k, i in enumerate(ids)}


def test_loose_bins_are_pooled(spark):
    """300 texts over 30 partitions: bins of their own would be mostly air."""
    df = spark.createDataFrame([(i, "w " * 300) for i in range(300)], "doc_id long, text string").repartition(30)
    bins = {(r["bin_id"], r["capacity"]) for r in P.pack(df).collect()}
    assert sum(c for _, c in bins) <= 1.15 * 300 * 300


def test_query(spark):
    got = P.op1_best_fit_packing(spark, SF).collect()
    words, bins = defaultdict(int), defaultdict(int)
    for r in got:
        words[r["doc_id"]] += r["length"]
        bins[r["bin_id"], r["capacity"], r["bin_fill"]] += r["length"]
    want = {r["doc_id"]: len(r["text"].split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert words == want
    assert all(n == fill <= capacity for (_, capacity, fill), n in bins.items() if capacity)
