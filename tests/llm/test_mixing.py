import math
from collections import defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from allotau.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, taken long"
BLOCK = 8


def data():
    rows = [(i, "w " * (i % 37), f"s{i % 5}", 0) for i in range(400)]
    rows += [(1000 + i, "x\ty  z", None, 0) for i in range(30)] + [(7, None, "s1", 0), (8, "", "s2", 0), (None, "a b", "s0", 0), (9, "   ", "only blanks", 0)]
    return rows + [(5000, "one two three", "s3", 0)] * 50


def size_of(text):
    return len((text or "").split())


def golden(i):
    return (i + 1) * M.STEP % 1.0


def brute_force(sizes, block, point=golden):
    """By source (sorted, null last): slots it gets from the points, and so the words of its blocks."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    aims = [round(t) for t in M.targets([sizes[n] for n in names])]
    total, got = sum(aims), defaultdict(int)
    for i in range(math.ceil(total / block)):
        at, k = math.floor(point(i) * total), 0
        while at >= aims[k]:
            at -= aims[k]
            k += 1
        got[names[k]] += 1
    return {n: min(2 * sizes[n], got[n] * block) for n in names}


def by_source(rows):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    return sizes, taken, target


def test_targets_of_the_frame_equal_the_loop(spark):
    for sizes in ([5, 5, 5], [100, 1, 1, 1, 50], [0, 3], [7], [1, 1000, 1, 1], [0, 0], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]):
        names = [f"s{i:02}" for i in range(len(sizes))]
        frame = spark.createDataFrame(list(zip(names, sizes, strict=True)), "skey string, source_size long")
        got = {r["skey"]: r for r in M.source_targets(frame).collect()}
        assert [got[n]["target"] for n in names] == pytest.approx(M.targets(sizes))
        edges = [0] + [got[n]["high"] for n in names]
        assert [got[n]["low"] for n in names] == edges[:-1]


def test_mix_takes_the_blocks_of_its_slots(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.mix(df, BLOCK).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((d or -1, size_of(t)) for d, t, *_ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] and (r["taken"] > 0) == (r["n_pieces"] > 0) == (r["first_slot"] is not None) for r in got)
    sizes, taken, target = by_source(got)
    assert dict(taken) == brute_force(sizes, BLOCK)
    names = sorted(s for s in sizes if s is not None) + [None]
    assert [target[n] for n in names] == pytest.approx(M.targets([sizes[n] for n in names]))
    assert all(abs(taken[n] - target[n]) <= 4 * BLOCK for n in names)
    again = M.mix(df.repartition(7), BLOCK).collect()
    key = lambda r: tuple(-1 if v is None else v for v in (r["doc_id"], r["size"], r["taken"], r["first_slot"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_the_schedule_decides(spark):
    """Another sequence of points takes other words; one that visits a few points only is far from the targets."""
    df = spark.createDataFrame(data(), SCHEMA)
    good = by_source(M.mix(df, BLOCK).collect())
    bad = by_source(M.mix(df, BLOCK, point=lambda slot: F.pmod(slot, F.lit(4)) / 4).collect())
    assert dict(bad[1]) == brute_force(bad[0], BLOCK, lambda i: i % 4 / 4)
    assert dict(good[1]) != dict(bad[1])
    assert max(abs(bad[1][n] - bad[2][n]) for n in bad[2]) > 20 * BLOCK
    assert sum(r["taken"] for r in M.mix(df, BLOCK, point=lambda slot: slot * 0.0 + 2.0).collect()) == 0  # points outside: no slot, no words


def test_pieces_are_whole_and_follow_the_schedule(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    pieces = M.mixture(df, BLOCK).collect()
    words = sum(size_of(t) for _, t, *_ in data())
    slots = math.ceil(words * 1.5 / BLOCK)
    by, in_slot = defaultdict(list), defaultdict(int)
    for p in pieces:
        by[p["doc_id"], p["text_hash"], p["skey"], p["copy"], p["time"]].append((p["from_word"], p["n_words"], p["size"]))
        in_slot[p["slot"]] += p["n_words"]
    for parts in by.values():  # no word comes twice in one reading
        at = 0
        for start, n, size in sorted(parts):
            assert at <= start and n > 0 and start + n <= size
            at = start + n
    assert max(in_slot.values()) <= BLOCK
    # at every prefix of the schedule each source has had about its share
    target = {r["skey"]: r["target"] for r in M.streams(df)[1].collect()}
    for upto in range(1, slots, 7):
        had = defaultdict(int)
        for p in pieces:
            if p["slot"] < upto:
                had[p["skey"]] += p["n_words"]
        for s, t in target.items():
            assert abs(had[s] - t * upto / slots) <= 4 * BLOCK


def test_many_equal_rows_are_numbered_in_steps(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 16)
    df = spark.createDataFrame([(1, "a b", "s", 0)] * 100 + [(None, None, None, 0)] * 33, SCHEMA)
    got = M.numbered(df).collect()
    assert sorted((r["doc_id"] or 0, r["copy"]) for r in got) == [(0, k) for k in range(33)] + [(1, k) for k in range(100)]


def test_empty_and_clashing_columns(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r["taken"] for r in M.mix(spark.createDataFrame([(1, None, None, 0)], SCHEMA)).collect()] == [0]
    df = spark.createDataFrame([(1, "a b c " * 99, "s", 5, 6, 7, 8)], "doc_id long, text string, source string, size int, slot int, skey int, target int")
    assert [r["size"] for r in M.mix(df).collect()] == [297]


def test_query(spark):
    got = M.op10_mixing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((d["doc_id"], size_of(d["text"])) for d in docs)
    source = {d["doc_id"]: d["source"] for d in docs}
    taken = defaultdict(int)
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
    sizes = {source[r["doc_id"]]: r["source_size"] for r in got}
    assert dict(taken) == brute_force(sizes, M.BLOCK)
