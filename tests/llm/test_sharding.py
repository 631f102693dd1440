import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from allotau.llm import sharding as H


def test_hypergeometric_has_its_law():
    rng, n = random.Random(1), 20_000
    got = Counter(H.hypergeometric(rng, 6, 9, 5) for _ in range(n))
    for k in range(6):
        p = math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
        assert abs(got[k] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-9
    big = [H.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(200)]
    assert abs(sum(big) / 200 - 300_000) < 5 * math.sqrt(1e6 * 0.3 * 0.7 / 200)


@pytest.mark.parametrize("sizes", [[0], [1], [5, 0, 17, 3], [100] * 40])
def test_matrix_sums(sizes):
    m = H.communication_matrix(sizes, 8, 3)
    assert [sum(r) for r in m] == sizes
    columns = [sum(c) for c in zip(*m, strict=True)]
    assert max(columns) - min(columns) <= 1 and sum(columns) == sum(sizes)


def shard(spark, data, parts=3, **kw):
    df = spark.createDataFrame(data, "doc_id long, text string, shard string")
    return H.shuffle_shards(df.repartition(parts), **kw).collect()


def test_exact_sizes_slots_and_checksums(spark):
    data = [(i, "é" * (i % 7) if i % 5 else None, "clash") for i in range(203)] + [(1, "same", "x")] * 60 + [(None, "", "x")]
    got = shard(spark, data)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in data)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_shuffle_is_uniform(spark):
    """First slots and shards over many seeds are spread evenly."""
    first, shards = Counter(), Counter()
    for seed in range(24):
        for r in shard(spark, [(i, "t", "") for i in range(8)], parts=2, shards=2, seed=seed):
            first[r["doc_id"]] += r["slot"] == 0
            shards[r["doc_id"]] += r["shard"]
    assert sum(first.values()) == 48 and max(first.values()) <= 15
    assert all(3 <= shards[i] <= 21 for i in range(8))


def test_empty(spark):
    assert shard(spark, []) == []


def test_query(spark):
    from conftest import SF

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = H.op4_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_very_long_texts(spark):
    data = [(i, "ä" * (2_000_000 if i == 3 else i), "x") for i in range(9)]
    got = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in shard(spark, data)}
    assert got == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in data}
