import math

import duckdb
import numpy as np
import pytest

from allotau.llm import _vectors as V
from allotau.llm import ann_search as A
from allotau.llm import exact_topk as T

SCHEMA = "vec_id long, v array<double>, score string"


def brute(rows, asked, k):
    """rows: list of (vec_id, v); asked: the places of the queries -> by query, sorted: its (vec_id, score)."""
    wide = max((len(v) for _, v in rows), default=0)
    x = [np.pad(np.array(v, float), (0, wide - len(v))) for _, v in rows]
    out = []
    for q in asked:
        scores = sorted((-float(x[i] @ x[q]), rows[i][0]) for i in range(len(rows)) if i != q)
        out.append((rows[q][0], [(i, -s) for s, i in scores[:k]]))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], "clash") for i, v in rows], SCHEMA)


def found(df):
    out = {}
    for r in df.orderBy("query_row", "rank").collect():
        out.setdefault((r["query_row"], r["query_id"]), []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_row"], r["query_id"]])
    return sorted((q, got) for (_, q), got in out.items())


def by_id(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("shard_rows", [10_000, 150, 30])
def test_exact_top_k_with_ties_copies_and_odd_lengths(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-4, 5, 6)) for i in range(600)]
    rows += [(600 + i, [1, 2, 3, 0, 0, 1]) for i in range(250)]  # copies of a vector
    rows += [(40, rng.integers(-4, 5, 6)) for _ in range(100)]  # and of an id
    rows += [(900, [3]), (901, [1, 1, 1, 1, 1, 1, 50]), (902, [])]
    asked = [k for k, (i, _) in enumerate(rows) if i % 20 == 0 or i > 898]
    numbered = V.numbered(frame(spark, rows))
    got = found(T.exact_top_k(numbered, numbered.where("vec_id % 20 = 0 or vec_id > 898"), 20, shard_rows))
    assert got == [(q, [(i, int(s)) for i, s in w]) for q, w in brute(rows, asked, 20)]


def test_regions_are_searched_as_far_as_their_boxes_reach(spark):
    """Vectors in far clusters: many pairs of query and region are ruled out, and nothing is lost."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 8) + 100 * np.eye(8, dtype=int)[i % 8]) for i in range(1600)]
    numbered = V.numbered(frame(spark, rows))
    got = found(T.exact_top_k(numbered, numbered.where("vec_id % 20 = 0"), 20, 50))
    assert got == [(q, [(i, int(s)) for i, s in w]) for q, w in brute(rows, range(0, 1600, 20), 20)]
    splits = T.median_splits(np.array([v for _, v in rows], float), 5)
    stored = T.regions_of(numbered, splits, 8)
    boxes = T.boxes(stored, 8)
    assert len(boxes[0]) == 32 and max(r["count"] for r in stored.groupBy("region").count().collect()) <= 200
    kth = spark.createDataFrame([(q, float(w[-1][1])) for q, w in got], "vec_id long, kth double")
    pairs = T.asked_regions(numbered.join(kth, "vec_id"), boxes, 8, 0, None).count()
    assert len(got) <= pairs <= 0.6 * 32 * len(got)


def test_splits_keep_equal_values_together():
    x = np.array([[1.0]] * 50 + [[2.0]] * 3 + [[3.0]])
    regions = T.median_splits(x, 2).regions(x)
    assert len(set(regions[:50])) == 1 and regions[50] != regions[0]
    assert set(T.median_splits(np.zeros((9, 2)), 3).regions(np.zeros((9, 2)))) == {0}


def test_large_integers_are_exact(spark):
    rows = [(i, [2**30 + i, -(2**29), 3]) for i in range(50)]
    numbered = V.numbered(frame(spark, rows))
    got = by_id(T.exact_top_k(numbered, numbered.where("vec_id = 0"), 5))
    exact = sorted((-sum(int(a) * int(b) for a, b in zip(v, rows[0][1], strict=True)), i) for i, v in rows if i)
    assert [i for i, _ in got[0]] == [i for _, i in exact[:5]]


def test_a_task_that_holds_few_queries(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD", 5)
    monkeypatch.setattr(V, "QUERY_BATCH", 4)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-4, 5, 6)) for i in range(400)]
    numbered = V.numbered(frame(spark, rows))
    got = found(T.exact_top_k(numbered, numbered.where("vec_id % 20 = 0"), 20, 50))
    assert got == [(q, [(i, int(s)) for i, s in w]) for q, w in brute(rows, range(0, 400, 20), 20)]


def test_few_candidates_empty_and_repeats(spark):
    rows = [(1, [1.0]), (2, [2.0])]
    one, two = V.numbered(frame(spark, rows)), V.numbered(frame(spark, rows * 2))
    for search in (T.exact_top_k, A.nearest):
        assert found(search(one, one, 20)) == [(1, [(2, 2)]), (2, [(1, 2)])]
        assert found(search(two, two, 20)) == [(1, [(2, 2), (2, 2), (1, 1)])] * 2 + [(2, [(2, 4), (1, 2), (1, 2)])] * 2
        empty = V.numbered(spark.createDataFrame([], SCHEMA))
        assert search(empty, empty).count() == 0


def test_op3_equals_its_sql_with_repeated_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(i % 90, [float(x) for x in rng.normal(size=4)]) for i in range(200)] + [(20, [0.5, 0.5, 0.25, -1.0])] * 30 + [(40, None), (None, [1.0] * 4)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert sorted(map(tuple, T.op3_exact_topk(spark, str(tmp_path)).collect())) == sorted(con.sql(T.OP3_SQL).fetchall())


def test_unusable_vectors_take_no_part(spark, tmp_path):
    data = [(0, [1.0, 2.0], 1), (20, None, 1), (40, [1.0, None], 1), (60, [math.nan, 1.0], 1), (80, [math.inf, 1.0], 1), (100, [0.5, 0.5], 1), (120, [0.0, 0.0], 1), (None, [1.0, 1.0], 1)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert by_id(T.op3_exact_topk(spark, str(tmp_path))) == {0: [(100, 6144), (120, 0)], 100: [(0, 6144), (120, 0)], 120: [(0, 0), (100, 0)]}
    assert by_id(A.op7_ann_search(spark, str(tmp_path))) == {0: [(100, 1.5)], 100: [(0, 1.5)]}


def test_boxes_bound_their_points():
    rng = np.random.default_rng(0)
    x = rng.integers(-9, 9, (500, 4)).astype(float)
    t = T.KDTree(np.arange(500), np.arange(500), x, leaf=16)
    for (a, b), low, high in zip(t.span, t.low, t.high, strict=True):
        assert (t.points[a:b].min(axis=0) == low).all() and (t.points[a:b].max(axis=0) == high).all()


def test_partitions_are_balanced():
    x = np.random.default_rng(1).standard_normal((1000, 8))
    a, b = A.neighbour_graph(x, 10)
    n = np.bincount(A.partition(1000, a, b, 3))
    assert len(n) == 8 and n.max() - n.min() <= 3
    assert (A.partition(1000, a, b, 3)[a] == A.partition(1000, a, b, 3)[b]).mean() > 0.3


def test_recall_and_copies(spark):
    rng = np.random.default_rng(7)
    vectors = {i: v / np.linalg.norm(v) for i, v in enumerate(rng.standard_normal((3000, 16)))}
    vectors |= {3000 + i: vectors[5] for i in range(1500)}
    queries = {i: v for i, v in vectors.items() if i % 20 == 0}
    numbered = V.numbered(frame(spark, vectors.items()))
    got = by_id(A.nearest(numbered, numbered.where("vec_id % 20 = 0"), 20, fit_rows=2000, shard_rows=800))
    want = dict(brute(list(vectors.items()), list(queries), 20))
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert set(got) == set(want) and hit >= 0.9 * 20 * len(want)
    exact = np.array([vectors[i] for i in range(4500)])
    for q, rows in got.items():
        assert len(rows) == 20 and all(abs(s - float(exact[i] @ exact[q])) < 1e-12 for i, s in rows)
        assert [(-s, i) for i, s in rows] == sorted((-s, i) for i, s in rows)


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    got = by_id(A.op7_ann_search(spark, sf))
    want = brute(rows, [k for k, (i, _) in enumerate(rows) if i % 20 == 0], 20)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want)
    assert len(got) == len(want) and hit >= 0.9 * sum(len(w) for _, w in want)
