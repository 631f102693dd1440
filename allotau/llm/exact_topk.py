"""Exact top-k search by largest inner product, with a KD-tree in each shard.

Dealing: median splits of the widest dimension, found on a bounded sample, cut the space
into regions; each candidate goes to its region, whose tight bounding box is then taken
over all of its rows. A region of more than SHARD_ROWS rows is dealt over several shards by
a hash of the row, so tasks stay bounded whatever is repeated.

A task builds a KD-tree over its shard, by median splits of the widest dimension, with the
tight bounding box of each node. A batch of queries walks it best first: a node's bound is
the largest inner product that any point of its box could have with a query, the node with
the largest bound among the queries that still need it is opened next, and a query leaves a
node whose bound is below its kth score.

The kth score travels: a query first searches the region of largest bound, then the next
few, then the rest; it goes only to regions whose box may hold something that reaches the
kth score found so far. The boxes (REGIONS at most) are broadcast for that.

Components become floor(64 * x); scores are exact integers (in doubles while they fit into
53 bits, else in 64-bit integers).

Defined results: vectors that are null or hold a null or non-finite component take no
part, nor do rows without an id; every other row is a candidate, whatever ids or vectors it
shares, and a query leaves out its own row alone; vectors of unlike lengths are filled up
with zeros; ties go to the smaller vec_id; fewer than k candidates are all returned; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allotau.llm import _base as B
from allotau.llm import _vectors as V

K = 20
SHARD_ROWS = 8192
LEAF = 256
#: Vectors that the median splits are found on, at most, and regions, at most.
SAMPLE, REGIONS = 32_768, 8_192
#: A query's turns, by the rank of a region's bound: the first one, the next ones, the rest.
TURNS = ((0, 1), (1, 5), (5, None))
QUANTA = 64


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with any point of each box; where doubles don't hold it exactly, a little more."""
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    largest = np.abs(queries).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * max(1, queries.shape[1])
    return bounds if largest < 2.0**53 else bounds + largest * 1e-9 + 1


class KDTree:
    """Points in leaves; tight boxes of all nodes. Children of node i are left[i] and left[i] + 1; leaves have left -1."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> None:
        self.left, self.span, low, high = [-1], [(0, len(ids))], [], []
        order = np.arange(len(ids))
        i = 0
        while i < len(self.span):
            a, b = self.span[i]
            inside = points[order[a:b]]
            low.append(inside.min(axis=0))
            high.append(inside.max(axis=0))
            wide = int(np.argmax(high[-1] - low[-1]))
            if b - a > leaf and high[-1][wide] > low[-1][wide]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(inside[:, wide], middle)]
                self.left[i] = len(self.span)
                self.span += [(a, a + middle), (a + middle, b)]
                self.left += [-1, -1]
            i += 1
        self.low, self.high = np.array(low), np.array(high)
        self.rows, self.ids, self.points = rows[order], ids[order], points[order]

    def search(self, query_rows: np.ndarray, queries: np.ndarray, best: V.Best) -> None:
        exact = np.abs(queries).max(initial=0) * np.abs(self.points).max(initial=0) * max(1, queries.shape[1]) < 2.0**53
        bounds = box_bounds(queries, self.low, self.high)
        points = self.points if exact else self.points.astype(np.int64)
        asked = queries if exact else queries.astype(np.int64)
        heap = [(-bounds[:, 0].max(initial=-np.inf), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            need = np.nonzero(bounds[:, node] >= best.kth)[0]
            if not len(need):
                continue
            if self.left[node] >= 0:
                for child in (self.left[node], self.left[node] + 1):
                    heapq.heappush(heap, (-bounds[need, child].max(), child))
                continue
            a, b = self.span[node]
            scores = (asked[need] @ points[a:b].T).astype(float)
            scores[query_rows[need][:, None] == self.rows[a:b][None, :]] = -np.inf
            best.add(need, scores, self.ids[a:b])


def make_tree(rows: np.ndarray, ids: np.ndarray, points: np.ndarray):
    return KDTree(rows, ids, points).search


@dataclass
class Splits:
    """A complete tree of median splits: node i goes to 2 i + 1, or to 2 i + 2 beyond its cut. Regions are numbered from left to right."""

    levels: int
    dim: np.ndarray
    cut: np.ndarray

    def regions(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.levels):
            at = 2 * at + 1 + (x[rows, self.dim[at]] > self.cut[at])
        return at - (2**self.levels - 1)


def median_splits(sample: np.ndarray, levels: int) -> Splits:
    inner = 2**levels - 1
    dim, cut, inside = np.zeros(inner, np.int64), np.full(inner, np.inf), {0: np.arange(len(sample))}
    for i in range(inner):
        own = inside.pop(i, np.zeros(0, np.int64))
        x = sample[own]
        if len(own) > 1:
            wide = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            values = np.sort(x[:, wide])
            middle = values[(len(values) - 1) // 2]
            if middle == values[-1]:
                middle = values[max(0, np.searchsorted(values, middle) - 1)]  # the next smaller one, if there is any
            if middle < values[-1]:
                dim[i], cut[i] = wide, middle
        beyond = x[:, dim[i]] > cut[i] if len(own) else np.zeros(0, bool)
        inside[2 * i + 1], inside[2 * i + 2] = own[~beyond], own[beyond]
    return Splits(levels, dim, cut)


def regions_of(vectors: DataFrame, splits: Splits, dim: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(splits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(region=shared.value.regions(V.matrix(pdf["v"], dim)).astype(np.int32))

    return vectors.select("row", "vec_id", "v").mapInPandas(run, "row long, vec_id long, v array<double>, region int")


def boxes(stored: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regions that hold a row, and their tight boxes; each task sends one box a region."""

    def joined(low: dict[int, np.ndarray], high: dict[int, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"region": list(low), "low": [x.tolist() for x in low.values()], "high": [x.tolist() for x in high.values()]})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for pdf in batches:
            x = V.matrix(pdf["v"], dim)
            for r, at in pdf.groupby("region").indices.items():
                a, b = x[at].min(axis=0), x[at].max(axis=0)
                low[r], high[r] = np.minimum(low.get(r, a), a), np.maximum(high.get(r, b), b)
        if low:
            yield joined(low, high)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["region"].iloc[0])
        return joined({r: np.stack(pdf["low"].to_numpy()).min(axis=0)}, {r: np.stack(pdf["high"].to_numpy()).max(axis=0)})

    schema = "region int, low array<double>, high array<double>"
    got = stored.select("region", "v").mapInPandas(partial, schema).groupBy("region").applyInPandas(merged, schema).orderBy("region").toPandas()
    return got["region"].to_numpy(), V.matrix(got["low"], dim), V.matrix(got["high"], dim)


def asked_regions(queries: DataFrame, found: tuple[np.ndarray, np.ndarray, np.ndarray], dim: int, first: int, last: int | None) -> DataFrame:
    """queries (row, vec_id, v, kth) with the array `parts` of regions: those of the ranks first to last, by bound, whose bound reaches the kth score."""
    shared = queries.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, low, high = shared.value
        for pdf in batches:
            for a in range(0, len(pdf), V.QUERY_BATCH):
                part = pdf.iloc[a : a + V.QUERY_BATCH]
                bounds = box_bounds(V.matrix(part["v"], dim), low, high)
                order = np.argsort(-bounds, axis=1, kind="stable")[:, first:last]
                reach = np.take_along_axis(bounds, order, axis=1) >= part["kth"].fillna(-np.inf).to_numpy(dtype=float)[:, None]
                yield part.assign(parts=[names[o[r]].astype(np.int32) for o, r in zip(order, reach, strict=True)])

    return queries.select("row", "vec_id", "v", "kth").mapInPandas(run, "row long, vec_id long, v array<double>, kth double, parts array<int>")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors, queries (row, vec_id, v: integers held as doubles) -> query_row, query_id, rank, vec_id, score."""
    n = vectors.count()
    levels = min(int(math.log2(REGIONS)), max(0, math.ceil(math.log2(max(1, n / shard_rows)))))
    sample = B.sampled(vectors, F.col("row"), SAMPLE).orderBy("row").limit(SAMPLE).toPandas()["v"]
    dim = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    stored = B.written(regions_of(vectors, median_splits(V.matrix(sample, dim), levels), dim), "regions")
    found = boxes(stored, dim)
    spans, shards = V.layout(stored, "region", shard_rows)
    placed, best, asking = V.dealt(stored, "region", spans), None, queries.count()
    for first, last in TURNS:
        if best is not None and first >= len(found[0]):
            break
        if best is None:
            asked = queries.withColumn("kth", F.lit(None).cast("double"))
        else:
            kth = best.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("kth"))
            asked = queries.join(kth, "row", "left")
        got = V.search_shards(placed, asked_regions(asked, found, dim, first, last), spans, shards, asking, make_tree, "long", k)
        best = V.best_of(got if best is None else best.drop("rank").unionByName(got), k)
        best = B.written(best, "best")
    return best


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of every query whose vec_id is divisible by 20."""
    rows = B.table(spark, sf_dir, "embeddings").where(V.usable(F.col("embedding")))
    rows = V.numbered(rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * QUANTA).cast("double")).alias("v")))
    return exact_top_k(rows, rows.where("vec_id % 20 = 0")).drop("query_row")


OP3_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
