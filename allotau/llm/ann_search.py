"""Approximate nearest neighbours (largest inner product) by learned partitions.

Fit, on a bounded sample of vectors: their neighbour graph is cut into balanced parts by
recursive spectral bisection at the median, then a small classifier (softmax regression)
learns a vector's part. Every row is indexed under its most probable part. A query goes to
its several most probable parts, whose rows are ranked by the exact inner product. How
many parts a query visits is set on the sample: the fewest that find RECALL of the true
neighbours of sample queries. Parts grow in number with the table, as far as the sample
has PART_SAMPLE vectors for each.

Parts of more than SHARD_ROWS rows, such as one that holds many copies of one vector, are
dealt over several shards by a hash of the row, so tasks stay bounded. The sample, the
classifier and the counts of the parts are all that the driver holds.

Defined results: vectors that are null, zero or hold a null or non-finite component take
no part, nor do rows without an id; every other row is a candidate, whatever ids or vectors
it shares, and a query leaves out its own row alone; vectors of unlike lengths are filled
up with zeros; ties go to the smaller vec_id; extra columns are ignored; an empty table
gives an empty result. Equal vectors score alike to the last bit: what a matrix product
selects is scored again row by row.
"""

from __future__ import annotations

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
#: Vectors that partitions and classifier are fitted on: at most, at least (if there are so many), and for each part.
FIT_ROWS, LEAST_FIT_ROWS, PART_SAMPLE = 24_576, 6144, 24
GRAPH_NEIGHBOURS = 20
#: Share of true neighbours that the sample's queries must find; the contract asks for 0.9 of all rows.
RECALL = 0.93
SHARD_ROWS = 8192
PART_ROWS, MIN_PARTS = 1600, 8


@dataclass
class Router:
    weights: np.ndarray  # (dim + 1) x parts
    probes: int

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.weights[:-1] + self.weights[-1]


def neighbour_graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) to the k nearest by inner product."""
    out = []
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out.append(np.argpartition(-s, k, axis=1)[:, :k])
    to = np.concatenate(out)
    return np.repeat(np.arange(len(x)), k), to.ravel()


def bisect(n: int, a: np.ndarray, b: np.ndarray, rng: np.random.Generator, steps: int = 60) -> np.ndarray:
    """Balanced halves (bool) of a graph of n nodes: the second eigenvector of its random walk, by power iteration, split at the median."""
    degree = np.maximum(1, np.bincount(a, minlength=n) + np.bincount(b, minlength=n)).astype(float)
    v = rng.standard_normal(n)
    for _ in range(steps):
        v -= (v @ degree) / degree.sum()
        v = 0.5 * v + 0.5 * (np.bincount(a, v[b], n) + np.bincount(b, v[a], n)) / degree
        v /= np.abs(v).max() or 1.0
    half = np.zeros(n, bool)
    half[np.argsort(v, kind="stable")[n // 2 :]] = True
    return half


def partition(n: int, a: np.ndarray, b: np.ndarray, levels: int, seed: int = 3) -> np.ndarray:
    """Part (0 to 2 ** levels - 1) of each node; parts differ by at most one node for each level."""
    rng, part = np.random.default_rng(seed), np.zeros(n, dtype=np.int64)
    for _ in range(levels):
        new = part * 2
        for p in np.unique(part):
            own = np.nonzero(part == p)[0]
            at = np.full(n, -1)
            at[own] = np.arange(len(own))
            inside = (at[a] >= 0) & (at[b] >= 0)
            new[own] += bisect(len(own), at[a[inside]], at[b[inside]], rng)
        part = new
    return part


def softmax_regression(x: np.ndarray, y: np.ndarray, parts: int, steps: int = 300, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    w = np.zeros((x.shape[1] + 1, parts))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    aim = np.eye(parts)[y]
    speed = np.zeros_like(w)
    for _ in range(steps):
        z = x1 @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - rate * 0.1 * (x1.T @ (p - aim) / len(x) + decay * w)
        w += speed
    return w


def fit(sample: np.ndarray, parts: int, k: int = K, recall: float = RECALL) -> Router:
    """A router for vectors like those of the sample."""
    n = len(sample)
    if n <= max(parts * 2, k + 1, GRAPH_NEIGHBOURS + 1):
        return Router(np.zeros((sample.shape[1] + 1, 1)), 1)
    scale = np.sqrt((sample**2).sum(axis=1).mean()) or 1.0
    x = sample / scale
    a, b = neighbour_graph(x, GRAPH_NEIGHBOURS)
    w = softmax_regression(x, partition(n, a, b, int(math.log2(parts))), parts)
    w[:-1] /= scale
    router = Router(w, parts)
    own = router.logits(sample).argmax(axis=1)
    asked = np.arange(0, n, max(1, n // 512))
    s = sample[asked] @ sample.T
    s[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-s, k, axis=1)[:, :k]
    turn = np.argsort(np.argsort(-router.logits(sample[asked]), axis=1), axis=1)  # when a query comes to each part
    seen_at = np.take_along_axis(turn, own[near], axis=1)
    found = np.array([(seen_at < p).mean() for p in range(1, parts + 1)])
    return Router(w, int(np.argmax(found >= recall)) + 1)


def make_flat(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
    """Search of a shard: distinct vectors are ranked by a matrix product, what may be among the best is scored again exactly."""
    order = np.argsort(ids, kind="stable")
    rows, ids, vectors = rows[order], ids[order], vectors[order]
    distinct, of = np.unique(vectors, axis=0, return_inverse=True)
    grouped = np.argsort(of, kind="stable")
    starts = np.searchsorted(of.ravel()[grouped], np.arange(len(distinct) + 1))

    def search(query_rows: np.ndarray, queries: np.ndarray, best: V.Best) -> None:
        k = best.k
        product = queries @ distinct.T
        slack = 1e-12 * (1 + np.abs(product).max(initial=0))
        take = min(k + 1, len(distinct))
        least = -np.partition(-product, take - 1, axis=1)[:, take - 1] - slack
        for q, products in enumerate(product):
            hit = np.nonzero(products >= least[q])[0]
            exact = (distinct[hit] * queries[q]).sum(axis=1)
            some = [grouped[starts[u] : min(starts[u + 1], starts[u] + k + 1)] for u in hit]  # of copies, those with the smallest ids
            some = np.concatenate(some) if (sizes := [len(x) for x in some]) else np.zeros(0, np.int64)
            scores = np.repeat(exact, sizes)
            scores[rows[some] == query_rows[q]] = -np.inf
            best.add(np.array([q]), scores[None, :], ids[some])

    return search


def parts_of(vectors: DataFrame, router: Router, most: int, out: str) -> DataFrame:
    """vectors (row, vec_id, v) with the array `out` of their `most` most probable parts."""
    shared = vectors.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                logits = shared.value.logits(V.matrix(pdf["v"], len(shared.value.weights) - 1))
                yield pdf.assign(**{out: list(np.argsort(-logits, axis=1, kind="stable")[:, :most].astype(np.int32))})

    return vectors.select("row", "vec_id", "v").mapInPandas(run, f"row long, vec_id long, v array<double>, {out} array<int>")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, fit_rows: int = FIT_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors, queries (row, vec_id, v) -> query_row, query_id, rank, vec_id, score."""
    parts = max(MIN_PARTS, 1 << max(0, int(math.log2(max(1, min(vectors.count() / PART_ROWS, fit_rows / PART_SAMPLE))))))
    fit_rows = min(fit_rows, max(LEAST_FIT_ROWS, PART_SAMPLE * parts))
    sample = B.sampled(vectors, F.col("row"), fit_rows).orderBy("row").limit(fit_rows).toPandas()["v"]
    dim = max(map(len, sample), default=1) or 1
    router = fit(V.matrix(sample, dim), parts, k)
    stored = B.written(parts_of(vectors, router, 1, "parts").select("row", "vec_id", "v", F.col("parts")[0].alias("part")), "ann")
    spans, shards = V.layout(stored, "part", shard_rows)
    asked = parts_of(queries, router, router.probes, "parts").withColumn("kth", F.lit(None).cast("double"))
    return V.best_of(V.search_shards(V.dealt(stored, "part", spans), asked, spans, shards, queries.count(), make_flat, "double", k), k)


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest found of every query whose vec_id is divisible by 20."""
    rows = B.table(spark, sf_dir, "embeddings").where(V.usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = V.numbered(rows)
    return nearest(rows, rows.where("vec_id % 20 = 0")).drop("query_row")
