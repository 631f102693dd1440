"""Search of query vectors in bounded shards of candidate vectors, for the two nearest-vector operators.

Shards are dealt over tasks. A query goes once to each task that has shards it asks for,
with their list, however many they are. Queries come in blocks of HELD at the most, each
with tasks of its own: a task holds its block and the best so far of its queries, while its
shards go by one after the other, of which it holds one (its size is bounded by the
caller). So a query is copied once a task, a candidate once a block, and a task sends a
query's best once.

Every row has a number (`row`), by which a query leaves out itself alone: other rows of its
vec_id, or of its vector, are candidates as any.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allotau.llm import _base as B

#: Queries answered at once.
QUERY_BATCH = 512
#: Queries of a block.
HELD = 100_000
NONE = np.iinfo(np.int64).max


def usable(v: Column) -> Column:
    """Neither null nor with a null, infinite or NaN component."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (vec_id, v) as a table with row numbers; rows without an id or a usable vector take no part."""
    kept = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    return B.written(kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "v"), "vectors")


def matrix(vectors: pd.Series | np.ndarray, dim: int) -> np.ndarray:
    """Rows of doubles, short vectors filled up with zeros, components beyond dim left out."""
    try:
        out = np.stack(np.asarray(vectors)).astype(float)
        if out.shape[1] == dim:
            return out
    except ValueError:
        pass
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors, strict=True):
        row[: min(dim, len(v))] = v[:dim]
    return out


class Best:
    """The k best of each query so far: larger scores first, then smaller ids."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), NONE)

    @property
    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each of the queries `which`, a column for each of `ids`; -inf: not a candidate."""
        for q, row in zip(which, scores, strict=True):
            hit = np.nonzero(row >= self.scores[q, -1])[0]
            if not len(hit):
                continue
            if len(hit) > 4 * self.k:
                least = np.partition(row[hit], len(hit) - self.k)[len(hit) - self.k]
                hit = hit[row[hit] >= least]
            s, i = np.concatenate([self.scores[q], row[hit]]), np.concatenate([self.ids[q], ids[hit]])
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], i[order]


#: (numbers of the queries' rows, their vectors, best)
Search = Callable[[np.ndarray, np.ndarray, Best], None]


Spans = dict[int, tuple[int, int]]


def layout(stored: DataFrame, part: str, shard_rows: int) -> tuple[Spans, int]:
    """stored has `part`, of few values -> (first shard, number of shards) of each, number of all shards: each part is dealt over so many shards that none holds much more than shard_rows."""
    counts = {r[part]: r["n"] for r in stored.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a part
    spans, shards = {}, 0
    for p in sorted(counts):
        spans[p] = (shards, math.ceil(counts[p] / shard_rows))
        shards += spans[p][1]
    return spans, shards


def dealt(stored: DataFrame, part: str, spans: Spans) -> DataFrame:
    """row, vec_id, v, shard of the candidates; the rows of a part go to its shards by a hash."""
    places = stored.sparkSession.createDataFrame([(p, *x) for p, x in spans.items()], f"{part} int, first int, salts int")
    return stored.join(F.broadcast(places), part).select("row", "vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("salts"))).cast("int").alias("shard"))


def by_tasks(asked: DataFrame, spans: Spans, tasks: int) -> DataFrame:
    """asked (row, vec_id, v, kth, parts) -> row, vec_id, v, kth, task, shards: a row for each task that has shards of the parts asked for."""
    shared = asked.sparkSession.sparkContext.broadcast(spans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            which, task, shards = [], [], []
            for i, parts in enumerate(pdf["parts"]):
                every = [np.arange(f, f + n) for f, n in (shared.value[p] for p in parts if p in shared.value)]
                ids = np.concatenate(every) if every else np.zeros(0, np.int64)
                ids = ids[np.argsort(ids % tasks, kind="stable")]
                for some in np.split(ids, np.flatnonzero(np.diff(ids % tasks)) + 1) if len(ids) else ():
                    which.append(i)
                    task.append(int(some[0] % tasks))
                    shards.append(some.astype(np.int32))
            if which:
                yield pdf[["row", "vec_id", "v", "kth"]].iloc[which].assign(task=task, shards=shards)

    return asked.select("row", "vec_id", "v", F.col("kth").cast("double").alias("kth"), "parts").mapInPandas(run, "row long, vec_id long, v array<double>, kth double, task int, shards array<int>")


def search_shards(candidates: DataFrame, asked: DataFrame, spans: Spans, shards: int, queries: int, make: Callable[[np.ndarray, np.ndarray, np.ndarray], Search], score: str, k: int) -> DataFrame:
    """candidates (shard, row, vec_id, v), asked (row, vec_id, v, kth, parts), of so many queries -> query_row, query_id, vec_id, score.

    make(rows, ids, vectors) gives the search of a shard. A task returns at most k rows a
    query, none that scores below its kth.
    """
    tasks = max(1, min(shards, int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    blocks = max(1, math.ceil(queries / HELD))
    none = F.lit(None)
    own = by_tasks(asked, spans, tasks).select((F.pmod(F.xxhash64("row"), F.lit(blocks)) * tasks + F.col("task")).alias("place"), F.lit(-1).alias("shard"), "row", "vec_id", "v", "kth", "shards")
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    rows = candidates.select("shard", "row", "vec_id", "v", block).select((F.col("block") * tasks + F.pmod("shard", F.lit(tasks))).cast("long").alias("place"), "shard", "row", "vec_id", "v", none.cast("double").alias("kth"), none.cast("array<int>").alias("shards"))
    both = own.unionByName(rows).repartitionById(tasks * blocks, F.col("place").cast("int")).sortWithinPartitions("shard", "row")
    score_type = np.int64 if score == "long" else float

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, block = None, [], []
        rows = ids = vectors = best = None
        askers: dict[int, list[int]] = {}

        def begin() -> None:
            """Queries come before all shards."""
            nonlocal rows, ids, vectors, best
            pdf = pd.concat(block, ignore_index=True) if block else pd.DataFrame({c: [] for c in ("row", "vec_id", "v", "kth", "shards")})
            block.clear()
            rows, ids, best = pdf["row"].to_numpy(np.int64), pdf["vec_id"].to_numpy(np.int64), Best(len(pdf), k)
            kth = pdf["kth"].to_numpy(dtype=float)
            best.scores[:] = np.nextafter(np.where(np.isnan(kth), -np.inf, kth), -np.inf)[:, None]  # what ties with the kth may still take its place
            vectors = matrix(pdf["v"], max(map(len, pdf["v"]), default=1))
            for i, some in enumerate(pdf["shards"]):
                for s in some:
                    askers.setdefault(int(s), []).append(i)

        def answer() -> None:
            if not held or shard not in askers:
                held.clear()
                return
            some = pd.concat(held, ignore_index=True)
            held.clear()
            dim = max(map(len, some["v"]))
            search = make(some["row"].to_numpy(), some["vec_id"].to_numpy(), matrix(some["v"], dim))
            which = np.array(askers[shard])
            for i in range(0, len(which), QUERY_BATCH):
                at = which[i : i + QUERY_BATCH]
                now = Best(len(at), k)
                now.scores, now.ids = best.scores[at], best.ids[at]
                search(rows[at], matrix(vectors[at], dim), now)  # components beyond dim meet zeros
                best.scores[at], best.ids[at] = now.scores, now.ids

        for batch in batches:
            for s, of_shard in batch.groupby("shard", sort=False):
                if s < 0:
                    block.append(of_shard)
                    continue
                if best is None:
                    begin()
                if s != shard:
                    answer()
                    shard = s
                held.append(of_shard[["row", "vec_id", "v"]])
        if best is None:
            return
        answer()
        for i in range(0, len(rows), 10_000):
            scores, found = best.scores[i : i + 10_000], best.ids[i : i + 10_000]
            q, r = np.nonzero((found != NONE) & (scores > -np.inf))
            yield pd.DataFrame({"query_row": rows[i + q], "query_id": ids[i + q], "vec_id": found[q, r], "score": scores[q, r].astype(score_type)})

    return both.mapInPandas(run, f"query_row long, query_id long, vec_id long, score {score}")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query_row, query_id, rank, vec_id, score: the k best of each query."""
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")
