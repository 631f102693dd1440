"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows source partition p sends to shard k is a multivariate hypergeometric draw,
so the shard sizes hold exactly (at most one row apart) and the joint law is that of a
uniform shuffle. Each partition permutes its rows and deals them out by its row of the
matrix; each shard permutes what it got. Both permutations are windows over bounded
groups: a source partition, or one of several random sub-blocks of a shard whose counts
give the offsets. The rows that move are (id, size, checksum) only.

Defined results: a null text has size 1 and checksum 0; rows with null or repeated ids,
and repeated rows, are rows of their own; extra columns are ignored; an empty table gives
an empty result. Equal texts aren't kept together: the law is `rows`.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allotau.llm import _base as B

SHARDS = 8
SEED = 20240501
#: Source partitions are told apart up to this number; more share a row of the matrix.
MAX_SOURCES = 1 << 16
#: Rows that a sub-block of a shard holds, about.
BLOCK_ROWS = 50_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` without replacement are good: the cumulated masses, from ratios about the mode, are inverted.

    Numbers have no upper limit; the masses left out, 12 standard deviations from the mode, are below 1e-30.
    """
    n = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    spread = math.sqrt(draws * (good / n) * (bad / n) * (n - draws) / max(1, n - 1))
    reach = int(12 * spread) + 40
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=float)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each source sends to each shard; columns sum to n / shards, at most one apart."""
    n = sum(sizes)
    left = [n // shards + (k < n % shards) for k in range(shards)]
    rng, out = random.Random(seed), []
    for size in sizes:
        row, need, pool = [], size, sum(left)
        for k in range(shards):
            got = hypergeometric(rng, left[k], pool - left[k], need)
            pool -= left[k]
            row.append(got)
            need -= got
        left = [x - y for x, y in zip(left, row, strict=True)]
        out.append(row)
    return out


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = B.written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.pmod(F.spark_partition_id(), F.lit(MAX_SOURCES)).alias("src"),
            F.monotonically_increasing_id().alias("pos"),
        ),
        "shards",
    )
    counts = {r["src"]: r["n"] for r in rows.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()}  # MAX_SOURCES rows at most
    sources = sorted(counts)
    matrix = communication_matrix([counts[s] for s in sources], shards, seed)
    # the matrix as running bounds: row number r of a source goes to the first shard whose bound exceeds r
    bounds = spark.createDataFrame([(s, [int(x) for x in np.cumsum(row)]) for s, row in zip(sources, matrix, strict=True)], "src int, bounds array<long>")
    blocks = max(32, math.ceil(sum(counts.values()) / shards / BLOCK_ROWS))

    def mixed(salt):
        return F.xxhash64(F.lit(seed + salt), "pos", "doc_id")

    first = F.row_number().over(Window.partitionBy("src").orderBy(mixed(1), "pos")) - 1
    sent = rows.withColumn("r", first).join(F.broadcast(bounds), "src")
    sent = sent.withColumn("shard", F.size(F.filter("bounds", lambda x: x <= F.col("r"))))
    sent = sent.select("doc_id", "size", "text_crc32", "pos", "shard", F.pmod(mixed(2), F.lit(blocks)).cast("int").alias("block"))
    sent = B.written(sent, "sent")
    per_block = sent.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))  # shards x blocks rows
    starts = per_block.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    second = F.row_number().over(Window.partitionBy("shard", "block").orderBy(mixed(3), "pos")) - 1
    return (
        sent.withColumn("within", second)
        .join(starts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"))
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    got = shuffle_shards(B.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
