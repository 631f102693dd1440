"""Chebyshev grids and curves sampled on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allotau.functions import scalar as S

#: Nodes that one row is spread to at once; a grid is spread in two steps, with a shuffle of the chunks between.
CHUNK = 65_536


def bounds(samples: DataFrame, positive_only: bool = True) -> DataFrame:
    """samples (dataset, tau; one row a sample) -> dataset, n, low, high. n counts all samples; the filtered grid spans the positive tau."""
    tau = F.when(S.positive(F.col("tau")), F.col("tau")) if positive_only else F.nanvl("tau", F.lit(None).cast("double"))
    return samples.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.min(tau).alias("low"), F.max(tau).alias("high"))


def chunks(grids: DataFrame) -> DataFrame:
    """grids (dataset, n, low, high) -> a row for every CHUNK nodes."""
    return grids.where("n > 0 and low is not null").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))


def spread(rows: DataFrame) -> DataFrame:
    """Rows of chunks -> a row a node (node_pos, tau).

    Chunks are a few bytes each, so they are dealt out by number: partitions that Spark
    may coalesce by their bytes would all go to one task.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    at = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1)
    placed = rows.repartition(tasks).withColumn("node_pos", F.explode(at))
    return placed.withColumn("tau", S.chebyshev(F.col("node_pos"), F.col("n"), F.col("low"), F.col("high")))


def nodes(grids: DataFrame) -> DataFrame:
    """grids (dataset, n, low, high) -> dataset, node_pos, tau, ascending."""
    return spread(chunks(grids)).select("dataset", "node_pos", "tau")


def curves(grids: DataFrame, fitted: DataFrame) -> DataFrame:
    """dataset, node_pos, tau, series_pos, series, y: every fitted curve on its dataset's grid.

    Curves meet chunks, not nodes: Spark sizes a grid by the table it is spread from, and
    would send all its nodes to every executor.
    """
    return drawn(spread(chunks(grids).join(fitted, "dataset")))


def sample(grid: DataFrame, fitted: DataFrame) -> DataFrame:
    """The same for nodes at hand; neither side is held in memory."""
    return drawn(grid.join(fitted.hint("merge"), "dataset"))


def drawn(rows: DataFrame) -> DataFrame:
    return rows.select("dataset", "node_pos", "tau", "series_pos", "series", S.power(F.col("tau"), F.col("a"), F.col("b")).alias("y"))
