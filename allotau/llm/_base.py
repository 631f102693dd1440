"""Shared helpers of the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allotau.operators.matrix import free
from allotau.sources.tables import shared_dir, written

__all__ = ["free", "held_out", "in_batches", "sampled", "shared_dir", "table", "with_results", "words_of", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_results(df: DataFrame, text: str, results: str, make: Callable[[], Callable[[list[str | None]], dict[str, pa.Array]]], most: int) -> DataFrame:
    """df without its column `text`, and the columns `results` that a function of a list of texts gives.

    A column of df that has the name of a result gives way to it.
    make() gives the function, once a task; it gets texts of about `most` characters at once.
    The other columns stay in Arrow, so that a null among ids makes no floats of them.
    """
    new = T.DataType.fromDDL(results).fields
    others = [f for f in df.schema.fields if f.name != text and f.name.lower() not in {n.name.lower() for n in new}]
    ordered = df.select(F.col(f"`{text}`"), *[F.col(f"`{f.name}`") for f in others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in in_batches(texts, most):
                rest = [c.slice(a, b - a) for c in batch.columns[1:]]
                got = work(texts[a:b])
                yield pa.RecordBatch.from_arrays([*rest, *got.values()], names=[*batch.schema.names[1:], *got])

    return ordered.mapInArrow(run, T.StructType([*others, *new]))


def in_batches(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of texts of about `most` characters at the most, or of one longer text."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if size and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def words_of(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` runs; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sampled(df: DataFrame, key: Column, most: int, seed: int = 7) -> DataFrame:
    """About `most` rows of df at the most (all, if it has no more), chosen by a hash of `key`."""
    n = df.count()
    if n <= most:
        return df
    share = math.floor(0.97 * most / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < share)


def held_out(doc_id: Column, mod: int, equal: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == equal, F.lit(False))
