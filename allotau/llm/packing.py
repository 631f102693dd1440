"""Best-fit packing into bins of several permitted lengths.

Documents are cut into pieces of at most the largest permitted length (no word is lost)
and packed by best-fit decreasing: a piece goes to the open bin that it leaves least room
in; if none has room, a bin is opened, of the permitted length of least cost for a word
among those that an opening rule allows. The permitted lengths are optimised jointly:
each rule (open nothing longer than length k, where the piece fits) packs the block, every
bin is then downsized to the shortest length that holds its contents, and the packing of
least total cost wins.

Packing runs where the rows are: each input partition packs its own documents, in blocks
of BLOCK pieces, so memory is bounded; of texts only the word counts reach Python. Bins
that stay less than FULL full, of which each block leaves a few, are undone, and their
pieces pooled: they alone are shuffled, into as few partitions as blocks hold them, and
packed again. Rows are sorted within a block, so a partition recomputed after a loss packs
the same way.

Defined results: a null text, or one without words, has one row with length 0, bin_id and
capacity null; rows with null or repeated ids, and repeated rows, are packed as rows of
their own; ids of any size come out as they are; equal pieces tie by (doc_id, piece); a
very long text becomes many pieces; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allotau.llm import _base as B

CAPACITIES = (512, 1024, 2048, 4096, 8192)
BLOCK = 100_000
#: Bins that are less full than this are packed again with those of other partitions.
FULL = 0.98
#: Bins of one partition have ids below this number apart; the second round's partitions are numbered from POOL.
BIN_IDS, POOL = 1 << 33, 1 << 24
SCHEMA = "doc_id long, no_id boolean, piece int, start long, length long, bin_id long, capacity int, bin_fill int, offset int"
COLUMNS = ["doc_id", "piece", "start", "length", "bin_id", "capacity", "bin_fill", "offset"]


def default_cost(capacity: int) -> float:
    """Of a bin: its slots and a fixed overhead of a row, so that short bins aren't free."""
    return capacity + 64.0


def best_fit(lengths: list[int], openings: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Lengths in falling order -> bin of each, offset of each, fill of each bin.

    openings[n]: the length of the bin that a piece of n words opens.
    rooms is a bit mask of the rooms that open bins have; the lowest set bit from n on is the best fit.
    """
    by_room: dict[int, list[int]] = {}
    rooms, fills, where, offsets = 0, [], [], []
    for n in lengths:
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            bins = by_room[room]
            b = bins.pop()
            if not bins:
                rooms &= ~(1 << room)
        else:
            room = openings[n]
            b = len(fills)
            fills.append(0)
        where.append(b)
        offsets.append(fills[b])
        fills[b] += n
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return where, offsets, fills


def opening_rule(capacities: tuple[int, ...], largest: int, cost: Callable[[int], float]) -> list[int]:
    """By length: the bin to open, of least cost for a word up to `largest`, or the shortest that holds the piece."""
    out = []
    for n in range(capacities[-1] + 1):
        fits = [c for c in capacities if c >= n]
        out.append(min([c for c in fits if c <= largest] or fits[:1], key=lambda c: (cost(c) / c, c)))
    return out


def pack_block(lengths: np.ndarray, capacities: tuple[int, ...], cost: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths in falling order -> bin, offset, capacity, fill of each piece, by the rule of least total cost."""
    best, caps = None, np.array(capacities)
    costs = np.array([cost(c) for c in capacities])
    items = lengths.tolist()
    for largest in capacities:
        where, offsets, fills = best_fit(items, opening_rule(capacities, largest, cost))
        size = np.searchsorted(caps, np.array(fills, dtype=np.int64))
        total = costs[size].sum()
        if best is None or total < best[0]:
            best = (total, where, offsets, caps[size], fills)
    _, where, offsets, size, fills = best
    where = np.array(where, dtype=np.int64)
    return where, np.array(offsets, dtype=np.int64), size[where], np.array(fills, dtype=np.int64)[where]


def cut(pdf: pd.DataFrame, longest: int) -> pd.DataFrame:
    """A row for each piece of at most `longest` words; one of length 0 for a document without words."""
    n = np.maximum(1, -(-pdf["length"].to_numpy() // longest))
    out = pdf.loc[pdf.index.repeat(n)].reset_index(drop=True)
    more = (np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)) * (np.repeat(n, n) > 1)
    out["piece"] += more
    out["start"] += more * longest
    out["length"] = np.minimum(out["length"] - more * longest, longest)
    return out


def packed_in_place(pieces: DataFrame, capacities: tuple[int, ...], cost: Callable[[int], float], block: int, first_part: int) -> DataFrame:
    """pieces (doc_id, no_id, piece, start, length) -> SCHEMA: each partition packed by itself."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            pieces = cut(pdf, capacities[-1])
            for i in range(0, len(pieces), block):
                held.append(pieces.iloc[i : i + block])
                n += len(held[-1])
                if n >= block:
                    yield pd.concat(held, ignore_index=True)
                    held, n = [], 0
        if n:
            yield pd.concat(held, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = 0
        for got in blocks(batches):
            got = got.sort_values(["length", "no_id", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
            full = int((got["length"] > 0).sum())
            where, offsets, size, fill = pack_block(got["length"].to_numpy()[:full], capacities, cost) if full else [np.zeros(0, np.int64)] * 4
            for name, x in (("bin_id", where + first + (got["part"].to_numpy()[:full] + first_part) * BIN_IDS), ("capacity", size), ("bin_fill", fill), ("offset", offsets)):
                got[name] = pd.Series(pd.array(x, dtype="Int64"), index=got.index[:full]).reindex(got.index)
            first += int(where.max()) + 1 if full else 0
            yield got[["doc_id", "no_id", "piece", "start", "length", "bin_id", "capacity", "bin_fill", "offset"]]

    return pieces.withColumn("part", F.spark_partition_id().cast("long")).mapInPandas(run, SCHEMA)


def pack_lengths(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = default_cost, block: int = BLOCK) -> DataFrame:
    """lengths (doc_id, length) -> doc_id, piece, start, length, bin_id, capacity, bin_fill, offset; all in words."""
    capacities = tuple(sorted(capacities))
    zero = F.lit(0).cast("long")
    # a null among longs would make floats of them in pandas, so a flag stands for it
    whole = lengths.select(F.coalesce(F.col("doc_id").cast("long"), zero).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.lit(0).alias("piece"), zero.alias("start"), F.col("length").cast("long"))
    packed = B.written(packed_in_place(whole, capacities, cost, block, 0), "packed")
    loose = F.coalesce(F.col("bin_fill") < FULL * F.col("capacity"), F.lit(False))
    pool = packed.where(loose)
    parts = math.ceil(max(1, pool.count()) / block)
    # by their places, which no two pieces share, as ids may be null or the same
    pool = pool.repartition(parts, "bin_id", "offset").select("doc_id", "no_id", "piece", "start", "length")
    again = packed_in_place(pool, capacities, cost, block, POOL)
    got = packed.where(~loose).unionByName(again)
    return got.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), *COLUMNS[1:])


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = default_cost) -> DataFrame:
    """docs (doc_id, text), measured in words."""
    return pack_lengths(docs.select("doc_id", B.words_of(F.col("text")).alias("length")), capacities, cost)


def bin_texts(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """The bins as texts: bin_id, capacity, text (pieces in order, words one space apart); ids must be unique. A bin holds `capacity` words at most."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut_out = packed.where("bin_id is not null").join(docs.select("doc_id", words.alias("words")), "doc_id")
    part = F.array_join(F.slice("words", (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " ")
    parts = F.sort_array(F.collect_list(F.struct("offset", part.alias("part"))))
    return cut_out.groupBy("bin_id", "capacity").agg(F.array_join(F.transform(parts, lambda x: x["part"]), " ").alias("text"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, bin_id, capacity, bin_fill, offset of every piece of every document."""
    return pack(B.table(spark, sf_dir, "documents"))
