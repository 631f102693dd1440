"""Mixing of sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: the sources, in code point order with null last, get shares of 150 % of all
words in proportion to their weights; no target exceeds twice its source, and what is
over goes to the others by weight until none is over.

Schedule: slot i stands at the golden-ratio point frac((i + 1) * 0.618...), which the
cumulated targets map to a source; slots are ranked within their source. A source's stream
is its documents in shuffled order, read round twice and cut into blocks of BLOCK words.
The j-th slot of a source takes the j-th block of its stream: the slots alone decide what
is taken. So the mix, and any beginning of it, holds each source's share to within a few
blocks, which is what the sequence's discrepancy allows (it grows with the logarithm of
the number of slots). Blocks that no slot came to aren't taken, and slots beyond the
second reading's end find no block.

Nothing is ranked in one task: sources are dealt by ranges of their names, slots by
chunks, documents by runs, and the sums of each range, chunk or run start the next.

Defined results: a null text has size 0 and takes 0; a source without words has target 0;
rows with null or repeated ids, and repeated rows, each stand for themselves; extra
columns are ignored; an empty table gives an empty result. The order is one of hashes of
id, source, text and the number among equal rows, so that reruns agree whatever the
layout of the files is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allotau.llm import _base as B

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 20240601
#: 1 / golden ratio.
STEP = 0.6180339887498949
#: Words of a block, whatever the size of the corpus.
BLOCK = 64
#: Documents of one run of a source's stream, about; runs of a source, at least.
RUN_ROWS, MIN_RUNS = 20_000, 256
#: Slots ranked in one window; equal rows numbered by one task.
CHUNK = 1 << 16
ROW = ["doc_id", "source", "skey", "text_hash", "size", "copy"]


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> list[float]:
    """Targets of sources of these sizes, in order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    caps, out, open_ = [most * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        unit = left / sum(w[i] for i in open_)
        over = {i for i in open_ if w[i] * unit > caps[i]}
        if not over:
            for i in open_:
                out[i] = w[i] * unit
            break
        for i in over:
            out[i] = float(caps[i])
            left -= caps[i]
        open_ -= over
    return out


def source_key(source: Column) -> Column:
    """Never null; in byte order, which is code point order, a null source comes last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def running(df: DataFrame, keys: list[str], chunk: str, value: Column, order: list, name: str) -> DataFrame:
    """df with the sum of `value` over all rows of its keys that come earlier, by chunk and then by order, in two bounded steps."""
    starts = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*keys, chunk, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    laid = df.withColumn("_before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return laid.join(starts, [*keys, chunk]).withColumn(name, (F.col("_start") + F.col("_before")).cast("long")).drop("_start", "_before")


def in_ranges(df: DataFrame, key: str, what: str) -> DataFrame:
    """df as a table with the column `range`, which rises with the key."""
    return B.written(df.repartitionByRange(key).withColumn("range", F.spark_partition_id()), what)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (skey, source_size) -> skey, source_size, target, low, high: one row a source.

    low and high bound the source's words among all targets, rounded, one behind the other.
    The level (target for a unit of weight) rises until no more sources are above their cap.
    """
    ranked = running(in_ranges(sizes, "skey", "sources"), [], "range", F.lit(1), ["skey"], "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    ranked = B.written(ranked.withColumn("w", w).withColumn("cap", (most * F.col("source_size")).cast("double")), "ranked")
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("w") * level
        got = ranked.agg(F.sum("source_size").alias("all"), F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("gone"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        if got["n"] == capped or not got["w"]:
            break
        capped, level = got["n"], (share * got["all"] - (got["gone"] or 0.0)) / got["w"]
    aims = ranked.select("skey", "source_size", "range", F.least("cap", F.col("w") * F.lit(level)).alias("target"))
    aims = running(aims.withColumn("words", F.round("target").cast("long")), [], "range", F.col("words"), ["skey"], "low")
    return aims.select("skey", "source_size", "target", "low", (F.col("low") + F.col("words")).alias("high"))


def golden(slot: Column) -> Column:
    """frac((slot + 1) * STEP), with the product split so that large slots lose no digits."""
    far, near = F.floor((slot + 1) / CHUNK), F.pmod(slot + 1, F.lit(CHUNK))
    at = far * (CHUNK * STEP % 1.0) + near * STEP
    return at - F.floor(at)


def schedule(aims: DataFrame, block: int = BLOCK, point=golden) -> DataFrame:
    """aims (skey, low, high) -> slot, skey, rank (from 0 within the source)."""
    facts = aims.agg(F.max("high").alias("words"), F.count(F.lit(1)).alias("sources")).first()
    words = facts["words"] or 0
    # an equal join on cells of the unit interval, then the bounds: a source meets only the cells it reaches
    cells = max(1024, 4 * facts["sources"])

    def cell(word: Column) -> Column:
        return F.floor(word / max(1, words) * cells).cast("int")

    points = aims.sparkSession.range(math.ceil(words / block)).select(F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk"), F.floor(point(F.col("id")) * words).alias("at"))
    spans = aims.where("high > low").select("skey", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    slots = points.withColumn("cell", cell(F.col("at"))).join(spans, "cell").where("at >= low and at < high").select("slot", "chunk", "skey")
    return running(slots, ["skey"], "chunk", F.lit(1), ["slot"], "rank").select("slot", "skey", "rank")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, source, skey, text_hash, size, copy: equal rows are told apart by a number, without a window over them."""
    rows = docs.select("doc_id", "source", source_key(F.col("source")).alias("skey"), F.xxhash64("text", F.lit(SEED)).alias("text_hash"), B.words_of(F.col("text")).alias("size"))
    same = B.written(rows.groupBy(*ROW[:-1]).agg(F.count(F.lit(1)).alias("n")), "same")
    few = same.where(F.col("n") <= CHUNK).withColumn("first", F.lit(0).cast("long"))
    many = same.where(F.col("n") > CHUNK).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    every = few.unionByName(many.repartition("doc_id", "text_hash", "first"))
    return every.select(*ROW[:-1], F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + CHUNK) - 1)).alias("copy"))


def streams(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their places (offset) in their sources' streams; sources with targets."""
    order = F.xxhash64("doc_id", "skey", "text_hash", "copy", F.lit(SEED))
    runs = max(MIN_RUNS, math.ceil(docs.count() / RUN_ROWS))
    rows = B.written(numbered(docs).withColumn("order", order).withColumn("run", F.pmod(F.shiftright("order", 8), F.lit(runs)).cast("int")), "mix")
    aims = B.written(source_targets(rows.groupBy("skey").agg(F.sum("size").alias("source_size"))), "aims")
    return running(rows, ["skey"], "run", F.col("size"), ["order", *ROW[:1], *ROW[3:]], "offset").drop("order", "run"), aims


def pieces(laid: DataFrame, slots: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """laid (ROW, source_size, offset), slots (slot, skey, rank) -> ROW, slot, time, from_word, n_words: what each slot's block holds of each document."""
    ends = B.written(slots.groupBy("skey").agg(F.max("rank").alias("last")), "ends")  # no later block is asked for; of known size, so that a few sources need no shuffle by source
    times = laid.where("size > 0").join(ends, "skey").withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    times = times.withColumn("low", F.col("time") * F.col("source_size") + F.col("offset")).withColumn("high", F.col("low") + F.col("size"))
    first, last = F.floor(F.col("low") / block), F.least(F.floor((F.col("high") - 1) / block), F.col("last"))
    cut = times.where(first <= F.col("last")).withColumn("rank", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("low"), F.col("rank") * block)
    cut = cut.select(*ROW, "rank", "time", (start - F.col("low")).alias("from_word"), (F.least(F.col("high"), (F.col("rank") + 1) * block) - start).alias("n_words"))
    return cut.join(slots, ["skey", "rank"]).select(*ROW, "slot", "time", "from_word", "n_words")


def mixture(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, by slot: which words (n_words from from_word on) of which documents stand in it."""
    laid, aims = streams(docs)
    return pieces(laid.join(aims.select("skey", "source_size"), "skey"), schedule(aims, block), block)


def mix(docs: DataFrame, block: int = BLOCK, point=golden) -> DataFrame:
    """docs (doc_id, text, source) -> ROW, source_size, target, taken, n_pieces, first_slot (null if nothing is taken); one row a row of docs."""
    laid, aims = streams(docs)
    laid = B.written(laid.join(aims.select("skey", "source_size", "target"), "skey"), "laid")
    taken = pieces(laid, B.written(schedule(aims, block, point), "slots"), block).select(*ROW, "slot", "n_words")
    every = taken.unionByName(laid.select(*ROW, F.lit(None).cast("long").alias("slot"), F.lit(0).cast("long").alias("n_words")))
    sums = every.groupBy(*ROW).agg(F.sum("n_words").cast("long").alias("taken"), F.count("slot").alias("n_pieces"), F.min("slot").alias("first_slot"))
    return sums.join(aims.select("skey", "source_size", "target"), "skey").drop("skey")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_pieces, first_slot of every document."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "first_slot")
