"""The corpus pipeline: stages of documents, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents, whatever others there are and
whatever they are called. Rows without an id or a text pass all filters; a null source is a
source; of repeated rows one stays at near_dedup; of texts that tie, the one of the smallest
id; long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allotau.llm import _base as B
from allotau.llm import mixing, near_dedup, packing, secrets, toxicity
from allotau.sources import tables


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay."""
    learnable = ~B.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.learn(spark, docs, B.table(spark, sf_dir, "labels"), learnable)
    return docs.where(toxicity.score_of(F.col("text"), model, spark) < 0.5)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of equal and nearly equal texts, the text of the smallest id stays, once, whatever other texts its ids come with."""
    key, kept_id, kept_sum = B.free("_sum", docs), B.free("_kept_id", docs), B.free("_kept_sum", docs)
    classes = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    keep = classes.where("kept and sum is not null").select(F.col("doc_id").alias(kept_id), F.col("sum").alias(kept_sum)).distinct()
    marked = docs.withColumn(key, F.when(F.col("doc_id").isNotNull() & (F.col("text") != ""), F.md5(F.col("text").cast("binary"))))
    once = marked.where(F.col(key).isNotNull()).join(keep, (F.col("doc_id") == F.col(kept_id)) & (F.col(key) == F.col(kept_sum)), "left_semi").dropDuplicates(["doc_id", key])
    return once.unionByName(marked.where(F.col(key).isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, and n_chars follows."""
    least = secrets.thresholds(docs.select("text"))
    base, spans = B.free("_base", docs), B.free("_spans", docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn(base, secrets.base_spans(text))
    found = found.withColumn(spans, secrets.all_spans(text, F.col(base), least))
    masked = found.withColumn("text", secrets.redacted(F.col("text"), F.col(spans)))
    masked = masked.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (0, 1 or 2) as the mix takes its words, to the nearest; one without words once."""
    key, mix_id, mix_source, mix_hash, copies = (B.free(name, docs) for name in ("_hash", "_mix_id", "_mix_source", "_mix_hash", "_copies"))
    rows = mixing.mix(docs.select("doc_id", "text", "source")).groupBy("doc_id", "source", "text_hash", "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n"))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size") / F.col("n"))).otherwise(1).cast("int")
    rows = rows.select(F.col("doc_id").alias(mix_id), F.col("source").alias(mix_source), F.col("text_hash").alias(mix_hash), times.alias(copies)).where(F.col(copies) > 0)
    marked = docs.withColumn(key, F.xxhash64("text", F.lit(mixing.SEED)))
    got = marked.join(rows, F.col("doc_id").eqNullSafe(F.col(mix_id)) & F.col("source").eqNullSafe(F.col(mix_source)) & (F.col(key) == F.col(mix_hash)))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return got.select(*own, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(key)).select(*own)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, bin_id, capacity, bin_fill, offset: the documents packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", one_of_each),
    ("secrets", secrets_masked),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express none of the model-based stages; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others leave; their tables, and what they wrote on the way, go as soon as the next stage is written, and the last one with the session."""
    docs = B.table(spark, sf_dir, "documents")
    base = tables.scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with tables.dropped_after(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        if i:
            tables.drop(spark, f"{base}/{i - 1}")
        docs = spark.read.parquet(f"{base}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
