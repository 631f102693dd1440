"""Tables in the folder that all executors share, and result sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a local session without one gets a new one."""
    conf = spark.sparkContext.getConf()
    where = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not conf.get("spark.master", "local").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it takes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Lists of the scratch paths made within dropped_after, innermost last.
_MADE: list[list[str]] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the session ends, or earlier by dropped_after."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, path)
    fs.deleteOnExit(p)
    for made in _MADE[-1:]:
        made.append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


@contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made within are removed at the end; for work whose result is written by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            drop(spark, path)


def copy_beginning(spark: SparkSession, path: str, folder: str, size: int) -> str | None:
    """The first `size` bytes of a file as a file of its name in a folder, copied by the driver's file system; None if it is no longer, or compressed."""
    jvm = spark.sparkContext._jvm
    fs, p = filesystem(spark, path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p) is not None or fs.getFileStatus(p).getLen() <= size:
        return None
    to = f"{folder}/{p.getName()}"
    out_fs, out = filesystem(spark, to)
    source, sink = fs.open(p), out_fs.create(out, True)
    try:
        jvm.org.apache.commons.io.IOUtils.copyLarge(source, sink, 0, size)
    finally:
        source.close()
        sink.close()
    return to


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, which ends its lineage."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """df as CSV files with headers, which read_matrices reads as a dataset each."""
    df.write.option("header", True).csv(path)


def write_lines(df: DataFrame, line: str, header: str, path: str) -> None:
    """A column of lines as text files, a file a partition, each with a header line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([header, *lines] if first else lines, pa.string())], names=["value"])
            first = False

    df.select(line).mapInArrow(run, "value string").write.text(path)


def in_ranges(df: DataFrame, keys: list[str], part: str, what: str) -> DataFrame:
    """df as a table, dealt by ranges of the keys and sorted in each; the column `part` rises with the range, and by one from row to row in it."""
    return written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(part, F.monotonically_increasing_id()), what)


def write_result(df: DataFrame, path: str) -> None:
    """A result as Parquet, one folder a dataset, in place of an older one.

    It is written beside and then takes the old one's place, which is set aside for that
    moment; whatever happens, one of the two is whole, and read_result finds it.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old"
    df.write.partitionBy("dataset").parquet(new)
    fs, p = filesystem(spark, path)
    (_, new_p), (_, old_p) = filesystem(spark, new), filesystem(spark, old)
    if fs.exists(p):
        fs.delete(old_p, True)
        if not fs.rename(p, old_p):
            raise OSError(f"{path} can't be set aside")
    if not fs.rename(new_p, p):
        raise OSError(f"{new} can't be named {path}")
    fs.delete(old_p, True)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The last whole result that write_result left."""
    path = path.rstrip("/")
    fs, p = filesystem(spark, path)
    return spark.read.parquet(path if fs.exists(p) else f"{path}.old")
