"""Matrices: wide form (a column a series) and long form (a row a cell), and the ways between.

Wide: dataset, row_id and value columns. Long: dataset, row_id, row_label, series_pos,
series, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allotau.functions.scalar import number


def numeric_columns(df: DataFrame, apart: tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric columns, in order; booleans aren't numeric."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in apart]


def numeric_only(df: DataFrame, apart: tuple[str, ...] = ()) -> DataFrame:
    """The columns `apart` as they are, and the numeric ones as doubles."""
    return df.select(*[F.col(f"`{c}`") for c in apart], *[number(F.col(f"`{c}`")).alias(c) for c in numeric_columns(df, apart)])


def with_numbers(df: DataFrame, change: dict[str, Column]) -> DataFrame:
    """df with some columns replaced, all in their old order."""
    return df.select(*[change[c].alias(c) if c in change else F.col(f"`{c}`") for c in df.columns])


def free(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def to_long(wide: DataFrame, values: list[str], keys: dict[str, str] | tuple[str, ...] = ("dataset", "row_id")) -> DataFrame:
    """keys, series_pos, series, value: a row a cell; no shuffle. A dict of keys gives them other names, as value columns may have those."""
    cells = F.array(*[F.struct(F.lit(i).alias("series_pos"), F.lit(c).alias("series"), number(F.col(f"`{c}`")).alias("value")) for i, c in enumerate(values)])
    keys = keys if isinstance(keys, dict) else {k: k for k in keys}
    long = wide.select(F.struct(*[F.col(f"`{k}`").alias(new) for k, new in keys.items()]).alias("own"), F.explode(cells).alias("cell"))
    return long.select(*[F.col(f"own.`{new}`") for new in keys.values()], *[F.col(f"cell.{c}") for c in ("series_pos", "series", "value")])


def to_wide(long: DataFrame, series: list[str]) -> DataFrame:
    """A column a series, for series that the caller names."""
    return long.groupBy("dataset", "row_id").pivot("series", series).agg(F.first("value"))


def transpose(long: DataFrame) -> DataFrame:
    """Samples and variables change places: a renaming of keys."""
    return long.select(
        "dataset",
        F.col("series_pos").cast("long").alias("row_id"),
        F.col("series").alias("row_label"),
        F.col("row_id").cast("int").alias("series_pos"),
        F.coalesce("row_label", F.col("row_id").cast("string")).alias("series"),
        "value",
    )


def first_cells(long: DataFrame, rows: int | None = None, columns: int | None = None) -> DataFrame:
    """The first rows and columns of every dataset; label columns don't count."""
    if rows is not None:
        long = long.where(F.col("row_id") < rows)
    if columns is not None:
        long = long.where(F.col("series_pos") < columns)
    return long


def first_series(rows: DataFrame, most: int) -> DataFrame:
    """Rows of the first `most` series that each dataset has left, by position."""
    own = Window.partitionBy("dataset").orderBy("series_pos")
    kept = rows.select("dataset", "series_pos").distinct().withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= most).drop("_k")
    return rows.join(kept, ["dataset", "series_pos"], "left_semi")


def shown_series(long: DataFrame, most: int) -> DataFrame:
    """dataset, n_series, n_shown, truncated: how many of its series a dataset shows if it shows the first `most`."""
    n = long.select("dataset", "series_pos").distinct().groupBy("dataset").agg(F.count(F.lit(1)).alias("n_series"))
    return n.select("dataset", "n_series", F.least("n_series", F.lit(most).cast("long")).alias("n_shown"), (F.col("n_series") > most).alias("truncated"))


def first_rows(wide: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first n rows of every dataset by an explicit key, with their position; Spark keeps n rows a dataset before it shuffles."""
    own = Window.partitionBy("dataset").orderBy(key)
    return wide.withColumn("row_pos", F.row_number().over(own).cast("long") - 1).where(F.col("row_pos") < n)


def shape(long: DataFrame) -> DataFrame:
    """dataset, n_rows, n_columns."""
    cells = long.groupBy("dataset", "row_id").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.max("n").alias("n_columns"))


def without_numbers(datasets: DataFrame, long: DataFrame) -> DataFrame:
    """Status rows of the datasets that have no numeric column; those with a status of their own keep it."""
    if "status" in datasets.columns:
        datasets = datasets.where("status = 'ok'")
    return datasets.select("dataset").distinct().join(long.select("dataset").distinct(), "dataset", "left_anti").select("dataset", F.lit("no_numeric_columns").alias("status"), F.lit("no numeric column").alias("reason"))
