"""Quasi-dynamic order: each sample's time is its row total tau, and samples come in order of it.

A row total skips missing cells (all missing: 0) and is NaN for inf and -inf together.
Equal totals keep the order of row_id. The order is needed for display only; fits and
grids use tau itself.

A table may have a value column of the name tau; its row total then takes another name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allotau.functions.scalar import number
from allotau.operators.matrix import free
from allotau.sources.tables import in_ranges, written


def row_total(values: list[str]) -> Column:
    """tau as one expression over the columns of the wide form; from 64 columns on, a fold over an array keeps the plan small."""
    cells = [F.coalesce(number(F.col(f"`{c}`")), F.lit(0.0)) for c in values]
    if len(cells) < 64:
        return reduce(lambda x, y: x + y, cells, F.lit(0.0))
    return F.aggregate(F.array(*cells), F.lit(0.0), lambda x, y: x + y)


def with_total(wide: DataFrame, values: list[str], name: str = "tau") -> DataFrame:
    """wide with its row total as the column `name`, which wide must not have."""
    if name.lower() in {c.lower() for c in wide.columns}:
        raise ValueError(f"the table has a column {name}: name the row total otherwise")
    return wide.withColumn(name, row_total(values))


def long_totals(long: DataFrame) -> DataFrame:
    """dataset, row_id, tau of the long form: the row's cells are added in the order of columns, as row_total adds them, so that both are equal to the last bit on every run. A group is a row."""
    cells = F.array_sort(F.collect_list(F.struct("series_pos", F.coalesce(number(F.col("value")), F.lit(0.0)).alias("value"))))
    return long.groupBy("dataset", "row_id").agg(F.aggregate(cells, F.lit(0.0), lambda x, c: x + c["value"]).alias("tau"))


def ordered(rows: DataFrame, tau: str = "tau") -> DataFrame:
    """rows (dataset, row_id, row total, ...) with tau_pos (0-based); tau: the row total's name.

    Rows are dealt by ranges and numbered within each; a dataset's rows in a range follow
    each other, so its count in the ranges before is all that is added. No task holds a dataset.
    """
    at, part, name, place = (free(x, rows) for x in ("_at", "_part", "_name", "_place"))
    sorted_rows = in_ranges(rows, ["dataset", tau, "row_id"], at, "ordered").withColumn(part, F.shiftright(F.col(at), 33))
    spans = sorted_rows.groupBy("dataset", part).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("dataset").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = written(spans.select("dataset", part, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("tau_pos")), "spans")
    placed = sorted_rows.join(shift.select(F.col("dataset").alias(name), F.col(part).alias(place), "tau_pos"), F.col("dataset").eqNullSafe(F.col(name)) & (F.col(part) == F.col(place)))
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("tau_pos") + F.col(at)).alias("tau_pos"))


def first_in_order(rows: DataFrame, n: int = 10, tau: str = "tau") -> DataFrame:
    """The first n rows of each dataset in the order of tau. Spark keeps n rows a dataset before it shuffles."""
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(tau, "row_id")).cast("long") - 1
    return rows.withColumn("tau_pos", place).where(F.col("tau_pos") < n)
