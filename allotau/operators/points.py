"""Tables of points, as charts draw them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allotau.functions import scalar as S


def scatter(long: DataFrame) -> DataFrame:
    """Position of the sample against value."""
    return long.select("dataset", "series_pos", "series", "row_id", "value")


def quasi_scatter(points: DataFrame) -> DataFrame:
    """tau against value."""
    return points.select("dataset", "series_pos", "series", "tau", "value")


def in_log_space(points: DataFrame) -> DataFrame:
    """Points with positive tau and value, infinite ones too, and their logarithms."""
    kept = points.where(S.positive(F.col("tau")) & S.positive(F.col("value")))
    return kept.select("dataset", "series_pos", "series", "tau", "value", F.log("tau").alias("log_tau"), F.log("value").alias("log_value"))


def not_in_log_space(points: DataFrame) -> DataFrame:
    """Series without any positive pair."""
    any_pair = points.groupBy("dataset", "series_pos", "series").agg(F.max(S.positive(F.col("tau")) & S.positive(F.col("value"))).alias("any"))
    return any_pair.where(~F.col("any")).select("dataset", "series_pos", "series", F.lit("no_positive_pair").alias("status"))


def overlay(points: DataFrame, curves: DataFrame, fitted: DataFrame) -> DataFrame:
    """dataset, series_pos, series, kind (observed or fitted), tau, y: positive points of fitted series, and their curves."""
    keys = fitted.select("dataset", "series_pos")
    seen = in_log_space(points).join(keys, ["dataset", "series_pos"], "left_semi").select("dataset", "series_pos", "series", F.lit("observed").alias("kind"), "tau", F.col("value").alias("y"))
    drawn = curves.join(keys, ["dataset", "series_pos"], "left_semi").select("dataset", "series_pos", "series", F.lit("fitted").alias("kind"), "tau", "y")
    return seen.unionByName(drawn)
