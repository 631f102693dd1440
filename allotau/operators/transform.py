"""Rescaling of columns: none, min-max to [-1, 1] or [0, 1], log1p. A dataset that can't be rescaled is reported, not raised.

Min-max: missing cells stay missing and don't count; a constant column goes to the lower
bound; a dataset with an infinite cell fails (`non_finite`). log1p: a cell below -1 fails
its dataset (`log1p_domain`); -1 gives -inf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allotau.functions import scalar as S
from allotau.operators.matrix import free, with_numbers

RANGES = {"rescale_to_-1_1": (-1.0, 1.0), "rescale_to_0_1": (0.0, 1.0)}
KINDS = ("none", *RANGES, "log1p")


def checked(kind: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown transform: {kind}")


def scaled(v: Column, least: Column, most: Column, low: float, high: float) -> Column:
    factor = (high - low) / F.when(most > least, most - least)
    return F.when(v.isNull(), None).when(most == least, F.lit(low)).otherwise(v * factor + (low - least * factor))


def failures(bad: DataFrame, kind: str) -> DataFrame:
    """bad (dataset, bad) -> dataset, status, reason."""
    status, reason = ("log1p_domain", "a value is below -1") if kind == "log1p" else ("non_finite", "a value is infinite")
    return bad.select("dataset", F.when(F.col("bad"), status).otherwise("ok").alias("status"), F.when(F.col("bad"), reason).alias("reason"))


def transform_wide(wide: DataFrame, values: list[str], kind: str, key: str = "dataset") -> tuple[DataFrame, DataFrame]:
    """(wide with doubles in place of `values`, without failed datasets; dataset, status, reason). One aggregate serves bounds and guards.

    key names the column of the dataset, so that a value column may be called `dataset`.
    """
    checked(kind)
    numbers, dataset = {c: S.number(F.col(f"`{c}`")) for c in values}, F.col(f"`{key}`")
    if kind == "none" or not values:
        return with_numbers(wide, numbers), wide.groupBy(dataset.alias("dataset")).agg(F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"))
    wrong = [(v < -1) if kind == "log1p" else S.is_infinite(v) for v in numbers.values()]
    bounds = [] if kind == "log1p" else [f(v).alias(f"{n}{i}") for i, v in enumerate(numbers.values()) for n, f in (("least", F.min), ("most", F.max))]
    fact = free("facts", wide)  # all in one struct, so that one name is enough
    bad = F.max(F.greatest(*[F.coalesce(w, F.lit(False)) for w in wrong], F.lit(False))).alias("bad")
    facts = wide.groupBy(dataset).agg(F.struct(bad, *bounds).alias(fact))
    good = wide.join(facts.where(~F.col(fact)["bad"]), key)
    if kind == "log1p":
        change = {c: S.log1p(v) for c, v in numbers.items()}
    else:
        change = {c: scaled(v, F.col(fact)[f"least{i}"], F.col(fact)[f"most{i}"], *RANGES[kind]) for i, (c, v) in enumerate(numbers.items())}
    status = failures(facts.select(dataset.alias("dataset"), F.col(fact)["bad"].alias("bad")), kind)
    return good.select(*[change[c].alias(c) if c in change else F.col(f"`{c}`") for c in wide.columns]), status


def transform_long(long: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The same for the long form."""
    checked(kind)
    v = S.number(F.col("value"))
    if kind == "none":
        return long.withColumn("value", v), long.groupBy("dataset").agg(F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"))
    wrong = F.coalesce((v < -1) if kind == "log1p" else S.is_infinite(v), F.lit(False))
    facts = long.groupBy("dataset", "series_pos").agg(F.max(wrong).alias("bad"), F.min(v).alias("_least"), F.max(v).alias("_most"))
    status = failures(facts.groupBy("dataset").agg(F.max("bad").alias("bad")), kind)
    good = long.join(status.where("status = 'ok'").select("dataset"), "dataset", "left_semi")
    if kind == "log1p":
        return good.withColumn("value", S.log1p(v)), status
    good = good.join(facts.select("dataset", "series_pos", "_least", "_most"), ["dataset", "series_pos"])
    return good.withColumn("value", scaled(v, F.col("_least"), F.col("_most"), *RANGES[kind])).select(*long.columns), status
