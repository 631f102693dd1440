"""The three workloads, on the long form of many matrices or on one wide table; `python -m allotau.plans.jobs` runs one on CSV files.

    python -m allotau.plans.jobs fit|curve|quasi OUT CSV... [--transform KIND] [--label] [--transpose] [--rows N] [--columns P] [--min-points M]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allotau.functions import scalar as S
from allotau.operators import curve, fit, matrix, quasi, transform
from allotau.sources.csv_matrices import read_matrices
from allotau.sources.tables import write_result, written


#: Columns up to which one aggregate counts the valid points of all.
FUSED = 500
#: Columns up to which the passes of large fits read wide rows.
SHARED = 64


def points_of_wide(wide: DataFrame, values: list[str], key: str = "dataset") -> DataFrame:
    """dataset, series_pos, series, tau, value: no shuffle. Value columns may have any names, tau too; key names the column of the dataset."""
    tau = matrix.free("tau", wide)
    return matrix.to_long(quasi.with_total(wide, values, tau), values, {key: "dataset", tau: "tau"})


def facts_of_wide(wide: DataFrame, values: list[str], key: str = "dataset") -> DataFrame:
    """dataset, n, low, high (as curve.bounds), used (valid points of each column, null from FUSED columns on): one aggregate over the wide rows, without a cell exploded."""
    tau = matrix.free("tau", wide)
    positive = F.when(S.positive(F.col(tau)), F.col(tau))
    used = [F.count_if(fit.is_valid(F.col(tau), S.number(F.col(f"`{c}`")))) for c in values]
    used = F.array(*used) if 0 < len(values) <= FUSED else F.lit(None).cast("array<bigint>")
    facts = quasi.with_total(wide, values, tau).groupBy(F.col(f"`{key}`").alias("dataset")).agg(F.count(F.lit(1)).alias("n"), F.min(positive).alias("low"), F.max(positive).alias("high"), used.alias("used"))
    return written(facts, "facts")


def stats_of_facts(facts: DataFrame, values: list[str]) -> DataFrame | None:
    """fit.point_stats from facts_of_wide."""
    if not 0 < len(values) <= FUSED:
        return None
    names = F.array(*[F.lit(c) for c in values])
    rows = facts.select("dataset", "n", F.posexplode("used").alias("series_pos", "used_points"))
    return rows.select("dataset", "series_pos", F.get(names, F.col("series_pos")).alias("series"), F.col("n").alias("total_points"), (F.col("n") - F.col("used_points")).alias("removed_points"), "used_points")


def points_of_long(long: DataFrame) -> DataFrame:
    return long.join(quasi.long_totals(long), ["dataset", "row_id"]).select("dataset", "series_pos", "series", "row_id", "tau", "value")


def fit_wide(wide: DataFrame, values: list[str], kind: str = "none", min_points: int = 3, large: int = fit.LARGE, key: str = "dataset", facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fit report, dataset status) of a wide table; facts: its facts_of_wide, where the caller has them. The source is read twice, for the facts and for the points of the solver."""
    good, status = transform.transform_wide(wide, values, kind, key)
    stats = stats_of_facts(facts_of_wide(good, values, key) if facts is None else facts, values)
    tau = matrix.free("tau", good)
    cells = [S.number(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(values)]
    rows = quasi.with_total(good, values, tau).select(F.col(f"`{key}`").alias("dataset"), F.col(tau).alias("tau"), *cells)
    wide_rows = (rows, values) if 0 < len(values) <= SHARED else None
    return fit.fit_report(points_of_wide(good, values, key), min_points, large, stats, wide_rows), status


def fit_long(long: DataFrame, kind: str = "none", min_points: int = 3) -> tuple[DataFrame, DataFrame]:
    """(fit report, dataset status) of the long form."""
    good, status = transform.transform_long(long, kind)
    return fit.fit_report(points_of_long(good), min_points), status


def curves_wide(wide: DataFrame, values: list[str], report: DataFrame, key: str = "dataset", facts: DataFrame | None = None) -> DataFrame:
    """Fitted curves on the grid of every dataset."""
    facts = facts_of_wide(wide, values, key) if facts is None else facts
    return curve.curves(facts.select("dataset", "n", "low", "high"), fit.params(report))


def curves_long(long: DataFrame, report: DataFrame) -> DataFrame:
    return curve.curves(curve.bounds(quasi.long_totals(long)), fit.params(report))


def curves_unfiltered(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Curves of the unfiltered fit, on the grid over all tau."""
    fitted = fit.fit_unfiltered(points).where("status = 'ok'").select("dataset", "series_pos", "series", "a", "b")
    return curve.curves(curve.bounds(samples, positive_only=False), fitted)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("job", choices=("fit", "curve", "quasi"))
    p.add_argument("out")
    p.add_argument("csv", nargs="+")
    p.add_argument("--transform", default="none", choices=transform.KINDS)
    p.add_argument("--label", action="store_true")
    p.add_argument("--transpose", action="store_true")
    p.add_argument("--rows", type=int)
    p.add_argument("--columns", type=int)
    p.add_argument("--min-points", type=int, default=3)
    o = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"allotau-{o.job}").getOrCreate()
    long, files = read_matrices(spark, o.csv, o.label, o.transpose, o.rows, o.columns)
    good, status = transform.transform_long(written(long, "matrix"), o.transform)
    good = written(good, "matrix")
    bare = matrix.without_numbers(files, long).unionByName(files.where("status <> 'ok'").select("dataset", "status", "reason"))
    if o.job == "quasi":
        result = quasi.ordered(quasi.long_totals(good)).join(good, ["dataset", "row_id"])
    else:
        result = written(fit.fit_report(points_of_long(good), o.min_points), "report")
        bare = bare.unionByName(fit.unfitted_datasets(result))
        if o.job == "curve":
            result = curves_long(good, result)
    write_result(result, f"{o.out}/{o.job}")
    write_result(status.join(bare, "dataset", "left_anti").unionByName(bare), f"{o.out}/status")


if __name__ == "__main__":
    main()
