"""Power-law fit y = a * x^b of every series by least squares, as a report with one row a series.

The contract is the local optimum that Gauss-Newton with step halving reaches from b = 1.
`a` enters linearly and is eliminated: with L = ln x - mean(ln x) and z = exp(b L), six
sums over the points give the best `a`, the squared error and the next step in b.

Two ways compute the same: series of up to LARGE points are fitted within one group each.
Of larger ones only sums move: as the six sums are smooth in b, Chebyshev moments of L, and
of y over L, stand for all points; the descent runs on them, and a pass over the points
confirms what it found.

Points with a missing, infinite or non-positive x or y are removed first (`filtered`).
The unfiltered fit takes y <= 0 too; it reports `fit_failed` for missing or infinite
points and `unsupported_domain` for x <= 0. A series whose x are all equal is
`degenerate`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allotau.functions import scalar as S
from allotau.sources.tables import written

LARGE = 1_000_000
STEPS = 100
TOLERANCE = 1e-9
#: A step may raise the squared error by this share of sum(y^2), which is rounding.
SLACK = 1e-12
#: Chebyshev moments of a large series; series whose facts are broadcast.
NODES, FEW_SERIES = 64, 100_000
KEYS = ["dataset", "series_pos", "series"]
RESULT = [*KEYS, "status", "a", "b"]


def is_valid(x: Column, y: Column) -> Column:
    return S.positive_finite(x) & S.positive_finite(y)


def point_stats(points: DataFrame) -> DataFrame:
    """points (KEYS, tau, value) -> KEYS, total_points, removed_points, used_points."""
    valid = is_valid(F.col("tau"), F.col("value"))
    return points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total_points"), F.count_if(~valid).alias("removed_points"), F.count_if(valid).alias("used_points"))


def descend(sums: Callable[[float], tuple[float, ...]], syy: float, tolerance: float = TOLERANCE, steps: int = STEPS) -> tuple[str, float, tuple[float, ...]]:
    """Gauss-Newton with step halving from b = 1; sums(b) gives the sums of z^2, z^2 L, z^2 L^2, y z and y z L. -> status, b, its sums."""
    b = 1.0
    szz, szl, szll, syz, syzl = now = sums(b)
    for _ in range(steps):
        if not szz > 0:
            return "degenerate", b, now
        best, bend = syz / szz, szz * szll - szl * szl
        if best == 0 or bend <= 0 or not np.isfinite(bend):
            return "degenerate", b, now
        step = (szz * (syzl - best * szl) - szl * (syz - best * szz)) / bend / best
        error = syy - syz * syz / szz
        for _ in range(60):
            now = sums(b + step)
            if np.isfinite(now).all() and now[0] > 0 and syy - now[3] ** 2 / now[0] <= error + SLACK * syy:
                break
            step /= 2
        b, (szz, szl, szll, syz, syzl) = b + step, now
        if abs(step) < tolerance * (1 + abs(b)):
            return "ok", b, now
    return "fit_failed", b, now


def weighted_sums(l: np.ndarray, weights: np.ndarray, values: np.ndarray) -> Callable[[float], tuple[float, ...]]:
    """The sums over points of these L, with weights for sums without y, and values for those with it."""

    def sums(b: float) -> tuple[float, ...]:
        z = np.exp(b * l)
        zz = z * z * weights
        yz = z * values
        return tuple(float(v) for v in (zz.sum(), zz @ l, zz @ (l * l), yz.sum(), yz @ l))

    return sums


def solve(x: np.ndarray, y: np.ndarray) -> tuple[str, float | None, float | None]:
    """status, a, b of one series."""
    log_x = np.log(x)
    mean = log_x.mean()
    centred = log_x - mean
    if centred.max() - centred.min() <= 1e-14 * max(1.0, abs(mean)):
        return "degenerate", None, None
    status, b, (szz, _, _, syz, _) = descend(weighted_sums(centred, np.ones(len(y)), y), float(y @ y))
    return ("ok", float(syz / szz * np.exp(-b * mean)), float(b)) if status == "ok" else (status, None, None)


def fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    status, a, b = solve(pdf["tau"].to_numpy(), pdf["value"].to_numpy())
    return pd.DataFrame({k: [pdf[k].iloc[0]] for k in ("key_1", "key_2")} | {"status": [status], "a": [a], "b": [b]}).astype({"a": float, "b": float})


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, and the series as two 64-bit hashes: names are long, and a point is two numbers."""
    return df.select(*columns, *[F.xxhash64(*KEYS, F.lit(seed)).alias(f"key_{seed}") for seed in (1, 2)])


def fit_small(points: DataFrame, series: DataFrame) -> DataFrame:
    """Valid points of the series (KEYS) -> RESULT; a series is fitted in one task."""
    fits = keyed(points, "tau", "value").groupBy("key_1", "key_2").applyInPandas(fit_group, "key_1 long, key_2 long, status string, a double, b double")
    return keyed(series, *KEYS).join(fits, ["key_1", "key_2"]).select(*RESULT)


SERIES = ["key_1", "key_2"]


def near(points: DataFrame, facts: DataFrame) -> DataFrame:
    """points with the facts of their series. Large series are few for their rows; if they are many all the same, nothing is broadcast."""
    return points.join(F.broadcast(facts) if facts.count() <= FEW_SERIES else facts, SERIES)


def moments(points: DataFrame) -> DataFrame:
    """points (SERIES, u in [-1, 1], value) -> SERIES, moments: the sums of T_n(u), then of value * T_n(u), for the first NODES Chebyshev polynomials; summed in each task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            code, keys = pd.factorize(pd.MultiIndex.from_frame(pdf[SERIES]))
            u, y = pdf["u"].to_numpy(), pdf["value"].to_numpy()
            sums = np.empty((len(keys), 2 * NODES))
            before, now = u, np.ones(len(u))
            for n in range(NODES):
                sums[:, n] = np.bincount(code, now, len(keys))
                sums[:, NODES + n] = np.bincount(code, now * y, len(keys))
                before, now = now, (2 * u * now - before)
            for key, row in zip(keys, sums, strict=True):
                held[key] = held[key] + row if key in held else row
        if held:
            yield pd.DataFrame(list(held), columns=SERIES).assign(moments=list(held.values()))

    parts = points.mapInPandas(run, "key_1 long, key_2 long, moments array<double>").select(*SERIES, F.posexplode("moments").alias("n", "m"))
    sums = parts.groupBy(*SERIES, "n").agg(F.sum("m").alias("m"))
    return sums.groupBy(*SERIES).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "m"))), lambda x: x["m"]).alias("moments"))


def by_moments(pdf: pd.DataFrame, steps: int) -> pd.DataFrame:
    """Moments of series with half (of the range of L) and yy -> SERIES, trial: the b that they give, or 1.

    A smooth function's sum over the points is that over NODES nodes with weights that the
    moments give, as long as its Chebyshev series ends by then.
    """
    angle = np.pi * (np.arange(NODES) + 0.5) / NODES
    basis = np.cos(np.outer(np.arange(NODES), angle)) * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES
    trial = []
    for got, half, yy in zip(pdf["moments"], pdf["half"], pdf["yy"], strict=True):
        m = np.asarray(got)
        with np.errstate(over="ignore", invalid="ignore"):
            status, b, _ = descend(weighted_sums(half * np.cos(angle), m[:NODES] @ basis, m[NODES:] @ basis), float(yy), 1e-13, steps)
        trial.append(b if status == "ok" and abs(2 * b * half) <= NODES / 3 else 1.0)
    return pdf[SERIES].assign(trial=trial)


def exact_sums(centred: DataFrame, state: DataFrame) -> DataFrame:
    """SERIES and the five sums at each series' trial."""
    z = F.exp(F.col("trial") * F.col("l"))
    zl = z * F.col("l")
    return near(centred, state.select(*SERIES, "trial")).groupBy(*SERIES).agg(*[F.sum(v).alias(n) for n, v in (("zz", z * z), ("zl", z * zl), ("zll", zl * zl), ("yz", F.col("value") * z), ("yzl", F.col("value") * zl))])


def stepped(seen: DataFrame, last: bool) -> DataFrame:
    """state and the sums at the trials -> the next state: a trial that doesn't raise the error is taken, and else the step halved."""
    best, bend = F.try_divide("yz", "zz"), F.col("zz") * F.col("zll") - F.col("zl") * F.col("zl")
    flat = (F.coalesce(bend, F.lit(0.0)) <= 0) | F.isnan(bend) | (F.coalesce(best, F.lit(0.0)) == 0)
    error = F.col("yy") - F.try_divide(F.col("yz") * F.col("yz"), F.col("zz"))
    fine = F.coalesce(F.col("b").isNull() | ((error <= F.col("error") + SLACK * F.col("yy")) & (F.abs("zz") < S.INFINITY) & ~F.isnan(error)), F.lit(False))
    step = F.try_divide(F.try_divide(F.col("zz") * (F.col("yzl") - best * F.col("zl")) - F.col("zl") * (F.col("yz") - best * F.col("zz")), bend), best)
    b, step = F.when(fine, F.col("trial")).otherwise(F.col("b")), F.when(fine, step).otherwise(F.col("step") / 2)
    # a start that overflows is no minimum, and is tried again nearer to 0
    status = F.when(F.col("status").isNotNull(), F.col("status")).when(fine & flat, "degenerate").when(fine & (F.abs(step) < TOLERANCE * (1 + F.abs("trial"))), "ok")
    a = best * F.exp(-F.col("trial") * F.col("centre"))
    got = seen.select(*SERIES, "centre", "half", "yy", b.alias("b"), step.alias("step"), F.when(fine, error).otherwise(F.col("error")).alias("error"), status.alias("status"), F.when(fine, a).otherwise(F.col("a")).alias("a"))
    end = F.coalesce("status", F.lit("fit_failed")) if last else F.col("status")
    return got.withColumn("status", end).withColumn("trial", F.col("b") + F.col("step"))


def searched(names: DataFrame, facts: DataFrame, moments: DataFrame, sums_at: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """names (KEYS, SERIES), facts (SERIES, centre, half, yy, status) and moments of large series -> RESULT.

    The descent runs on the moments, and a pass shows that the next step at the b found is
    below the tolerance. A series for which it isn't goes on with exact sums, a pass a step;
    sums_at gives these at the trials of a state.
    """
    found = moments.join(facts.select(*SERIES, "half", "yy"), SERIES)
    steps = STEPS
    trials = found.mapInPandas(lambda batches: (by_moments(pdf, steps) for pdf in batches), "key_1 long, key_2 long, trial double")
    nothing = [F.lit(None).cast("double").alias(c) for c in ("b", "step", "error", "a")]
    state = written(facts.join(trials, SERIES, "left").select(*SERIES, "centre", "half", "yy", "status", "trial", *nothing), "fit")
    for i in range(STEPS):
        open_ = state.where("status is null")
        if not open_.limit(1).count():
            break
        seen = state.join(sums_at(open_), SERIES, "left")
        state = written(stepped(seen, i + 1 == STEPS), "fit")
    ok = F.col("status") == "ok"
    return names.join(state, SERIES).select(*KEYS, "status", F.when(ok, F.col("a")).alias("a"), F.when(ok, F.col("b")).alias("b"))


def is_flat(low: Column, high: Column) -> Column:
    return high - low <= 1e-14 * F.greatest(F.lit(1.0), F.abs(low))


def fit_large(points: DataFrame, series: DataFrame) -> DataFrame:
    """Valid points of the series (KEYS) -> RESULT, in passes over a table of the points, of which only sums move: the range of L, its moments, and exact sums."""
    kept = written(keyed(points, F.log("tau").alias("log_x"), "value"), "points")
    low, high = F.min("log_x"), F.max("log_x")
    facts = kept.groupBy(*SERIES).agg(((low + high) / 2).alias("centre"), ((high - low) / 2).alias("half"), F.sum(F.col("value") * F.col("value")).alias("yy"), F.when(is_flat(low, high), "degenerate").alias("status"))
    facts = written(facts, "facts")
    centred = near(kept, facts.where("status is null").select(*SERIES, "centre", "half")).select(*SERIES, (F.col("log_x") - F.col("centre")).alias("l"), "half", "value")
    found = moments(centred.select(*SERIES, (F.col("l") / F.col("half")).alias("u"), "value"))
    return searched(keyed(series, *KEYS), facts, found, lambda open_: exact_sums(centred.drop("half"), open_))


def task_sums(rows: DataFrame, columns: list[str], given: list[str], sums: Callable[[np.ndarray, np.ndarray, list[float]], np.ndarray]) -> DataFrame:
    """rows (dataset, l, columns, given) -> dataset, series_pos, sums: what `sums` gives for a dataset's l, values (NaN: none) and its given numbers, a row a column, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field("dataset").type
            dataset = batch.column("dataset").dictionary_encode()
            code = dataset.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            l = batch.column("l").to_numpy(zero_copy_only=False)[order]
            values = [batch.column(c).to_numpy(zero_copy_only=False)[order] for c in columns]
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(order)], strict=True):
                key = dataset.dictionary[int(code[order[start]])].as_py()
                own = [batch.column(c)[int(order[start])].as_py() for c in given]
                got = sums(l[start:end], [v[start:end] for v in values], own)
                held[key] = held[key] + got if key in held else got
        for key, got in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), kind), pa.array(range(len(got)), pa.int32()), pa.array(got.tolist(), pa.list_(pa.float64()))], names=["dataset", "series_pos", "sums"])

    parts = rows.select("dataset", "l", *columns, *given).mapInArrow(run, f"dataset {rows.schema['dataset'].dataType.simpleString()}, series_pos int, sums array<double>")
    each = parts.select("dataset", "series_pos", F.posexplode("sums").alias("n", "m")).groupBy("dataset", "series_pos", "n").agg(F.sum("m").alias("m"))
    return each.groupBy("dataset", "series_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "m"))), lambda x: x["m"]).alias("sums"))


def moment_sums(u: np.ndarray, values: list[np.ndarray], _: list[float]) -> np.ndarray:
    """As moments, for all columns at once: they share u, so the polynomials are made once and summed by a matrix product."""
    basis = np.empty((NODES, len(u)))
    basis[0], basis[1], double = 1, u, 2 * u
    for n in range(2, NODES):
        np.multiply(double, basis[n - 1], out=basis[n])
        basis[n] -= basis[n - 2]
    y = np.array(values)
    seen = ~np.isnan(y)
    return np.hstack([seen.astype(float) @ basis.T, np.where(seen, y, 0.0) @ basis.T])


def trial_sums(l: np.ndarray, values: list[np.ndarray], trials: list[float | None]) -> np.ndarray:
    """The five sums of each column at its trial; zeros where it has none."""
    got = np.zeros((len(trials), 5))
    with np.errstate(over="ignore", invalid="ignore"):
        for i, (y, trial) in enumerate(zip(values, trials, strict=True)):
            if trial is not None:
                seen = ~np.isnan(y)
                x, y = (l, y) if seen.all() else (l[seen], y[seen])
                got[i] = weighted_sums(x, np.ones(len(x)), y)(trial)
    return got


def fit_large_wide(rows: DataFrame, names: list[str], series: DataFrame) -> DataFrame:
    """rows (dataset, tau, v0, v1, ...: a column for each of `names`) -> RESULT of the series (KEYS).

    As fit_large, over the rows as they come, which are read once a pass and not written:
    the columns of a dataset share tau, so a row serves all of them, on one range of L.
    Rows that are dear to make are better written by the caller first.
    """
    columns = [f"v{i}" for i in range(len(names))]
    valid = [F.when(is_valid(F.col("tau"), F.col(c)), F.col(c)).alias(c) for c in columns]
    own = series.select("dataset").distinct()
    kept = rows.where(S.positive_finite(F.col("tau"))).join(own, "dataset", "left_semi").select("dataset", F.log("tau").alias("log_x"), *valid)
    at = [F.when(F.col(c).isNotNull(), F.col("log_x")) for c in columns]
    spans = F.array(*[F.struct(F.lit(i).alias("series_pos"), F.min(x).alias("low"), F.max(x).alias("high"), F.sum(F.col(c) * F.col(c)).alias("yy")) for i, (c, x) in enumerate(zip(columns, at, strict=True))])
    low, high = F.array_min(F.col("spans.low")), F.array_max(F.col("spans.high"))
    spans = kept.groupBy("dataset").agg(spans.alias("spans")).select("dataset", ((low + high) / 2).alias("centre"), ((high - low) / 2).alias("half"), F.explode("spans").alias("own"))
    keys = keyed(series, *KEYS)
    named = spans.select("dataset", "own.series_pos", "centre", "half", "own.yy", F.when(is_flat(F.col("own.low"), F.col("own.high")), "degenerate").alias("status")).join(keys.select("dataset", "series_pos", *SERIES), ["dataset", "series_pos"])
    named = written(named, "facts")

    def sums_of(state: DataFrame, l: Column, given: list[str], how: Callable[[np.ndarray, list[np.ndarray], list[float]], np.ndarray]) -> DataFrame:
        """state (dataset, series_pos, centre, half, trial): sums of its series."""
        trials = [F.max(F.when(F.col("series_pos") == i, F.col("trial"))).alias(c) for i, c in enumerate(given)]
        facts = written(state.groupBy("dataset").agg(F.first("centre").alias("centre"), F.first("half").alias("half"), *trials), "trials")
        beside = F.broadcast(facts) if facts.count() * len(columns) <= FEW_SERIES else facts
        got = task_sums(kept.join(beside, "dataset").select("dataset", l.alias("l"), *columns, *given), columns, given, how)
        return got.join(state.select("dataset", "series_pos", *SERIES), ["dataset", "series_pos"])

    l = F.col("log_x") - F.col("centre")
    start = named.where("status is null").withColumn("trial", F.lit(None).cast("double"))
    found = sums_of(start, l / F.col("half"), [], moment_sums).select(*SERIES, F.col("sums").alias("moments"))

    def sums_at(open_: DataFrame) -> DataFrame:
        state = open_.select(*SERIES, "trial").join(named.select("dataset", "series_pos", "centre", "half", *SERIES), SERIES)
        got = sums_of(state, l, [f"t{i}" for i in range(len(columns))], trial_sums)
        return got.select(*SERIES, *[F.get("sums", F.lit(i)).alias(n) for i, n in enumerate(("zz", "zl", "zll", "yz", "yzl"))])

    return searched(keys, named.select(*SERIES, "centre", "half", "yy", "status"), found, sums_at)


def fit_by_size(points: DataFrame, sizes: DataFrame, large: int = LARGE, wide: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """Points and sizes (KEYS, n) of the series to fit -> RESULT, by the way that a series' size asks for; wide: the same points as the rows and names of fit_large_wide, where they come so."""
    least, most = sizes.agg(F.min("n"), F.max("n")).first()
    if (most or 0) <= large:
        return fit_small(points, sizes)
    small, big = (sizes.where(which).select(*KEYS) for which in (F.col("n") <= large, F.col("n") > large))
    fits = fit_large_wide(*wide, big) if wide else fit_large(points.join(big, KEYS, "left_semi"), big)
    return fits if least > large else fit_small(points.join(small, KEYS, "left_semi"), small).unionByName(fits)


def fit_report(points: DataFrame, min_points: int = 3, large: int = LARGE, stats: DataFrame | None = None, wide: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """points (KEYS, tau, value) -> KEYS, total_points, removed_points, used_points, status, reason, a, b; stats: their point_stats, where these came with less work; wide: as in fit_by_size."""
    stats = written(point_stats(points) if stats is None else stats, "stats")
    valid = points.where(is_valid(F.col("tau"), F.col("value"))).select(*KEYS, "tau", "value")
    enough = F.col("used_points") >= min_points
    if stats.where(~enough & (F.col("used_points") > 0)).limit(1).count():
        valid = valid.join(stats.where(~enough).select(*KEYS), KEYS, "left_anti")
    fits = fit_by_size(valid, stats.where(enough).select(*KEYS, F.col("used_points").alias("n")), large, wide)
    report = stats.join(fits, KEYS, "left").withColumn("status", F.coalesce("status", F.lit("too_few_points")))
    reason = (
        F.when(F.col("status") == "too_few_points", F.concat(F.lit(f"fewer than {min_points} valid points: "), F.col("used_points")))
        .when(F.col("status") == "degenerate", "the exponent isn't determined: all x are equal")
        .when(F.col("status") == "fit_failed", f"no convergence in {STEPS} steps")
    )
    return report.select(*KEYS, "total_points", "removed_points", "used_points", "status", reason.alias("reason"), "a", "b")


def fit_unfiltered(points: DataFrame, large: int = LARGE) -> DataFrame:
    """KEYS, status, a, b with no point removed."""
    x, y = F.col("tau"), F.col("value")
    odd = F.coalesce(S.is_infinite(x) | S.is_infinite(y) | F.isnan(x) | F.isnan(y), F.lit(False)) | x.isNull() | y.isNull()
    facts = points.groupBy(*KEYS).agg(F.max(odd).alias("odd"), F.max(F.coalesce(x <= 0, F.lit(False))).alias("low"), F.count(F.lit(1)).alias("n"))
    failed = F.when(F.col("odd") | (F.col("n") < 2), "fit_failed").when(F.col("low"), "unsupported_domain")
    facts = written(facts.select(*KEYS, failed.alias("failed"), "n"), "facts")
    fits = fit_by_size(points.join(facts.where("failed is null"), KEYS, "left_semi"), facts.where("failed is null").select(*KEYS, "n"), large)
    return facts.join(fits, KEYS, "left").select(*KEYS, F.coalesce("failed", "status").alias("status"), "a", "b")


def params(report: DataFrame) -> DataFrame:
    """The fitted series: KEYS, a, b."""
    return report.where("status = 'ok'").select(*KEYS, "a", "b")


def skipped(report: DataFrame) -> DataFrame:
    """The others, and why."""
    return report.where("status <> 'ok'").select("dataset", "series_pos", "series", "status", "reason")


def unfitted_datasets(report: DataFrame) -> DataFrame:
    """Status rows of the datasets of which no series could be fitted."""
    ok = report.groupBy("dataset").agg(F.max(F.col("status") == "ok").alias("ok"))
    return ok.where(~F.col("ok")).select("dataset", F.lit("no_fittable_column").alias("status"), F.lit("no series has enough valid points").alias("reason"))
