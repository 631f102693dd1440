import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from allotau.functions import scalar as S
from allotau.operators import curve, fit, matrix, points, quasi, transform
from allotau.plans import jobs
from allotau.sources.tables import written

INF = float("inf")


def wide(spark, data, schema="dataset string, row_id long, x double, y double"):
    return spark.createDataFrame(data, schema)


def test_numeric_columns_leave_out_booleans_and_texts_and_keep_the_order(spark):
    df = spark.createDataFrame([("a", 1, True, 2.5, None)], "id string, n int, b boolean, v double, w double")
    assert matrix.numeric_columns(df) == ["n", "v", "w"]
    good, _ = transform.transform_wide(df.withColumn("dataset", F.lit("d")), ["n", "v", "w"], "none")
    assert good.drop("dataset").dtypes == [("id", "string"), ("n", "double"), ("b", "boolean"), ("v", "double"), ("w", "double")]


def test_minmax(spark):
    df = wide(spark, [("a", 0, 1.0, 5.0), ("a", 1, 3.0, 5.0), ("a", 2, None, 5.0), ("b", 0, 7.0, None), ("b", 1, 9.0, None)])
    got, status = transform.transform_wide(df, ["x", "y"], "rescale_to_-1_1")
    assert sorted(rows(got), key=str) == sorted([("a", 0, -1.0, -1.0), ("a", 1, 1.0, -1.0), ("a", 2, None, -1.0), ("b", 0, -1.0, None), ("b", 1, 1.0, None)], key=str)
    assert {r["status"] for r in status.collect()} == {"ok"}
    long = matrix.to_long(df, ["x", "y"])
    again, _ = transform.transform_long(long, "rescale_to_-1_1")
    assert {(r["dataset"], r["row_id"], r["series"]): r["value"] for r in again.collect()}["a", 1, "x"] == 1.0


def test_minmax_range_and_infinite_cells(spark):
    df = wide(spark, [("a", i, float(v), float(-v)) for i, v in enumerate(np.random.default_rng(0).normal(size=50))] + [("b", 0, INF, 1.0), ("b", 1, 2.0, 1.0)])
    got, status = transform.transform_wide(df, ["x", "y"], "rescale_to_0_1")
    assert {r["dataset"]: r["status"] for r in status.collect()} == {"a": "ok", "b": "non_finite"}
    assert all(-1e-12 <= v <= 1 + 1e-12 for r in got.collect() for v in (r["x"], r["y"])) and got.count() == 50


def test_log1p_guard(spark):
    df = wide(spark, [("a", 0, -1.0, 0.0), ("a", 1, None, 1.0), ("b", 0, -1.5, 0.0), ("b", 1, 2.0, 0.0)])
    for got, status in (transform.transform_wide(df, ["x", "y"], "log1p"), transform.transform_long(matrix.to_long(df, ["x", "y"]), "log1p")):
        assert {r["dataset"]: r["status"] for r in status.collect()} == {"a": "ok", "b": "log1p_domain"}
        assert {r["dataset"] for r in got.collect()} == {"a"}
    got, _ = transform.transform_wide(df, ["x", "y"], "log1p")
    assert sorted(rows(got), key=str) == sorted([("a", 0, -INF, 0.0), ("a", 1, None, math.log(2))], key=str)


def test_columns_of_any_name(spark):
    """Dots, and names of helper columns."""
    names = ["a.1", "bad", "facts", "_least0", "none", "cell"]
    df = spark.createDataFrame([("d", 0, *map(float, range(6))), ("d", 1, *map(float, range(1, 7)))], "dataset string, row_id long, " + ", ".join(f"`{n}` double" for n in names))
    for kind, want in (("rescale_to_0_1", 1.0), ("log1p", math.log(2)), ("none", 1.0)):
        got, status = transform.transform_wide(df, names, kind)
        assert got.columns == df.columns and rows(status)[0][:2] == ("d", "ok")
        assert {r["row_id"]: r["a.1"] for r in got.collect()}[1] == pytest.approx(want)
    assert matrix.numeric_only(df, ("dataset", "a.1")).columns == ["dataset", "a.1", "row_id", "bad", "facts", "_least0", "none", "cell"]
    assert matrix.to_long(df, names).count() == 12
    ordered = quasi.ordered(quasi.with_total(df, names).withColumnRenamed("a.1", "_at").withColumnRenamed("none", "_part"))
    assert [r["tau_pos"] for r in ordered.orderBy("tau").collect()] == [0, 1]


def test_order_over_many_ranges(spark):
    rng = np.random.default_rng(2)
    data = [(["a", "b", "c", None][int(k)], i, float(v), 0.0) for i, (k, v) in enumerate(zip(rng.integers(0, 4, 500), rng.integers(0, 20, 500), strict=True))]
    got = [(r["dataset"], r["tau"], r["row_id"], r["tau_pos"]) for r in quasi.ordered(quasi.with_total(wide(spark, data).repartition(7), ["x", "y"])).collect()]
    assert len(got) == 500
    for name in ("a", "b", "c", None):
        own = sorted((t, i, p) for x, t, i, p in got if x == name)
        assert own and [p for _, _, p in own] == list(range(len(own)))


def test_shown_series(spark):
    long = matrix.to_long(wide(spark, [("a", 0, 1.0, 2.0), ("a", 1, 1.0, None)]), ["x", "y"])
    assert rows(matrix.shown_series(long, 1)) == [("a", 2, 1, True)] and rows(matrix.shown_series(long, 2)) == [("a", 2, 2, False)]


def test_unfiltered_fit_by_both_paths(spark):
    p = pts(spark, [("down", TAU, 3 - TAU), ("root", TAU, 2 * TAU**0.5), ("gap", TAU, [None, *TAU[1:]]), ("low", TAU - 1, TAU)])
    a, b = ({r["series"]: r for r in fit.fit_unfiltered(p, large=n).collect()} for n in (10**6, 0))
    assert {k: r["status"] for k, r in a.items()} == {k: r["status"] for k, r in b.items()} == {"down": "ok", "root": "ok", "gap": "fit_failed", "low": "unsupported_domain"}
    for k in ("down", "root"):
        assert b[k]["a"] == pytest.approx(a[k]["a"], rel=1e-8) and b[k]["b"] == pytest.approx(a[k]["b"], rel=1e-8)


def test_fit_without_convergence_is_recorded(spark, monkeypatch):
    monkeypatch.setattr(fit, "STEPS", 1)
    p = pts(spark, [("noisy", TAU, 3 * TAU**0.7 * np.exp(np.random.default_rng(5).normal(0, 0.4, 20)))])
    for report in (fit.fit_report(p, large=0), fit.fit_unfiltered(p, large=0)):
        assert report.first()["status"] == "fit_failed" and report.first()["a"] is None


def test_unknown_transform(spark):
    with pytest.raises(ValueError):
        transform.transform_wide(wide(spark, [("a", 0, 1.0, 1.0)]), ["x"], "cube root")


def test_totals_and_order(spark):
    df = wide(spark, [("a", 0, None, None), ("a", 1, INF, -INF), ("a", 2, 2.0, -3.0), ("a", 3, 1.0, float("nan")), ("a", 4, 0.0, 1.0)])
    got = {r["row_id"]: (r["tau"], r["tau_pos"]) for r in quasi.ordered(quasi.with_total(df, ["x", "y"])).collect()}
    assert got[0] == (0.0, 1) and got[2] == (-1.0, 0) and got[3] == (1.0, 2) and got[4] == (1.0, 3)
    assert math.isnan(got[1][0]) and got[1][1] == 4
    long = {r["row_id"]: r["tau"] for r in quasi.long_totals(matrix.to_long(df, ["x", "y"])).collect()}
    assert long[0] == 0.0 and long[2] == -1.0 and long[3] == 1.0 and math.isnan(long[1])
    assert [r["row_id"] for r in quasi.first_in_order(quasi.with_total(df, ["x", "y"]), 2).orderBy("tau_pos").collect()] == [2, 0]


def test_totals_of_many_columns(spark):
    names = [f"c{i}" for i in range(80)]
    df = spark.createDataFrame([("a", 0, *map(float, range(80)))], "dataset string, row_id long, " + ", ".join(f"{n} double" for n in names))
    assert quasi.with_total(df, names).first()["tau"] == sum(range(80))


def test_transpose_twice_is_identity_and_slices(spark):
    long = matrix.to_long(wide(spark, [("a", i, float(i), i * 2.0) for i in range(4)]), ["x", "y"]).withColumn("row_label", F.concat(F.lit("r"), "row_id"))
    once = matrix.transpose(long)
    assert matrix.shape(once).first()[1:] == (2, 4)
    assert {r["series"] for r in once.collect()} == {"r0", "r1", "r2", "r3"}
    twice = matrix.transpose(once).select("dataset", "row_id", "row_label", "series_pos", "series", "value")
    assert sorted(rows(twice)) == sorted(rows(long.select(*twice.columns)))
    assert matrix.first_cells(long, 2, 1).count() == 2
    assert matrix.to_wide(long, ["x", "y"]).count() == 4
    assert {r["series"] for r in matrix.first_series(long, 1).collect()} == {"x"}


def pts(spark, series):
    data = [("d", i, name, float(x), None if y is None else float(y)) for i, (name, xs, ys) in enumerate(series) for x, y in zip(xs, ys, strict=True)]
    return spark.createDataFrame(data, "dataset string, series_pos int, series string, tau double, value double")


TAU = np.arange(1.0, 21.0)


def test_exact_recovery_and_both_paths(spark):
    big = TAU * 5e4
    noisy = 3 * TAU**0.7 * np.exp(np.random.default_rng(5).normal(0, 0.4, 20))
    p = pts(spark, [("root", TAU, 2 * TAU**0.5), ("steep", TAU, 0.3 * TAU**1.7), ("falling", TAU, 5 / TAU), ("large", big, 2 * big**1.2), ("noisy", TAU, noisy)])
    a = {r["series"]: r for r in fit.fit_report(p).collect()}
    b = {r["series"]: r for r in fit.fit_report(p, large=0).collect()}
    for name, (x, y) in {"root": (2, 0.5), "steep": (0.3, 1.7), "falling": (5, -1), "large": (2, 1.2)}.items():
        assert a[name]["status"] == "ok" and a[name]["a"] == pytest.approx(x, rel=1e-7) and a[name]["b"] == pytest.approx(y, rel=1e-7)
    for name, r in a.items():
        assert b[name]["status"] == "ok" and b[name]["a"] == pytest.approx(r["a"], rel=1e-8) and b[name]["b"] == pytest.approx(r["b"], rel=1e-8)


def test_scaling_and_gradient():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.lognormal(1, 1, 30)
        y = 2 * x ** rng.normal(0.5, 0.5) * rng.lognormal(0, 0.3, 30)
        status, a, b = fit.solve(x, y)
        assert status == "ok"
        r = y - a * x**b
        assert abs((r * x**b).sum()) < 1e-6 * (y * x**b).sum() and abs((r * x**b * np.log(x)).sum()) < 1e-5 * np.abs(y * x**b * np.log(x)).sum()
        _, a2, b2 = fit.solve(3 * x, 5 * y)
        assert b2 == pytest.approx(b, rel=1e-5, abs=1e-7) and a2 == pytest.approx(5 * a * 3**-b, rel=1e-5)
        order = rng.permutation(30)
        assert fit.solve(x[order], y[order])[2] == pytest.approx(b, rel=1e-6, abs=1e-8)


def test_report_of_what_cannot_be_fitted(spark):
    p = pts(
        spark,
        [
            ("few", TAU[:4], [1, 2, -1, None]),
            ("three", TAU[:4], [1, 2, 3, 0]),
            ("negative", TAU[:4], [-1, -2, -3, -4]),
            ("equal", [2, 2, 2, 2], [1, 2, 3, 4]),
            ("odd", [1, 2, 3, -4, INF, float("nan")], [1, INF, 3, 4, 5, 6]),
        ],
    )
    got = {r["series"]: r for r in fit.fit_report(p).collect()}
    assert [got[s]["status"] for s in ("few", "three", "negative", "equal", "odd")] == ["too_few_points", "ok", "too_few_points", "degenerate", "too_few_points"]
    assert all(r["total_points"] == r["removed_points"] + r["used_points"] for r in got.values())
    assert got["odd"]["used_points"] == 2 and got["few"]["total_points"] == 4
    assert fit.fit_report(p.where("series = 'equal'"), large=0).first()["status"] == "degenerate"
    report = fit.fit_report(p.where("series = 'negative'"))
    assert fit.params(report).count() == 0 and fit.skipped(report).count() == 1
    assert fit.unfitted_datasets(report).first()["status"] == "no_fittable_column"


def test_unfiltered_fit(spark):
    p = pts(spark, [("fine", TAU, 2 * TAU**0.5), ("signs", TAU, np.where(TAU > 3, TAU, -1.0)), ("missing", TAU[:3], [1, None, 3]), ("low", [0, 1, 2], [1, 2, 3])])
    got = {r["series"]: r for r in fit.fit_unfiltered(p).collect()}
    assert got["fine"]["status"] == "ok" and got["signs"]["status"] == "ok"
    assert got["missing"]["status"] == "fit_failed" and got["low"]["status"] == "unsupported_domain"


@pytest.mark.parametrize("n", [1, 2, 5])
def test_nodes(spark, n):
    got = [r["tau"] for r in curve.nodes(spark.createDataFrame([("d", n, 1.0, 9.0)], "dataset string, n long, low double, high double")).orderBy("node_pos").collect()]
    assert got == pytest.approx(sorted(5 + 4 * math.cos((2 * i + 1) * math.pi / (2 * n)) for i in range(n)))
    assert got == sorted(got) and all(1 < x < 9 for x in got) and got[0] + got[-1] == pytest.approx(10)


def test_bounds_and_curves(spark):
    samples = spark.createDataFrame([("d", t) for t in (-3.0, 0.0, 2.0, 8.0, float("nan"))], "dataset string, tau double")
    assert rows(curve.bounds(samples)) == [("d", 5, 2.0, 8.0)]
    assert rows(curve.bounds(samples, positive_only=False)) == [("d", 5, -3.0, 8.0)]
    fitted = spark.createDataFrame([("d", 0, "x", 2.0, 0.5)], "dataset string, series_pos int, series string, a double, b double")
    got = curve.sample(curve.nodes(curve.bounds(samples)), fitted).collect()
    assert len(got) == 5 and all(r["y"] == pytest.approx(2 * r["tau"] ** 0.5) for r in got)


def test_point_tables(spark):
    p = pts(spark, [("x", [1, -1, INF, float("nan")], [1, 1, 2, 3]), ("none", [1, 2], [-1, 0])])
    assert points.in_log_space(p).count() == 2
    assert [r["series"] for r in points.not_in_log_space(p).collect()] == ["none"]
    fitted = spark.createDataFrame([("d", 0, "x", 1.0, 1.0)], "dataset string, series_pos int, series string, a double, b double")
    drawn = spark.createDataFrame([("d", 0, 1.5, 0, "x", 1.5)], "dataset string, node_pos long, tau double, series_pos int, series string, y double")
    got = points.overlay(p, drawn, fitted)
    assert sorted(r["kind"] for r in got.collect()) == ["fitted", "observed", "observed"]


def test_power_edges(spark):
    got = spark.range(1).select(S.power(F.lit(0.0), F.lit(1.0), F.lit(-1.0)), S.power(F.lit(-1.0), F.lit(1.0), F.lit(0.5))).first()
    assert got[0] == INF and math.isnan(got[1])


def test_empty_tables(spark):
    empty = wide(spark, [])
    for kind in transform.KINDS:
        good, status = transform.transform_wide(empty, ["x", "y"], kind)
        assert good.count() == 0 and status.count() == 0
    report, _ = jobs.fit_wide(empty, ["x", "y"])
    assert report.count() == 0 and jobs.curves_wide(empty, ["x", "y"], report).count() == 0


def test_columns_called_as_keys(spark):
    """tau, dataset and row_id as value columns, through every step of the wide form."""
    names = ["tau", "dataset", "row_id", "own"]
    df = spark.createDataFrame([("d", float(i), i * 2.0, i * 3.0, 1.0) for i in range(1, 30)], "name string, " + ", ".join(f"{n} double" for n in names))
    got = jobs.points_of_wide(df, names, key="name").collect()
    assert {(r["series"], r["tau"], r["value"]) for r in got if r["series"] in ("tau", "own")} == {(n, 6.0 * i + 1, v) for i in range(1, 30) for n, v in (("tau", float(i)), ("own", 1.0))}
    report, status = jobs.fit_wide(df, names, key="name")
    assert [r["dataset"] for r in report.collect()] == ["d"] * 4 and status.first()["dataset"] == "d"
    curves = jobs.curves_wide(df, names, report, key="name").collect()
    assert len(curves) == 4 * 29 and {r["series"] for r in curves} == set(names)
    with pytest.raises(ValueError, match="tau"):
        quasi.with_total(df, names)
    assert "total" in quasi.ordered(quasi.with_total(df.drop("dataset").withColumnRenamed("name", "dataset"), ["tau"], "total"), "total").columns
    for kind in ("rescale_to_0_1", "log1p"):
        good, status = transform.transform_wide(df, names, kind, key="name")
        assert good.columns == df.columns and status.columns == ["dataset", "status", "reason"] and good.count() == 29


def test_totals_of_both_forms_are_equal_to_the_last_bit(spark):
    rng = np.random.default_rng(3)
    data = [("a", i, *[None if rng.random() < 0.1 else float(v) for v in rng.normal(size=9) * 10.0 ** rng.integers(-9, 9, 9)]) for i in range(300)]
    names = [f"c{i}" for i in range(9)]
    df = spark.createDataFrame(data, "dataset string, row_id long, " + ", ".join(f"{n} double" for n in names))
    want = {r["row_id"]: r["tau"] for r in quasi.with_total(df, names).collect()}
    for n in (1, 3, 7):
        long = matrix.to_long(df, names).repartition(n, "value")
        assert {r["row_id"]: r["tau"] for r in quasi.long_totals(long).collect()} == want


def test_facts_of_many_columns_equal_point_stats(spark, monkeypatch):
    df = wide(spark, [("a", i, float(i), None if i % 3 else -1.0) for i in range(20)] + [("b", i, INF, float(i)) for i in range(5)])
    want = sorted(rows(fit.point_stats(jobs.points_of_wide(df, ["x", "y"]))))
    assert sorted(rows(jobs.stats_of_facts(jobs.facts_of_wide(df, ["x", "y"]), ["x", "y"]))) == want
    first = sorted(map(str, rows(jobs.fit_wide(df, ["x", "y"])[0])))
    monkeypatch.setattr(jobs, "FUSED", 1)
    assert sorted(map(str, rows(jobs.fit_wide(df, ["x", "y"])[0]))) == first


def test_large_fits_take_three_passes(spark, monkeypatch):
    """Noisy series of many shapes: moments lead to where exact sums have nothing left to do."""
    rng, passes = np.random.default_rng(9), []
    plain = fit.exact_sums
    monkeypatch.setattr(fit, "exact_sums", lambda *a: passes.append(1) or plain(*a))
    shapes = {f"s{i}": (b, noise, low) for i, (b, noise, low) in enumerate([(0.7, 0.4, 0.0), (-1.2, 0.3, -3.0), (2.5, 0.2, 2.0), (0.0, 1.0, 0.0), (4.0, 0.5, -2.0)])}
    p = pts(spark, [(n, x, 3 * x**b * np.exp(rng.normal(0, noise, 400))) for n, (b, noise, low) in shapes.items() for x in [np.exp(rng.uniform(low, low + 4, 400))]])
    a, b = ({r["series"]: r for r in fit.fit_report(p, large=n).collect()} for n in (10**6, 0))
    for name in shapes:
        assert a[name]["status"] == b[name]["status"] == "ok" and b[name]["b"] == pytest.approx(a[name]["b"], rel=1e-8, abs=1e-8) and b[name]["a"] == pytest.approx(a[name]["a"], rel=1e-7)
    assert len(passes) == 1
    monkeypatch.setattr(fit, "by_moments", lambda pdf, steps: pdf[fit.SERIES].assign(trial=1.0))
    c = {r["series"]: r for r in fit.fit_report(p.where("series in ('s0', 's3')"), large=0).collect()}
    assert len(passes) > 3 and all(c[n]["b"] == pytest.approx(a[n]["b"], rel=1e-7, abs=1e-7) for n in c)


def test_curves_of_a_large_grid_are_spread_over_tasks(spark):
    """No grid is broadcast, and no task spreads it alone, though the table it comes from has one row."""
    facts = written(spark.createDataFrame([("d", 400_000, 1.0, 9.0)], "dataset string, n long, low double, high double"), "facts")
    report = written(spark.createDataFrame([("d", i, c, "ok", 2.0, 0.5 + i) for i, c in enumerate("xy")], "dataset string, series_pos int, series string, status string, a double, b double"), "report")
    got = jobs.curves_wide(facts, [], report, facts=facts)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and plan.index("least(") < plan.index("Join")
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 800_000 and max(r["count"] for r in tasks) <= 200_000
    assert got.groupBy("series").agg(F.countDistinct("node_pos").alias("n"), F.max(F.abs(F.col("y") - 2 * F.pow("tau", 0.5 + F.col("series_pos")))).alias("off")).where("n <> 400000 or off > 1e-9").count() == 0
    ends = got.where("series = 'x' and node_pos in (0, 65535, 65536, 399999)").orderBy("node_pos").collect()
    assert [r["tau"] for r in ends] == pytest.approx([5 - 4 * math.cos((2 * i + 1) * math.pi / 800_000) for i in (0, 65535, 65536, 399999)])


def test_large_fits_of_wide_rows_write_no_points(spark, monkeypatch):
    """Missing, negative and infinite cells, a dataset of one total, datasets that aren't texts, a small series among large ones."""
    rng, made = np.random.default_rng(11), []
    plain = fit.written
    monkeypatch.setattr(fit, "written", lambda df, what: made.append(what) or plain(df, what))
    odd = [None, -1.0, float("nan"), 0.0]
    data = [(d, i, float(np.exp(rng.normal(d, 1))), odd[i % 4] if i % 7 == 0 else float(np.exp(rng.normal(0, 0.5))), float(i + 1) if i < 5 else None) for d in (1, 2) for i in range(300)]
    data += [(2, 301, INF, 1.0, None)] + [(3, i, 2.0, 3.0, None) for i in range(20)]
    df = spark.createDataFrame(data, "dataset long, row_id long, tau double, y double, v0 double")
    names = ["tau", "y", "v0"]
    want = {(r["dataset"], r["series"]): r for r in jobs.fit_wide(df, names)[0].collect()}
    assert want[3, "y"]["status"] == "degenerate" and want[1, "v0"]["used_points"] == 5
    for large in (0, 10):
        made.clear()
        got = {(r["dataset"], r["series"]): r for r in jobs.fit_wide(df, names, large=large)[0].collect()}
        assert "points" not in made and made.count("fit") == 2 and set(got) == set(want)
        for k, r in want.items():
            assert got[k]["status"] == r["status"] and (got[k]["b"], got[k]["a"]) == ((None, None) if r["b"] is None else pytest.approx((r["b"], r["a"]), rel=1e-7, abs=1e-8)), k
    monkeypatch.setattr(fit, "by_moments", lambda pdf, steps: pdf[fit.SERIES].assign(trial=1.0))
    got = {(r["dataset"], r["series"]): r["b"] for r in jobs.fit_wide(df, names, large=10)[0].collect()}
    assert got[1, "y"] == pytest.approx(want[1, "y"]["b"], rel=1e-6) and got[2, "tau"] == pytest.approx(want[2, "tau"]["b"], rel=1e-6)
