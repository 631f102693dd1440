"""Registered queries over the star-schema tables read as matrices, and their SQL.

line: lineitem by return flag and status; evt: events by day, user and event type; emb:
embeddings by label; cust: customers by segment; part: parts by brand. Computed doubles
are rounded to 6 decimals on both sides, as sums are reordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allotau.functions import scalar as S
from allotau.operators import curve, fit, matrix, points, quasi, transform
from allotau.plans import jobs
from allotau.sources.csv_matrices import numeric_cells, read_matrices
from allotau.sources.tables import scratch, write_csv, write_lines, written

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART = ["p_size", "p_retailprice"]
EVENTS = ["cart", "click", "error", "purchase", "view"]
PREVIEW, PLOTS, FIRST = 10, 6, 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def digits(c: str) -> Column:
    """Six significant digits, as text."""
    return F.format_string("%.5e", F.col(c))


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("dataset"), *LINE)


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("row_id"), *PART)


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells where a user had no event of a type that day."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("dataset"), F.col("user_id").alias("row_id"), "event_type", "value")
    return rows.groupBy("dataset", "row_id").pivot("event_type", EVENTS).agg(F.sum("value"))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("dataset"), F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("series_pos", "value"))
    return rows.select("dataset", "row_id", F.lit(None).cast("string").alias("row_label"), "series_pos", F.concat(F.lit("d"), "series_pos").alias("series"), F.col("value").cast("double").alias("value"))


def numeric_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.numeric_only(table(spark, sf_dir, "part"))


def transform_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    values = matrix.numeric_columns(rows)
    good, _ = transform.transform_wide(rows.withColumn("dataset", F.lit("part")), values, "none")
    return good.drop("dataset")


def minmax_0_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = transform.transform_wide(part(spark, sf_dir), PART, "rescale_to_0_1")
    return good.select("dataset", "row_id", *[r6(c).alias(c) for c in PART])


def data_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 rows of every brand, rescaled (the limit is the feature)."""
    good, _ = transform.transform_wide(part(spark, sf_dir), PART, "rescale_to_0_1")
    return matrix.first_rows(good, "row_id", PREVIEW).select("dataset", "row_pos", "row_id", *[r6(c).alias(c) for c in PART])


def minmax_neg1_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = transform.transform_wide(evt(spark, sf_dir), EVENTS, "rescale_to_-1_1")
    return good.select("dataset", "row_id", *[r6(c).alias(c) for c in EVENTS])


def minmax_constant_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = transform.transform_wide(part(spark, sf_dir).withColumn("same", F.lit(7)), [*PART, "same"], "rescale_to_-1_1")
    return good.select("dataset", "row_id", *[r6(c).alias(c) for c in [*PART, "same"]])


def minmax_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = transform.transform_long(emb(spark, sf_dir), "rescale_to_0_1")
    return good.select("dataset", "row_id", "series_pos", r6("value").alias("value"))


def log1p_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = transform.transform_wide(part(spark, sf_dir), PART, "log1p")
    return good.select("dataset", "row_id", *[r6(c).alias(c) for c in PART])


def log1p_dataset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("dataset"), F.col("c_custkey").alias("row_id"), "c_acctbal")
    return transform.transform_wide(rows, ["c_acctbal"], "log1p")[1].select("dataset", "status")


def log1p_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in blocks of ten: the blocks without a balance below -1, which go on while the others fail."""
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 10).cast("string").alias("dataset"), F.col("c_custkey").alias("row_id"), "c_acctbal")
    good, _ = transform.transform_wide(rows, ["c_acctbal"], "log1p")
    return good.select("dataset", "row_id", r6("c_acctbal").alias("c_acctbal"))


def row_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quasi.with_total(evt(spark, sf_dir), EVENTS).select("dataset", "row_id", r6("tau").alias("tau"))


def quasi_dynamic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quasi.with_total(evt(spark, sf_dir), EVENTS).withColumn("tau", r6("tau"))
    return quasi.ordered(rows.select("dataset", "row_id", "tau")).select("dataset", "row_id", "tau", "tau_pos")


def quasi_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quasi.long_totals(emb(spark, sf_dir)).withColumn("tau", r6("tau"))
    return quasi.first_in_order(rows, PREVIEW).select("dataset", "row_id", "tau", "tau_pos")


def transpose_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.transpose(emb(spark, sf_dir)).select("dataset", "row_id", "row_label", "series_pos", "series", r6("value").alias("value"))


def slice_n_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 rows by vec_id of every label, and 10 columns (the limits are the feature)."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("dataset"), F.col("vec_id").alias("row_id"), "embedding")
    long = matrix.first_rows(rows, "row_id", 100).select("dataset", "row_id", F.posexplode("embedding").alias("series_pos", "value"))
    return matrix.first_cells(long, None, 10).select("dataset", "row_id", "series_pos", r6(F.col("value").cast("double")).alias("value"))


def shown_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of its 64 series each label shows when 6 are drawn, and that some are left out."""
    return matrix.shown_series(emb(spark, sf_dir), PLOTS)


def first_series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the first 6 of the series of every label (the limit is the feature)."""
    got = points.quasi_scatter(matrix.first_series(emb_points(spark, sf_dir), PLOTS))
    return got.select("dataset", "series_pos", "series", r6("tau").alias("tau"), r6("value").alias("value"))


def csv_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts written as CSV files and read again, p_partkey as label column; every file is a dataset."""
    path = scratch(spark, "csv")
    write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", *PART), path)
    long, _ = read_matrices(spark, path, label_column=True)
    return long.select("row_label", "series_pos", "series", r6("value").alias("value"))


def csv_stray_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as CSV lines whose labels have stray marks, text behind a closing mark, doubled marks, or line breaks in quotes."""
    kinds = ['5" pipe %d', '"a"b %d', '"say ""%d"", please"', '"two\n\nlines of %d"']
    label = F.element_at(F.array(*[F.format_string(k, F.col("p_partkey")) for k in kinds]), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.concat_ws(",", label, *[F.col(c).cast("string") for c in PART]).alias("line"))
    path = scratch(spark, "csv")
    write_lines(rows, "line", "id," + ",".join(PART), path)
    long, _ = read_matrices(spark, path, label_column=True)
    return long.select("row_label", "series_pos", "series", r6("value").alias("value"))


def csv_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as five CSV files, by p_partkey % 5, of which the first 30 rows are read (the limit is the feature); behind those p_size holds texts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 5).alias("file"), "p_partkey", *PART)
    place = Window.partitionBy("file").orderBy("p_partkey")
    size = F.when(F.row_number().over(place) > FIRST, "late").otherwise(F.col("p_size").cast("string"))
    lines = parts.select(F.concat_ws(",", "id", size, F.col("p_retailprice").cast("string")).alias("line"), "file", "p_partkey")
    path = scratch(spark, "csv")
    for i in range(5):
        write_lines(lines.where(F.col("file") == i).coalesce(1).sortWithinPartitions("p_partkey"), "line", "id," + ",".join(PART), f"{path}/{i}")
    long, _ = read_matrices(spark, [f"{path}/{i}" for i in range(5)], label_column=True, rows=FIRST)
    return long.select("row_label", "row_id", "series_pos", "series", r6("value").alias("value"))


def columns_of_any_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the parts with value columns called tau and dataset, against their row total."""
    wide = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("tau"), F.col("p_retailprice").alias("dataset"))
    good, _ = transform.transform_wide(wide, ["tau", "dataset"], "log1p", key="brand")
    got = jobs.points_of_wide(good, ["tau", "dataset"], key="brand")
    return got.select("dataset", "series_pos", "series", r6("tau").alias("tau"), r6("value").alias("value"))


def no_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, whose documents have texts only, beside labels, which have numbers: status rows of the former."""

    def cells(rows: DataFrame, dataset: Column, columns: list[str]) -> DataFrame:
        raw = F.array(*[F.struct(F.lit(i).alias("series_pos"), F.lit(c).alias("series"), F.col(c).cast("string").alias("raw")) for i, c in enumerate(columns)])
        long = rows.select(dataset.alias("dataset"), F.col("doc_id").alias("row_id"), F.lit(None).cast("string").alias("row_label"), F.explode(raw).alias("c"))
        return long.select("dataset", "row_id", "row_label", "c.series_pos", "c.series", "c.raw")

    every = cells(table(spark, sf_dir, "documents"), F.col("source"), ["lang"]).unionByName(cells(table(spark, sf_dir, "labels"), F.lit("labels"), ["quality", "toxic"]))
    return matrix.without_numbers(every, numeric_cells(every)).select("dataset", "status")


def dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.shape(emb(spark, sf_dir))


def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.scatter(matrix.to_long(part(spark, sf_dir), PART)).select("dataset", "series_pos", "series", "row_id", r6("value").alias("value"))


def quasi_scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = points.quasi_scatter(jobs.points_of_wide(evt(spark, sf_dir), EVENTS))
    return got.select("dataset", "series_pos", "series", r6("tau").alias("tau"), r6("value").alias("value"))


def emb_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.points_of_long(emb(spark, sf_dir))


def loglog_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = points.in_log_space(emb_points(spark, sf_dir))
    return got.select("dataset", "series_pos", "series", *[r6(c).alias(c) for c in ("tau", "value", "log_tau", "log_value")])


def loglog_skipped_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals with their sign turned, so that few points of a series have both coordinates positive."""
    turned = emb_points(spark, sf_dir).withColumn("tau", -F.abs("tau") * (F.col("series_pos") % 2 - F.lit(0.5)))
    return points.not_in_log_space(turned)


def fit_point_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.point_stats(emb_points(spark, sf_dir).withColumn("tau", r6("tau")))


def rounded_params(fitted: DataFrame) -> DataFrame:
    return fitted.select("dataset", "series_pos", "series", digits("a").alias("a"), r6("b").alias("b"))


def fit_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = jobs.fit_wide(line(spark, sf_dir), LINE)
    return rounded_params(fit.params(report))


def fit_large_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = jobs.fit_wide(line(spark, sf_dir), LINE, large=0)
    return rounded_params(fit.params(report))


def fit_params_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = jobs.fit_wide(part(spark, sf_dir), PART, "log1p")
    return rounded_params(fit.params(report))


def fit_skip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of fewer than 60 valid points."""
    report, _ = jobs.fit_wide(evt(spark, sf_dir), EVENTS, min_points=60)
    return fit.skipped(report).where("status = 'too_few_points'").select("dataset", "series_pos", "series", "status", "reason")


def fit_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fit.fit_unfiltered(jobs.points_of_wide(part(spark, sf_dir), PART))
    return got.select("dataset", "series_pos", "series", "status", digits("a").alias("a"), r6("b").alias("b"))


def fit_unfiltered_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and event types whose unfiltered fit fails for a missing cell, or has a total that isn't positive."""
    got = fit.fit_unfiltered(jobs.points_of_wide(evt(spark, sf_dir), EVENTS))
    return got.where("status in ('fit_failed', 'unsupported_domain')").select("dataset", "series_pos", "series", "status")


def power_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quasi.with_total(line(spark, sf_dir), LINE)
    return rows.select("dataset", F.col("tau").alias("x"), r6(S.power(F.col("tau"), F.lit(0.5), F.lit(0.25))).alias("y")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("y"), 5).alias("least"), F.round(F.max("y"), 5).alias("most"), F.round(F.sum("y"), 2).alias("total"))


def power_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve at every total of the parts, row by row."""
    return quasi.with_total(part(spark, sf_dir), PART).select("dataset", "row_id", r6(S.power(F.col("tau"), F.lit(0.5), F.lit(-0.25))).alias("y"))


def chebyshev_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = curve.nodes(curve.bounds(quasi.long_totals(emb(spark, sf_dir))))
    return grid.select("dataset", "node_pos", r6("tau").alias("tau"))


def curve_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = line(spark, sf_dir)
    facts = jobs.facts_of_wide(wide, LINE)
    return jobs.curves_wide(wide, LINE, jobs.fit_wide(wide, LINE, facts=facts)[0], facts=facts).select("dataset", "node_pos", F.round("tau", 4).alias("tau"), "series_pos", "series", F.round("y", 3).alias("y"))


def fit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and curves of the first 6 fitted series of every dataset (the limit is the feature)."""
    wide = line(spark, sf_dir)
    facts = jobs.facts_of_wide(wide, LINE)
    report = written(jobs.fit_wide(wide, LINE, facts=facts)[0], "report")  # a row a series, read by the curves and by the points
    report = written(matrix.first_series(fit.params(report).withColumn("status", F.lit("ok")), PLOTS), "shown")
    got = points.overlay(jobs.points_of_wide(wide, LINE), jobs.curves_wide(wide, LINE, report, facts=facts), fit.params(report))
    return got.select("dataset", "series_pos", "series", "kind", F.round("tau", 4).alias("tau"), F.round("y", 3).alias("y"))


def curve_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = part(spark, sf_dir)
    got = jobs.curves_unfiltered(quasi.with_total(wide, PART).select("dataset", "tau"), jobs.points_of_wide(wide, PART))
    return got.select("dataset", "node_pos", F.round("tau", 4).alias("tau"), "series_pos", "series", F.round("y", 3).alias("y"))


def dataset_status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of which no series has 60 valid points."""
    report, _ = jobs.fit_wide(evt(spark, sf_dir), EVENTS, min_points=60)
    return fit.unfitted_datasets(report).select("dataset", "status")


QUERIES = {f.__name__: f for f in (
    numeric_projection, transform_none, data_preview, minmax_0_1, minmax_neg1_1, minmax_constant_column, minmax_long, log1p_transform, log1p_dataset_status,
    row_total, quasi_dynamic_order, quasi_preview, transpose_long, slice_n_p, dataset_shape, scatter_points, quasi_scatter_points, loglog_points, loglog_skipped_series,
    csv_matrices, csv_stray_quotes, csv_first_rows, columns_of_any_name, no_numeric_columns, shown_series, first_series_points, log1p_survivors, fit_unfiltered_failures, power_points,
    fit_point_stats, fit_params, fit_large_path, fit_params_log1p, fit_skip_report, fit_unfiltered, power_eval, chebyshev_nodes, curve_sample,
    fit_overlay, curve_unfiltered, dataset_status_report,
)}

# The SQL of the queries, from shared parts.

_PART = "part_m AS (SELECT p_brand AS dataset, p_partkey AS row_id, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part)"
_LINE = "line_m AS (SELECT l_returnflag || l_linestatus AS dataset, l_quantity, l_extendedprice, l_discount, l_tax, l_quantity + l_extendedprice + l_discount + l_tax AS tau FROM lineitem)"
_EVT = "evt_m AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dataset, user_id AS row_id, " + ", ".join(f"sum(value) FILTER (event_type = '{e}') AS {e}" for e in EVENTS) + " FROM events GROUP BY ALL)"
_EVT_TAU = "evt_t AS (SELECT *, " + " + ".join(f"coalesce({e}, 0)" for e in EVENTS) + " AS tau FROM evt_m)"
_EMB = "emb_m AS (SELECT CAST(label AS VARCHAR) AS dataset, vec_id AS row_id, CAST(i - 1 AS INTEGER) AS series_pos, 'd' || CAST(i - 1 AS VARCHAR) AS series, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"
_EMB_TAU = "emb_t AS (SELECT dataset, row_id, sum(coalesce(value, 0)) AS tau FROM emb_m GROUP BY ALL)"
_EMB_POINTS = "emb_p AS (SELECT dataset, series_pos, series, row_id, tau, value FROM emb_m JOIN emb_t USING (dataset, row_id))"


def _unpivot(source: str, columns: list[str], tau: str = "tau") -> str:
    return " UNION ALL ".join(f"SELECT dataset, {i} AS series_pos, '{c}' AS series, {tau} AS tau, {c} AS value FROM {source}" for i, c in enumerate(columns))


def _fit(points_sql: str, name: str = "fitted", valid: str = "tau > 0 AND value > 0", least: int = 3) -> str:
    """Gauss-Newton from b = 1 over lists, as common table expressions."""
    keys = "dataset, series_pos, series"
    return f"""
pts AS ({points_sql}),
lists AS (
  SELECT {keys}, list(ln(tau) - m ORDER BY tau, value) AS l, list(value ORDER BY tau, value) AS y, any_value(m) AS m
  FROM (SELECT *, avg(ln(tau)) OVER (PARTITION BY {keys}) AS m FROM pts WHERE {valid}) GROUP BY {keys} HAVING count(*) >= {least}
),
steps AS (
  SELECT {keys}, 0 AS i, CAST(1 AS DOUBLE) AS b FROM lists
  UNION ALL
  SELECT {keys}, i + 1, b + (szz * (syzl - syz / szz * szl) - szl * (syz - syz / szz * szz)) / (szz * szll - szl * szl) / (syz / szz)
  FROM (
    SELECT {keys}, i, b, list_inner_product(z, z) AS szz, list_inner_product(z, zl) AS szl, list_inner_product(zl, zl) AS szll,
           list_inner_product(y, z) AS syz, list_inner_product(y, zl) AS syzl
    FROM (SELECT {keys}, i, b, y, list_transform(l, lambda v: exp(b * v)) AS z, list_transform(l, lambda v: v * exp(b * v)) AS zl FROM steps JOIN lists USING ({keys}) WHERE i < 40)
  )
),
{name} AS (
  SELECT {keys}, list_inner_product(y, z) / list_inner_product(z, z) * exp(-b * m) AS a, b
  FROM (SELECT {keys}, b, m, y, list_transform(l, lambda v: exp(b * v)) AS z FROM steps JOIN lists USING ({keys}) WHERE i = 40)
)"""


def _scaled(c: str, low: int, high: int, source: str = "") -> str:
    least, most = f"min({c}) OVER (PARTITION BY dataset{source})", f"max({c}) OVER (PARTITION BY dataset{source})"
    return f"round(CASE WHEN {c} IS NULL THEN NULL WHEN {most} = {least} THEN {low} ELSE {c} * ({high - low}.0 / nullif({most} - {least}, 0)) + ({low} - {least} * ({high - low}.0 / nullif({most} - {least}, 0))) END, 6) + 0.0 AS {'value' if source else c}"


_NODES = "{name} AS (SELECT dataset, CAST(n - 1 - i AS BIGINT) AS node_pos, 0.5 * (low + high) + 0.5 * (high - low) * cos((2 * i + 1) * pi() / (2 * n)) AS tau FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT dataset, count(*) AS n, min(tau){where} AS low, max(tau){where} AS high FROM {source} GROUP BY dataset)))"
_POSITIVE = " FILTER (tau > 0)"
_LINE_FIT = f"WITH RECURSIVE {_LINE}, {_fit(_unpivot('line_m', LINE))}"
_LINE_CURVE = _LINE_FIT + ", " + _NODES.format(name="nodes", source="line_m", where=_POSITIVE)
_PARAMS = "SELECT dataset, CAST(series_pos AS INTEGER) AS series_pos, series, format('{:.5e}', a) AS a, round(b, 6) + 0.0 AS b FROM fitted"
_PART_PTS = _unpivot("part_m", PART, "p_size + p_retailprice")

ORACLE_SQL = {
    "numeric_projection": "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part",
    "transform_none": "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part",
    "minmax_0_1": f"WITH {_PART} SELECT dataset, row_id, {', '.join(_scaled(c, 0, 1) for c in PART)} FROM part_m",
    "data_preview": f"WITH {_PART}, scaled AS (SELECT dataset, row_id, {', '.join(_scaled(c, 0, 1) for c in PART)} FROM part_m) SELECT * FROM (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY row_id) - 1 AS row_pos, row_id, {', '.join(PART)} FROM scaled) WHERE row_pos < {PREVIEW}",
    "quasi_scatter_points": f"WITH {_EVT}, {_EVT_TAU}, pts AS ({_unpivot('evt_t', EVENTS)}) SELECT dataset, CAST(series_pos AS INTEGER) AS series_pos, series, round(tau, 6) + 0.0 AS tau, round(value, 6) + 0.0 AS value FROM pts",
    "minmax_neg1_1": f"WITH {_EVT} SELECT dataset, row_id, {', '.join(_scaled(c, -1, 1) for c in EVENTS)} FROM evt_m",
    "minmax_constant_column": f"WITH {_PART} SELECT dataset, row_id, {', '.join(_scaled(c, -1, 1) for c in PART)}, CAST(-1 AS DOUBLE) AS same FROM part_m",
    "minmax_long": f"WITH {_EMB} SELECT dataset, row_id, series_pos, {_scaled('value', 0, 1, ', series_pos')} FROM emb_m",
    "log1p_transform": f"WITH {_PART} SELECT dataset, row_id, {', '.join(f'round(ln(1 + {c}), 6) AS {c}' for c in PART)} FROM part_m",
    "log1p_dataset_status": "SELECT c_mktsegment AS dataset, CASE WHEN bool_or(c_acctbal < -1) THEN 'log1p_domain' ELSE 'ok' END AS status FROM customer GROUP BY 1",
    "row_total": f"WITH {_EVT}, {_EVT_TAU} SELECT dataset, row_id, round(tau, 6) + 0.0 AS tau FROM evt_t",
    "quasi_dynamic_order": f"WITH {_EVT}, {_EVT_TAU} SELECT dataset, row_id, round(tau, 6) + 0.0 AS tau, row_number() OVER (PARTITION BY dataset ORDER BY round(tau, 6), row_id) - 1 AS tau_pos FROM evt_t",
    "quasi_preview": f"WITH {_EMB}, {_EMB_TAU} SELECT * FROM (SELECT dataset, row_id, round(tau, 6) + 0.0 AS tau, row_number() OVER (PARTITION BY dataset ORDER BY round(tau, 6), row_id) - 1 AS tau_pos FROM emb_t) WHERE tau_pos < {PREVIEW}",
    "transpose_long": f"WITH {_EMB} SELECT dataset, CAST(series_pos AS BIGINT) AS row_id, series AS row_label, CAST(row_id AS INTEGER) AS series_pos, CAST(row_id AS VARCHAR) AS series, round(value, 6) + 0.0 AS value FROM emb_m",
    "slice_n_p": f"WITH {_EMB} SELECT dataset, row_id, series_pos, round(value, 6) + 0.0 AS value FROM emb_m WHERE series_pos < 10 QUALIFY rank() OVER (PARTITION BY dataset, series_pos ORDER BY row_id) <= 100",
    "shown_series": f"SELECT CAST(label AS VARCHAR) AS dataset, max(len(embedding)) AS n_series, least(max(len(embedding)), {PLOTS}) AS n_shown, max(len(embedding)) > {PLOTS} AS truncated FROM embeddings GROUP BY 1",
    "first_series_points": f"WITH {_EMB}, {_EMB_TAU}, {_EMB_POINTS} SELECT dataset, series_pos, series, round(tau, 6) + 0.0 AS tau, round(value, 6) + 0.0 AS value FROM emb_p WHERE series_pos < {PLOTS}",
    "csv_matrices": " UNION ALL ".join(f"SELECT CAST(p_partkey AS VARCHAR) AS row_label, {i + 1} AS series_pos, '{c}' AS series, round(CAST({c} AS DOUBLE), 6) AS value FROM part" for i, c in enumerate(PART)),
    "csv_stray_quotes": " UNION ALL ".join(f"SELECT CASE p_partkey % 4 WHEN 0 THEN '5\" pipe ' || p_partkey WHEN 1 THEN 'ab ' || p_partkey WHEN 2 THEN 'say \"' || p_partkey || '\", please' ELSE 'two' || chr(10) || chr(10) || 'lines of ' || p_partkey END AS row_label, {i} AS series_pos, '{c}' AS series, round(CAST({c} AS DOUBLE), 6) AS value FROM part" for i, c in enumerate(PART)),
    "csv_first_rows": "WITH p AS (SELECT *, rank() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) AS place FROM part) " + " UNION ALL ".join(f"SELECT CAST(p_partkey AS VARCHAR) AS row_label, place - 1 AS row_id, {i} AS series_pos, '{c}' AS series, round(CAST({c} AS DOUBLE), 6) AS value FROM p WHERE place - 1 < {FIRST}" for i, c in enumerate(PART)),
    "columns_of_any_name": f"WITH {_PART}, s AS (SELECT dataset, ln(1 + p_size) AS x, ln(1 + p_retailprice) AS y FROM part_m) SELECT dataset, 0 AS series_pos, 'tau' AS series, round(x + y, 6) + 0.0 AS tau, round(x, 6) + 0.0 AS value FROM s UNION ALL SELECT dataset, 1, 'dataset', round(x + y, 6) + 0.0, round(y, 6) + 0.0 FROM s",
    "no_numeric_columns": "SELECT source AS dataset, 'no_numeric_columns' AS status FROM documents GROUP BY source HAVING count(lang) > 0",
    "log1p_survivors": "WITH b AS (SELECT CAST(c_custkey // 10 AS VARCHAR) AS dataset, c_custkey AS row_id, c_acctbal, min(c_acctbal) OVER (PARTITION BY c_custkey // 10) < -1 AS bad FROM customer) SELECT dataset, row_id, round(ln(1 + c_acctbal), 6) + 0.0 AS c_acctbal FROM b WHERE NOT bad",
    "fit_unfiltered_failures": f"WITH {_EVT}, {_EVT_TAU}, pts AS ({_unpivot('evt_t', EVENTS)}), s AS (SELECT dataset, CAST(series_pos AS INTEGER) AS series_pos, series, CASE WHEN bool_or(value IS NULL) OR count(*) < 2 THEN 'fit_failed' WHEN min(tau) <= 0 THEN 'unsupported_domain' END AS status FROM pts GROUP BY ALL) SELECT * FROM s WHERE status IS NOT NULL",
    "power_points": f"WITH {_PART} SELECT dataset, row_id, round(0.5 * pow(p_size + p_retailprice, -0.25), 6) AS y FROM part_m",
    "dataset_shape": "SELECT CAST(label AS VARCHAR) AS dataset, count(*) AS n_rows, max(len(embedding)) AS n_columns FROM embeddings GROUP BY 1",
    "scatter_points": f"WITH {_PART} " + " UNION ALL ".join(f"SELECT dataset, {i} AS series_pos, '{c}' AS series, row_id, round({c}, 6) AS value FROM part_m" for i, c in enumerate(PART)),
    "loglog_points": f"WITH {_EMB}, {_EMB_TAU}, {_EMB_POINTS} SELECT dataset, series_pos, series, round(tau, 6) AS tau, round(value, 6) AS value, round(ln(tau), 6) + 0.0 AS log_tau, round(ln(value), 6) + 0.0 AS log_value FROM emb_p WHERE tau > 0 AND value > 0",
    "loglog_skipped_series": f"WITH {_EMB}, {_EMB_TAU}, {_EMB_POINTS} SELECT dataset, series_pos, series, 'no_positive_pair' AS status FROM (SELECT *, -abs(tau) * (series_pos % 2 - 0.5) AS t FROM emb_p) GROUP BY ALL HAVING NOT bool_or(t > 0 AND value > 0)",
    "fit_point_stats": f"WITH {_EMB}, {_EMB_TAU}, {_EMB_POINTS} SELECT dataset, series_pos, series, count(*) AS total_points, count(*) FILTER (NOT (round(tau, 6) > 0 AND value > 0)) AS removed_points, count(*) FILTER (round(tau, 6) > 0 AND value > 0) AS used_points FROM emb_p GROUP BY ALL",
    "fit_params": f"{_LINE_FIT} {_PARAMS}",
    "fit_large_path": f"{_LINE_FIT} {_PARAMS}",
    "fit_params_log1p": f"WITH RECURSIVE {_PART}, part_l AS (SELECT dataset, ln(1 + p_size) AS p_size, ln(1 + p_retailprice) AS p_retailprice FROM part_m), {_fit(_unpivot('part_l', PART, 'p_size + p_retailprice'))} {_PARAMS}",
    "fit_skip_report": f"WITH {_EVT}, {_EVT_TAU}, pts AS ({_unpivot('evt_t', EVENTS)}) SELECT dataset, CAST(series_pos AS INTEGER) AS series_pos, series, 'too_few_points' AS status, 'fewer than 60 valid points: ' || CAST(count(*) FILTER (tau > 0 AND value > 0) AS VARCHAR) AS reason FROM pts GROUP BY dataset, series_pos, series HAVING count(*) FILTER (tau > 0 AND value > 0) < 60",
    "fit_unfiltered": f"WITH RECURSIVE {_PART}, {_fit(_PART_PTS, valid='true', least=2)} SELECT dataset, CAST(series_pos AS INTEGER) AS series_pos, series, 'ok' AS status, format('{{:.5e}}', a) AS a, round(b, 6) + 0.0 AS b FROM fitted",
    "power_eval": f"WITH {_LINE} SELECT dataset, count(*) AS n, round(min(y), 5) AS least, round(max(y), 5) AS most, round(sum(y), 2) AS total FROM (SELECT dataset, round(0.5 * pow(tau, 0.25), 6) AS y FROM line_m) GROUP BY dataset",
    "chebyshev_nodes": f"WITH {_EMB}, {_EMB_TAU}, {_NODES.format(name='nodes', source='emb_t', where=_POSITIVE)} SELECT dataset, node_pos, round(tau, 6) + 0.0 AS tau FROM nodes",
    "curve_sample": f"{_LINE_CURVE} SELECT dataset, node_pos, round(tau, 4) AS tau, CAST(series_pos AS INTEGER) AS series_pos, series, round(a * pow(tau, b), 3) AS y FROM nodes JOIN fitted USING (dataset)",
    "fit_overlay": f"{_LINE_CURVE} SELECT dataset, CAST(series_pos AS INTEGER) AS series_pos, series, 'observed' AS kind, round(tau, 4) AS tau, round(value, 3) AS y FROM pts SEMI JOIN fitted USING (dataset, series_pos) WHERE tau > 0 AND value > 0 UNION ALL SELECT dataset, CAST(series_pos AS INTEGER), series, 'fitted', round(tau, 4), round(a * pow(tau, b), 3) FROM nodes JOIN fitted USING (dataset)",
    "curve_unfiltered": f"WITH RECURSIVE {_PART}, part_t AS (SELECT dataset, p_size + p_retailprice AS tau FROM part_m), {_fit(_PART_PTS, valid='true', least=2)}, {_NODES.format(name='nodes', source='part_t', where='')} SELECT dataset, node_pos, round(tau, 4) AS tau, CAST(series_pos AS INTEGER) AS series_pos, series, round(a * pow(tau, b), 3) AS y FROM nodes JOIN fitted USING (dataset)",
    "dataset_status_report": f"WITH {_EVT}, {_EVT_TAU}, pts AS ({_unpivot('evt_t', EVENTS)}), n AS (SELECT dataset, series_pos, count(*) FILTER (tau > 0 AND value > 0) AS used FROM pts GROUP BY ALL) SELECT dataset, 'no_fittable_column' AS status FROM n GROUP BY dataset HAVING max(used) < 60",
}
