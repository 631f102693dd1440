"""CSV files of unlike headers as one long matrix.

Files are read as lines, so each keeps its own header and types, and large files are split
wherever the blocks end. A line may begin outside of quotes or within them, and is a
function from that state to the state behind it; these functions compose, so each block
is read once for what it makes of both states and how many records it then holds, the
blocks of a file are put together in order, and a second reading of the lines knows where
each record begins. Only records that go over a block's end are shuffled. Line states and
fields are found in Arrow batches: the quoting rule needs a state that column functions
don't have, and files may have thousands of columns.

A quotation mark opens quotes only at the beginning of a field; elsewhere it is a
character. Within quotes two of them are one; after the closing one the rest of the field
is plain (`"a"b` is ab). A line break in quotes comes out as one line feed. Blank lines
outside of quotes don't count.

With a number of rows, only so much of each file is read as holds them.

A file that can't be read as a matrix has a status row, and the others their results: one
without a header, with more fields in a record than in the header, with bytes that aren't
UTF-8, with quotes that don't close, or with a record of over RECORD_MOST bytes.

A column is numeric if every field of it, in the rows that are kept, is missing or a
number; an all-missing column is numeric; booleans and other texts aren't. What isn't a
number is gathered as one bit set a task and file, so no cell is shuffled. Repeated header
names become a, a.1, a.2, passing over names that the header has itself; empty ones
`Unnamed: k`.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allotau.operators.matrix import first_cells, transpose
from allotau.sources.tables import copy_beginning, scratch, written

#: Texts that mean a missing cell; fixed values.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
RECORD_MOST = 1 << 26
#: Blocks, and bytes of headers, that are broadcast; with more, they are joined.
FEW_BLOCKS, SMALL_HEADERS = 100_000, 1 << 25
#: Bytes of a file's beginning that are tried first for a number of rows, and the most of them; beyond, the file is read whole.
PREFIX, PREFIX_MOST = 1 << 16, 1 << 26


def within_quotes(line: bytes, quoted: bool) -> bool:
    """Whether a line that begins within quotes, or outside, ends within quotes."""
    if b'"' not in line:
        return quoted
    i = 0
    while True:
        if not quoted and line[i : i + 1] == b'"':
            quoted, i = True, i + 1
        if quoted:
            i = line.find(b'"', i)
            while i >= 0 and line[i + 1 : i + 2] == b'"':
                i = line.find(b'"', i + 2)
            if i < 0:
                return True
            quoted = False
        i = line.find(b",", i) + 1
        if not i:
            return False


def fields_of(record: bytes) -> tuple[list[str] | None, str | None]:
    """Fields of a record, or what is wrong with it."""
    try:
        text = record.decode()
    except UnicodeDecodeError:
        return None, "not UTF-8"
    return next(csv.reader([text]), [""]) if '"' in text else text.split(","), None


def unique_names(names: list[str]) -> list[str]:
    """a, a, a -> a, a.1, a.2; a.1 is passed over if the header has it."""
    filled = [name if name.strip() else f"Unnamed: {i}" for i, name in enumerate(names)]
    taken, seen, count, out = set(filled), set(), {}, []
    for name in filled:
        new = name
        if name in seen:
            k = count.get(name, 1)
            while (new := f"{name}.{k}") in taken:
                k += 1
            count[name] = k + 1
            taken.add(new)
        seen.add(name)
        out.append(new)
    return out


def named(field: str) -> Column:
    """A name of the file that a row is from, without its percent signs for spaces and others."""
    return F.url_decode(F.replace(F.col(f"_metadata.{field}"), F.lit("+"), F.lit("%2B")))


def files_of(spark: SparkSession, paths: list[str] | str) -> list[str]:
    """Every file, as the listing has it; empty ones too."""
    return [unquote(p) for p in spark.read.text(paths).inputFiles()]


def name_of(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def lines_of(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """dataset, block, line (bytes), in order within a block."""
    return spark.read.text(paths).select(named("file_name").alias("dataset"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[bytes]]]:
    """(values of the keys, some lines) in order; the same keys may come again."""
    for batch in batches:
        lines = batch.column("line").to_pylist()
        columns = [batch.column(k).to_pylist() for k in keys]
        a = 0
        for b in range(1, len(lines) + 1):
            if b == len(lines) or any(c[b] != c[a] for c in columns):
                yield tuple(c[a] for c in columns), lines[a:b]
                a = b


def is_blank(line: bytes) -> bool:
    return not line.strip(b" \t\r")


def block_facts(lines: DataFrame) -> DataFrame:
    """dataset, block, and of a beginning outside of quotes and within: the state behind it (quoted_0, quoted_1), the records that begin (n_0, n_1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n, out = None, [False, True], [0, 0], []
        for new, lines in runs(batches, ["dataset", "block"]):
            if new != key:
                if key is not None:
                    out.append((*key, *state, *n))
                key, state, n = new, [False, True], [0, 0]
            for line in lines:
                for s in (0, 1):
                    if not state[s]:
                        if is_blank(line):
                            continue
                        n[s] += 1
                    state[s] = within_quotes(line, state[s])
        if key is not None:
            out.append((*key, *state, *n))
            types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["dataset", "block", "quoted_0", "quoted_1", "n_0", "n_1"])

    return lines.select("dataset", "block", "line").mapInArrow(run, "dataset string, block long, quoted_0 boolean, quoted_1 boolean, n_0 long, n_1 long")


#: How a block begins (within quotes, records before it), and of its file whether quotes stay open and how many records there are.
STARTS = "dataset string, block long, quoted boolean, first long, last_quoted boolean, n_records long"


def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one file, a row each -> STARTS."""
    pdf = pdf.sort_values("block", ignore_index=True)
    quoted, n, out = False, 0, []
    for r in pdf.itertuples():
        out.append((quoted, n))
        quoted, n = (r.quoted_1, n + r.n_1) if quoted else (r.quoted_0, n + r.n_0)
    return pdf[["dataset", "block"]].assign(quoted=[q for q, _ in out], first=[f for _, f in out], last_quoted=quoted, n_records=n)


def block_starts(lines: DataFrame) -> DataFrame:
    """STARTS of every block, which is a row for so many bytes of input, not for a line."""
    return block_facts(lines).groupBy("dataset").applyInPandas(put_together, STARTS)


def with_starts(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """lines with quoted and first of their block, in order within a block."""
    starts = starts.select("dataset", "block", "quoted", "first")
    if starts.count() <= FEW_BLOCKS:
        return lines.join(F.broadcast(starts), ["dataset", "block"])
    placed = lines.withColumn("at", F.monotonically_increasing_id()).join(starts, ["dataset", "block"])
    return placed.repartition("dataset", "block").sortWithinPartitions("dataset", "block", "at")


RECORD = "dataset string, record_no long, block long, fields array<string>, piece binary, error string"


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["dataset", "record_no", "block", "fields", "piece", "error"])


def records_of_blocks(lines: DataFrame) -> DataFrame:
    """Lines with starts -> RECORD: a record that is whole within its block has fields or an error, others are pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        key, quoted, n, held, size, begun, out = None, False, 0, [], 0, False, []

        def finished(whole: bool) -> tuple:
            dataset, block, _, _ = key
            fields = piece = error = None
            if size > RECORD_MOST:
                error = f"a record of over {RECORD_MOST} bytes"
            elif whole:
                fields, error = fields_of(b"\n".join(held))
            else:
                piece = b"\n".join(held)
            return dataset, n - 1, block, fields, piece, error

        for new, some in runs(batches, ["dataset", "block", "quoted", "first"]):
            if new != key:
                if held:
                    out.append(finished(False))
                key, quoted, n, held, size = new, new[2], new[3], [], 0
                begun = False  # what comes first in a block that begins within quotes is a piece
            for line in some:
                line = line.removesuffix(b"\r")
                if not quoted:
                    if is_blank(line):
                        continue
                    n, begun = n + 1, True
                size += len(line) + 1
                if size <= RECORD_MOST or not held:
                    held.append(line)
                quoted = within_quotes(line, quoted)
                if not quoted:
                    out.append(finished(begun))
                    held, size, begun = [], 0, False
            if len(out) >= 2000:
                yield record_batch(out)
                out = []
        if held:
            out.append(finished(False))
        if out:
            yield record_batch(out)

    return lines.select("dataset", "block", "quoted", "first", "line").mapInArrow(run, RECORD)


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces of records -> RECORD without pieces. Records that are too long aren't put together."""
    sizes = pieces.groupBy("dataset", "record_no").agg((F.sum(F.length("piece")) > RECORD_MOST).alias("long"))
    sized = pieces.join(sizes, ["dataset", "record_no"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"])
    whole = sized.where("not long").groupBy("dataset", "record_no").agg(parts.alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            rows = []
            for dataset, n, some in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fields, error = fields_of(b"\n".join(some))
                rows.append((dataset, n, 0, fields, None, error))
            if rows:
                yield record_batch(rows)

    nothing = [F.lit(0).cast("long").alias("block"), F.lit(None).cast("array<string>").alias("fields"), F.lit(None).cast("binary").alias("piece")]
    far = sized.where("long").select("dataset", "record_no", *nothing, F.lit(f"a record of over {RECORD_MOST} bytes").alias("error"))
    return written(whole.mapInArrow(run, RECORD).unionByName(far.dropDuplicates(["dataset", "record_no"])), "records")


def beginnings(spark: SparkSession, files: list[str], rows: int) -> list[str]:
    """Copies of the files' beginnings that hold a header and `rows` records.

    A beginning is copied anew, each time longer, until it holds a record more than is
    asked for, or is the file; so what is read depends on the rows, not on the size of the
    files. Compressed files, and those whose beginning would be too long, are read whole.
    """
    chosen, open_, base, size = {}, files, scratch(spark, "beginnings"), PREFIX
    while open_ and size <= PREFIX_MOST:
        with ThreadPoolExecutor(16) as pool:
            copies = dict(zip(open_, pool.map(lambda path: copy_beginning(spark, path, f"{base}/{size}", size) or path, open_), strict=True))
        chosen |= {path: path for path, copy in copies.items() if copy == path}
        tried = {name_of(path): path for path, copy in copies.items() if copy != path}
        if tried:
            enough = block_starts(lines_of(spark, [copies[path] for path in tried.values()])).where(F.col("n_records") >= rows + 2).select("dataset").distinct().collect()
            chosen |= {tried[r["dataset"]]: copies[tried[r["dataset"]]] for r in enough}
        open_ = [path for path in open_ if path not in chosen]
        size *= 8
    return [chosen.get(path, path) for path in files]


def read_records(spark: SparkSession, paths: list[str] | str, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(dataset, record_no, fields, error; dataset, last_quoted, n_records of every file). Two files of one name are an error."""
    files = files_of(spark, paths)
    names = sorted(map(name_of, files))
    twice = [a for a, b in zip(names, names[1:], strict=False) if a == b]
    if twice:
        raise ValueError(f"two files are named {twice[0]}")
    lines = lines_of(spark, paths if rows is None else beginnings(spark, files, rows))
    starts = written(block_starts(lines), "blocks")
    records = records_of_blocks(with_starts(lines, starts))
    if rows is not None:
        records = records.where(F.col("record_no") <= rows)
    records = written(records, "records")
    pieces, whole = records.where("piece is not null"), records.where("piece is null")
    if pieces.limit(1).count():
        whole = whole.unionByName(joined_pieces(pieces))
    ends = starts.select("dataset", "last_quoted", "n_records").distinct()
    return whole.select("dataset", "record_no", "fields", "error"), spark.createDataFrame([(n,) for n in names], "dataset string").join(ends, "dataset", "left")


def not_numbers(records: DataFrame) -> DataFrame:
    """Records -> dataset, bits: a bit set of the fields' places that hold something else than numbers, a row a task and dataset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("fields")
            cells = lists.flatten()
            cells = pc.ascii_trim_whitespace(cells)
            bad = pc.invert(pc.or_(pc.is_in(cells, pa.array(MISSING)), pc.match_substring_regex(cells, NUMBER)))
            at = np.flatnonzero(bad.fill_null(False).to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            row = np.searchsorted(ends, at, side="right")
            place, names = at - (ends - n)[row], batch.column("dataset").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)[row]
            for k in np.unique(code):
                dataset, places = names.dictionary[int(k)].as_py(), np.unique(place[code == k])
                bits = found.get(dataset, np.zeros(0, bool))
                if len(bits) <= places[-1]:
                    bits = np.concatenate([bits, np.zeros(max(places[-1] + 1, 2 * len(bits)) - len(bits), bool)])
                bits[places] = True
                found[dataset] = bits
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in found.values()], pa.binary())], names=["dataset", "bits"])

    return records.where("fields is not null").select("dataset", "fields").mapInArrow(run, "dataset string, bits binary")


def either(bits: Iterator[bytes]) -> bytes:
    out = b""
    for b in bits:
        n = max(len(out), len(b))
        out = (int.from_bytes(out, "little") | int.from_bytes(b, "little")).to_bytes(n, "little")
    return out


def columns_of(headers: DataFrame, bits: DataFrame, first: int, all_or_none: bool) -> DataFrame:
    """dataset, columns (at, series_pos, series of the numeric ones; `first` leading fields aren't columns) of each header (dataset, fields)."""

    def run(key: tuple, heads: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        out = []
        other = np.unpackbits(np.frombuffer(either(sets["bits"]), np.uint8), bitorder="little")
        for names in heads["fields"]:
            numeric = [i >= len(other) or not other[i] for i in range(len(names))]
            if all_or_none and not all(numeric[first:]):
                numeric = [False] * len(names)
            named = [(i, i - first, name) for i, name in enumerate(unique_names(list(names))) if i >= first and numeric[i]]
            out.append((key[0], [a for a, _, _ in named], [p for _, p, _ in named], [s for _, _, s in named]))
        return pd.DataFrame(out, columns=["dataset", "ats", "places", "names"])

    got = headers.groupBy("dataset").cogroup(bits.groupBy("dataset")).applyInPandas(run, "dataset string, ats array<int>, places array<int>, names array<string>")
    return got.select("dataset", F.transform(F.arrays_zip("ats", "places", "names"), lambda c: F.struct(c["ats"].alias("at"), c["places"].alias("series_pos"), c["names"].alias("series"))).alias("columns"))


def statuses(records: DataFrame, files: DataFrame, rows: int | None) -> DataFrame:
    """dataset, status (ok or unreadable), reason of every file."""
    width = F.when(F.col("record_no") > 0, F.struct(F.size("fields").alias("n"), (-F.col("record_no")).alias("at")))
    facts = records.groupBy("dataset").agg(
        F.max(F.when(F.col("record_no") == 0, F.size("fields"))).alias("header"), F.max(F.when(F.col("fields").isNotNull(), width)).alias("widest"), F.min(F.when(F.col("error").isNotNull(), F.struct("record_no", "error"))).alias("wrong")
    )
    open_ = F.col("last_quoted") if rows is None else F.col("last_quoted") & (F.col("n_records") <= rows + 1)
    reason = (
        F.when(F.col("wrong").isNotNull(), F.concat(F.lit("record "), F.col("wrong.record_no"), F.lit(": "), F.col("wrong.error")))
        .when(F.col("header").isNull(), F.lit("no header"))
        .when(F.coalesce(open_, F.lit(False)), F.concat(F.lit("record "), F.col("n_records") - 1, F.lit(": quotes don't close")))
        .when(F.col("widest.n") > F.col("header"), F.concat(F.lit("record "), -F.col("widest.at"), F.lit(": "), F.col("widest.n"), F.lit(" fields, the header has "), F.col("header")))
    )
    every = files.join(facts, "dataset", "left").withColumn("reason", reason)
    return every.select("dataset", F.when(F.col("reason").isNull(), "ok").otherwise("unreadable").alias("status"), "reason")


def small(df: DataFrame, size: Column, most: int) -> bool:
    return (df.agg(F.sum(size)).first()[0] or 0) <= most


def number(raw: Column) -> Column:
    """A text that NUMBER matches as a double; missing tokens are null."""
    bare = F.trim(raw, F.lit(" \t\n\x0b\x0c\r"))
    value = F.regexp_replace(bare, "(?i)^([+-]?)inf(inity)?$", "$1Infinity")
    return F.when(~bare.isin(*MISSING), value).cast("double")


def numeric_cells(cells: DataFrame, all_or_none: bool = False) -> DataFrame:
    """cells (dataset, row_id, row_label, series_pos, series, raw) -> the long matrix of the numeric columns; all_or_none: of datasets that have no other."""
    is_number = F.coalesce(F.col("raw").rlike(NUMBER) | F.trim("raw").isin(*MISSING), F.lit(True))
    kinds = cells.groupBy("dataset", "series_pos").agg(F.min(is_number).alias("numeric"))
    if all_or_none:
        kinds = kinds.withColumn("numeric", F.min("numeric").over(Window.partitionBy("dataset")))
    long = cells.join(kinds.where("numeric").select("dataset", "series_pos"), ["dataset", "series_pos"], "left_semi")
    return long.select("dataset", "row_id", "row_label", "series_pos", "series", number(F.col("raw")).alias("value"))


def read_matrices(
    spark: SparkSession, paths: list[str] | str, label_column: bool = False, transposed: bool = False, rows: int | None = None, columns: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(long matrix of the numeric columns of the readable files; dataset, status, reason of every file).

    Rows are cut before types are told, but after a transpose; a transposed file with any
    column that isn't numeric has no numeric column.
    """
    most = None if transposed else rows
    records, files = read_records(spark, paths, most)
    status = written(statuses(records, files, most), "status")
    data = records.where("record_no > 0 and fields is not null")
    # only readable files have headers, and only they are joined
    first, headers = int(label_column), records.where("record_no = 0").join(status.where("status = 'ok'").select("dataset"), "dataset", "left_semi")
    heads = written(columns_of(headers.select("dataset", "fields"), not_numbers(data), first, transposed), "headers")
    if small(heads, F.aggregate("columns", F.lit(8), lambda n, c: n + F.length(c["series"]) + 16), SMALL_HEADERS):
        heads = F.broadcast(heads)
    label = F.get("fields", F.lit(0)) if label_column else F.lit(None).cast("string")
    cells = data.join(heads, "dataset").select("dataset", (F.col("record_no") - 1).alias("row_id"), label.alias("row_label"), F.explode(F.transform("columns", lambda c: F.struct(c["series_pos"].alias("series_pos"), c["series"].alias("series"), F.get("fields", c["at"]).alias("raw")))).alias("c"))
    long = cells.select("dataset", "row_id", "row_label", "c.series_pos", "c.series", number(F.col("c.raw")).alias("value"))
    return first_cells(transpose(long), rows, columns) if transposed else first_cells(long, None, columns), status
