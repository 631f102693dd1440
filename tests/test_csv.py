import io
import math
import os
import random

import pandas as pd
import pytest
from conftest import rows

from allotau.operators import matrix
from allotau.plans import jobs
from allotau.sources import csv_matrices as C
from allotau.sources import tables
from allotau.sources.csv_matrices import read_matrices, unique_names


def files(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return [f"{tmp_path}/{n}.csv" for n in texts]


def cells(long):
    return {(r["dataset"], r["row_id"], r["series"]): r["value"] for r in long.collect()}


def test_unlike_headers_and_repeated_names(spark, tmp_path):
    long, datasets = read_matrices(spark, files(tmp_path, one="a,a,b\n1,2,x\n3,4,y\n", two='id,"b, c"\nq,5\n\nr,"6"\n'))
    assert cells(long) == {("one.csv", 0, "a"): 1, ("one.csv", 0, "a.1"): 2, ("one.csv", 1, "a"): 3, ("one.csv", 1, "a.1"): 4, ("two.csv", 0, "b, c"): 5, ("two.csv", 1, "b, c"): 6}
    assert datasets.count() == 2


def test_missing_tokens_infinity_and_empty_columns(spark, tmp_path):
    long, _ = read_matrices(spark, files(tmp_path, t="a,b,c,d,e\n1,NA,,True,1d\nnan,inf,,False,2\n,-Infinity,N/A,True,3\n4\n"))
    got = cells(long)
    assert {k[2] for k in got} == {"a", "b", "c"}
    assert got["t.csv", 0, "a"] == 1 and got["t.csv", 1, "a"] is None and got["t.csv", 3, "a"] == 4 and got["t.csv", 3, "b"] is None
    assert got["t.csv", 1, "b"] == math.inf and got["t.csv", 2, "b"] == -math.inf and got["t.csv", 0, "c"] is None


def test_labels_slices_and_types_of_the_slice(spark, tmp_path):
    paths = files(tmp_path, s="id,a,b\nr0,1,2\nr1,3,4\nr2,oops,6\n")
    long, _ = read_matrices(spark, paths, label_column=True, rows=2, columns=1)
    assert cells(long) == {("s.csv", 0, "a"): 1, ("s.csv", 1, "a"): 3}
    assert {r["row_label"] for r in long.collect()} == {"r0", "r1"}
    assert {r["series"] for r in read_matrices(spark, paths, label_column=True)[0].collect()} == {"b"}


def test_transpose(spark, tmp_path):
    paths = files(tmp_path, n="id,a,b\nr0,1,2\nr1,3,4\n", m="a,b\n1,x\n2,y\n")
    long, _ = read_matrices(spark, paths[:1], label_column=True, transposed=True)
    assert cells(long) == {("n.csv", 0, "r0"): 1, ("n.csv", 1, "r0"): 2, ("n.csv", 0, "r1"): 3, ("n.csv", 1, "r1"): 4}
    mixed, datasets = read_matrices(spark, paths[1:], transposed=True)
    assert mixed.count() == 0 and rows(matrix.without_numbers(datasets, mixed))[0][:2] == ("m.csv", "no_numeric_columns")


def test_two_files_of_one_name(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "y").mkdir()
    with pytest.raises(ValueError):
        read_matrices(spark, files(tmp_path / "x", a="a\n1\n") + files(tmp_path / "y", a="a\n2\n"))


def test_line_breaks_in_quotes(spark, tmp_path):
    text = 'id,"two\nlines",b\nr0,1,2\n"r\n\n1",3,4\n\n"say ""hi"", then\r\nleave",5,6\nr3,7,"8"\n'
    paths = files(tmp_path, q=text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "10"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = read_matrices(spark, paths, label_column=True)[0].collect()
        assert {(r["row_id"], r["row_label"], r["series"]): r["value"] for r in got} == {
            (0, "r0", "two\nlines"): 1, (0, "r0", "b"): 2, (1, "r\n\n1", "two\nlines"): 3, (1, "r\n\n1", "b"): 4,
            (2, 'say "hi", then\nleave', "two\nlines"): 5, (2, 'say "hi", then\nleave', "b"): 6, (3, "r3", "two\nlines"): 7, (3, "r3", "b"): 8,
        }
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_wide_file_of_quoted_fields(spark, tmp_path):
    n = 20_000
    paths = files(tmp_path, w="\n".join(",".join(f'"{x}{i}"' for i in range(n)) for x in ("c", "", "1")) + "\n")
    long, _ = read_matrices(spark, paths)
    assert long.count() == 2 * n and long.where("row_id = 0 and value <> series_pos").count() == 0


def test_names_are_unique():
    assert unique_names(["a", "a.1", "a"]) == ["a", "a.1", "a.2"]
    assert unique_names(["a", "a", "", "a", "a.1", "a.1"]) == ["a", "a.2", "Unnamed: 2", "a.3", "a.1", "a.1.1"]
    many = unique_names(["x"] * 5000 + ["x.7"])
    assert len(set(many)) == 5001


def test_long_file_keeps_its_order(spark, tmp_path):
    paths = files(tmp_path, big="a,b\n" + "".join(f"{i},{i * 2}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        long, _ = read_matrices(spark, paths)
        assert long.where("series = 'a' and value <> row_id").count() == 0 and long.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_job_from_files_to_result(spark, tmp_path):
    paths = files(tmp_path, p="x,y\n" + "".join(f"{i},{3 * i}\n" for i in range(1, 30)), q="t\nhello\n")
    for job in ("fit", "curve", "quasi"):
        jobs.main([job, f"{tmp_path}/out", *paths])
        assert spark.read.parquet(f"{tmp_path}/out/{job}").count() == {"fit": 2, "curve": 58, "quasi": 58}[job]
        status = {r["dataset"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/out/status").collect()}
        assert status == {"p.csv": "ok", "q.csv": "no_numeric_columns"}


@pytest.fixture
def cut_small(spark):
    """Blocks of a few bytes."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "23")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("few", [True, False])
def test_quotes_as_pandas_reads_them(spark, tmp_path, monkeypatch, cut_small, few):
    """Stray marks, text behind a closing mark, doubled marks and line breaks, with blocks cut anywhere."""
    if not few:
        monkeypatch.setattr(C, "FEW_BLOCKS", 0)
    rng = random.Random(8)
    texts = {f"f{i}": "h\n" + "".join(rng.choices('a1,"\n ', [3, 2, 3, 4, 2, 1], k=rng.randrange(10, 70))) + "\n" for i in range(14)}
    texts |= {"pipe": 'id,a\n5" pipe,3\n"a"b,4\n"a"b"c",5\nx"",6\n', "breaks": 'id,a\n"x\n\n, ""y""\nz",1\nw"\n"\n'}
    records, ends = C.read_records(spark, files(tmp_path, **texts))
    got = {}
    for r in records.orderBy("dataset", "record_no").collect():
        got.setdefault(r["dataset"], []).append(r["fields"])
    open_ = {r["dataset"]: r["last_quoted"] for r in ends.collect()}
    compared = 0
    for name, text in texts.items():
        try:
            want = pd.read_csv(io.StringIO(text), header=None, names=range(80), dtype=str, keep_default_na=False, engine="c", index_col=False)
        except pd.errors.ParserError as e:
            assert "EOF inside string" in str(e) and open_[f"{name}.csv"]
            continue
        compared += 1
        assert not open_[f"{name}.csv"]
        bare = lambda row: "|".join(row).rstrip("|")  # noqa: E731  pandas fills short records up
        assert [bare(r) for r in got[f"{name}.csv"]] == [bare(r) for r in want.itertuples(index=False)], text
    assert compared > 5


def test_a_broken_file_is_a_status_row(spark, tmp_path):
    good = "x,y\n" + "".join(f"{i},{3 * i}\n" for i in range(1, 30))
    paths = files(tmp_path, good=good, ragged="a,b\n1,2\n3,4,5\n6,7\n", open='a,b\n1,"2\n3,4\n', empty="", blank="\n \n", head="a,b\n")
    (tmp_path / "bytes.csv").write_bytes(b"a,b\n1,\xff\xfe\n")
    for name, made in (("long file.csv", b"a\n" + b"x" * 2000 + b"\n"),):
        (tmp_path / name).write_bytes(made)
    every = [*paths, f"{tmp_path}/bytes.csv", f"{tmp_path}/long file.csv"]
    long, status = read_matrices(spark, every)
    got = {r["dataset"]: (r["status"], r["reason"]) for r in status.collect()}
    assert {k for k, (s, _) in got.items() if s == "ok"} == {"good.csv", "head.csv", "long file.csv"}
    assert got["ragged.csv"][1] == "record 2: 3 fields, the header has 2" and got["open.csv"][1] == "record 1: quotes don't close"
    assert got["bytes.csv"][1] == "record 1: not UTF-8" and got["empty.csv"][1] == got["blank.csv"][1] == "no header"
    assert {r["dataset"] for r in long.select("dataset").distinct().collect()} == {"good.csv"}
    cut, status = read_matrices(spark, every, rows=1)
    assert {r["dataset"]: r["status"] for r in status.collect()}["ragged.csv"] == "ok"
    jobs.main(["fit", f"{tmp_path}/out", *every])
    status = {r["dataset"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/out/status").collect()}
    assert status["good.csv"] == "ok" and status["ragged.csv"] == "unreadable" and status["long file.csv"] == "no_numeric_columns"
    assert spark.read.parquet(f"{tmp_path}/out/fit").count() == 2


def test_a_record_without_end_is_not_held(spark, tmp_path, monkeypatch):
    """RECORD_MOST bounds what is put together of pieces, too."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    monkeypatch.setattr(C, "RECORD_MOST", 200)
    long, status = read_matrices(spark, files(tmp_path, open='a,b\n1,"2\n' + "3,4\n" * 300, fine="a\n1\n"))
    got = {r["dataset"]: r["reason"] for r in status.collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got["fine.csv"] is None and "a record of over 200 bytes" in got["open.csv"] and long.count() == 1


def test_what_is_read_for_some_rows_is_flat(spark, tmp_path, monkeypatch):
    """The beginning of a file is enough, whatever its size, and the numbers are the same."""
    line = 'r{0},"{0}\n",{1}\n'
    for size in (5_000, 40_000):
        paths = files(tmp_path, **{f"big{size}": "id,a,b\n" + "".join(line.format(i, 2 * i) for i in range(size)) + "x,y,oops,4\n"})
        listed = C.files_of(spark, paths)
        got = C.beginnings(spark, listed, 100)
        assert os.path.getsize(paths[0]) > C.PREFIX and sum(os.path.getsize(p.removeprefix("file:")) for p in got) == C.PREFIX
        long, status = read_matrices(spark, paths, label_column=True, rows=100)
        assert sorted((r["row_id"], r["value"]) for r in long.where("series = 'b'").collect()) == [(i, 2.0 * i) for i in range(100)] and status.first()["status"] == "ok"
        assert long.count() == 200
    monkeypatch.setattr(C, "PREFIX_MOST", C.PREFIX)
    assert len(C.beginnings(spark, listed, 30_000)) == 1 and read_matrices(spark, paths, label_column=True, rows=30_000)[0].where("series = 'b'").count() == 30_000


def test_a_result_is_whole_or_the_old_one(spark, tmp_path, monkeypatch):
    one, two = (spark.createDataFrame([(d, 1)], "dataset string, n int") for d in "ab")
    path = f"{tmp_path}/result"
    tables.write_result(one, path)
    with pytest.raises(Exception, match="half"):
        tables.write_result(two.selectExpr("dataset", "raise_error('half') as n"), path)
    assert tables.read_result(spark, path).first()["dataset"] == "a"
    os.rename(path, f"{path}.old")  # as a job leaves it that ends between the two renamings
    assert tables.read_result(spark, path).first()["dataset"] == "a"
    tables.write_result(two, path)
    assert tables.read_result(spark, path).first()["dataset"] == "b" and not os.path.exists(f"{path}.old")


def test_scratch_tables_go_with_their_work(spark):
    with tables.dropped_after(spark):
        path = tables.written(spark.range(3), "some").inputFiles()[0].removeprefix("file:").removeprefix("//")
        assert os.path.exists(path)
    assert not os.path.exists(path)
