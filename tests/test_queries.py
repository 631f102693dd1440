import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from allotau.plans import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(own.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = own.QUERIES[name](spark, SF).toPandas(), duck.sql(own.ORACLE_SQL[name]).df()
    for frame in (got, want):
        for c in frame.columns:
            if str(frame[c].dtype).startswith("int"):
                frame[c] = frame[c].astype("int64")
    assert plain(got) == plain(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
