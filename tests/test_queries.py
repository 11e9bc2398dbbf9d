"""A cross-section of registered queries against the comparison SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("d3_jsd", "u7_reason", "a17_confusion", "r2_srcc_ordinal", "s2_last_line_wins", "p6_rating_response", "j13_merge_records", "x6_resample_exact", "m12_cosine", "r27_cer", "x26_conversations_to_chat")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    cell = lambda v: None if v is None or v != v else v
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted(str([cell(r[c]) for c in names]) for r in got.collect())
    b = sorted(str([cell(v) for v in r]) for r in want.fetchall())
    assert a == b


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 3
