"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lurelens import detail_queries
from lurelens import queries as main_queries

QUERIES, SQL = main_queries.QUERIES | detail_queries.QUERIES, main_queries.SQL | detail_queries.SQL
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="tables are not there")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(df):
    cols = sorted(df.columns)
    df = df[cols].copy()
    for c in cols:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
    text = df.astype(object).where(df.notna(), None).astype(str).apply(lambda v: v.str.replace(r"\.0$", "", regex=True))
    return text.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), con.sql(SQL[name]).df()
    pd.testing.assert_frame_equal(plain(got), plain(want))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_word_errors_match_brute_force(spark, con):
    turns = con.sql("SELECT concat(conv_id, '-', turn) AS filename, text, replace(text, 'e', '') AS seen, (conv_id + turn) % 7 <> 0 AS ok FROM conversations").fetchall()
    got = {r.filename: r.wer for r in main_queries.recognition_words(spark, DIR).collect()}
    assert len(got) == len(turns)
    for name, text, seen, ok in turns:
        want = round(edits(text.split(), seen.split()) / len(text.split()), 6) if ok else None
        assert got[name] == want or abs(got[name] - want) < 1e-6
