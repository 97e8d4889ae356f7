"""The driver's contract, and some of the catalogue against DuckDB."""

import glob
from pathlib import Path

import pytest

import __spark_entry__ as entry
from quillon import queries

DATA = "/root/testdata/sf0.001"


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows[0].score >= rows[-1].score > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", ["doc_canonical_text", "match_nested", "match_near3", "count_mixed", "match_doc_phrase3", "bm25_scalar_bm25l", "bm25f_two_field", "search_topk_phrase", "relevance_metrics", "anomalous_docs_five", "highlight", "snippet", "index_vacuum", "facet_counts", "sql_regex", "sql_literal_and_prose", "index_repeated_ids", "query_texts"])
def test_results_equal_the_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted([tuple(map(plain, r)) for r in got.select(*columns).collect()], key=repr) == sorted([tuple(map(plain, r)) for r in want.fetchall()], key=repr)
