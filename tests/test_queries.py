"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_queries_without_llm_have_sql():
    from chunkyard.plans import oracle, queries

    assert set(queries.QUERIES) == set(oracle.ORACLE_SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["id", "difficulty"]


def test_entry_without_the_llm_subpackage(monkeypatch):
    monkeypatch.setattr(entry, "_llm", lambda: None)
    from chunkyard.plans import queries

    assert set(entry.queries()) == set(queries.QUERIES)
    assert set(entry.oracle_sql()) == set(queries.QUERIES)


def test_lines_are_searched_on_pages_that_hold_a_quote_alone(spark, monkeypatch):
    from chunkyard.operators import cleaning, validation
    from chunkyard.plans import queries, surrogates

    seen = []
    straddling = validation.straddling
    monkeypatch.setattr(validation, "straddling", lambda pages, lines, quotes: seen.append(lines) or straddling(pages, lines, quotes))
    queries.QUERIES["quote_straddles"](spark, DATA)
    assert 0 < seen[0].count() < cleaning.page_lines(surrogates.pages(spark, DATA)).count()
