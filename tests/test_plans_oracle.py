"""Plan shape checks and the DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from parley.operators import classifier
from parley.plans import catalog
from parley.sources import tables
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_score_is_a_map(spark):
    d = tables.documents(spark, SF_SMALL).select("doc_id", "text")
    p = plan(classifier.margins(d, ["doc_id"], classifier.demo_model(spark)))
    assert "Exchange" not in p and "Join" not in p


def test_tokeniser_runs_once_per_row(spark):
    df = catalog.q_svm_score(spark, SF_SMALL)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("split(lower(") == 1


def test_filters_reach_the_scan(spark):
    df = catalog.q_glossary_simplify(spark, SF_SMALL)
    p = plan(df)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def _digest(cols, rows_):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows_)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    got = _digest(df.columns, [tuple(r) for r in df.collect()])
    res = duck.sql(entry.oracle_sql()[name])
    want = _digest(res.columns, res.fetchall())
    assert sorted(df.columns) == sorted(res.columns)
    assert got == want


def test_every_query_has_an_oracle_or_a_reason():
    """The library's own queries; tests/llm holds the optional package's against brute force."""
    no_oracle = set(catalog.queries()) - set(entry.oracle_sql())
    assert no_oracle == set(catalog.NO_SQL)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "translation" in df.columns
