"""Every core query against its SQL on the smallest tables."""

import duckdb
import pytest

from loomgraph.plans import queries as core
from loomgraph.plans import dictionary_queries, evidence_queries, graph_queries, rule_queries, survey_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_matches_sql(spark, data, oracle, name):
    df = core.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = oracle.execute(core.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(rounded(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert got == want


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(core.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
