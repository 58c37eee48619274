"""Corpus queries against the SQL that gives their whole rows."""

import duckdb
import pytest

from episodica.llm import queries

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op7_chat", "op9_quality", "op12_trie", "op13_repair"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    found = queries.QUERIES[name](spark, D)
    columns = sorted(found.columns)
    cursor = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})")
    said = sorted(cursor.fetchall(), key=str)
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=str) == said
