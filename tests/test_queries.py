"""Every registered query against its SQL on the smallest tables; queries without SQL must run."""

import math

import duckdb
import pytest

from episodica.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(str(value(r[k])) for k in order) for r in rows))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, D)
    rows = found.collect()
    if name in registry.SQL:
        cursor = duck.execute(registry.SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(found.columns)
        assert table(found.columns, rows) == table(columns, cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
