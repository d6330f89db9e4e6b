"""Every query of the index with SQL gives DuckDB's rows."""

import duckdb
import pytest

from pathloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in (r[i] for i in order)) for r in data)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, sf, db, name):
    df = queries.QUERIES[name](spark, sf)
    want = db.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
