"""Every registered query beside its SQL on the same small tables."""

import math

import duckdb
import pytest

from tessella.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v if isinstance(v, (int, str, type(None))) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf, db):
    df = catalog.queries()[name](spark, sf)
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()
    got = rows(df.columns, df.collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    want = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
