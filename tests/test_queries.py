"""Every query with SQL to compare, over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from ratiolake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def read_once():
    """The files that the PDF queries make and read, once for all of them."""
    from ratiolake.plans import pdf_queries

    before = {name: getattr(pdf_queries, name) for name in ("_read", "_merge", "_split", "_again")}
    for name, make in before.items():
        made = {}

        def once(*args, make=make, made=made):
            key = tuple(map(str, args[1:] if make is before["_read"] else [id(a) if not isinstance(a, str | dict) else a for a in args]))
            if key not in made:
                made[key] = args, make(*args)
            return made[key][1]

        setattr(pdf_queries, name, once)
    yield
    for name, make in before.items():
        setattr(pdf_queries, name, make)


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    want = sorted(tuple(map(plain, r)) for r in con.execute(f"SELECT {quoted} FROM ({registry.ORACLE_SQL[name]})").fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
