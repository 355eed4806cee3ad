"""Every query of the catalogue against its SQL in another engine, exactly; queries without SQL must run and be stable in schema."""

import math
import os

import duckdb
import pytest

from siltstone import catalog

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    """Values as they are; numbers with ten significant digits, which both engines' sums share."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.10g}") + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.ORACLE_SQL:
        assert df.columns
        return
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    bad = [(x, y) for x, y in zip(got, want) if x != y]
    assert not bad, bad[:3]
