"""Every registered graph query against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from weftgraph.plans import queries_index, queries_more, queries_scopes, queries_structure, queries_tools  # noqa: F401
from weftgraph.plans.queries import QUERIES, SQL


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return "null" if v is None else str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == cols
        order = [rel.columns.index(c) for c in cols]
        assert got == sorted(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
