"""Every query with SQL of its own gives what DuckDB gives by it."""

import math
from pathlib import Path

import duckdb
import pytest

from riskloom.plans import registry
from riskloom.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        out.append(tuple(None if r[i] is None or (isinstance(r[i], float) and math.isnan(r[i])) else f"{float(r[i]):.4f}" if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, DATA)
    found = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.collect(), got.columns) == plain(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name, monkeypatch):
    monkeypatch.setattr(registry, "TREES", 2)  # trees are held against a plain search in test_boosting
    assert QUERIES[name](spark, DATA).count() > 0
