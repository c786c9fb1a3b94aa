"""Every query of the core against its SQL, over the whole tables of the smallest data."""

from __future__ import annotations

from pathlib import Path

import pytest

from linkloom.plans import registry

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(tidy, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    done = duck.execute(ORACLES[name])
    names = [d[0] for d in done.description]
    want = _rows(names, done.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() >= 0
