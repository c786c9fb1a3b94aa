"""All queries of the subpackage run over whole tables; those with SQL give its rows."""

from __future__ import annotations

from pathlib import Path

import pytest

from linkloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() >= 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, sf_dir)
    done = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in done.description]
    tidy = lambda rows: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)
    assert tidy([r[n] for n in names] for r in df.collect()) == tidy(done.fetchall())
