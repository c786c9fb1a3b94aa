"""Pairs against counting by hand."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa

from linkloom.llm import together as T

SCHEMA = "proc_id bigint, tags array<string>, categories array<string>, field string, item string"


def plain(rows, field):
    one = {}
    for r in rows:
        if r[0] is not None:
            own = {x.strip().lower() for x in (r[1 if field == "tags" else 2] or []) if x and x.strip()}
            one.setdefault(r[0], set()).update(own)
    single, both = Counter(), Counter()
    for s in one.values():
        single.update(s)
        both.update(combinations(sorted(s), 2))
    return len(one), single, both


def some(n, rng):
    items = [f"i{k}" for k in range(25)] + ["Hot ", " hot", None, "", " "]
    rows = []
    for i in range(n):
        tags = rng.choices(items, k=rng.randrange(9)) if rng.random() < 0.95 else None
        rows.append((i, tags, rng.choices(["a", "b", "A", "c"], k=rng.randrange(4)), "clash", "clash"))
    return rows + rows[: n // 5] + [(None, ["x", "y"], ["x", "y"], "", "")]


def test_against_plain_version(spark, monkeypatch):
    rows = some(400, random.Random(5))
    for run_pairs, broadcast in ((T.RUN_PAIRS, T.MAX_BROADCAST), (17, 0)):
        monkeypatch.setattr(T, "RUN_PAIRS", run_pairs)
        monkeypatch.setattr(T, "MAX_BROADCAST", broadcast)
        got = T.pairs_together(spark.createDataFrame(rows, SCHEMA), "proc_id", ["tags", "categories"], 3, 0.01).collect()
        want = set()
        for field in ("tags", "categories"):
            n, single, both = plain(rows, field)
            want |= {(field, a, b, k, single[a], single[b], n) for (a, b), k in both.items() if k >= max(3, 0.01 * n)}
        assert {tuple(r)[:7] for r in got} == want and len(got) == len(want)
        for r in got:
            cells = r.n_ab + 0.5, r.n_a - r.n_ab + 0.5, r.n_b - r.n_ab + 0.5, r.n - r.n_a - r.n_b + r.n_ab + 0.5
            assert abs(r.odds_ratio - cells[0] * cells[3] / cells[1] / cells[2]) < 1e-9 and r.log_odds_error > 0


def test_large_record_and_empty(spark):
    row = [(1, [f"w{i:04d}" for i in range(700)], None, "", "")]
    got = T.pairs_together(spark.createDataFrame(row, SCHEMA), "proc_id", ["tags", "categories"])
    assert got.count() == 700 * 699 // 2
    assert T.pairs_together(spark.createDataFrame([], SCHEMA), "proc_id", ["tags", "categories"]).count() == 0


def test_runs_across_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"]) for p, n in (([1, 1, 2], [1, 2, 3]), ([], []), ([2, 2], [4, 5]), ([2, 7], [1, 1]))]
    got = [(p, n) for b in T._count_runs(iter(batches)) for p, n in zip(b["pair"].to_pylist(), b["n"].to_pylist())]
    assert got == [(1, 3), (2, 13), (7, 1)]
    assert T._runs(np.array([3, 1, 3]))["n"].to_pylist() == [1, 2]


def test_registered_pairs_are_all_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/processed_bookmarks.parquet").select("proc_id", "tags", "categories").collect()
    got = {tuple(r) for r in T.p5_pairs(spark, sf_dir).select("field", "item_a", "item_b", "n_ab").collect()}
    want = {(f, a, b, k) for f in ("tags", "categories") for (a, b), k in plain(rows, f)[2].items()}
    assert got == want and min(k for *_, k in got) == 1
    n = plain(rows, "tags")[0]
    assert all(r.n_ab >= max(6, n / 1000) for r in T.p5_found(spark, sf_dir).join(T.p5_pairs(spark, sf_dir), ["field", "item_a", "item_b"]).collect())


def test_counts_of_billions(spark):
    rows = [(2 * 10**9, 3 * 10**9, 2 * 10**9, 5 * 10**9), (10**9, 2 * 10**9, 2 * 10**9, 16 * 10**9), (10**9 - 1, 2 * 10**9, 2 * 10**9, 16 * 10**9)]
    got = T.above_chance(spark.createDataFrame(rows, "n_ab bigint, n_a bigint, n_b bigint, n bigint"), 4).collect()
    assert [r["n_ab"] for r in got] == [10**9]


def test_key_of_a_third_of_the_rows(spark, monkeypatch):
    rng = random.Random(6)
    rows = some(200, rng) + [(7, rng.sample([f"i{k}" for k in range(25)], 3), None, "", "") for _ in range(150)]
    for broadcast in (T.MAX_BROADCAST, 0):
        monkeypatch.setattr(T, "MAX_BROADCAST", broadcast)
        got = {tuple(r)[:6] for r in T.pairs_together(spark.createDataFrame(rows, SCHEMA), "proc_id", ["tags", "categories"]).collect()}
        want = set()
        for field in ("tags", "categories"):
            _, single, both = plain(rows, field)
            want |= {(field, a, b, k, single[a], single[b]) for (a, b), k in both.items()}
        assert got == want
