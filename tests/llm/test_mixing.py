"""Poisson replication: the distribution, the caps and the shares."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from linkloom.llm import mixing as M

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(M.TOKENIZER), reason="no tokenizer")
DOCS, TARGETS = "doc_id bigint, text string, source string, uses int, copy_no int", "source string, target_share double, max_repeats int"


def docs(spark):
    rows = [(i, "one two three four five " * (1 + i % 3), "Web-Articles" if i % 2 else " web_articles ", 0, 0) for i in range(3000)]
    rows += [(10_000 + i, "alpha beta " * (1 + i % 5), "small", 0, 0) for i in range(400)] + [(20_000, None, "small", 0, 0), (20_001, "", None, 0, 0), (20_002, "x", "other", 0, 0)]
    return spark.createDataFrame(rows, DOCS)


def targets(spark):
    return spark.createDataFrame([("web_articles", 0.7, 1), ("small", 0.29, 4), ("none", 0.1, 2), (None, 0.5, 1), ("zero", None, None)], TARGETS)


@pytest.mark.parametrize(("rate", "cap"), [(0.05, 1), (0.9, 1), (1.5, 2), (3.6, 4), (0.5, 1000), (30.0, 100), (800.0, 1000), (900.0, 1000), (2000.0, 10**9), (0.3, 10**9)])
def test_capped_mean_is_met(rate, cap):
    mean = M.poisson_mean(rate, cap)
    assert abs(M.capped_mean(mean, cap) - rate) < 1e-6
    first, steps = M.cumulative(mean, cap)
    assert all(a <= b + 1e-15 for a, b in zip(steps, steps[1:])) and len(steps) <= cap
    assert abs(first + sum(1 - s for s in steps) - rate) < 1e-6
    assert first or abs(steps[0] - math.exp(-mean)) < 1e-12


def test_plan_limits_scarce_source():
    plan = M.plan_mix({"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2), "c": (0.3, 1)})
    assert plan["b"]["rate"] == pytest.approx(1.8) and plan["a"]["rate"] == pytest.approx(0.018) and plan["c"]["share"] is None
    assert M.plan_mix({}, {"a": (0.5, 1)})["a"]["rate"] == 0.0
    assert M.plan_mix({"a": 10}, {"a": (1.0, 2)}, total=10**9)["a"]["rate"] == pytest.approx(1.8)


def test_shares_and_caps(spark):
    report = {r["source"]: r for r in M.mix_report(docs(spark), targets(spark)).collect()}
    assert abs(report["web_articles"]["actual_share"] - 0.7 / 0.99) < 0.03 and report["web_articles"]["most_uses"] == 1
    assert report["small"]["most_uses"] <= 4 and report["none"]["used_tokens"] == 0 and report["other"]["uses"] == 0
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1.0)


def test_mixed_rows_agree_with_report_and_repeat(spark):
    one, again = M.mixed(docs(spark), targets(spark)), M.mixed(docs(spark).repartition(5), targets(spark))
    rows = [tuple(r) for r in one.collect()]
    assert rows == [tuple(r) for r in again.collect()]  # same draw and order, however the rows are spread
    counts = one.groupBy("doc_id", "source").agg(F.max("copy_no").alias("m"), F.count("*").alias("n")).collect()
    assert all(r["m"] == r["n"] <= {"web_articles": 1, "small": 4}[r["source"]] for r in counts)
    assert rows != [tuple(r) for r in M.mixed(docs(spark), targets(spark), seed=1).collect()]
    report = {r["source"]: r for r in M.mix_report(docs(spark), targets(spark)).collect()}
    assert sum(r["uses"] for r in report.values()) == len(rows)


def test_tokens_against_tokenizer(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(M.TOKENIZER, "rb"))}
    e = tiktoken.Encoding("t", pat_str=M.PIECES, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "Hello, it's 2024!\n\n  Grüße", None, "<|endoftext|>", "word " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in M.with_tokens(df, "t", "n").orderBy("i").collect()]
    assert got == [0 if t is None else len(e.encode_ordinary(t)) for t in texts]


def test_empty(spark):
    assert M.mixed(docs(spark).limit(0), targets(spark)).count() == 0
    assert M.mixed(docs(spark), targets(spark).limit(0)).count() == 0
    assert M.mix_report(docs(spark).limit(0), targets(spark)).where("used_tokens > 0").count() == 0


def test_high_rates_vary(spark):
    """Each document is used about as often as its rate says, not as often as its cap allows."""
    rows = spark.range(400).select(F.col("id").alias("doc"), F.lit("a").alias("source"), F.lit(3).cast("bigint").alias("n_tokens"))
    wanted = spark.createDataFrame([("a", 1.0, 2000)], TARGETS)
    used, plan = M.drawn(rows, wanted, total=400 * 3 * 800)
    got = [r["uses"] for r in used.collect()]
    assert plan["a"]["rate"] == pytest.approx(800) and abs(sum(got) / 400 - 800) < 6 and max(got) < 950 and len(set(got)) > 50
