"""One host, source or group of copies holds a third of all rows, and joins shuffle and split skewed partitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from linkloom.llm import boilerplate, copies, leaks, mixing

SCHEMA = "extract_id bigint, site string, title string, content string, token int, pages int, _k string"


def article(rng):
    return [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(20)).capitalize() + "." for _ in range(2)]


@pytest.fixture
def skewed(spark):
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_host(skewed, monkeypatch):
    monkeypatch.setattr(boilerplate, "MAX_BROADCAST", 0)
    rng, rows, truth = random.Random(3), [], {}
    for n in range(240):
        host = "hot.example" if n % 3 == 0 else f"h{n % 16}.example"
        one, two = article(rng)
        lines = [("Home | News | Jobs", 1), (one, 0), (f"{rng.randrange(999)} shares", 1), (two, 0), (f"Imprint of {host}", 1)]
        rows.append((n, host, "", "\n".join(x for x, _ in lines), 0, 0, ""))
        truth[n] = [i for i, (_, drop) in enumerate(lines) if drop]
    got = boilerplate.drop_boilerplate(skewed.createDataFrame(rows, SCHEMA).repartition(6))
    assert {r["extract_id"]: r["dropped"] for r in got.collect()} == truth


def test_group_of_copies(skewed, monkeypatch):
    monkeypatch.setattr(copies, "HOT_SHARE", 2.0)  # no group counts as hot, so the join by key has to carry it
    rows = [(i, "https://a.example/?b=1&a=2" if i % 3 == 0 else f"https://b.example/{i // 4}", "Same text!" if i % 3 == 0 else f"text {i // 4}") for i in range(900)]
    got = {(r["first_seq"], r["copy_seq"]) for r in copies.copies(skewed.createDataFrame(rows, "bm_seq bigint, url string, content string"), bucket_rows=50).collect()}
    groups = {}
    for i, *key in rows:
        groups.setdefault(tuple(key), []).append(i)
    assert got == {(own[0], x) for own in groups.values() for x in own[1:]}


def test_passage(skewed, monkeypatch):
    """A third of the documents hold one item, and many items share its opening."""
    rng = random.Random(4)
    opening = [f"o{i}" for i in range(14)]
    items = [(i, " ".join(opening + [f"x{i}y{j}" for j in range(20)])) for i in range(30)]
    docs = [(d, " ".join([f"w{rng.randrange(999)}" for _ in range(30)] + (opening if d % 3 == 0 else []) + ["end"])) for d in range(120)]
    want = {(d, i) for d in range(0, 120, 3) for i in range(30)}
    for most in (leaks.MAX_WORDS, 1):
        monkeypatch.setattr(leaks, "MAX_WORDS", most)
        got = leaks.leaked(skewed.createDataFrame(docs, "doc_id bigint, text string"), skewed.createDataFrame(items, "item_id bigint, text string"))
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


@pytest.mark.skipif(not __import__("os").path.exists(mixing.TOKENIZER), reason="no tokenizer")
def test_source(skewed, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 0)
    docs = skewed.range(1500).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.expr("IF(id % 3 = 0, 'hot', concat('s', id % 5))").alias("source"))
    targets = skewed.createDataFrame([("hot", 0.5, 3), *[(f"s{i}", 0.1, 2) for i in range(5)]], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixing.mix_report(docs, targets).collect()}
    assert abs(report["hot"]["actual_share"] - 0.5) < 0.04 and report["hot"]["docs"] == 500 and report["hot"]["most_uses"] <= 3
