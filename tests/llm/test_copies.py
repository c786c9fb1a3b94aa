"""Copies against a plain version, and the steps of radix partitioning on small buckets."""

from __future__ import annotations

import random
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from linkloom.llm import copies as C

SCHEMA = "bm_seq bigint, url string, content string, seq string, key int"


def plain_canonical(x):
    return "".join(ch for ch in x if unicodedata.category(ch)[0] in "LMN").upper().lower()


def plain_url(u):
    rest, _, fragment = u.partition("#")
    path, _, query = rest.partition("?")
    return plain_canonical(path) + "".join(sorted(plain_canonical(p) for p in query.split("&"))) + plain_canonical(fragment)


def plain_groups(rows):
    groups = defaultdict(list)
    for n, u, t in rows:
        if n is not None and u and u.strip() and t and t.strip():
            groups[plain_url(u), plain_canonical(t)].append(n)
    return [sorted(g) for g in groups.values()]


def varied(rng, n):
    words = ["Straße", "alpha", "beta-gamma", "Ünder", "x1", "ñandú"]
    rows = []
    for i in range(n):
        w = rng.sample(words, 3)
        url = f"https://h.example/{w[0]}?b={i % 7}&a={w[1]}"
        text = " ".join(w) + "." * rng.randrange(3)
        form = rng.randrange(5)
        if form == 1:
            url, text = f"HTTPS://h.example/{w[0]}?a={w[1]}&b={i % 7}#", text.upper()
        elif form == 2:
            text = "­​ «" + text.replace(" ", " \n") + "»!"
        elif form == 3:
            text = text.replace("-", " — ")
        rows.append((i, url, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(n, u, t, "clash", 0) for n, u, t in rows], SCHEMA)


def test_against_plain_version(spark):
    rows = varied(random.Random(3), 900) + [(9000, None, "x"), (9001, "u", None), (9002, " ​", "x"), (9003, "u", " \n"), (9004, "", ""), (9005, "u" * 3000, "y" * 200_000), (9006, "u" * 3000, "y, " * 200_000), (9007, "?!", "..."), (9008, "!?", ".")]
    want = {(g[0], m) for g in plain_groups(rows) for m in g[1:]}
    assert len(want) > 100
    for bucket_rows in (C.BUCKET_ROWS, 40, 1):
        got = C.copies(frame(spark, rows), bucket_rows=bucket_rows)
        assert {tuple(r) for r in got.collect()} == want
        assert got.count() == len(want)


def test_counts_and_hot_group(spark):
    rows = [(i, "https://a.example", "same Text") for i in range(3000)] + [(10_000 + i, f"u{i}", "z") for i in range(500)]
    got = C.collapse(frame(spark, rows).repartition(7), bucket_rows=50)
    assert got.count() == 501 and got.agg(F.max("copies")).first()[0] == 3000
    found = C.copies(frame(spark, rows).repartition(7), bucket_rows=50)
    assert found.count() == 2999 and {r[0] for r in found.select("first_seq").distinct().collect()} == {0}


def test_repeated_numbers_and_empty(spark):
    assert C.copies(frame(spark, [(1, "u", "t"), (1, "u", "t"), (2, "U!", "T")])).collect() == [(1, 2)]
    assert C.copies(frame(spark, [])).count() == 0 == C.collapse(frame(spark, [])).count()


def test_trie():
    rng = random.Random(1)
    keys = [bytes(rng.randrange(3) for _ in range(32)) for _ in range(300)]
    t, want = C.Trie(), {}
    for i, k in enumerate(keys * 2):
        t.add(k, i, 1)
        want[k] = (min(i, want.get(k, (i, 0))[0]), want.get(k, (0, 0))[1] + 1)
    assert {x[0]: (x[1], x[2]) for x in t.terminals()} == want


def test_buckets_fit(spark):
    keys = spark.range(5000).select(F.col("id").alias("seq"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("key"))
    sizes = C.radix_buckets(C.merged_runs(keys), 30).groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 30 and sum(r["count"] for r in sizes) == 5000
