"""Subjects on made-up texts: held-out accuracy and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from linkloom.llm import subjects as S

DOCS = "bm_seq bigint, content string, bookmark_type string, subject string, subjects int"
TERMS = {s: [f"{s[:4]}{i}" for i in range(25)] for s in ("alpha", "bravo", "carol", "delta")}
TERMS = {s: ["".join(chr(97 + (ord(c) * 7 + i) % 26) for c in w) for i, w in enumerate(ws)] for s, ws in TERMS.items()}


def about(rng, s):
    return f"the {rng.choice(TERMS[s])} and the {rng.choice(TERMS[s])} were in the note."


def filler(rng):
    return rng.choice(["nobody expected that.", "more on that later.", "so much for the start."])


def made(rng, n):
    docs, own = [], []
    for i in range(n):
        k = rng.choices([0, 1, 2], [1, 6, 2])[0]
        picked = rng.sample(sorted(TERMS), 2)
        main = rng.randrange(2, 6)
        lines = [about(rng, picked[0]) for _ in range(main)] if k else []
        if k == 2:
            lines += [about(rng, picked[1]) for _ in range(main)]
        elif k == 1 and main > 3 and rng.random() < 0.4:
            lines.append(about(rng, picked[1]))  # a passing sentence
        lines += [filler(rng) for _ in range(rng.randrange(1, 4))]
        rng.shuffle(lines)
        docs.append((i, " ".join(lines).capitalize(), rng.choice(["tweet", None, "general"]), "clash", 1))
        own.append(set(picked[:k]))
    return docs, own


def test_held_out_accuracy(spark):
    docs, own = made(random.Random(1), 1200)
    labels = [(i, rand + s, "a") for i, o in enumerate(own[:700]) for s in o for rand in [" " if i % 9 == 0 else ""]] + [(3, "nonsense", "b"), (None, "alpha", "b"), (10**9, "alpha", "b")]
    lab = spark.createDataFrame(labels, "bm_seq bigint, subject string, annotator string")
    subj = spark.createDataFrame([(s, "p") for s in TERMS] + [(None, "p"), ("alpha", "q")], "subject string, parent string")
    got = {r["bm_seq"]: set(r["subjects"]) for r in S.with_subjects(spark.createDataFrame(docs, DOCS), lab, subj).collect()}
    exact = np.mean([got[i] == own[i] for i in range(700, 1200)])
    assert exact > 0.93, exact


def test_odd_rows(spark):
    docs, own = made(random.Random(2), 150)
    lab = spark.createDataFrame([(i, s, "a") for i, o in enumerate(own) for s in o], "bm_seq bigint, subject string, annotator string")
    subj = spark.createDataFrame([(s,) for s in TERMS], "subject string")
    odd = [(900, None, "tweet", "", 0), (901, " \n", None, "", 0), (902, "keep", "tweet", "", 0), (None, docs[0][1], docs[0][2], "", 0), (0, docs[0][1], docs[0][2], "", 0), (2**60 + 1, "the word " * 60_000, None, "", 0)]
    df = spark.createDataFrame(docs + odd, DOCS)
    got = S.with_subjects(df, lab, subj).collect()
    by = {r["bm_seq"]: r["subjects"] for r in got}
    assert len(got) == len(docs) + len(odd) and by[900] == by[901] == by[902] == by[2**60 + 1] == []
    assert by[None] == by[0]
    assert S.with_subjects(df.limit(0), lab, subj).count() == 0
    assert all(r["subjects"] == [] for r in S.with_subjects(df, lab.limit(0), subj).collect())
    assert all(r["subjects"] == [] for r in S.with_subjects(df, lab, subj.limit(0)).collect())


def test_units():
    assert len(S.units("One two. Three four! Five\nsix")) == 3
    assert len(S.units(" ".join(["word"] * 100))) > 3 and S.units(" ... ") == []


def test_more_labels_than_the_sample(spark, monkeypatch):
    """The fit takes as many as its bound says; all documents are classified."""
    docs, own = made(random.Random(4), 1500)
    lab = spark.createDataFrame([(i, s, "a") for i, o in enumerate(own) for s in o], "bm_seq bigint, subject string, annotator string")
    subj, df = spark.createDataFrame([(s,) for s in TERMS], "subject string"), spark.createDataFrame(docs, DOCS)
    rows = df.selectExpr("bm_seq AS _key", "content AS _text", "bookmark_type AS _kind", "'f' AS _feed", "'h' AS _host")
    assert S.labelled(rows, lab, sorted(TERMS), "bm_seq", 300).count() == 300
    monkeypatch.setattr(S, "SAMPLE_CHARS", 20_000)
    assert 0 < S.labelled(rows, lab, sorted(TERMS), "bm_seq", 300).selectExpr("sum(length(_text))").first()[0] <= 20_000
    monkeypatch.undo()
    got = {r["bm_seq"]: set(r["subjects"]) for r in S.with_subjects(df, lab, subj, sample=300).collect()}
    assert len(got) == 1500 and np.mean([got[i] == own[i] for i in range(1500)]) > 0.88


def test_many_subjects(spark, monkeypatch):
    docs, own = made(random.Random(5), 300)
    lab = spark.createDataFrame([(i, s, "a") for i, o in enumerate(own) for s in o], "bm_seq bigint, subject string, annotator string")
    subj = spark.createDataFrame([(s,) for s in TERMS] + [(f"other {i}",) for i in range(196)], "subject string")
    df = spark.createDataFrame(docs, DOCS)
    got = {r["bm_seq"]: set(r["subjects"]) for r in S.with_subjects(df, lab, subj).collect()}
    assert len(got) == 300 and np.mean([got[i] == own[i] for i in range(300)]) > 0.8
    monkeypatch.setattr(S, "MAX_SUBJECTS", 199)
    with pytest.raises(ValueError, match="199"):
        S.with_subjects(df, lab, subj)


def test_sources_count():
    values, own = np.array(["a", "b", "a", "", "b"] * 40, object), np.tile(np.array([[1, 0], [0, 1], [1, 0], [0, 1], [0, 1]], float), (40, 1))
    odds = S.source_odds(values, own, np.ones(200, bool))
    assert set(odds) == {"a", "b"} and odds["a"][0] > 0.5 > 0 > odds["a"][1] and odds["b"][1] > 0
    assert S.read_odds(odds, np.array(["a", "new", ""], object), 2)[1:].tolist() == [[0, 0], [0, 0]]
