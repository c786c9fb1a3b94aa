"""Cut texts: held-out accuracy on texts cut here, limits, and cases without any text."""

from __future__ import annotations

import random

import pytest

from linkloom.llm import truncation as T

SCHEMA = "doc_id bigint, text string, source string, score int, limits int"
NOUNS = "river garden engine letter window market bridge forest planet candle mirror ladder basket harbour meadow".split()
VERBS = "opens follows carries watches repairs paints measures leaves crosses answers".split()


def sentence(rng):
    n = rng.sample(NOUNS, 3)
    return rng.choice([f"The {n[0]} {rng.choice(VERBS)} the {n[1]}", f"Every {n[0]} {rng.choice(VERBS)} a {n[1]} near the {n[2]}", f"Nobody {rng.choice(VERBS)} the {n[0]} without a {n[1]}"])


def whole(rng):
    text = ". ".join(sentence(rng) for _ in range(rng.randrange(3, 9))) + "."
    return text + rng.choice(["", "", "", " #" + rng.choice(NOUNS), " https://a.example/" + str(rng.randrange(9999)), "\n- " + rng.choice(NOUNS) + "\n- " + rng.choice(NOUNS), " Who knows…"])


def corpus(n=1500, seed=1):
    rng, rows, cut = random.Random(seed), [], set()
    for i in range(n):
        text, source = whole(rng), rng.choice(["Feed-Items", "books"])
        if source == "Feed-Items" and len(text) > 200:
            text = text[:200]
            if text[-1] not in ".…" and not text.rstrip().endswith("."):
                cut.add(i)
        elif rng.random() < 0.12:
            at = rng.randrange(20, len(text) - 30)
            text = text[:at].rstrip(". ") + rng.choice(["", "...", " [...]", "… [+40 chars]", "\n[connection closed]", "�"])
            cut.add(i)
        rows.append((i, text, source, 0, 0))
    return rows, cut


def words_of(df):
    return T.known_words(T.corpus_counts(df, "text", __import__("pyspark").sql.functions.lit("s")))


def test_held_out_accuracy(spark):
    rows, cut = corpus()
    got = {r["doc_id"] for r in T.scored(spark.createDataFrame(rows, SCHEMA)).where("score >= 0.5").collect()}
    precision, recall = len(got & cut) / len(got), len(got & cut) / len(cut)
    assert precision > 0.93 and recall > 0.85, (precision, recall)


def test_limits(spark):
    rows, _ = corpus()
    from pyspark.sql import functions as F

    got = {r["source"]: r["limits"] for r in T.source_limits(T.corpus_counts(spark.createDataFrame(rows, SCHEMA), "text", T.source_name(F.col("source")))).collect()}
    assert got == {"feed_items": [200]}


def test_rates(spark):
    rows, cut = corpus()
    rates = {r["source"]: r for r in T.truncation_rates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert rates["feed_items"]["docs"] + rates["books"]["docs"] == len(rows) and rates["feed_items"]["cut_rate"] > rates["books"]["cut_rate"]


def test_nulls_blanks_repeats_and_empty(spark):
    rows, _ = corpus(200)
    odd = [(900, None, "books", 0, 0), (901, " \n", None, 0, 0), (902, "", "x", 0, 0), (903, "word " * 100_000, None, 0, 0), (904, rows[0][1], rows[0][2], 0, 0), (None, "A line.", "books", 0, 0)]
    got = T.scored(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(rows) + len(odd) and by[900] == by[901] == by[902] == 0.0 and by[904] == pytest.approx(by[0])
    assert T.scored(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("text", "kind", "shape"), [("a b…", "ell", "letter"), ("a [...]", "bracket", "letter"), ("a... Read more", "more", "letter"), ("a � ", "broken", "letter"), ("a b&am", "entity", "letter"), ("a<a hre", "tag", "letter"), ("I <3", "none", "smiley"), ("a. #tag", "none", "hash"), ("x\n- one\n- item", "none", "item"), ("x\n- item", "none", "first"), ("A b.\n- C d.\n- and", "none", "letter"), ("", "none", "empty"), ("A b.", "none", "ended")])
def test_closings(text, kind, shape):
    c = T.close_of(text)
    assert (c.kind, c.shape) == (kind, shape)


def test_stumps_stay_unknown(spark):
    ends = ["", "…", "...", " [...]", "… [+40 chars]", "\n[connection closed]", "�", "&am", "<a hre", "...\n[cut]", " \n"]
    rows = [(i, f"The government of river {i} opens. A new gover{e}", "books", 0, 0) for i, e in enumerate(ends * 4)]
    known = words_of(spark.createDataFrame(rows, SCHEMA))
    assert [T.is_known(w, known) for w in ("government", "river", "opens", "new", "gover")] == [True, True, True, True, False]
    rows += [(100 + i, "A gover slip is in few texts.", "books", 0, 0) for i in range(3)]
    assert not T.is_known("gover", words_of(spark.createDataFrame(rows, SCHEMA)))


def test_filter_of_words_grows(spark):
    """Numbers are one word each by their length, and a filter has room for all others."""
    name = "concat('w', translate(cast(x AS string), '0123456789', 'abcdefghij'))"
    words = words_of(spark.range(3).selectExpr(f"concat_ws(' ', transform(sequence(1, 200000), x -> {name}), 'x12', '.') AS text"))
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    assert all(T.is_known("w" + letters(i), words) for i in range(1, 200_000, 7)) and sum(T.is_known("v" + letters(i), words) for i in range(20_000)) < 400
    assert T.is_known("x34", words) and not T.is_known("x5", words)


def test_nothing_to_learn_from(spark):
    rows = [(i, f"note without any end {i}", "notes", 0, 0) for i in range(40)] + [(41, None, "notes", 0, 0)]
    got = {r["doc_id"]: r["score"] for r in T.scored(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 41 and got[41] == 0.0 and all(v is None for k, v in got.items() if k != 41)
    assert T.truncation_rates(spark.createDataFrame(rows, SCHEMA)).first()["cut_docs"] == 0


def test_sample_of_any_size(spark):
    rows = spark.range(100_000)
    assert rows.where(T._sample("id", 500, 1000)).count() == pytest.approx(50_000, rel=0.02)
    assert rows.where(T._sample("id", 500, 200)).count() == 100_000
    assert 5 < spark.range(40_000_000).where(T._sample("id", 500_000, 10**12)).count() < 50  # 20, where a millionth would be the least


def test_lengths_of_one_source(spark):
    from pyspark.sql import functions as F

    lengths = spark.range(30_000).select(F.lit("s").alias("source"), F.expr("repeat('x', cast(IF(id % 3 = 0, 977, 400 + pmod(id * 7919, 2000)) AS int))").alias("text"))
    counts = T.corpus_counts(lengths, "text", F.col("source"))
    assert T.source_limits(counts).first()["limits"] == [977] and counts.where("size > 0").agg(F.sum("n")).first()[0] == 30_000


def test_marks_not_seen_in_training(spark):
    """Recall on texts cut with marks that training leaves out. Of marks that no pattern has, only few are found."""
    rng = random.Random(11)
    left_out = ("... Read more", " [...]", "\n[connection closed]", "<a hre", " >>", " (continued on next page", " ~~")
    rows, cut = corpus(900, 3)
    for i in range(210):
        text = whole(rng)
        rows.append((5000 + i, text[: rng.randrange(25, len(text) - 30)].rstrip(". ") + left_out[i % len(left_out)], "books", 0, 0))
    tails = tuple(t for t in T.TAILS if t.strip() not in {x.strip() for x in left_out})
    scores = {r["doc_id"]: r["score"] for r in T.scored(spark.createDataFrame(rows, SCHEMA), tails=tails).collect()}
    found = [scores[5000 + i] >= 0.5 for i in range(210)]
    by_mark = {m: sum(found[i] for i in range(k, 210, len(left_out))) / 30 for k, m in enumerate(left_out)}
    known = [m for m in left_out if T.close_of("word" + m).kind != "none"]
    assert len(known) == 4 and min(by_mark[m] for m in known) > 0.8, by_mark
    print(by_mark)
