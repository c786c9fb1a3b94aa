"""Operators on literal rows, one for each branch that data seldom reach."""

from __future__ import annotations

import difflib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.functions import urls as U
from linkloom.operators import analysis, categories, pages, responses, state, tags, threads, validate


def one(spark, schema, row, expr):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


def each(spark, values, make, schema="v string"):
    return [r["x"] for r in spark.createDataFrame([(v,) for v in values], schema).select(make(F.col("v")).alias("x")).collect()]


def test_routing_table(spark):
    cases = [
        ("https://twitter.com/u/status/1", "tweet"), ("https://x.com/u/status/1", "tweet"), ("https://twitter.com/u/thread/1", "thread"), ("https://youtube.com/watch?v=1", "video"), ("https://youtu.be/1", "video"),
        ("https://example.com/a", "general"), ("https://netflix.com/status/1", "tweet"), ("https://x.com/u", None), (None, None), ("", "general"),
    ]
    assert each(spark, [c[0] for c in cases], U.bookmark_type) == [c[1] for c in cases]


def test_url_checks(spark):
    cases = {"https://e.com/a": True, "http://localhost:80/": True, "e.com": False, "https://": False, "": False, None: False, "ftp://e.com": True, "https://a_b.com": False, "https://e.com/" + "a" * 2100: True, "javascript:alert(1)": False}
    got = each(spark, list(cases), lambda c: validate.check_url(c))
    assert [g["is_valid"] for g in got] == list(cases.values())
    assert got[1]["warnings"] == ["URL points to local/blocked domain: localhost:80"]
    assert got[8]["warnings"] == ["URL is very long (>2000 characters)"]
    assert each(spark, ["https://a.onion", "https://a.onion/p", "https://a.com/x.exe"], lambda c: F.size(validate.url_warnings(c))) == [1, 0, 1]


def test_bookmark_checks(spark):
    df = spark.createDataFrame([("1", "https://e.com", "t", None), ("", "https://e.com", "t", "2024-13-01"), ("2", None, None, "2024-01-01T00:00:00Z")], "id string, url string, title string, created_at string")
    got = [r["checked"] for r in validate.check_bookmarks(df).collect()]
    assert [g["is_valid"] for g in got] == [True, False, False]
    assert "Invalid created_at date format" in got[1]["errors"] and "Title must be a string" in got[2]["errors"]
    lacking = validate.check_bookmarks(df.drop("title").withColumn("extra", F.lit(1))).first()["checked"]
    assert lacking["errors"] == ["Missing required field: title"] and lacking["warnings"] == ["Unknown fields: extra"]
    assert validate.summarise(validate.check_bookmarks(df.limit(0))).first()["total_items"] == 0


def test_text_functions(spark):
    assert each(spark, ["  a   b&amp;c ", None, ""], T.clean_text) == ["a bc", None, ""]
    assert each(spark, ["a  b\n c", "", None], T.word_count) == [3, 0, 0]
    assert each(spark, ["<script>x</script><b>a</b> &lt;b&gt;&nbsp;c", None], T.clean_html) == ["a <b> c", ""]
    assert each(spark, [0, 1536, 5 * 1024**3], T.human_size, "v bigint") == ["0.0 B", "1.5 KB", "5.0 GB"]
    assert each(spark, ["#café #b x", None], T.hashtags) == [["café", "b"], None]


def test_pages(spark):
    html = '<title>A / X</title><meta content="no" name="description"><meta name="author" content="Ann"><script>"</p>"</script><p>one <b>two</b></p><p>three</p>'
    assert one(spark, "h string", (html,), pages.page_text(F.col("h"))) == "one two three"
    assert one(spark, "h string", (html,), pages.meta_map(F.col("h"))) == {"author": "Ann"}
    assert one(spark, "h string", (html,), pages.post_title(F.col("h"))) == "A"
    assert each(spark, [None, ""], pages.post_text) == ["", ""]
    assert each(spark, [r"café \"x\"", "plain ü", "bad \\q"], pages.unescape) == ['café "x"', "plain ü", "bad \\q"]
    assert each(spark, [59, 61, 3661, None], pages.format_duration, "v bigint") == ["0:59", "1:01", "1:01:01", None]


def test_analysis(spark):
    assert each(spark, ["GOOD great bad", "poor", "", None], analysis.sentiment) == ["Positive", "Negative", "Neutral", "Neutral"]
    assert each(spark, ["a study of news", "tutorial review", None], analysis.content_type) == ["News", "Tutorial", "Article"]
    assert each(spark, ["machine learning and sales"], analysis.topics_by_keyword) == [["Machine Learning", "Sales"]]
    assert each(spark, ["The most important thing is this. No. key"], analysis.insights_by_keyword) == [["The most important thing is this"]]


def test_categories(spark):
    got = each(spark, ["Python and Docker for technology", "nothing here", None], categories.by_keywords)
    assert got[0]["primary"] == "Technology" and got[1]["primary"] == "Other" and got[2]["secondary"] == []
    assert each(spark, ["python", "Entertainment", "", None, "zzz", "Statistics"], categories.normalise) == ["Python", "AI", "Other", "Other", "Other", "Statistics"]
    placed = categories.places(spark.createDataFrame([(1, "Statistics"), (2, "Business"), (3, "zzz")], "k int, c string"), "c", "k").collect()
    assert sorted((r["k"], r["main"], r["kind"]) for r in placed) == [(1, "Science", "parent"), (1, "Technology", "parent"), (2, "Business", "main")]


def test_tags(spark):
    arr = "v array<string>"
    assert each(spark, [["C++", "ci/cd", "The", "Machine Learning", "machine learning", "x" * 31], [], None], tags.clean, arr) == [["cicd", "machine-learning"], [], None]
    assert each(spark, ["javascript", "zzz", "io", None], tags.category) == ["language", "general", "methodology", None]
    assert each(spark, [["python", "javascript", "web"]], tags.hierarchy, arr) == [{"python": ["javascript"]}]
    assert each(spark, [["colour", "color", "zebra"], None, []], lambda c: tags.merge_similar(c), arr) == [["color", "zebra"], None, []]
    got = each(spark, ["Visit https://docs.site.io/x About #Rust and python", "", None], tags.by_keywords)
    assert {"visit", "about", "rust", "docs"} <= set(got[0]) and got[1] == [] == got[2]


def plain_tag_candidates(text):
    import re

    from linkloom import vocab

    found = re.findall(r"\b[A-Z][a-z]+\b", text) + [k for ks in vocab.TAG_VOCABULARY.values() for k in ks if k.lower() in text.lower()]
    found += [re.findall(r"://([^/]+)", u)[0].split(".")[0] for u in re.findall(r"https?://[^\s]+", text) if re.findall(r"://([^/]+)", u)]
    return found + re.findall(r"#(\w+)", text)


def test_tag_candidates_against_plain_version(spark):
    texts = ["Learn Python at https://docs.a.io/x today #DevOps", "éFoo Bar baz", "An Api IoT guide http://b.c", ""]
    assert each(spark, texts, tags.candidates) == [plain_tag_candidates(t) for t in texts]


def test_threads(spark):
    rows = [(1, 0, "ann", "First thread post", 1, 2, 3), (1, 1, "ann", "", 0, None, 0), (1, 2, "ann", "The end, finally. Follow me", 5, 5, 5), (2, 0, None, "Alone", None, None, None)]
    df = spark.createDataFrame(rows, "thread_id int, pos int, author string, content string, replies int, retweets int, likes int")
    df = df.withColumn("hashtags", T.hashtags(F.col("content"))).withColumn("mentions", F.lit(None).cast("array<string>"))
    got = {r["thread_id"]: r for r in threads.assemble(df).collect()}
    assert got[1]["content"] == "1. First thread post\n\n3. The end, finally. Follow me" and got[1]["total_retweets"] == 7
    assert got[2]["title"] == "Tweet by Unknown" and got[2]["content"] == "Alone" and got[2]["mentions"] == []
    summary = {r["thread_id"]: r for r in threads.summary(threads.assemble(df)).collect()}
    assert summary[1]["most_engaged_pos"] == 2 and summary[2]["most_engaged_pos"] is None
    s = threads.assemble(df).select("thread_id", threads.structure(F.col("tweets"), F.col("content")).alias("s")).where("thread_id = 1").first()["s"]
    assert s["has_introduction"] and s["has_conclusion"] and s["has_numbered_points"] and s["has_call_to_action"]
    assert threads.assemble(df.limit(0)).count() == 0


def test_parse_analysis(spark):
    text = "**Main Topics**\n- A: b\n- C\n**Author Expertise**\nLevel: Expert\n**Relevance Score**\nScore: 42/10"
    got = one(spark, "r string, o string", (text, "a tutorial"), responses.parse_analysis(F.col("r"), F.col("o")))
    assert got["main_topics"] == ["A: b", "C"] and got["author_expertise"] == "Expert" and got["relevance_score"] == 10.0 and got["content_type"] == "Tutorial"
    line = "- **Author Expertise**: Expert\n- **Relevance Score**: abc"
    strict = one(spark, "r string, o string", (line, ""), responses.parse_analysis(F.col("r"), F.col("o")))
    inline = one(spark, "r string, o string", (line, ""), responses.parse_analysis(F.col("r"), F.col("o"), True))
    assert strict["author_expertise"] == "Unknown" and inline["author_expertise"] == "Expert" and inline["relevance_score"] == 5.0
    assert one(spark, "r string, o string", (None, None), responses.parse_analysis(F.col("r"), F.col("o")))["relevance_score"] == 5.0


def test_parse_categories_and_tags(spark):
    text = "**Primary Category**\nCategory: python\n**Secondary Categories**\n- cloud\n- Growth: no\n- Python\n**Confidence Score**\nConfidence: 8/10"
    got = one(spark, "r string, o string", (text, ""), responses.parse_categories(F.col("r"), F.col("o")))
    assert (got["primary"], got["secondary"], got["confidence"], got["method"]) == ("Python", ["Cloud"], 8.0, "response")
    fell = one(spark, "r string, o string", ("nothing", "docker and sales"), responses.parse_categories(F.col("r"), F.col("o")))
    assert fell["method"] == "keywords" and fell["primary"] == "Business"
    cases = {"**Tags**\n- api\n- The\n**Tag Confidence**\napi: 9 sure": ["api"], "alpha, beta, c": ["alpha", "beta"], "alpha\nbeta gamma\na b c d": ["alpha", "beta-gamma"]}
    for response, want in cases.items():
        assert one(spark, "r string, o string", (response, ""), responses.parse_tags(F.col("r"), F.col("o")))["tags"] == want


def test_requests_round_trip(spark):
    df = spark.createDataFrame([('he said "hi"\nü',)], "t string")
    for provider, path in (("claude", "$.messages[0].content"), ("grok", "$.messages[1].content"), ("gemini", "$.contents[0].parts[0].text")):
        assert df.select(F.get_json_object(responses.request_json(provider, "m", F.col("t"), "s"), path).alias("x")).first()["x"] == 'he said "hi"\nü'
    assert df.select(responses.response_text("claude", F.lit("broken")).alias("x")).first()["x"] is None


def plain_limiter(rows, per, most, seconds):
    kept, out = [], []
    for t, a in rows:
        now = [(x, y) for x, y in kept if t - x < seconds]
        ok = len(now) < per and sum(y for _, y in now) + a <= most
        if ok:
            kept.append((t, a))
        out.append(ok)
    return out


def test_limiter_against_plain_version(spark):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(1)
    at, rows = 0, []
    for i in range(300):
        at += rng.choice([1, 5, 20, 61, 200])
        rows.append((i, "k", datetime(2024, 1, 1) + timedelta(seconds=at), float(rng.randrange(1, 50)), at))
    df = spark.createDataFrame(rows, "i int, k string, ts timestamp_ntz, v double, s int")
    got = [r["admitted"] for r in state.admitted(df, "k", "ts", "i", "v", 4, 100.0).orderBy("i").collect()]
    assert got == plain_limiter([(r[4], r[3]) for r in rows], 4, 100.0, 60)


def test_state(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, "b", 2), (4, None, 0)], "n int, id string, o int")
    assert sorted(r["n"] for r in state.first_seen(df, "id", ["o"]).collect()) == [2, 3]
    assert sorted(r["n"] for r in state.unprocessed(df, df.where("id = 'a'"), "id").collect()) == [3, 4]
    assert [r["n"] for r in state.beyond_newest(df.where("id = 'a'"), "id", "o", "n", 1).collect()] == [2]
    numbers = state.batch_number(spark.range(25).withColumnRenamed("id", "n"), "n", 10)
    assert sorted((r["batch"] for r in numbers.collect())) == [0] * 10 + [1] * 10 + [2] * 5


def test_merging_against_plain_version(spark):
    """A tag that no earlier one has taken leads; it takes all that are like it, and the shortest stands for them."""
    rng = random.Random(4)
    stems = ["color", "colour", "colours", "react", "reactjs", "react-js", "Reacts", "zebra", "zebras", "py", "python", "pythons"]
    rows = [[rng.choice(stems) for _ in range(rng.randrange(9))] for _ in range(200)]

    def plain(row):
        left, out = list(dict.fromkeys(row)), []
        while left:
            first = left[0]
            like = [t for t in left if t == first or difflib.SequenceMatcher(None, first.lower(), t.lower()).ratio() >= 0.8]
            out.append(sorted(like, key=len)[0])
            left = [t for t in left if t not in like]
        return out

    df = spark.createDataFrame(list(enumerate(rows)), "i int, t array<string>")
    got = {r["i"]: r["m"] for r in df.select("i", tags.merge_similar("t").alias("m")).collect()}
    assert got == {i: plain(r) for i, r in enumerate(rows)}


def limiter(requests, per_window, most, seconds):
    kept, out = [], []
    for t, a in requests:
        kept = [(u, b) for u, b in kept if t - u < seconds]
        ok = len(kept) < per_window and sum(b for _, b in kept) + a <= most
        kept += [(t, a)] * ok
        out.append(ok)
    return out


def test_hot_keys(spark):
    """One key has a third of the rows; results are those of plain versions."""
    rng = random.Random(9)
    t0 = datetime(2024, 3, 1)
    rows = [(i, None if i % 3 == 0 else f"k{rng.randrange(20)}", t0 + timedelta(seconds=rng.randrange(4000) + (9000 if i % 2 else 0)), float(rng.randrange(1, 30))) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, k string, ts timestamp, v double")
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    pruned = {r["i"] for r in state.beyond_newest(df, "k", "ts", "i", 5).collect()}
    assert pruned == {r[0] for own in by.values() for r in sorted(own, key=lambda r: (r[2], r[0]))[:-5]}
    newest = {r["k"]: (r["i"], r["v"]) for r in state.latest(df, "k", "ts", "i").collect()}
    assert newest == {k: (m[0], m[3]) for k, own in by.items() for m in [max(own, key=lambda r: (r[2], r[0]))]}
    used = {r["i"]: (r["requests"], r["used"]) for r in state.window_usage(df, "k", "ts", "v", 60).collect()}
    for own in by.values():
        for r in own:
            inside = [x for x in own if 0 <= (r[2] - x[2]).total_seconds() < 60]
            assert used[r[0]] == (len(inside), pytest.approx(sum(x[3] for x in inside)))
    got = {r["i"]: r["admitted"] for r in state.admitted(df, "k", "ts", "i", "v", 3, 60.0, 60).collect()}
    for own in by.values():
        own = sorted(own, key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in own] == limiter([((r[2] - t0).total_seconds(), r[3]) for r in own], 3, 60.0, 60)


def test_names_of_categories_have_a_bound(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Alpha beta"), (2, None)], "i int, t string")
    names = spark.createDataFrame([("m", "alpha", 2), ("m", "BETA", 3), (None, "x", 1), ("m", "", 9)], "main string, name string, weight int")
    assert [tuple(r) for r in categories.category_matches(df, "i", "t", names).collect()] == [(1, "m", 5)]
    monkeypatch.setattr(categories, "MAX_NAMES", 1)
    with pytest.raises(ValueError, match="more than 1 names"):
        categories.category_matches(df, "i", "t", names)


def test_statistics_of_nothing(spark):
    got = tags.statistics(spark.createDataFrame([], "tags array<string>")).first().asDict()
    assert got == {"total_tagged": 0, "average_tags_per_item": None, "total_unique_tags": 0, "average_confidence": None}
    two = tags.statistics(spark.createDataFrame([(["python", "x", "x"],), (None,)], "tags array<string>")).first()
    assert (two["total_tagged"], two["total_unique_tags"], two["average_confidence"], two["average_tags_per_item"]) == (2, 2, 6.5, 1.5)
