"""Files written and read again, and streams against batches."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from linkloom import settings
from linkloom.operators import knowledge, responses
from linkloom.plans import pipeline
from linkloom.plans.pipeline import enrich, process
from linkloom.sinks import files
from linkloom.sources import bookmarks
from linkloom.streaming import incremental, windows

ROWS = [{"id": str(i), "url": f"https://e.com/{i}", "title": f"t{i}", "content": f"A good tutorial {i} on Python #tag{i}", "author": "ann", "metadata": {"n": i}} for i in range(12)]


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ROWS[:3], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"bookmarks": ROWS[3:5]}))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text("[]")
    got = bookmarks.read_json(spark, str(tmp_path)).orderBy("id").collect()
    assert [r["id"] for r in got] == ["0", "1", "2", "3", "4"] and json.loads(got[0]["metadata"]) == {"n": 0}


def _lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_fetch_keeps_failures_as_data(spark):
    def transport(u):
        if "bad" in u:
            raise ValueError("no")
        return f"<p>{u}</p>"

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "k int, url string")
    got = {r["k"]: (r["html"], r["error"]) for r in bookmarks.fetch(df, "k", "url", transport).collect()}
    assert got == {1: ("<p>good</p>", None), 2: (None, "ValueError: no"), 3: (None, "no address")}


def test_retry():
    calls = []

    def flaky(u):
        calls.append(u)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    waits = []
    assert bookmarks.retrying(flaky, wait=waits.append)("u") == "ok" and len(calls) == 3 and waits == [1.0, 2.0]


def test_transports():
    answers, waits = [(429, ""), (200, "page"), (500, "gone"), (429, ""), (429, "")], []
    call = bookmarks.retrying(bookmarks.checked(lambda u: answers.pop(0)), attempts=2, wait=waits.append)
    assert call("https://a.example/x") == "page" and waits == [1.0]
    with pytest.raises(bookmarks.HttpError, match="HTTP 500: gone"):
        call("https://a.example/x")
    with pytest.raises(bookmarks.HttpError, match="HTTP 429"):
        call("https://a.example/x")
    with pytest.raises(ValueError, match="Invalid URL"):
        call("ftp://a.example/x")
    clock = [0.0]
    slow = bookmarks.throttled(lambda u: str(clock[0]), 2, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    assert [slow("u") for _ in range(5)] == ["0.0", "0.0", "60.0", "60.0", "120.0"]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefghijkl"), (3, "bad"), (4, None)], "k int, t string")
    got = bookmarks.token_counts(df, "k", "t", lambda t: {"abcdefgh": "5", "abcdefghijkl": "many"}[t])
    assert {r["k"]: r["tokens"] for r in got.collect()} == {1: 5, 2: 3, 3: 0, 4: 0}


def test_pages_and_posts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, url string")
    pages = spark.createDataFrame([("a", "<p>one</p>"), ("a", "<p>one</p>"), (None, "x")], "url string, html string")
    assert {r["k"]: r["html"] for r in bookmarks.from_pages(df, pages).collect()} == {1: "<p>one</p>", 2: None, 3: None}
    got = bookmarks.posted(df, "k", "url", lambda body: body.upper())
    assert got.columns == ["k", "response", "error"] and {r["k"]: r["response"] for r in bookmarks.fetched_only(got).collect()} == {1: "A", 2: "B"}


def test_sinks(spark, tmp_path):
    _lines(tmp_path / "in", "a.json", ROWS)
    df = enrich(bookmarks.read_json_lines(spark, str(tmp_path / "in"))).withColumns({"key_insights": F.array(F.lit("x")), "processing_time": F.lit(0.5), "created_at": F.lit("2024-01-01")})
    done = files.write_knowledge_base(df, str(tmp_path / "kb"), ("json", "csv", "markdown", "training", "nonsense"))
    assert set(done) == {"json", "csv", "markdown", "training", "statistics"}
    assert spark.read.json(done["json"] + "/bookmarks").count() == 12 and spark.read.json(done["json"] + "/metadata").first()["total_bookmarks"] == 12
    assert spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(done["csv"]).count() == 12
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(done["markdown"]).collect())
    assert text.count("### t") == 12 and text.startswith("# Knowledge Base\n\nGenerated on: 2") and "Total bookmarks: 12" in text
    assert text.index("## Table of Contents") < text.index("- [Technology](#technology)") < text.index("## Technology\n") < text.index("### t0")
    assert [text.index(f"### t{i}\n") for i in (0, 1, 10, 11, 2)] == sorted(text.index(f"### t{i}\n") for i in (0, 1, 10, 11, 2))  # by id
    header = spark.read.option("header", True).csv(done["csv"]).columns
    assert header == ["id", "title", "url", "author", "content", "bookmark_type", "categories", "tags", "created_at", "processed_at", "processing_time", "metadata", "analysis_results"]
    files.write_markdown(df.withColumn("at", 100 - F.col("id").cast("int")), str(tmp_path / "md"), "By number", "at")
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(str(tmp_path / "md")).collect())
    assert [text.index(f"### t{i}\n") for i in (11, 10, 9, 2, 1)] == sorted(text.index(f"### t{i}\n") for i in range(12) if i in (11, 10, 9, 2, 1))
    stats = {(r["kind"], r["value"]): r["n"] for r in spark.read.json(done["statistics"]).collect()}
    assert stats["authors", "ann"] == 12 and stats["processing_times", "total"] == 6.0
    assert not files.write_training(df.limit(10), str(tmp_path / "few"))


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    _lines(tmp_path / "in", "a.json", ROWS[:6] + ROWS[:1])
    incremental.start(spark, source, target, state).awaitTermination()
    first = spark.read.parquet(target).count()
    incremental.start(spark, source, target, state).awaitTermination()
    assert spark.read.parquet(target).count() == first == 6
    _lines(tmp_path / "in", "b.json", ROWS[5:])
    incremental.start(spark, source, target, state).awaitTermination()
    batch = process(bookmarks.read_json_lines(spark, source), ["id"])
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == sorted(r["id"] for r in batch.collect())
    again = process(bookmarks.read_json_lines(spark, source), ["id"], spark.read.parquet(target).select("id"))
    assert again.count() == 0


def test_partitioning_changes_nothing(spark, tmp_path):
    _lines(tmp_path / "in", "a.json", ROWS)
    df = bookmarks.read_json_lines(spark, str(tmp_path / "in"))
    a, b = (sorted(map(str, process(df.repartition(n), ["id"], options=pipeline.Options(now="2024-01-01")).collect())) for n in (1, 8))
    assert a == b


def test_windows(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 10,0) AS ts, id % 2 AS u FROM range(12)")
    assert sorted(r["n"] for r in windows.windowed(df, "ts", "1 hour", "1 hour").collect()) == [6, 6]
    assert windows.windowed(df, "ts", "1 hour", "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 24
    assert windows.sessions(df, "ts", "15 minutes", "1 hour", "u").count() == 12


def test_outcomes_route_and_keep_what_went_wrong(spark):
    post = '<div data-testid="User-Names"><span>@lena</span></div><div data-testid="tweetText">A <b>useful</b> post about Python</div><time datetime="2024-05-06T07:08:09Z"></time>'
    tube = '<script>{"title":"Cooking - YouTube","description":{"simpleText":"How to cook"},"author":"Chef","publishDate":"2023-01-02"}</script>'
    rows = [
        ("1", "https://x.com/a/status/1", "given", "own text", "", "", post), ("2", "https://www.youtube.com/watch?v=abcdefghijk", "given", "", "", "", tube), ("3", "https://site.example/x", "given", "good tutorial", "ann", "2020-01-01", "<p>not read</p>"),
        ("4", "https://site.example/y", "given", " ", "ann", "", None), ("5", "nonsense", "given", "text", "ann", "", None), ("6", "https://x.com/a/status/6", "given", "own text", "ann", "", None), ("1", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, url string, title string, content string, author string, created_at string, html string")
    got = {r["id"] + str(r["url"]): r for r in pipeline.outcomes(df).collect()}
    by = {k: (r["status"], r["bookmark_type"], r["content"], r["author"]) for k, r in got.items()}
    assert by["1https://x.com/a/status/1"] == ("successful", "tweet", "A useful post about Python", "lena")
    assert by["2https://www.youtube.com/watch?v=abcdefghijk"] == ("successful", "video", "How to cook", "Chef")
    assert by["3https://site.example/x"] == ("successful", "general", "good tutorial", "ann") and by["6https://x.com/a/status/6"][2] == "own text"
    assert got["2https://www.youtube.com/watch?v=abcdefghijk"]["created_at"].startswith("2023-01-02") and got["4https://site.example/y"]["created_at"].startswith("20")
    assert by["4https://site.example/y"][0] == "failed" and by["5nonsense"][0] == "skipped" and got["4https://site.example/y"]["tags"] is None
    wrong = {(r["id"], r["status"]): r["errors"] for r in pipeline.rejected(df).collect()}
    assert wrong["4", "failed"] == ["Content cannot be empty"] and wrong["5", "skipped"] and len(wrong) == 3
    seen, counts = pipeline.observed(pipeline.outcomes(df))
    seen.write.format("noop").mode("overwrite").save()
    assert counts.get == {"total_processed": 7, "successful": 4, "failed": 1, "skipped": 2}
    assert pipeline.enrich(df.drop("html", "created_at")).count() == 3 and pipeline.outcomes(df.limit(0)).count() == 0


def test_exports(spark):
    df = spark.createDataFrame([("1", None)], "id string, title string")
    assert knowledge.exported(df).first()["value"] == '{"id":"1","title":null}'
    with pytest.raises(NotImplementedError):
        knowledge.exported(df, "csv")
    with pytest.raises(ValueError, match="Unsupported"):
        knowledge.exported(df, "xml")
    assert knowledge.csv_rows(df).columns == list(knowledge.COLUMNS)


def test_request_bodies(spark):
    df = spark.createDataFrame([("hi \"there\"",)], "p string")
    body = lambda *a, **k: json.loads(df.select(responses.request_json(*a, **k).alias("j")).first()["j"])
    picture = F.array(F.struct(F.lit("image/png").alias("media_type"), F.lit("QUJD").alias("data")))
    got = body("claude", "m", F.col("p"), None, tools=[{"name": "t"}], tool_choice={"type": "auto"}, images=picture)
    assert "system" not in got and got["tools"] == [{"name": "t"}] and got["tool_choice"] == {"type": "auto"}
    assert got["messages"][0]["content"] == [{"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "QUJD"}}, {"type": "text", "text": 'hi "there"'}]
    assert body("claude", "m", F.col("p"), "s")["messages"] == [{"role": "user", "content": 'hi "there"'}]
    grok = body("grok", "m", F.col("p"), "s", response_format={"type": "json_object"})
    assert grok["response_format"] == {"type": "json_object"} and [x["role"] for x in grok["messages"]] == ["system", "user"] and "top_p" not in grok
    gemini = body("gemini", "m", F.col("p"), "s", stop=["END"])
    assert gemini["contents"] == [{"parts": [{"text": 'hi "there"'}]}] and gemini["generationConfig"]["stopSequences"] == ["END"] and len(gemini["safetySettings"]) == 4
    assert body("gemini", "m", F.col("p"), None, images=picture)["contents"][0]["parts"][0] == {"inline_data": {"mime_type": "image/png", "data": "QUJD"}}
    for provider, more in (("grok", {"images": picture}), ("claude", {"response_format": {}}), ("other", {})):
        with pytest.raises(ValueError):
            responses.request_json(provider, "m", F.col("p"), "s", **more)


def test_settings(spark, tmp_path):
    good = {"app": {"name": "a", "version": "1", "environment": "test"}, "logging": {"level": "INFO"}, "database": {"type": "sqlite"}, "processing": {"batch_size": 10}}
    assert settings.check_settings(good) == {"is_valid": True, "errors": [], "warnings": [], "metadata": {"section_count": 4}}
    bad = settings.check_settings({"app": {"name": "a"}, "logging": {"level": "LOUD"}, "database": {"type": "files"}, "processing": {"batch_size": 0, "max_workers": "4"}})
    assert bad["errors"] == ["Missing app configuration field: version", "Missing app configuration field: environment", "Invalid logging level: LOUD", "Invalid database type: files", "Processing batch_size must be a positive integer", "Processing max_workers must be a positive integer"]
    assert settings.check_settings([])["errors"] == ["Configuration must be a dictionary"] and len(settings.check_settings({})["errors"]) == 4
    assert settings.check_settings({**good, "app": 1})["errors"] == ["App configuration must be a dictionary"]
    (tmp_path / "test.json").write_text(json.dumps(good))
    (tmp_path / "broken.json").write_text("{")
    assert settings.read_settings(str(tmp_path), "test") == good and settings.read_settings(str(tmp_path), "broken") == {} == settings.read_settings(str(tmp_path), "none")
    path = settings.check_path(str(tmp_path / "test.json"), True, [".json"])
    assert path["is_valid"] and path["metadata"]["is_file"] and path["metadata"]["extension"] == ".json"
    assert settings.check_path("")["errors"] == ["File path must be a non-empty string"] and settings.check_path(str(tmp_path))["warnings"]
    assert len(settings.check_path(str(tmp_path / "no.txt"), True, [".json"])["errors"]) == 2
    assert settings.choose_provider(["a", "b"], "b") == "b" and settings.choose_provider(["a", "b"], "x", "b") == "b" and settings.choose_provider(["a", "b"], "x", "y") == "a"
    with pytest.raises(ValueError):
        settings.choose_provider([])
    assert settings.model_info("claude", {})["known"] and not settings.model_info("grok", {"model": "other", "api_key": "k"})["known"]
    for name, size in (("app.log", 5), ("app.log.1", 7), ("app.log.2", 1), ("other.log", 9)):
        (tmp_path / "logs").mkdir(exist_ok=True)
        (tmp_path / "logs" / name).write_text("x" * size)
    assert tuple(settings.log_statistics(spark, str(tmp_path / "logs"), "app.log").first()) == (5, 2, 8)
    assert [r["size_bytes"] for r in settings.listed_files(spark, str(tmp_path / "logs")).collect()] == [5, 7, 1, 9]


def test_stream_that_forgets(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    _lines(tmp_path / "in", "a.json", ROWS[:4] + ROWS[:2])
    incremental.start(spark, source, target, state, forget_after="1 hour").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == ["0", "1", "2", "3"]
