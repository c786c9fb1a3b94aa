"""Base views of the queries, each one SQL text that Spark and DuckDB run unchanged.

The stored records seldom hold addresses of known platforms, hashtags, markup or words of the vocabularies, so the views
add fixed pieces chosen by the record's number. They cover whole tables. A table is written as @name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..runtime import spread, table

_URLS = [
    "'https://twitter.com/' || coalesce(author, 'someone') || '/status/' || CAST(7000000 + bm_seq AS VARCHAR(20))",
    "'https://x.com/i/thread/' || CAST(bm_seq AS VARCHAR(20)) || '?s=20#top'",
    "'https://www.youtube.com/watch?v=abcdefg' || CAST(1000 + bm_seq % 9000 AS VARCHAR(20)) || '&t=10'",
    "'https://youtu.be/ABCDEF-' || CAST(1000 + bm_seq % 9000 AS VARCHAR(20))",
    "'https://vimeo.com/' || CAST(100000 + bm_seq AS VARCHAR(20))",
    "'https://www.netflix.com/title/' || CAST(bm_seq AS VARCHAR(20))",
    "'https://x.com/' || coalesce(author, 'someone')",
    "'http://localhost:8080/a/b;v=1?q=x#f'",
    "'ftp://files.example/get/' || CAST(bm_seq AS VARCHAR(20)) || '.tar.gz'",
    "'https://www.twitch.tv/videos/' || CAST(bm_seq AS VARCHAR(20))",
    "'https://www.tiktok.com/@a/video/' || CAST(bm_seq AS VARCHAR(20))",
    "'https://bad_host.example/x.EXE'",
    "'mailto:someone'",
    "'https://www.dailymotion.com/video/x' || CAST(bm_seq AS VARCHAR(20))",
]
_TEXTS = [
    "' An excellent and useful tutorial on Python and Machine Learning. The most important idea is a simple overview. #python #ml'",
    "' RT @lena a terrible and frustrating review of the new framework. Thanks @max. See https://docs.tool.example/start'",
    "' @sam thread 1/3 about startup growth, marketing strategy and funding. To be continued...'",
    "' News: an advanced algorithm and architecture for cloud infrastructure with Docker and Kubernetes. ci/cd #DevOps'",
    "' Research study on nutrition and fitness, with good advice for mental health &amp; wellness. '",
    "' My thoughts on leadership and productivity; retweeted by many. Key points matter most here. '",
    "' Live stream of the gaming session, a basic beginner guide to Go and Rust. IoT, saas, b2b '",
    "' How to cook: travel tips, photography and culture. Part 1 of a series, see below. '",
]


def _cases(by: str, n: int, values: list[str], other: str) -> str:
    return f"CASE {by} % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {other} END"


BOOKMARKS = f"""SELECT bm_seq, id, title, coalesce(author, '') AS author, created_at, metadata, bookmark_type AS stored_type, feed_id, ingested_at,
{_cases("bm_seq", 20, _URLS, "url")} AS url, coalesce(content, '') || {_cases("bm_seq", 11, _TEXTS, "''")} AS content FROM @bookmarks"""

_HEADS = [
    """'<meta name="description" content="About ' || coalesce(title, '') || '"><META property="og:image" content="https://img.example/1.png">'""",
    """'<meta name="author" content="' || coalesce(author, '') || '"><meta name="keywords" content="a, b"><meta property="og:title" content="OG ' || coalesce(title, '') || '">'""",
    """'<meta content="wrong order" name="description"><meta property="og:description" content="Described: ' || coalesce(title, '') || ' &amp; more">'""",
    """'<meta name="twitter:creator" content="@creator"><meta property="article:published_time" content="2024-03-0' || CAST(1 + extract_id % 9 AS VARCHAR(20)) || 'T10:00:00Z">'""",
]
_BODIES = [
    """'<div data-testid="User-Names"><span>@' || coalesce(author, 'nobody') || '</span></div><div data-testid="tweetText">Post on <b>' || coalesce(title, '') || '</b> #tag' || CAST(extract_id % 5 AS VARCHAR(20)) || ' @you</div><div data-testid="reply"><span>' || CAST(extract_id % 7 AS VARCHAR(20)) || '</span></div><div data-testid="retweet">' || CAST(extract_id % 11 AS VARCHAR(20)) || '</div><div data-testid="like">' || CAST(extract_id % 13 AS VARCHAR(20)) || '</div><img src="https://pbs.twimg.com/m/' || CAST(extract_id AS VARCHAR(20)) || '.jpg"><img src="/local.png">'""",
    """'<script>var d = {"title":"' || coalesce(title, '') || ' - YouTube","description":{"simpleText":"All about it"},"author":"Channel ' || coalesce(author, '') || '","lengthSeconds":"' || CAST(extract_id % 9000 AS VARCHAR(20)) || '","viewCount":"' || CAST(extract_id * 3 AS VARCHAR(20)) || '","keywords":["Science","how to"],"category":"Education","likes":{"simpleText":"1.2K"},"thumbnails":[{"url":"https://i.example/t.jpg"}],"publishDate":"2023-01-02"}</script>'""",
    """'<script>{"name":"Maker ' || coalesce(author, '') || '","duration":' || CAST(extract_id % 500 AS VARCHAR(20)) || '}</script><time datetime="2022-05-06">May</time>'""",
    """'<style>p { color: red } </style><script>var x = "</p>";</script><a href="https://x.com/linked?y=1">a</a>'""",
]
PAGES = f"""SELECT extract_id, site, coalesce(title, '') AS title, coalesce(author, '') AS author,
'https://' || CASE extract_id % 4 WHEN 0 THEN 'x.com/a/status/' WHEN 1 THEN 'www.youtube.com/watch?v=abcdefghijk&n=' WHEN 2 THEN 'vimeo.com/' ELSE 'page.example/' END || CAST(extract_id AS VARCHAR(20)) AS url,
'<html><head>' || CASE WHEN extract_id % 5 < 4 THEN '<title> ' || coalesce(title, '') || ' / X</title>' ELSE '' END || {_cases("extract_id", 7, _HEADS, "''")} || '</head><body>' || {_cases("extract_id", 4, _BODIES, "''")}
|| '<p class="x">' || replace(coalesce(content, ''), chr(10), '</p><P>') || '</p>&nbsp;&copy; end</body></html>' AS html FROM @extracted_content"""

POSTS = f"""SELECT bm_seq, CAST(floor(bm_seq / 4) AS BIGINT) AS thread_id, bm_seq % 4 AS pos, CASE WHEN author = '' THEN 'someone' ELSE author END AS author,
CASE WHEN bm_seq % 9 = 5 THEN '' ELSE content END AS content, bm_seq % 7 AS replies, CASE WHEN bm_seq % 3 = 0 THEN NULL ELSE bm_seq % 11 END AS retweets, bm_seq % 13 * (bm_seq % 2) AS likes FROM ({BOOKMARKS}) AS bm"""

RECORDS = """SELECT proc_id, min(bookmark.id) AS id, min(bookmark.url) AS url, min(bookmark.title) AS title, min(bookmark.author) AS author, min(bookmark.created_at) AS created_at,
min(analysis_results.relevance_score) AS relevance_score, min(analysis_results.word_count) AS word_count, min(analysis_results.reading_time_minutes) AS reading_time_minutes,
min(analysis_results.content_type) AS content_type, min(analysis_results.complexity_level) AS complexity_level, min(processed_at) AS processed_at, min(processing_time) AS processing_time,
min(categories) AS categories, min(tags) AS tags, min(analysis_results.main_topics) AS main_topics, min(analysis_results.key_insights) AS key_insights FROM @processed_bookmarks GROUP BY proc_id"""

# Stored contents are shorter than the limits of the formats; three times the content is longer than some.
KB = f"""SELECT r.*, b.bookmark_type, b.metadata, b.content || ' ' || b.content || ' ' || b.content AS content FROM ({RECORDS}) AS r
LEFT JOIN (SELECT id AS bid, min(content) AS content, min(bookmark_type) AS bookmark_type, min(metadata) AS metadata FROM @bookmarks GROUP BY id) AS b ON r.id = b.bid"""

_ANSWERS = [
    "'**Main Topics**' || chr(10) || '- Databases' || chr(10) || '- Good tools' || chr(10) || '**Key Insights**' || chr(10) || '  - Indexes: matter' || chr(10) || '**Author Expertise**' || chr(10) || 'Level: Expert' || chr(10) || '**Relevance Score**' || chr(10) || 'Score: ' || CAST(response_id % 14 AS VARCHAR(20)) || '/10'",
    "'- **Main Topics**: one, two' || chr(10) || '- **Author Expertise**: Expert' || chr(10) || '- **Relevance Score**: abc' || chr(10) || 'Note: high' || chr(10) || 'A simple overview'",
    "'**Primary Category**' || chr(10) || 'Category: python' || chr(10) || '**Secondary Categories**' || chr(10) || '- cloud' || chr(10) || '- Growth: no' || chr(10) || '- entertainment' || chr(10) || '**Confidence Score**' || chr(10) || 'Confidence: 8/10'",
    "'**Tags**' || chr(10) || '- C++' || chr(10) || '- Machine Learning' || chr(10) || '- the' || chr(10) || '- api' || chr(10) || '- api' || chr(10) || '**Tag Confidence**' || chr(10) || 'api: 9 sure' || chr(10) || 'machine-learning: bad'",
]
ANSWERS = f"""SELECT response_id, step, model, processing_time, usage, {_cases("response_id", 6, _ANSWERS, "content")} AS answer, content AS original FROM @llm_responses"""

EVENTS = "SELECT event_id, user_id, ts, event_type, value FROM @events"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view over the tables of a directory, in Spark."""
    for name in sorted(set(re.findall(r"@(\w+)", re.sub(r"'[^']*'", "", sql)))):
        spread(table(spark, sf_dir, name)).createOrReplaceTempView(f"linkloom_{name}")
        sql = re.sub(rf"(FROM|JOIN) @{name}\b", rf"\1 linkloom_{name}", sql)
    return spark.sql(sql)


def plain(sql: str) -> str:
    """The same view for an engine that has the tables under their own names."""
    return re.sub(r"(FROM|JOIN) @(\w+)", r"\1 \2", sql)
