"""The core's queries. Each stands beside the SQL that gives the same rows, where SQL can express it.

A query reads a base view (plans.views) or a table and applies one operator to all of its rows. Arrays leave a query as
text joined by bars, so that engines that order or print arrays differently agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from ..functions import urls as U
from ..operators import analysis as A
from ..operators import categories as C
from ..operators import knowledge as K
from ..operators import pages as P
from ..operators import responses as R
from ..operators import state as S
from ..operators import tags as G
from ..operators import threads as H
from ..operators import validate as V
from ..runtime import table
from ..streaming.windows import sessions, windowed
from . import pipeline, views
from .views import ANSWERS, BOOKMARKS, EVENTS, KB, PAGES, POSTS, RECORDS, plain, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
col = F.col


def add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = plain(sql)


def project(name: str, base: str, key: str, *columns: tuple[str, Column | Callable[[], Column], str], where: str = "TRUE") -> None:
    """A query of columns over a base view: (name, Spark expression, SQL). Expressions are made when the query runs, as
    they need a session."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return view(spark, d, base).where(where).select(key, *[c().alias(n) for n, c, _ in columns])

    add(name, run, f"WITH b AS ({base}) SELECT {key}, " + ", ".join(f"{q} AS {n}" for n, _, q in columns) + f" FROM b WHERE {where}")


# SQL pieces

W = r"[\s\p{Z}]"


def lit(w: str) -> str:
    return "'" + w.replace("'", "''") + "'"


def q_any(c: str, words: Iterable[str]) -> str:
    return "coalesce(" + " OR ".join(f"contains({c}, {lit(w)})" for w in words) + ", false)"


def q_hits(c: str, words: Iterable[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, {lit(w)}) AS INTEGER)" for w in words) + ")"


def q_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"


def q_squeeze(c: str) -> str:
    return f"regexp_replace({c}, '{W}+', ' ', 'g')"


def q_words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{W}+'), lambda x: x <> '')"


def q_join(c: str) -> str:
    return f"array_to_string({c}, '|')"


def q_some(items: Iterable[str]) -> str:
    """A list of the items that aren't null."""
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def q_match(c: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({c}, {lit(pattern)}, {group}), '')"


def q_first(c: str, patterns: Iterable[str]) -> str:
    return "coalesce(" + ", ".join(q_match(c, p) for p in patterns) + ")"


def q_sorted(c: str) -> str:
    return f"list_sort(list_distinct({c}))"


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


def long(c: Column) -> Column:
    return c.cast("bigint")


# Addresses and routes

_P = U._PARTS
q_host = "lower(regexp_extract(url, " + lit(_P) + ", 2))"
q_route = "CASE WHEN url IS NULL THEN NULL WHEN contains(url, 'twitter.com') OR contains(url, 'x.com') THEN CASE WHEN contains(url, '/status/') THEN 'tweet' WHEN contains(url, '/thread/') THEN 'thread' END WHEN contains(url, 'youtube.com') OR contains(url, 'youtu.be') THEN 'video' ELSE 'general' END"
project("bookmark_type", BOOKMARKS, "bm_seq", ("type", lambda: U.bookmark_type(col("url")), q_route))
project("extractor_route", BOOKMARKS, "bm_seq", ("route", lambda: U.extractor_route(col("url")), f"CASE WHEN contains({q_host}, 'twitter.com') OR contains({q_host}, 'x.com') THEN 'twitter' WHEN contains({q_host}, 'youtube.com') OR contains({q_host}, 'youtu.be') THEN 'youtube' ELSE 'generic' END"))
project(
    "url_parts", BOOKMARKS, "bm_seq", ("scheme", lambda: U.scheme(col("url")), f"lower(regexp_extract(url, {lit(_P)}, 1))"), ("netloc", lambda: U.netloc(col("url")), f"regexp_extract(url, {lit(_P)}, 2)"),
    ("path", lambda: U.path(col("url")), f"regexp_replace(regexp_extract(url, {lit(_P)}, 3), ';[^/]*$', '')"), ("params", lambda: U.params(col("url")), f"regexp_extract(regexp_extract(url, {lit(_P)}, 3), ';([^/]*)$', 1)"),
    ("query", lambda: U.query(col("url")), f"regexp_extract(url, {lit(_P)}, 4)"), ("fragment", lambda: U.fragment(col("url")), f"regexp_extract(url, {lit(_P)}, 5)"),
)
q_domain = f"regexp_matches(split_part({q_host}, ':', 1), {lit(U.DOMAIN)})"
project("url_domain_valid", BOOKMARKS, "bm_seq", ("valid", lambda: U.domain_valid(F.lower(U.netloc(col("url")))), q_domain))
project("is_twitter_url", BOOKMARKS, "bm_seq", ("twitter", lambda: U.is_twitter(col("url")), f"coalesce({q_host} IN ({', '.join(map(lit, vocab.TWITTER_HOSTS))}), false)"))
q_platform = "CASE " + " ".join(f"WHEN {q_any(q_host, hosts)} THEN {lit(p)}" for p, hosts in vocab.PLATFORMS) + " END"
project("video_platform", BOOKMARKS, "bm_seq", ("platform", lambda: U.platform(col("url")), q_platform))
project("tweet_id", BOOKMARKS, "bm_seq", ("tweet_id", lambda: U.tweet_id(col("url")), q_match("url", "/status/([0-9]+)")))
_KEY = "([a-zA-Z0-9_-]{11})"
project("youtube_id", BOOKMARKS, "bm_seq", ("video_id", lambda: U.youtube_id(col("url")), q_first("url", [rf"(?:youtube\.com/watch\?v=|youtu\.be/){_KEY}", rf"youtube\.com/embed/{_KEY}", rf"youtube\.com/v/{_KEY}"])))

# Checks

q_u = q_strip("url")
q_scheme, q_net = f"lower(regexp_extract({q_u}, {lit(_P)}, 1))", f"lower(regexp_extract({q_u}, {lit(_P)}, 2))"
q_url_errors = f"CASE WHEN url IS NULL OR url = '' THEN ['URL must be a non-empty string'] ELSE " + q_some([
    f"CASE WHEN {q_scheme} = '' THEN 'URL missing scheme (http/https)' END", f"CASE WHEN {q_scheme} <> '' AND {q_scheme} NOT IN ({', '.join(map(lit, vocab.SCHEMES))}) THEN 'Invalid URL scheme: ' || {q_scheme} END",
    f"CASE WHEN {q_net} = '' THEN 'URL missing domain' END", f"CASE WHEN {q_net} <> '' AND NOT regexp_matches(split_part({q_net}, ':', 1), {lit(U.DOMAIN)}) THEN 'Invalid domain format: ' || {q_net} END",
]) + " END"
q_url_warnings = "CASE WHEN url IS NULL OR url = '' THEN CAST([] AS VARCHAR[]) ELSE " + q_some([
    f"CASE WHEN {q_any(q_net, vocab.BLOCKED)} THEN 'URL points to local/blocked domain: ' || {q_net} END", *[f"CASE WHEN regexp_matches({q_u}, {lit('(?i)' + p)}) THEN {lit('URL contains suspicious pattern: ' + p)} END" for p in vocab.SUSPICIOUS],
    f"CASE WHEN length({q_u}) > 2000 THEN 'URL is very long (>2000 characters)' END",
]) + " END"
project(
    "url_validate", BOOKMARKS, "bm_seq", ("is_valid", lambda: V.check_url(col("url"))["is_valid"], f"len({q_url_errors}) = 0"), ("errors", lambda: joined(V.url_errors(col("url"))), q_join(q_url_errors)),
    ("warnings", lambda: joined(V.url_warnings(col("url"))), q_join(q_url_warnings)), ("url_length", lambda: long(F.length(T.strip(col("url")))), f"CAST(length({q_u}) AS BIGINT)"), ("is_secure", lambda: U.scheme(T.strip(col("url"))) == "https", f"{q_scheme} = 'https'"),
)
_FIELDS = ["id", "url", "title", "content", "author", "created_at", "metadata"]
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
q_iso = f"CASE WHEN regexp_full_match(created_at, {lit(_ISO)}) THEN try_cast(replace(regexp_replace(created_at, '(Z|[+-]\\d{{2}}:?\\d{{2}})$', ''), ',', '.') AS TIMESTAMP) END"
q_own = q_some(
    [f"CASE WHEN coalesce({f} = '', true) THEN 'Required field is empty: {f}' END" for f in ("id", "title", "url")] + ["CASE WHEN coalesce(id = '', true) THEN 'ID must be a non-empty string' END", "CASE WHEN title IS NULL THEN 'Title must be a string' END", f"CASE WHEN coalesce(created_at <> '' AND ({q_iso}) IS NULL, false) THEN 'Invalid created_at date format' END"]
)
q_errors = f"list_concat({q_own}, list_transform({q_url_errors}, lambda e: 'URL validation: ' || e))"
q_limits = q_some([f"CASE WHEN length({f}) > {n} THEN {lit(m)} END" for f, n, m in (("id", 100, "ID is very long (>100 characters)"), ("title", 500, "Title is very long (>500 characters)"), ("content", 50000, "Content is very long (>50,000 characters)"))])
q_warnings = f"list_concat(list_transform({q_url_warnings}, lambda w: 'URL validation: ' || w), {q_limits})"


def checked(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, BOOKMARKS).select("bm_seq", *_FIELDS)
    return V.check_bookmarks(b, (*_FIELDS, "bm_seq"))


def _fields(df: DataFrame) -> DataFrame:
    c = col("checked")
    return df.select("bm_seq", c["is_valid"].alias("is_valid"), joined(c["errors"]).alias("errors"), joined(c["warnings"]).alias("warnings"))


CHECKED_SQL = f"WITH b AS ({BOOKMARKS}), c AS (SELECT *, {q_errors} AS errs, {q_warnings} AS warns FROM b) "
add("bookmark_validate", lambda s, d: _fields(checked(s, d)), CHECKED_SQL + f"SELECT bm_seq, len(errs) = 0 AS is_valid, {q_join('errs')} AS errors, {q_join('warns')} AS warnings FROM c")
add("bookmark_facts", lambda s, d: view(s, d, BOOKMARKS).select("bm_seq", F.inline(F.array(V.bookmark_facts(view(s, d, BOOKMARKS).select(*_FIELDS))))), f"WITH b AS ({BOOKMARKS}) SELECT bm_seq, {' + '.join(f'CAST({f} IS NOT NULL AS INTEGER)' for f in _FIELDS)} AS field_count, coalesce(content <> '', false) AS has_content, coalesce(author <> '', false) AS has_author FROM b")
add("valid_bookmarks", lambda s, d: V.valid_bookmarks(view(s, d, BOOKMARKS)).select("bm_seq", "url"), CHECKED_SQL + "SELECT bm_seq, url FROM c WHERE len(errs) = 0")
add("validation_summary", lambda s, d: V.summarise(checked(s, d)), CHECKED_SQL + "SELECT count(*) AS total_items, count(*) FILTER (len(errs) = 0) AS valid_items, count(*) FILTER (len(errs) > 0) AS invalid_items, count(*) FILTER (len(warns) > 0) AS items_with_warnings FROM c")
for _name, _sql in (("common_errors", "errs"), ("common_warnings", "warns")):
    add(_name, lambda s, d, f=_name[7:]: V.common(checked(s, d), col("checked")[f]), CHECKED_SQL + f"SELECT m AS message, count(*) AS n FROM (SELECT unnest({_sql}) AS m FROM c) GROUP BY m ORDER BY n DESC, m LIMIT 10")
_USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")
q_resp = q_some(
    [f"CASE WHEN {f} IS NULL THEN 'Missing required field: {f}' END" for f in ("content", "model", "usage")] + [f"CASE WHEN {q_strip('content')} = '' THEN 'Content is empty' END"] + [f"CASE WHEN usage.{f} < 0 THEN 'Usage field {f} must be a non-negative integer' END" for f in _USAGE]
    + [f"CASE WHEN {q_strip('model')} = '' THEN 'Model must be a non-empty string' END", "CASE WHEN processing_time < 0 THEN 'Processing time must be a non-negative number' END"]
)
add(
    "llm_response_validate", lambda s, d: table(s, d, "llm_responses").select("response_id", V.check_response(col("content"), col("usage"), col("model"), col("processing_time")).alias("c"), long(V.response_word_count(col("content"))).alias("word_count")).select("response_id", col("c")["is_valid"].alias("is_valid"), joined(col("c")["errors"]).alias("errors"), joined(col("c")["warnings"]).alias("warnings"), "word_count"),
    f"SELECT response_id, len({q_resp}) = 0 AS is_valid, {q_join(q_resp)} AS errors, CASE WHEN processing_time > 300 THEN 'Processing time is very high (>5 minutes)' ELSE '' END AS warnings, CASE WHEN {q_strip('content')} <> '' THEN CAST(len({q_words('content')}) AS BIGINT) END AS word_count FROM llm_responses",
)
_SHAPES = (
    """'{"content": "some text", "model": "m", "usage": {"total_tokens": ' || coalesce(CAST(usage.total_tokens AS VARCHAR(20)), '"x"') || '}, "processing_time": 400.5}'""", """'{"content": 5, "model": " ", "usage": [1]}'""",
    """'{"usage": {"prompt_tokens": 1.5, "completion_tokens": -1}, "processing_time": -2}'""", """'[1, 2]'""", """'{broken'""", """'{"content": " ", "model": null, "usage": {}, "processing_time": "fast"}'""",
)
SHAPED = f"SELECT response_id, CASE response_id % 6 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_SHAPES))} END AS j FROM @llm_responses"
_TYPE = lambda path: f"json_type(v, '$.{path}')"
_TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")
q_shape = q_some(
    [f"CASE WHEN v IS NOT NULL AND {_TYPE(n)} IS NULL THEN 'Missing required field: {n}' END" for n in ("content", "model", "usage")]
    + [f"CASE WHEN {_TYPE('content')} <> 'VARCHAR' THEN 'Content must be a string' END", f"CASE WHEN {_TYPE('content')} = 'VARCHAR' AND trim(v ->> '$.content') = '' THEN 'Content is empty' END", f"CASE WHEN {_TYPE('usage')} <> 'OBJECT' THEN 'Usage must be a dictionary' END"]
    + [f"CASE WHEN {_TYPE('usage')} = 'OBJECT' AND {_TYPE('usage.' + n)} IS NOT NULL AND NOT ({_TYPE('usage.' + n)} IN ('UBIGINT', 'BIGINT') AND try_cast(v ->> '$.usage.{n}' AS DOUBLE) >= 0) THEN 'Usage field {n} must be a non-negative integer' END" for n in _TOKENS]
    + [f"CASE WHEN {_TYPE('model')} IS NOT NULL AND ({_TYPE('model')} <> 'VARCHAR' OR trim(v ->> '$.model') = '') THEN 'Model must be a non-empty string' END"]
    + [f"CASE WHEN {_TYPE('processing_time')} IS NOT NULL AND NOT ({_TYPE('processing_time')} IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND coalesce(try_cast(v ->> '$.processing_time' AS DOUBLE) >= 0, false)) THEN 'Processing time must be a non-negative number' END"]
)
add(
    "llm_response_json_validate", lambda s, d: view(s, d, SHAPED).select("response_id", V.check_response_json(col("j")).alias("c")).select("response_id", col("c")["is_valid"].alias("is_valid"), joined(col("c")["errors"]).alias("errors"), joined(col("c")["warnings"]).alias("warnings")),
    f"WITH b AS ({SHAPED}), o AS (SELECT response_id, CASE WHEN json_valid(j) THEN CASE WHEN json_type(j) = 'OBJECT' THEN j END END AS v FROM b), e AS (SELECT response_id, CASE WHEN v IS NULL THEN ['LLM response must be a dictionary'] ELSE {q_shape} END AS errs, CASE WHEN {_TYPE('processing_time')} IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND try_cast(v ->> '$.processing_time' AS DOUBLE) > 300 THEN 'Processing time is very high (>5 minutes)' ELSE '' END AS warnings FROM o) SELECT response_id, len(errs) = 0 AS is_valid, array_to_string(errs, '|') AS errors, warnings FROM e",
)
_NEEDED = ["source", "tags", "reading_time"]
q_keys = "CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' THEN json_keys(metadata) ELSE CAST([] AS VARCHAR[]) END"
add("json_structure", lambda s, d: table(s, d, "bookmarks").select("bm_seq", joined(V.json_missing(col("metadata"), _NEEDED)).alias("missing")), f"SELECT bm_seq, {q_join(f'list_filter({_NEEDED}, lambda r: NOT list_contains({q_keys}, r))')} AS missing FROM bookmarks")

# Text functions

project("clean_text", BOOKMARKS, "bm_seq", ("cleaned", lambda: T.clean_text(col("content")), f"regexp_replace({q_squeeze(q_strip('content'))}, '&[a-zA-Z0-9#]+;', '', 'g')"))
project("word_count", BOOKMARKS, "bm_seq", ("words", lambda: long(T.word_count(col("content"))), f"CAST(len({q_words('content')}) AS BIGINT)"), ("minutes", lambda: A.reading_minutes(col("content")), f"len({q_words('content')}) / 200.0::DOUBLE"))
project("token_estimate", BOOKMARKS, "bm_seq", ("by_length", lambda: long(T.tokens_by_length(col("content"))), "CAST(floor(length(content) / 4) AS BIGINT)"), ("by_words", lambda: long(T.tokens_by_words(col("content"))), f"CAST(floor(len({q_words('content')}) * 1.3::DOUBLE) AS BIGINT)"))
project("slug", BOOKMARKS, "bm_seq", ("slug", lambda: T.slug(col("title")), "replace(lower(title), ' ', '-')"))
project("content_hash", BOOKMARKS, "bm_seq", ("hash", lambda: F.sha2(F.concat_ws("|", "id", "content"), 256), "sha256(concat_ws('|', id, content))"))
project("build_prompt", BOOKMARKS, "bm_seq", ("prompt", lambda: R.prompt("tags", col("content")), f"replace({lit(R.PROMPTS['tags'][1])}, '{{content}}', content)"))
q_size = "CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GB', n / 1073741824.0::DOUBLE) END"
add("human_size", lambda s, d: view(s, d, BOOKMARKS).select("bm_seq", T.human_size(col("bm_seq") * col("bm_seq") * 74 + 1).alias("size")), f"SELECT bm_seq, {q_size} AS size FROM (SELECT bm_seq, bm_seq * bm_seq * 74 + 1 AS n FROM bookmarks)")
add("date_format", lambda s, d: view(s, d, BOOKMARKS).select("bm_seq", F.date_format("ingested_at", "yyyy-MM-dd").alias("day")), "SELECT bm_seq, strftime(ingested_at, '%Y-%m-%d') AS day FROM bookmarks")
project("format_duration", PAGES, "extract_id", ("duration", lambda: P.format_duration(col("extract_id") * 7), "CASE WHEN extract_id * 7 >= 3600 THEN printf('%d:%02d:%02d', (extract_id * 7) // 3600, (extract_id * 7) % 3600 // 60, (extract_id * 7) % 60) ELSE printf('%d:%02d', (extract_id * 7) % 3600 // 60, (extract_id * 7) % 60) END"))

# Pages, posts and videos

_SCRIPTS = (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>")


def q_no_scripts(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, {lit(_SCRIPTS[0])}, '', 'g'), {lit(_SCRIPTS[1])}, '', 'g')"


def q_clean(c: str) -> str:
    return f"regexp_replace({q_squeeze(q_strip(c))}, '&[a-zA-Z0-9#]+;', '', 'g')"


def q_tags(c: str) -> str:
    return f"regexp_replace({c}, '<[^>]+>', '', 'g')"


def q_decode(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"


def q_meta(a: str, k: str) -> str:
    p = rf"(?i)<meta[^>]*{a}={P.Q}{k}{P.Q}[^>]*content={P.Q}([^\"']*){P.Q}"
    return f"CASE WHEN regexp_matches(html, {lit(p)}) THEN regexp_extract(html, {lit(p)}, 1) END"


project("html_title", PAGES, "extract_id", ("title", lambda: P.page_title(col("html")), q_clean(f"coalesce({q_match('html', '(?i)<title>([^<]+)</title>')}, '')")))
project("html_text", PAGES, "extract_id", ("body", lambda: P.page_text(col("html")), q_clean(q_tags(f"array_to_string(regexp_extract_all({q_no_scripts('html')}, {lit('(?is)<p[^>]*>(.*?)</p>')}, 1), ' ')"))))
project("html_meta", PAGES, "extract_id", *[(k.replace("og:", "og_"), lambda k=k: P.meta_map(col("html"))[k], q_meta(a, k)) for a, k in P.META_KEYS])
project("clean_html", PAGES, "extract_id", ("cleaned", lambda: T.clean_html(col("html")), q_strip(q_squeeze(f"replace({q_decode(q_tags(q_no_scripts('html')))}, '&nbsp;', ' ')"))))
q_tweet_text = q_match("html", rf"(?s)<div[^>]*data-testid={P.Q}tweetText{P.Q}[^>]*>(.*?)</div>")
project(
    "tw_simple", PAGES, "extract_id", ("title", lambda: P.simple_post(col("html"))["title"], q_clean(f"CASE WHEN length(coalesce({q_tweet_text}, '')) > 100 THEN left({q_tweet_text}, 100) || '...' ELSE coalesce({q_tweet_text}, '') END")),
    ("content", lambda: P.simple_post(col("html"))["content"], q_clean(f"coalesce({q_tweet_text}, '')")), ("author", lambda: P.simple_post(col("html"))["author"], f"coalesce({q_match('html', '<span[^>]*>@([^<]+)</span>')}, '')"),
)
q_post_texts = ", ".join(q_strip(q_squeeze(q_decode(q_tags(q_strip(q_match("html", p)))))) for p in P.POST_TEXTS)
q_post_content = f"coalesce(list_filter([{q_post_texts}], lambda t: length(t) > 10)[1], '')"
q_post_title = f"coalesce(replace(replace({q_squeeze(q_strip(q_first('html', P.POST_TITLES)))}, ' / X', ''), ' / Twitter', ''), 'Tweet')"
q_post_author = f"coalesce(regexp_replace({q_strip(q_first('html', P.POST_AUTHORS))}, '^@+', ''), '')"
project("tweet_fields", PAGES, "extract_id", ("title", lambda: P.post_title(col("html")), q_post_title), ("content", lambda: P.post_text(col("html")), q_post_content), ("author", lambda: P.post_author(col("html")), q_post_author))
q_enhanced = f"CASE WHEN t = 'Tweet' AND length(c) > 0 THEN 'Tweet by ' || a || ': ' || left(c, 50) || CASE WHEN length(c) > 50 THEN '...' ELSE '' END ELSE t END"
add("tweet_enhance", lambda s, d: view(s, d, PAGES).select("extract_id", P.better_post_title(P.post_title(col("html")), P.post_text(col("html")), P.post_author(col("html"))).alias("title")), f"WITH b AS ({PAGES}), x AS (SELECT extract_id, {q_post_title} AS t, {q_post_content} AS c, {q_post_author} AS a FROM b) SELECT extract_id, {q_enhanced} AS title FROM x")
q_count = lambda w: f"try_cast({q_match('html', rf'(?is)<div[^>]*data-testid={P.Q}{w}{P.Q}[^>]*>.*?([0-9]+)')} AS BIGINT)"
q_media = "list_filter(list_concat(" + ", ".join(f"regexp_extract_all(html, {lit(rf'<{t}[^>]*src={P.Q}([^\"' + chr(39) + rf']+){P.Q}')}, 1)" for t in ("img", "video")) + "), lambda u: contains(u, 'pbs.twimg.com') OR contains(u, 'video.twimg.com'))"
_UW = r"([\p{L}\p{M}\p{N}\p{Pc}]+)"
project(
    "tweet_html_meta", PAGES, "extract_id", *[(f"{w}_count", lambda w=w: P.post_count(col("html"), w), q_count(w)) for w in ("reply", "retweet", "like")],
    ("hashtags", lambda: joined(P.post_metadata(col("html"))["hashtags"]), q_join(q_sorted(f"regexp_extract_all(html, '#{_UW}', 1)"))), ("mentions", lambda: joined(P.post_metadata(col("html"))["mentions"]), q_join(q_sorted(f"regexp_extract_all(html, '@{_UW}', 1)"))), ("media", lambda: joined(P.post_media(col("html"))), q_join(q_media)),
)
q_dates = "coalesce(" + ", ".join(f"try_cast(replace({q_match('html', p)}, 'Z', '') AS TIMESTAMP)" for p in P.POST_DATES) + ")"
project("published_date", PAGES, "extract_id", ("published", lambda: F.date_format(P.post_date(col("html")), "yyyy-MM-dd HH:mm:ss"), f"strftime({q_dates}, '%Y-%m-%d %H:%M:%S')"))
for _name, _fn, _patterns in (("youtube", P.youtube_date, P.YT_DATES), ("other", P.video_date, P.VIDEO_DATES)):
    q_video_date = "coalesce(" + ", ".join(f"try_cast(replace({q_match('html', p)}, 'Z', '') AS TIMESTAMP)" for p in _patterns) + ")"
    project(f"video_date_{_name}", PAGES, "extract_id", ("published", lambda f=_fn: F.date_format(f(col("html")), "yyyy-MM-dd HH:mm:ss"), f"strftime({q_video_date}, '%Y-%m-%d %H:%M:%S')"))
_COUNTS = (("replies", "reply"), ("retweets", "retweet"), ("likes", "like"))
project("tweet_engagement", PAGES, "extract_id", ("engagement", lambda: joined(F.transform(F.array_sort(F.map_entries(P.engagement_counts(P.post_metadata(col("html"))))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), "nullif(array_to_string([x for x in [" + ", ".join(f"'{n}=' || ({q_count(w)})" for n, w in sorted(_COUNTS)) + "] if x IS NOT NULL], '|'), '')"))
_EMBED = "'{\"author_name\": \"Someone\", \"html\": \"<p>Embedded ' || extract_id || '</p>\"}'"
project(
    "tweet_or_embed", PAGES, "extract_id", *[(f, lambda f=f: P.scraped_or_embedded(col("html"), F.expr(_EMBED))[f], q) for f, q in (
        ("title", f"CASE WHEN length({q_post_content}) > 0 THEN {q_post_title} ELSE 'Someone' END"), ("content", f"CASE WHEN length({q_post_content}) > 0 THEN {q_post_content} ELSE 'Embedded ' || extract_id END"),
        ("author", f"CASE WHEN length({q_post_content}) > 0 THEN {q_post_author} ELSE 'Someone' END"), ("extraction_method", f"CASE WHEN length({q_post_content}) > 0 THEN 'web_scraping' ELSE 'oembed' END"),
    )],
)
project("is_retweet", POSTS, "bm_seq", ("retweet", lambda: P.is_retweet(col("content")), "starts_with(content, 'RT @') OR contains(lower(content), 'retweeted')"))
project("is_reply", POSTS, "bm_seq", ("reply", lambda: P.is_reply(col("content")), "starts_with(content, '@') OR contains(lower(content), 'replying to')"))
for _name, _mark, _fn in (("hashtags", "#", T.hashtags), ("mentions", "@", T.mentions)):
    project(_name, POSTS, "bm_seq", (_name, lambda f=_fn: joined(P.all_marks(F.array(F.lit("own")), f(col("content")))), q_join(f"list_sort(list_distinct(list_concat(['own'], regexp_extract_all(content, '{_mark}{_UW}', 1))))")))
project("tweet_metrics", POSTS, "bm_seq", ("total", lambda: P.engagement(col("replies"), col("retweets"), col("likes"))["total_engagement"], "CAST(coalesce(replies, 0) + coalesce(retweets, 0) + coalesce(likes, 0) AS BIGINT)"))
_OEMBED = "to_json(struct(title as author_name, concat('<p>', title, ' &amp; <b>x</b></p><script>y</script>') as html, 'Posts' as provider_name))"
add("oembed_fields", lambda s, d: view(s, d, PAGES).select("extract_id", F.inline(F.array(P.embed(F.expr(_OEMBED))))), f"WITH b AS ({PAGES}) SELECT extract_id, title, {q_strip(q_squeeze(q_decode(chr(39) + chr(39) + ' || title || ' + lit(' &amp; x'))))} AS content, title AS author, 'Posts' AS provider_name FROM b")

q_yt_title = q_squeeze(f"replace({q_strip(q_first('html', P.YT_TITLES))}, ' - YouTube', '')")
project(
    "yt_fields", PAGES, "extract_id", ("title", lambda: P.youtube(col("html"))["title"], f"coalesce({q_yt_title}, 'YouTube Video')"), ("content", lambda: P.youtube(col("html"))["content"], f"coalesce({q_squeeze(q_strip(q_first('html', P.YT_TEXTS)))}, '')"),
    ("author", lambda: P.youtube(col("html"))["author"], f"coalesce({q_strip(q_first('html', P.YT_AUTHORS))}, '')"),
)
project("yt_simple", PAGES, "extract_id", ("title", lambda: P.simple_youtube(col("html"))["title"], q_clean(f"coalesce({q_match('html', '<title>([^<]+)</title>')}, '')")), ("content", lambda: P.simple_youtube(col("html"))["content"], q_clean(f"coalesce({q_match('html', chr(34) + 'description' + chr(34) + ':[{]' + chr(34) + 'simpleText' + chr(34) + ':' + chr(34) + '([^' + chr(34) + ']+)' + chr(34))}, '')")))


def q_duration(n: str) -> str:
    return f"CASE WHEN {n} IS NULL THEN NULL WHEN {n} >= 3600 THEN printf('%d:%02d:%02d', {n} // 3600, {n} % 3600 // 60, {n} % 60) ELSE printf('%d:%02d', {n} % 3600 // 60, {n} % 60) END"


q_len = f"try_cast({q_match('html', r'\"lengthSeconds\":\"([0-9]+)\"')} AS BIGINT)"
project(
    "yt_meta", PAGES, "extract_id", ("seconds", lambda: P.youtube_metadata(col("html"))["duration_seconds"], q_len), ("duration", lambda: P.youtube_metadata(col("html"))["duration_formatted"], q_duration(q_len)),
    ("views", lambda: P.youtube_metadata(col("html"))["view_count"], f"try_cast({q_match('html', r'\"viewCount\":\"([0-9]+)\"')} AS BIGINT)"), ("likes", lambda: P.youtube_metadata(col("html"))["like_count_text"], q_match("html", r'"likes":\{"simpleText":"([^"]+)"\}')),
    ("category", lambda: P.youtube_metadata(col("html"))["category"], q_match("html", r'"category":"([^"]+)"')), ("tags", lambda: joined(P.youtube_metadata(col("html"))["tags"]), q_join(f"regexp_extract_all(coalesce({q_match('html', r'\"keywords\":\[([^\]]+)\]')}, ''), '\"([^\"]+)\"', 1)")),
    ("thumbnail", lambda: P.youtube_metadata(col("html"))["thumbnail_url"], q_match("html", r'"thumbnails":\[\{"url":"([^"]+)"')),
)
q_vlen = f"try_cast({q_match('html', r'\"duration\":([0-9]+)')} AS BIGINT)"
project(
    "vimeo_meta", PAGES, "extract_id", ("video_id", lambda: P.vimeo(col("html"), col("url"))["video_id"], q_match("url", r"vimeo\.com/([0-9]+)")), ("author", lambda: P.vimeo(col("html"), col("url"))["author"], f"coalesce({q_strip(q_first('html', (r'(?i)\"name\":\"([^\"]+)\"', r'(?i)<meta property=\"video:actor\" content=\"([^\"]+)\"')))}, '')"),
    ("seconds", lambda: P.vimeo(col("html"), col("url"))["duration_seconds"], q_vlen), ("duration", lambda: P.vimeo(col("html"), col("url"))["duration_formatted"], q_duration(q_vlen)),
)
project(
    "generic_video", PAGES, "extract_id", ("title", lambda: P.any_video(col("html"))["title"], f"coalesce({q_squeeze(q_strip(q_first('html', P.VIDEO_TITLES)))}, 'Video')"), ("content", lambda: P.any_video(col("html"))["content"], f"coalesce({q_squeeze(q_strip(q_first('html', P.VIDEO_TEXTS)))}, '')"),
    ("author", lambda: P.any_video(col("html"))["author"], f"coalesce({q_strip(q_first('html', P.VIDEO_AUTHORS))}, '')"),
)
project(
    "video_enhance", PAGES, "extract_id", ("title", lambda: P.better_video_title(P.any_video(col("html"))["title"], P.any_video(col("html"))["author"]), f"CASE WHEN coalesce({q_first('html', P.VIDEO_TITLES)}, 'Video') = 'Video' AND length(coalesce({q_strip(q_first('html', P.VIDEO_AUTHORS))}, '')) > 0 THEN 'Video by ' || {q_strip(q_first('html', P.VIDEO_AUTHORS))} ELSE coalesce({q_squeeze(q_strip(q_first('html', P.VIDEO_TITLES)))}, 'Video') END"),
    ("minutes", lambda: P.watch_minutes(P.youtube_metadata(col("html"))["duration_seconds"]), f"CASE WHEN {q_len} > 0 THEN round_even({q_len} / 60.0::DOUBLE, 1) END"),
)
project(
    "video_metrics", PAGES, "extract_id", *[(n, lambda n=n: P.video_metrics(U.platform(col("url")), P.youtube_metadata(col("html"))["duration_seconds"], P.youtube_metadata(col("html"))["view_count"])[n], q) for n, q in (
        ("platform", f"coalesce({q_platform}, 'unknown')"), ("duration_seconds", f"coalesce({q_len}, 0)"), ("duration_formatted", f"coalesce({q_duration(q_len)}, '0:00')"), ("watch_time_minutes", f"coalesce(CASE WHEN {q_len} > 0 THEN round_even({q_len} / 60.0::DOUBLE, 1) END, 0.0::DOUBLE)"))],
)
project("is_live", BOOKMARKS, "bm_seq", ("live", lambda: P.is_live(col("title"), col("content")), f"{q_any('lower(title)', vocab.LIVE)} OR {q_any('lower(content)', vocab.LIVE)}"))
project("is_short_form", BOOKMARKS, "bm_seq", ("short", lambda: P.is_short(U.platform(col("url")), col("bm_seq") % 200, col("title")), f"coalesce({q_platform} = 'tiktok', false) OR coalesce({q_platform} = 'youtube' AND bm_seq % 200 BETWEEN 1 AND 60, false) OR {q_any('lower(title)', vocab.SHORT)}"))
q_names = lambda c, names: q_some([f"CASE WHEN {q_any(c, words)} THEN {lit(n)} END" for n, words in names.items()])
project("video_topics", BOOKMARKS, "bm_seq", ("topics", lambda: joined(P.video_topics(F.array(F.lit("Own")), col("title"), col("content"))), q_join(f"list_sort(list_distinct(list_concat(['own'], {q_names(chr(40) + 'lower(coalesce(title, ' + lit('') + ')) || ' + lit(' ') + ' || lower(content))', vocab.VIDEO_TOPICS)})))")))
project("video_quality", PAGES, "extract_id", ("score", lambda: P.video_quality(P.any_video(col("html"))["content"], P.youtube_metadata(col("html"))["thumbnail_url"], P.youtube_metadata(col("html"))["tags"], P.youtube_metadata(col("html"))["like_count_text"], P.youtube_metadata(col("html"))["duration_seconds"]), f"round_even((CAST(coalesce({q_first('html', P.VIDEO_TEXTS)}, '') <> '' AS INTEGER) + 3 * CAST(contains(html, '\"thumbnails\"') AS INTEGER) + CAST(coalesce({q_len} <= 0 OR {q_len} BETWEEN 30 AND 10800, true) AS INTEGER)) / 5.0::DOUBLE * 100, 1)"))
project(
    "extract_fallback", BOOKMARKS, "bm_seq", ("tweet_title", lambda: P.fallback("tweet", col("url"), col("content"), col("author"))["title"], f"'Tweet ' || coalesce({q_match('url', '/status/([0-9]+)')}, '')"),
    ("video_title", lambda: P.fallback("video", col("url"), col("content"), col("author"))["title"], f"'Video from ' || coalesce({q_platform}, 'Unknown')"),
)

# Threads

project("is_self_reply", POSTS, "bm_seq", ("self_reply", lambda: H.is_self_reply(col("content"), col("author")), "author <> '' AND contains(content, '@' || author)"))
project("is_thread", POSTS, "bm_seq", ("thread", lambda: H.is_thread(col("content"), col("author")), f"{q_any('lower(content)', vocab.THREAD_MARKS)} OR (author <> '' AND contains(content, '@' || author)) OR regexp_matches(content, '\\b[0-9]+/([0-9]+\\b|\\b)')"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, POSTS)
    return p.withColumn("hashtags", T.hashtags(col("content"))).withColumn("mentions", T.mentions(col("content")))


def threads(spark: SparkSession, d: str) -> DataFrame:
    return H.assemble(posts(spark, d))


add("thread_numbering", lambda s, d: H.numbered(view(s, d, POSTS), "thread_id", "pos").select("bm_seq", long(col("number")).alias("number")), f"WITH p AS ({POSTS}) SELECT bm_seq, row_number() OVER (PARTITION BY thread_id ORDER BY pos) AS number FROM p")
THREADS_SQL = f"""WITH p AS ({POSTS}), r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY thread_id) AS n FROM p),
t AS (SELECT thread_id, arg_min(author, pos) AS author, max(n) AS n, coalesce(string_agg(CASE WHEN n > 1 THEN k || '. ' || content ELSE content END, chr(10) || chr(10) ORDER BY pos) FILTER (content <> ''), '') AS content,
CAST(sum(coalesce(replies, 0)) AS BIGINT) AS total_replies, CAST(sum(coalesce(retweets, 0)) AS BIGINT) AS total_retweets, CAST(sum(coalesce(likes, 0)) AS BIGINT) AS total_likes, CAST(sum(length(content)) AS BIGINT) AS chars,
arg_min(pos, (-(replies + coalesce(retweets, 0) + likes)) * 10 + pos) FILTER (replies + coalesce(retweets, 0) + likes > 0) AS best, list_sort(list_distinct(flatten(list(regexp_extract_all(content, '#{_UW}', 1))))) AS hashtags,
list_sort(list_distinct(flatten(list(regexp_extract_all(content, '@{_UW}', 1))))) AS mentions, arg_min(content, pos) AS first_content, arg_max(content, pos) AS last_content, bool_or({q_any('lower(content)', vocab.CALLS)}) AS calls FROM r GROUP BY thread_id) """
add("thread_assemble", lambda s, d: threads(s, d).select("thread_id", "author", "title", "content", long(col("thread_length")).alias("thread_length")), THREADS_SQL + "SELECT thread_id, author, CASE WHEN n > 1 THEN 'Twitter Thread by ' || author || ' (' || n || ' tweets)' ELSE 'Tweet by ' || author END AS title, content, n AS thread_length FROM t")
add("thread_engagement", lambda s, d: threads(s, d).select("thread_id", "total_replies", "total_retweets", "total_likes", joined(col("hashtags")).alias("hashtags"), joined(col("mentions")).alias("mentions")), THREADS_SQL + "SELECT thread_id, total_replies, total_retweets, total_likes, array_to_string(hashtags, '|') AS hashtags, array_to_string(mentions, '|') AS mentions FROM t")
add("thread_summary", lambda s, d: H.summary(threads(s, d)).select("thread_id", "total_characters", "average_characters", "most_engaged_pos", long(col("hashtags_count")).alias("hashtags_count"), "estimated_reading_time"), THREADS_SQL + "SELECT thread_id, chars AS total_characters, round_even(chars::DOUBLE / n, 1) AS average_characters, best AS most_engaged_pos, CAST(len(hashtags) AS BIGINT) AS hashtags_count, round_even(chars / 1000.0::DOUBLE, 1) AS estimated_reading_time FROM t")
add("thread_topics", lambda s, d: threads(s, d).select("thread_id", joined(H.topics(col("hashtags"), col("content"))).alias("topics")), THREADS_SQL + f"SELECT thread_id, {q_join('list_sort(list_distinct(list_concat(hashtags, ' + q_names('lower(content)', vocab.THREAD_TOPICS) + ')))')} AS topics FROM t")
add("thread_complete", lambda s, d: threads(s, d).select("thread_id", H.is_complete(col("tweets")).alias("complete")), THREADS_SQL + f"SELECT thread_id, NOT {q_any('lower(last_content)', vocab.CONTINUES)} AS complete FROM t")
add("thread_structure", lambda s, d: threads(s, d).select("thread_id", F.inline(F.array(H.structure(col("tweets"), col("content"))))).withColumn("total_tweets", long(col("total_tweets"))), THREADS_SQL + f"SELECT thread_id, n AS total_tweets, {q_any('lower(first_content)', vocab.INTRODUCES)} AS has_introduction, n > 1 AND {q_any('lower(last_content)', vocab.CONCLUDES)} AS has_conclusion, regexp_matches(content, '[0-9]+\\.\\s') AS has_numbered_points, calls AS has_call_to_action FROM t")
q_points = f"list_filter(list_transform(string_split_regex(content, '\\n\\n[0-9]+\\.\\s*'), lambda p: {q_strip('p')}), lambda p: length(p) > 20)"
add("thread_key_points", lambda s, d: threads(s, d).select("thread_id", joined(H.key_points(col("content"))).alias("points")), THREADS_SQL + f"SELECT thread_id, {q_join(f'list_filter(list_transform({q_points}, lambda p: ' + q_strip('split_part(p, ' + lit('.') + ', 1)') + '), lambda p: p <> ' + lit('') + ')[1:10]')} AS points FROM t")

# Keyword analysis

q_more = lambda c, a, b, names: f"CASE WHEN {q_hits(c, a)} > {q_hits(c, b)} THEN '{names[0]}' WHEN {q_hits(c, b)} > {q_hits(c, a)} THEN '{names[1]}' ELSE '{names[2]}' END"
q_sentiment = q_more("lower(content)", vocab.POSITIVE, vocab.NEGATIVE, ("Positive", "Negative", "Neutral"))
q_complexity = q_more("lower(content)", vocab.COMPLEX, vocab.SIMPLE, ("High", "Low", "Medium"))
q_kind = "CASE " + " ".join(f"WHEN {q_any('lower(content)', words)} THEN '{n}'" for n, words in vocab.CONTENT_TYPES) + " ELSE 'Article' END"
project("sentiment", BOOKMARKS, "bm_seq", ("sentiment", lambda: A.sentiment(col("content")), q_sentiment))
project("complexity", BOOKMARKS, "bm_seq", ("complexity", lambda: A.complexity(col("content")), q_complexity))
project("content_type", BOOKMARKS, "bm_seq", ("content_type", lambda: A.content_type(col("content")), q_kind))
q_topics = q_some([f"CASE WHEN contains(lower(content), {lit(w)}) THEN {lit(w.title())} END" for w in vocab.TECH_TOPICS + vocab.BUSINESS_TOPICS])
project("topics_fallback", BOOKMARKS, "bm_seq", ("topics", lambda: joined(A.topics_by_keyword(col("content"))), q_join(f"({q_topics})[1:5]")))
q_sentences = f"list_transform(string_split(content, '.'), lambda s: {q_strip('s')})"
q_insights = q_join(f"list_filter({q_sentences}, lambda s: length(s) > 20 AND {q_any('lower(s)', vocab.INSIGHT_WORDS)})[1:3]")
project("insights_fallback", BOOKMARKS, "bm_seq", ("insights", lambda: joined(A.insights_by_keyword(col("content"))), q_insights))
project(
    "keyword_pipeline", BOOKMARKS, "bm_seq", ("sentiment", lambda: A.analysis(col("content"))["sentiment"], q_sentiment), ("content_type", lambda: A.analysis(col("content"))["content_type"], q_kind), ("category", lambda: C.by_keywords(col("content"))["primary"], "{PRIMARY}"),
)

# Categories

_ROWS = vocab.taxonomy_rows()
_MAINS = list(vocab.TAXONOMY)
q_points_of = {m: "(" + " + ".join(f"CAST(contains(lower(content), {lit(n.lower())}) AS INTEGER) * {w}" for _, mm, _, n, _, w in _ROWS if mm == m) + ")" for m in _MAINS}
SCORED_SQL = f"WITH b AS ({BOOKMARKS}), s AS (SELECT bm_seq, content, " + ", ".join(f"{q} AS p{i}" for i, q in enumerate(q_points_of.values())) + " FROM b), r AS (SELECT *, " + "list_transform(list_sort(list_filter([" + ", ".join(f"{{'p': -p{i}, 'o': {i}, 'n': '{m}'}}" for i, m in enumerate(_MAINS)) + "], lambda x: x.p < 0)), lambda x: x.n) AS ranked FROM s) "
ORACLES["keyword_pipeline"] = plain(SCORED_SQL + f"SELECT bm_seq, {q_sentiment} AS sentiment, {q_kind} AS content_type, coalesce(ranked[1], 'Other') AS category FROM r")
add("category_scores", lambda s, d: view(s, d, BOOKMARKS).select("bm_seq", C.points(col("content")).alias("s")).select("bm_seq", *[long(F.get(col("s"), F.lit(i))).alias(m.lower()) for i, m in enumerate(_MAINS)]), SCORED_SQL + "SELECT bm_seq, " + ", ".join(f"CAST(p{i} AS BIGINT) AS {m.lower()}" for i, m in enumerate(_MAINS)) + " FROM r")


def categorised(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, BOOKMARKS).select("bm_seq", C.by_keywords(col("content")).alias("category"))


q_max = "CASE coalesce(ranked[1], 'Other') " + " ".join(f"WHEN '{m}' THEN least(10.0::DOUBLE, p{i})" for i, m in enumerate(_MAINS)) + " END"
add("category_fallback", lambda s, d: categorised(s, d).select("bm_seq", col("category.primary").alias("primary_category"), joined(col("category.secondary")).alias("secondary"), F.try_element_at(col("category.confidence"), col("category.primary")).alias("confidence")), SCORED_SQL + f"SELECT bm_seq, coalesce(ranked[1], 'Other') AS primary_category, array_to_string(ranked[2:4], '|') AS secondary, {q_max} AS confidence FROM r")
DIM_SQL = "dim(ord, main, sub, name, level, weight) AS (VALUES " + ", ".join(f"({o}, {lit(m)}, {lit(s) if s else 'NULL'}, {lit(n)}, '{lv}', {w})" for o, m, s, n, lv, w in _ROWS) + ")"
add("category_theta_join", lambda s, d: C.category_matches(view(s, d, BOOKMARKS), "bm_seq", "content", C.taxonomy(s)), f"WITH b AS ({BOOKMARKS}), {DIM_SQL} SELECT bm_seq, main, CAST(sum(weight) AS BIGINT) AS points FROM b JOIN dim ON contains(lower(content), lower(name)) GROUP BY bm_seq, main")
CATS_SQL = "SELECT DISTINCT c AS category FROM (SELECT unnest(categories) AS c FROM processed_bookmarks UNION ALL SELECT unnest(tags) FROM processed_bookmarks UNION ALL SELECT unnest(['python', 'Entertainment', '', 'GROWTH', 'Statistics', 'Research', 'Python']))"


def category_names(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "processed_bookmarks")
    extra = spark.createDataFrame([(x,) for x in ("python", "Entertainment", "", "GROWTH", "Statistics", "Research", "Python")], "category string")
    return t.select(F.explode("categories").alias("category")).union(t.select(F.explode("tags"))).union(extra).distinct()


NORMAL_SQL = f"WITH {DIM_SQL}, c AS ({CATS_SQL}), m AS (SELECT category, arg_min(name, CASE WHEN category = name THEN 0 WHEN lower(category) = lower(name) THEN 1000 ELSE 2000 END + ord) AS name FROM c JOIN dim ON category <> '' AND (contains(lower(name), lower(category)) OR contains(lower(category), lower(name))) GROUP BY category) "
add("category_normalize", lambda s, d: category_names(s, d).select("category", C.normalise(col("category")).alias("normal")), NORMAL_SQL + "SELECT c.category, coalesce(m.name, 'Other') AS normal FROM c LEFT JOIN m ON c.category = m.category")
add("category_hierarchy", lambda s, d: C.places(category_names(s, d).select(F.coalesce("category", F.lit("")).alias("given"), C.normalise(col("category")).alias("normal")), "normal", "given"), NORMAL_SQL + "SELECT DISTINCT coalesce(c.category, '') AS given, d.name AS category, d.main, CASE d.level WHEN 'main' THEN 'main' ELSE 'parent' END AS kind, CASE d.level WHEN 'main' THEN NULL ELSE d.name END AS subcategory FROM c LEFT JOIN m ON c.category = m.category JOIN dim d ON d.name = coalesce(m.name, 'Other')")
add("category_stats_primary", lambda s, d: A.histogram(categorised(s, d), col("category.primary"), "category"), SCORED_SQL + "SELECT coalesce(ranked[1], 'Other') AS category, count(*) AS n FROM r GROUP BY 1")
add("category_stats_all", lambda s, d: A.item_counts(categorised(s, d), C.category_list(col("category.primary"), col("category.secondary")), "category"), SCORED_SQL + "SELECT c AS category, count(*) AS n FROM (SELECT unnest(list_concat([coalesce(ranked[1], 'Other')], coalesce(ranked[2:4], CAST([] AS VARCHAR[])))) AS c FROM r) GROUP BY 1")
q_confidences = " UNION ALL ".join(f"SELECT least(10.0::DOUBLE, p{i}) AS v FROM r WHERE p{i} > 0" for i in range(len(_MAINS)))
add("category_stats_summary", lambda s, d: C.statistics(categorised(s, d)), SCORED_SQL + f"SELECT (SELECT count(*) FROM r) AS total_categorized, (SELECT round_even(avg(v), 2) FROM ({q_confidences})) AS average_confidence, (SELECT count(DISTINCT c) FROM (SELECT unnest(list_concat([coalesce(ranked[1], 'Other')], coalesce(ranked[2:4], CAST([] AS VARCHAR[])))) AS c FROM r)) AS unique_categories")
add("suggest_categories", lambda s, d: C.suggest(view(s, d, BOOKMARKS), "content"), f"WITH b AS ({BOOKMARKS}), w AS (SELECT unnest({q_words('lower(content)')}) AS w FROM b) SELECT upper(left(w, 1)) || substr(w, 2) AS word, count(*) AS n FROM w WHERE length(w) > 3 AND regexp_full_match(w, '\\p{{L}}+') AND w NOT IN ({', '.join(sorted({lit(r[3].lower()) for r in _ROWS}))}) GROUP BY w HAVING count(*) >= 3 ORDER BY n DESC, w LIMIT 10")

# Tags

q_bare = q_strip("regexp_replace(t, '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s\\p{Z}-]', '', 'g')")
q_cleaned = f"list_transform(list_filter(list_transform(list_filter(tags, lambda t: t IS NOT NULL), lambda t: lower({q_bare})), lambda t: length(t) BETWEEN 2 AND 30 AND t NOT IN ({', '.join(map(lit, vocab.TAG_STOP_WORDS))})), lambda t: replace(t, ' ', '-'))"


def tagged(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, RECORDS).select("proc_id", G.clean(F.array_compact("tags")).alias("tags"))


TAGS_SQL = f"WITH b AS ({RECORDS}), cleaned AS (SELECT proc_id, {q_cleaned} AS l FROM b), t AS (SELECT proc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS tags FROM cleaned) "
add("clean_tags", lambda s, d: tagged(s, d).select("proc_id", joined(col("tags")).alias("tags")), TAGS_SQL + "SELECT proc_id, array_to_string(tags, '|') AS tags FROM t")
_TAGS = vocab.tag_rows()
VOCAB_SQL = "voc(co, ko, category, kw) AS (VALUES " + ", ".join(f"({i}, {j}, {lit(c)}, {lit(k)})" for i, j, c, k in _TAGS) + ")"
add("tag_categorize", lambda s, d: tagged(s, d).select(F.explode("tags").alias("tag")).distinct().select("tag", G.category(col("tag")).alias("category")), TAGS_SQL.rstrip() + f", {VOCAB_SQL}, d AS (SELECT DISTINCT unnest(tags) AS tag FROM t) SELECT tag, coalesce((SELECT arg_min(category, co * 100 + ko) FROM voc WHERE contains(tag, kw) OR contains(kw, tag)), 'general') AS category FROM d")
_FIXED = ("web", "mobile", "python", "javascript", "news", "guide")
HIERARCHY_SQL = TAGS_SQL.rstrip() + f", {VOCAB_SQL}, a AS (SELECT proc_id, list_concat([{', '.join(map(lit, _FIXED))}], coalesce(tags, CAST([] AS VARCHAR[]))) AS l FROM t), e AS (SELECT proc_id, unnest(range(len(l))) AS pos, unnest(l) AS tag FROM a), o AS (SELECT proc_id, tag, min(pos) AS pos FROM e GROUP BY proc_id, tag), f AS (SELECT DISTINCT proc_id, co, tag, pos FROM o JOIN voc ON contains(tag, kw) OR contains(kw, tag)), g AS (SELECT proc_id, co, arg_min(tag, length(tag) * 100000 + pos) AS general, list_sort(list(tag)) AS own FROM f GROUP BY proc_id, co HAVING count(*) > 1), k AS (SELECT *, row_number() OVER (PARTITION BY proc_id, general ORDER BY co DESC) AS n FROM g) "
add("tag_hierarchy", lambda s, d: tagged(s, d).select("proc_id", F.explode(G.hierarchy(F.array_distinct(F.concat(F.array(*[F.lit(x) for x in _FIXED]), F.coalesce("tags", F.array().cast("array<string>"))))))).select("proc_id", col("key").alias("general"), joined(F.array_sort("value")).alias("specific")), HIERARCHY_SQL + f"SELECT proc_id, general, {q_join('list_filter(own, lambda x: x <> general)')} AS specific FROM k WHERE n = 1")
add("related_tags", lambda s, d: tagged(s, d).select("proc_id", joined(G.related(col("tags"))).alias("related")), TAGS_SQL.rstrip() + f", {VOCAB_SQL}, u AS (SELECT proc_id, unnest(tags) AS tag FROM t), c AS (SELECT DISTINCT proc_id, v.category FROM u JOIN voc v ON contains(tag, kw) OR contains(kw, tag)), r AS (SELECT proc_id, list_sort(list_distinct(list(kw)))AS kws FROM c JOIN voc USING (category) GROUP BY proc_id) SELECT t.proc_id, CASE WHEN tags IS NULL THEN NULL ELSE coalesce(array_to_string(list_filter(kws, lambda k: NOT list_contains(tags, k))[1:10], '|'), '') END AS related FROM t LEFT JOIN r ON t.proc_id = r.proc_id")
add("tag_term_join", lambda s, d: view(s, d, BOOKMARKS).select("bm_seq", long(T.hits(F.lower(col("content")), [k.lower() for _, _, _, k in _TAGS])).alias("terms")), f"WITH b AS ({BOOKMARKS}) SELECT bm_seq, CAST({q_hits('lower(content)', [k.lower() for _, _, _, k in _TAGS])} AS BIGINT) AS terms FROM b")
q_terms = q_some([f"CASE WHEN contains(lower(content), {lit(k.lower())}) THEN {lit(k)} END" for _, _, _, k in _TAGS])
q_proper = "list_filter(string_split_regex(content, '[^\\p{L}\\p{M}\\p{N}\\p{Pc}]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+'))"
q_hosts = f"list_transform(regexp_extract_all(content, {lit('https?://([^/' + chr(92) + 's]+)')}, 1), lambda h: split_part(h, '.', 1))"
q_candidates = f"list_concat({q_proper}, {q_terms}, {q_hosts}, regexp_extract_all(content, {lit('#' + _UW)}, 1))"
q_tag_list = q_cleaned.replace("list_filter(tags, lambda t: t IS NOT NULL)", q_candidates)
add("tag_fallback", lambda s, d: view(s, d, BOOKMARKS).select("bm_seq", joined(G.by_keywords(col("content"))).alias("tags")), f"WITH b AS ({BOOKMARKS}), c AS (SELECT bm_seq, {q_tag_list} AS l FROM b) SELECT bm_seq, {q_join('list_filter(l, lambda x, i: list_position(l, x) = i)[1:10]')} AS tags FROM c")
add("tag_candidates", lambda s, d: view(s, d, BOOKMARKS).select("bm_seq", joined(G.candidates(col("content"))).alias("candidates")), f"WITH b AS ({BOOKMARKS}) SELECT bm_seq, {q_join(q_candidates)} AS candidates FROM b")
add("tag_confidence", lambda s, d: tagged(s, d).select(F.explode("tags").alias("tag")).distinct().select("tag", G.confidence(col("tag")).alias("confidence")), TAGS_SQL.rstrip() + f", {VOCAB_SQL}, d AS (SELECT DISTINCT unnest(tags) AS tag FROM t) SELECT tag, CASE WHEN tag IN (SELECT kw FROM voc) THEN 8.0::DOUBLE ELSE 5.0::DOUBLE END AS confidence FROM d")
add("merge_similar_tags", lambda s, d: tagged(s, d).select("proc_id", joined(G.merge_similar(col("tags"))).alias("merged")))
add("tag_stats_top", lambda s, d: A.top_items(tagged(s, d), col("tags"), 20, "tag", "proc_id"), TAGS_SQL + "SELECT tag, count(*) AS n FROM (SELECT proc_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM t) GROUP BY tag ORDER BY n DESC, min(proc_id * 100000 + pos) LIMIT 20")
add("tag_stats_categories", lambda s, d: A.histogram(tagged(s, d).select(F.explode("tags").alias("tag")), G.category(col("tag")), "category"), TAGS_SQL.rstrip() + f", {VOCAB_SQL}, d AS (SELECT unnest(tags) AS tag FROM t), u AS (SELECT DISTINCT tag FROM d), g AS (SELECT tag, coalesce((SELECT arg_min(category, co * 100 + ko) FROM voc WHERE contains(tag, kw) OR contains(kw, tag)), 'general') AS category FROM u) SELECT category, count(*) AS n FROM d JOIN g USING (tag) GROUP BY category")
add("tag_stats_summary", lambda s, d: G.statistics(tagged(s, d)), TAGS_SQL.rstrip() + f", {VOCAB_SQL}, u AS (SELECT unnest(tags) AS tag FROM t) SELECT (SELECT count(*) FROM t) AS total_tagged, (SELECT round_even(avg(coalesce(len(tags), 0)), 2) FROM t) AS average_tags_per_item, count(DISTINCT tag) AS total_unique_tags, round_even(avg(CASE WHEN tag IN (SELECT kw FROM voc) THEN 8.0::DOUBLE ELSE 5.0::DOUBLE END), 2) AS average_confidence FROM u")

# Responses of models



def unpacked(name: str, base: str, key: str, struct: Callable[[], Column], lists: tuple[str, ...] = ()) -> None:
    """A query of a struct's fields, worked out once a row. A fold over lines that carries its section has no SQL; these
    are tested against a plain version."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = view(spark, d, base).select(key, F.inline(F.array(struct())))
        return rows.withColumns({c: joined(col(c).cast("array<string>")) for c in lists})

    add(name, run)


unpacked("parse_analysis", ANSWERS, "response_id", lambda: R.parse_analysis(col("answer"), col("original")), ("main_topics", "key_insights", "actionable_items", "technologies_tools"))
unpacked("parse_category", ANSWERS, "response_id", lambda: R.parse_categories(col("answer"), col("original")), ("secondary",))
unpacked("parse_tags", ANSWERS, "response_id", lambda: R.parse_tags(col("answer"), col("original")), ("tags", "confidence"))
_TOOLS = [{"name": "look_up", "input_schema": {"type": "object"}}]


def requested(spark: SparkSession, d: str) -> DataFrame:
    """Fields read back from request bodies: the text, the system text, limits, tools, an image and what to block."""
    text, picture = R.prompt("tags", col("original")), F.array(F.struct(F.lit(None).cast("string").alias("media_type"), F.base64(F.encode("step", "utf-8")).alias("data")))
    bodies = {
        "claude": R.request_json("claude", "m", text, "sys", images=picture, tools=_TOOLS), "grok": R.request_json("grok", "m", text, "sys", tools=_TOOLS), "gemini": R.request_json("gemini", "m", text, "sys"),
    }
    paths = {
        "claude": ("$.messages[0].content[1].text", "claude", "$.system", "claude_system", "$.messages[0].content[0].source.data", "claude_image", "$.messages[0].content[0].source.media_type", "claude_kind", "$.tools[0].name", "claude_tool"),
        "grok": ("$.messages[1].content", "grok", "$.messages[0].content", "grok_system", "$.max_tokens", "grok_most", "$.tool_choice", "grok_choice"),
        "gemini": ("$.contents[0].parts[0].text", "gemini", "$.systemInstruction.parts[0].text", "gemini_system", "$.safetySettings[3].category", "gemini_safety", "$.generationConfig.topK", "gemini_k"),
    }
    fields = [F.get_json_object(bodies[p], path).alias(n) for p, own in paths.items() for path, n in zip(own[::2], own[1::2])]
    return view(spark, d, ANSWERS).select("response_id", *fields)


add("llm_request_json", requested, f"WITH b AS ({ANSWERS}), p AS (SELECT response_id, step, replace({lit(R.PROMPTS['tags'][1])}, '{{content}}', coalesce(original, '')) AS t FROM b) SELECT response_id, t AS claude, 'sys' AS claude_system, base64(encode(step)) AS claude_image, 'image/jpeg' AS claude_kind, 'look_up' AS claude_tool, t AS grok, 'sys' AS grok_system, '2000' AS grok_most, 'auto' AS grok_choice, t AS gemini, 'sys' AS gemini_system, 'HARM_CATEGORY_DANGEROUS_CONTENT' AS gemini_safety, '40' AS gemini_k FROM p")
_BODIES = {"claude": "to_json(named_struct('content', array(named_struct('type', 'text', 'text', answer), named_struct('type', 'tool', 'text', 'no'))))", "grok": "to_json(named_struct('choices', array(named_struct('message', named_struct('content', answer)))))", "gemini": "to_json(named_struct('candidates', array(named_struct('content', named_struct('parts', array(named_struct('text', answer)))))))"}
add("llm_response_parse", lambda s, d: view(s, d, ANSWERS).select("response_id", *[R.response_text(p, F.expr(b)).alias(p) for p, b in _BODIES.items()]), f"WITH b AS ({ANSWERS}) SELECT response_id, coalesce(answer, '') AS claude, coalesce(answer, '') AS grok, coalesce(answer, '') AS gemini FROM b")
add("sse_parse", lambda s, d: view(s, d, ANSWERS).select("response_id", joined(R.stream_events(F.expr("concat('event: x', char(10), 'data: ', replace(coalesce(answer, ''), char(10), concat(char(10), 'data: ')), char(10), 'data: [DONE]', char(10), 'data: late')"))).alias("events")), f"WITH b AS ({ANSWERS}) SELECT response_id, {q_join('list_transform(string_split(coalesce(answer, ' + lit('') + '), chr(10)), lambda l: ' + q_strip('l') + ')')} AS events FROM b")
_DEFAULTED = ("sentiment", "complexity_level", "content_type", "word_count")


def defaulted(spark: SparkSession, d: str) -> DataFrame:
    """Analyses with the default one where there is nothing to analyse."""
    rows = table(spark, d, "llm_responses").select("response_id", F.when(T.strip(col("content")) != "", A.analysis(col("content"))).alias("a"), A.default_analysis(F.lit("Content cannot be empty")).alias("e"))
    return rows.select("response_id", *[F.coalesce(col("a")[f].cast("string"), col("e")[f].cast("string")).alias(f) for f in _DEFAULTED], F.when(col("a").isNull(), col("e")["error"]).alias("error"))


add("batch_defaults", defaulted, f"WITH x AS (SELECT *, coalesce({q_strip('content')} <> '', false) AS there FROM llm_responses) SELECT response_id, CASE WHEN there THEN {q_sentiment} ELSE 'Neutral' END AS sentiment, CASE WHEN there THEN {q_complexity} ELSE 'Medium' END AS complexity_level, CASE WHEN there THEN {q_kind} ELSE 'Article' END AS content_type, CAST(CASE WHEN there THEN len({q_words('content')}) ELSE 0 END AS VARCHAR) AS word_count, CASE WHEN NOT there THEN 'Content cannot be empty' END AS error FROM x")
add("token_usage", lambda s, d: table(s, d, "llm_responses").groupBy("model").agg(F.count("*").alias("n"), F.sum(F.when(col("usage.total_tokens") >= 0, col("usage.total_tokens"))).alias("tokens")), "SELECT model, count(*) AS n, CAST(sum(CASE WHEN usage.total_tokens >= 0 THEN usage.total_tokens END) AS BIGINT) AS tokens FROM llm_responses GROUP BY model")

# Knowledge base

R_SQL = f"WITH b AS ({RECORDS}) "


def recs(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, RECORDS)


KB_SQL = f"WITH b AS ({KB}) "


def kept(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, KB)


add("kb_csv_rows", lambda s, d: K.csv_rows(kept(s, d)), KB_SQL + "SELECT id, title, url, author, left(content, 1000) AS content, bookmark_type, array_to_string(coalesce(categories, CAST([] AS VARCHAR[])), '; ') AS categories, array_to_string(coalesce(tags, CAST([] AS VARCHAR[])), '; ') AS tags, created_at, strftime(processed_at, '%Y-%m-%dT%H:%M:%S') AS processed_at, processing_time FROM b")
_OWN = ("id", "title", "url", "author", "content", "bookmark_type", "created_at")
add("kb_json_rows", lambda s, d: K.json_rows(kept(s, d).select(*_OWN, "categories", "tags", "processing_time")).select(*[F.get_json_object("json", f"$.{c}").alias(c) for c in (*_OWN, "categories", "tags")], F.get_json_object("json", "$.processing_time").cast("double").alias("processing_time")), KB_SQL + f"SELECT {', '.join(_OWN)}, CAST(to_json(categories) AS VARCHAR) AS categories, CAST(to_json(tags) AS VARCHAR) AS tags, processing_time FROM b")
add("kb_markdown_sections", lambda s, d: kept(s, d).select("proc_id", K.primary(col("categories")).alias("category"), K.markdown_record(col("title"), col("author"), col("url"), col("bookmark_type"), F.array_compact("tags"), F.date_format("processed_at", "yyyy-MM-dd"), col("content"), F.array_compact("key_insights")).alias("block")), KB_SQL + "SELECT proc_id, coalesce(categories[1], 'Uncategorized') AS category, '### ' || coalesce(title, '') || chr(10) || '**Author:** ' || coalesce(author, '') || chr(10) || '**URL:** [' || coalesce(url, '') || '](' || coalesce(url, '') || ')' || chr(10) || '**Type:** ' || coalesce(bookmark_type, '') || chr(10) || '**Tags:** ' || coalesce(array_to_string(tags, ', '), '') || chr(10) || '**Created:** ' || strftime(processed_at, '%Y-%m-%d') || coalesce(CASE WHEN length(content) > 0 THEN chr(10) || chr(10) || '**Content:**' || chr(10) || left(content, 500) || '...' END, '') || coalesce(CASE WHEN len(list_filter(key_insights, lambda k: k IS NOT NULL)) > 0 THEN chr(10) || chr(10) || '**Key Insights:**' || chr(10) || array_to_string(list_transform(list_filter(key_insights, lambda k: k IS NOT NULL)[1:3], lambda i: '- ' || i), chr(10)) END, '') || chr(10) || chr(10) || '---' || chr(10) AS block FROM b")
add("kb_toc", lambda s, d: K.contents_table(recs(s, d)), R_SQL + "SELECT DISTINCT coalesce(categories[1], 'Uncategorized') AS category, '- [' || coalesce(categories[1], 'Uncategorized') || '](#' || replace(lower(coalesce(categories[1], 'Uncategorized')), ' ', '-') || ')' AS entry FROM b")
_ANALYSIS = ("content_type", "complexity_level", "word_count")
add("training_jsonl", lambda s, d: kept(s, d).select("proc_id", K.training_rows(col("content"), col("categories"), col("tags"), F.struct(*_ANALYSIS), col("url"), col("title"), col("author"), col("bookmark_type")).alias("j")).select("proc_id", *[F.get_json_object("j", p).alias(n) for n, p in (("input", "$.input"), ("categories", "$.output.categories"), ("tags", "$.output.tags"), ("url", "$.metadata.url"), ("title", "$.metadata.title"), ("author", "$.metadata.author"), ("kind", "$.metadata.type"), *((c, f"$.output.analysis.{c}") for c in _ANALYSIS))]), KB_SQL + "SELECT proc_id, content AS input, CAST(to_json(categories) AS VARCHAR) AS categories, CAST(to_json(tags) AS VARCHAR) AS tags, url, title, author, bookmark_type AS kind, content_type, complexity_level, CAST(word_count AS VARCHAR) AS word_count FROM b")
add("kb_type_counts", lambda s, d: A.histogram(table(s, d, "bookmarks"), col("bookmark_type"), "type"), "SELECT bookmark_type AS type, count(*) AS n FROM bookmarks GROUP BY 1")
for _name, _field in (("kb_category_counts", "categories"), ("kb_tag_counts", "tags")):
    add(_name, lambda s, d, f=_field: A.item_counts(recs(s, d), col(f)), R_SQL + f"SELECT item, count(*) AS n FROM (SELECT unnest({_field}) AS item FROM b) WHERE item IS NOT NULL GROUP BY item")
add("kb_author_counts", lambda s, d: K.counts(table(s, d, "bookmarks"), col("author"), "author"), "SELECT author, count(*) AS n FROM bookmarks WHERE author <> '' GROUP BY author")
add("kb_time_stats", lambda s, d: K.time_statistics(recs(s, d)).select(F.round("total", 3).alias("total"), F.round("average", 6).alias("average"), "min", "max"), R_SQL + "SELECT round(sum(processing_time), 3) AS total, round(avg(processing_time), 6) AS average, min(processing_time) AS min, max(processing_time) AS max FROM b")
_STRUCT = lambda: F.when(col("content_type").isNotNull(), F.struct("relevance_score", "word_count", "reading_time_minutes"))
add("analysis_summary", lambda s, d: A.summary(recs(s, d).withColumn("analysis_results", _STRUCT())), R_SQL + "SELECT count(*) AS total_analyzed, round_even(avg(relevance_score), 2) AS average_relevance_score, round_even(avg(word_count), 0) AS average_word_count, round_even(avg(reading_time_minutes), 1) AS average_reading_time FROM b WHERE content_type IS NOT NULL HAVING count(*) > 0")
add("topic_top10", lambda s, d: A.top_items(recs(s, d), col("main_topics"), 10, "topic", "proc_id"), R_SQL + "SELECT topic, count(*) AS n FROM (SELECT proc_id, unnest(main_topics) AS topic, unnest(range(len(main_topics))) AS pos FROM b) WHERE topic IS NOT NULL GROUP BY topic ORDER BY n DESC, min(proc_id * 100000 + pos) LIMIT 10")
for _name, _field in (("content_type_hist", "content_type"), ("complexity_hist", "complexity_level")):
    add(_name, lambda s, d, f=_field: A.histogram(recs(s, d), col(f)), R_SQL + f"SELECT {_field} AS value, count(*) AS n FROM b GROUP BY 1")

# State

add("first_seen", lambda s, d: S.first_seen(table(s, d, "bookmarks").select("id", "bm_seq", "url"), "id", ["bm_seq"]), "SELECT id, min(bm_seq) AS bm_seq, arg_min(coalesce(url, chr(1)), bm_seq) AS url0 FROM bookmarks WHERE id IS NOT NULL GROUP BY id".replace("arg_min(coalesce(url, chr(1)), bm_seq) AS url0", "nullif(arg_min(coalesce(url, chr(1)), bm_seq), chr(1)) AS url"))
add("resume_anti_join", lambda s, d: S.unprocessed(table(s, d, "bookmarks").select("id", "bm_seq"), table(s, d, "processed_bookmarks").select("bookmark.id"), "id"), "SELECT id, bm_seq FROM bookmarks b WHERE NOT EXISTS (SELECT 1 FROM processed_bookmarks p WHERE p.bookmark.id = b.id)")


add("processed_union", lambda s, d: S.done_ids("id", table(s, d, "processed_bookmarks").select("bookmark.id"), table(s, d, "llm_responses").select(col("bookmark_id").alias("id"))), "SELECT bookmark.id AS id FROM processed_bookmarks WHERE bookmark.id IS NOT NULL UNION SELECT bookmark_id FROM llm_responses WHERE bookmark_id IS NOT NULL")


def saved(spark: SparkSession, d: str) -> DataFrame:
    """Responses stand for saved states: the bookmark is their name, the response the file."""
    return table(spark, d, "llm_responses").select("response_id", "bookmark_id", "step", "created_at", F.length("content").cast("bigint").alias("size")).distinct()


SAVED_SQL = "WITH f AS (SELECT DISTINCT response_id, bookmark_id, step, created_at, length(content) AS size FROM llm_responses) "
add("latest_checkpoint", lambda s, d: S.latest(saved(s, d), "bookmark_id", "created_at", "response_id").select("bookmark_id", "response_id"), SAVED_SQL + "SELECT bookmark_id, response_id FROM (SELECT *, row_number() OVER (PARTITION BY bookmark_id ORDER BY created_at DESC, response_id DESC) AS k FROM f) WHERE k = 1")
add("checkpoint_retention", lambda s, d: S.beyond_newest(saved(s, d), "step", "created_at", "response_id", 3).select("step", "response_id"), SAVED_SQL + "SELECT step, response_id FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY created_at DESC, response_id DESC) AS k FROM f) WHERE k > 3")
add("checkpoint_list", lambda s, d: saved(s, d).orderBy(F.desc("created_at"), F.desc("response_id")).select("response_id", "bookmark_id"), SAVED_SQL + "SELECT response_id, bookmark_id FROM f")
add("checkpoint_stats", lambda s, d: S.statistics(saved(s, d), "created_at", "size", "step").select("total", "total_size_bytes", "total_size_human", joined(F.transform(F.array_sort(F.map_entries("by_step")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))).alias("steps"), F.date_format("oldest", "yyyy-MM-dd HH:mm:ss").alias("oldest"), F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest")), SAVED_SQL + f"SELECT count(*) AS total, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size_bytes, (SELECT {q_size} FROM (SELECT coalesce(sum(size), 0) AS n FROM f)) AS total_size_human, (SELECT array_to_string(list_sort(list(step || '=' || n)), '|') FROM (SELECT step, count(*) AS n FROM f WHERE step IS NOT NULL GROUP BY step)) AS steps, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS newest FROM f")
add("checkpoint_expired", lambda s, d: S.expired(saved(s, d), "created_at", F.lit("2024-06-01").cast("timestamp_ntz")).select("response_id"), SAVED_SQL + "SELECT response_id FROM f WHERE created_at < TIMESTAMP '2024-06-01' - INTERVAL 30 DAY")
add("run_stats", lambda s, d: S.run_counters(checked(s, d), col("checked.is_valid") & (T.strip(col("content")) != ""), ~col("checked.is_valid")), CHECKED_SQL + f"SELECT count(*) FILTER (len(errs) = 0 AND {q_strip('content')} <> '') AS successful, count(*) FILTER (NOT (len(errs) = 0 AND {q_strip('content')} <> '')) AS failed, count(*) FILTER (len(errs) > 0) AS skipped, count(*) AS total_processed FROM c")
add("batch_assign", lambda s, d: S.batch_number(table(s, d, "bookmarks").select("bm_seq"), "bm_seq", 10), "SELECT bm_seq, CAST((row_number() OVER (ORDER BY bm_seq) - 1) // 10 AS BIGINT) AS batch FROM bookmarks")
add("rate_window", lambda s, d: S.window_usage(view(s, d, EVENTS), "user_id", "ts", "value", 3600).select("event_id", "requests", F.round("used", 6).alias("used")), "SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 6) AS used FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW)")
add("rate_admission", lambda s, d: S.admitted(view(s, d, EVENTS).select("event_id", "user_id", "ts", F.coalesce("value", F.lit(0.0)).alias("value")), "user_id", "ts", "event_id", "value", 3, 200.0, 6 * 3600).select("event_id", "admitted"))
add("event_windows", lambda s, d: windowed(view(s, d, EVENTS), "ts", "1 hour", "1 hour", by=("event_type",)).select(F.date_format(col("window")["start"], "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n"), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add("event_sessions", lambda s, d: sessions(view(s, d, EVENTS), "ts", "6 hours", "1 hour", "user_id").select("user_id", F.date_format(col("session")["start"], "yyyy-MM-dd HH:mm:ss").alias("began"), "n"), "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM g GROUP BY user_id, k")

# The whole pipeline

_RAW = ("id", "url", "title", "content", "author", "created_at", "metadata")


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.outcomes(view(spark, d, BOOKMARKS).select("bm_seq", *_RAW), pipeline.Options(False, False, False))


q_content = q_strip("content")
add("pipeline_outcomes", lambda s, d: outcomes(s, d).select("bm_seq", "status", joined(col("errors")).alias("errors")), CHECKED_SQL + f"SELECT bm_seq, CASE WHEN len(errs) > 0 THEN 'skipped' WHEN coalesce({q_content} = '', true) THEN 'failed' ELSE 'successful' END AS status, CASE WHEN len(errs) > 0 THEN {q_join('errs')} WHEN coalesce({q_content} = '', true) THEN 'Content cannot be empty' ELSE '' END AS errors FROM c")
_FIRST = f"SELECT * FROM (SELECT *, {q_errors} AS errs, row_number() OVER (PARTITION BY id ORDER BY bm_seq) AS nth FROM ({BOOKMARKS}) AS every) AS f WHERE nth = 1 AND id IS NOT NULL AND len(errs) = 0 AND {q_content} <> ''"


def piped(spark: SparkSession, d: str) -> DataFrame:
    """All stages over all bookmarks: first seen, checked, routed, analysed, categorised, tagged."""
    a = col("analysis_results")
    rows = pipeline.process(view(spark, d, BOOKMARKS).select("bm_seq", *_RAW), ["bm_seq"])
    lists = [joined(c).alias(n) for n, c in (("topics", a["main_topics"]), ("insights", a["key_insights"]), ("categories", col("categories")), ("tags", col("tags")))]
    return rows.select("bm_seq", "bookmark_type", a["sentiment"].alias("sentiment"), a["complexity_level"].alias("complexity"), a["content_type"].alias("content_type"), *lists)


add("pipeline_process", piped, SCORED_SQL.replace(f"({BOOKMARKS})", f"({_FIRST})", 1) + f"SELECT bm_seq, {q_route} AS bookmark_type, {q_sentiment} AS sentiment, {q_complexity} AS complexity, {q_kind} AS content_type, {q_join(f'({q_topics})[1:5]')} AS topics, {q_insights} AS insights, array_to_string(list_concat([coalesce(ranked[1], 'Other')], coalesce(ranked[2:4], CAST([] AS VARCHAR[]))), '|') AS categories, {q_join(f'list_filter({q_tag_list}, lambda x, i: list_position({q_tag_list}, x) = i)[1:10]')} AS tags FROM (SELECT r.*, b.url FROM r JOIN b USING (bm_seq)) AS x")

# Sources

INLINE_SQL = "SELECT 1 AS n, 'https://a.example/1' AS url UNION ALL SELECT 2, 'https://x.com/a/status/2' UNION ALL SELECT 3, 'https://youtu.be/abcdefghijk'"
add("scan_inline", lambda s, d: s.createDataFrame([(1, "https://a.example/1"), (2, "https://x.com/a/status/2"), (3, "https://youtu.be/abcdefghijk")], "n int, url string"), INLINE_SQL)
