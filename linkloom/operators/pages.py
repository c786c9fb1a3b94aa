"""Titles, texts, authors and metadata of web pages, posts and videos from their HTML, by patterns in the JVM.

Fixed values, as they are part of the results: all patterns of HTML, also those within functions, and the titles that stand
where a page gives none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from ..functions import urls
from ..functions.text import clean_html, clean_text, decode_entities, drop_scripts, drop_tags, first_match, found, half_even, has_any, hashtags, match, mentions, sorted_set, squeeze, strip
from .validate import iso_date

Q = "[\"']"

# The meta tags that are read, as attribute and key.
META_KEYS = (("name", "description"), ("name", "keywords"), ("name", "author"), ("property", "og:title"), ("property", "og:description"), ("property", "og:image"))


def meta_tag(html: Column, attribute: str, key: str) -> Column:
    """The content of a meta tag whose name stands before its content; null where there is none."""
    pattern = rf"(?i)<meta[^>]*{attribute}={Q}{key}{Q}[^>]*content={Q}([^\"']*){Q}"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def meta_map(html: Column) -> Column:
    """MAP of the six meta tags that are there."""
    entries = F.create_map(*[x for a, k in META_KEYS for x in (F.lit(k), meta_tag(html, a, k))])
    return F.map_filter(entries, lambda k, v: v.isNotNull())


def page_title(html: Column) -> Column:
    return clean_text(F.coalesce(match(html, r"(?i)<title>([^<]+)</title>"), F.lit("")))


def page_text(html: Column) -> Column:
    """The paragraphs of a page, without scripts, styles and tags."""
    paragraphs = F.regexp_extract_all(drop_scripts(html), F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    return F.coalesce(clean_text(drop_tags(F.array_join(paragraphs, " "))), F.lit(""))


def page_author(html: Column) -> Column:
    return F.coalesce(meta_tag(html, "name", "author"), F.lit(""))


# Posts

# Patterns of posts' pages, in the order in which they are tried.
POST_TITLES = (r"(?is)<title>([^<]+)</title>", r'(?is)<meta property="og:title" content="([^"]+)"', r'(?is)<meta name="twitter:title" content="([^"]+)"')
POST_TEXTS = (
    rf"(?is)<div[^>]*data-testid={Q}tweetText{Q}[^>]*>(.*?)</div>", rf"(?is)<div[^>]*class={Q}[^\"']*tweet-text[^\"']*{Q}[^>]*>(.*?)</div>", rf"(?is)<p[^>]*class={Q}[^\"']*tweet-text[^\"']*{Q}[^>]*>(.*?)</p>",
    r'(?is)<meta property="og:description" content="([^"]+)"', r'(?is)<meta name="twitter:description" content="([^"]+)"',
)
POST_AUTHORS = (
    rf"(?is)<div[^>]*data-testid={Q}User-Names{Q}[^>]*>.*?<span[^>]*>@([^<]+)</span>", rf"(?is)<a[^>]*href={Q}https://(?:twitter\.com|x\.com)/([^/\"'?]+)",
    r'(?is)<meta name="twitter:creator" content="@([^"]+)"', r'(?is)<meta property="twitter:creator" content="@([^"]+)"',
)
POST_DATES = (rf"(?i)<time[^>]*datetime={Q}([^\"']+){Q}", r'(?i)<meta property="article:published_time" content="([^"]+)"')


def post_title(html: Column) -> Column:
    title = squeeze(strip(first_match(html, POST_TITLES)))
    return F.coalesce(F.replace(F.replace(title, F.lit(" / X"), F.lit("")), F.lit(" / Twitter"), F.lit("")), F.lit("Tweet"))


def post_text(html: Column) -> Column:
    """The first of the texts found that has more than 10 characters once cleaned."""
    texts = F.array(*[strip(squeeze(decode_entities(drop_tags(strip(match(html, p)))))) for p in POST_TEXTS])
    return F.coalesce(F.get(F.filter(texts, lambda t: F.length(t) > 10), F.lit(0)), F.lit(""))


def post_author(html: Column) -> Column:
    return F.coalesce(F.regexp_replace(strip(first_match(html, POST_AUTHORS)), "^@+", ""), F.lit(""))


def first_date(html: Column, patterns: tuple[str, ...]) -> Column:
    """The first of the dates found that can be read."""
    return F.coalesce(*[iso_date(strip(match(html, p))) for p in patterns])


def post_date(html: Column) -> Column:
    return first_date(html, POST_DATES)


def post_count(html: Column, what: str) -> Column:
    return match(html, rf"(?is)<div[^>]*data-testid={Q}{what}{Q}[^>]*>.*?(\d+)").try_cast("bigint")


def post_media(html: Column) -> Column:
    found_urls = F.concat(*[F.regexp_extract_all(html, F.lit(rf"<{t}[^>]*src={Q}([^\"']+){Q}"), F.lit(1)) for t in ("img", "video")])
    return F.filter(found_urls, lambda u: has_any(u, ["pbs.twimg.com", "video.twimg.com"]))


def post_metadata(html: Column) -> Column:
    counts = [post_count(html, w).alias(f"{w}_count") for w in ("reply", "retweet", "like")]
    return F.struct(*counts, sorted_set(hashtags(html)).alias("hashtags"), sorted_set(mentions(html)).alias("mentions"), post_media(html).alias("media_urls"))


def engagement_counts(metadata: Column) -> Column:
    """MAP of replies, retweets and likes for those of the counts that are there; null for none."""
    names = (("replies", "reply_count"), ("retweets", "retweet_count"), ("likes", "like_count"))
    present = F.map_filter(F.create_map(*[x for name, count in names for x in (F.lit(name), metadata[count])]), lambda k, v: v.isNotNull())
    return F.when(F.size(present) > 0, present)


def better_post_title(title: Column, content: Column, author: Column) -> Column:
    """A generic title becomes one of the author and the first 50 characters."""
    cut = F.concat(F.substring(content, 1, 50), F.when(F.length(content) > 50, "...").otherwise(""))
    return F.when((title == "Tweet") & (F.length(content) > 0), F.concat(F.lit("Tweet by "), F.coalesce(author, F.lit("Unknown")), F.lit(": "), cut)).otherwise(title)


def simple_post(html: Column) -> Column:
    """The short form: text of the post, its author, the first 100 characters as title."""
    text = F.coalesce(match(html, rf"(?s)<div[^>]*data-testid={Q}tweetText{Q}[^>]*>(.*?)</div>"), F.lit(""))
    title = F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 100), F.lit("..."))).otherwise(text)
    return F.struct(clean_text(title).alias("title"), clean_text(text).alias("content"), F.coalesce(match(html, r"<span[^>]*>@([^<]+)</span>"), F.lit("")).alias("author"))


def embed(json: Column) -> Column:
    """What an oEmbed answer holds of a post; null fields where the JSON is broken."""
    j = F.from_json(json, "author_name string, html string, author_url string, provider_name string")
    return F.struct(F.coalesce(j["author_name"], F.lit("Tweet")).alias("title"), clean_html(j["html"]).alias("content"), F.coalesce(j["author_name"], F.lit("")).alias("author"), F.coalesce(j["provider_name"], F.lit("")).alias("provider_name"))


def scraped_or_embedded(html: Column, json: Column) -> Column:
    """A post's title, content and author from its page, or from its oEmbed answer where the page gives no content."""
    page = F.struct(post_title(html).alias("title"), post_text(html).alias("content"), post_author(html).alias("author"), F.lit("web_scraping").alias("extraction_method"))
    other = embed(json)
    given = F.struct(other["title"].alias("title"), other["content"].alias("content"), other["author"].alias("author"), F.lit("oembed").alias("extraction_method"))
    return F.when(F.length(post_text(html)) > 0, page).when(F.length(other["content"]) > 0, given).otherwise(page)


def is_retweet(content: Column) -> Column:
    return F.coalesce(F.startswith(content, F.lit("RT @")) | F.contains(F.lower(content), F.lit("retweeted")), F.lit(False))


def is_reply(content: Column) -> Column:
    return F.coalesce(F.startswith(content, F.lit("@")) | F.contains(F.lower(content), F.lit("replying to")), F.lit(False))


def all_marks(own: Column, in_text: Column) -> Column:
    """Marks given with a post and those in its text, each once, sorted."""
    return F.array_sort(F.array_union(F.coalesce(own, F.array().cast("array<string>")), in_text))


def engagement(replies: Column, retweets: Column, likes: Column) -> Column:
    zero = [F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")) for c in (replies, retweets, likes)]
    return F.struct(zero[0].alias("replies"), zero[1].alias("retweets"), zero[2].alias("likes"), (zero[0] + zero[1] + zero[2]).alias("total_engagement"))


# Videos

# Patterns of videos' pages, in the order in which they are tried.
YT_TITLES = (r'(?i)"title":"([^"]+)"', r"(?i)<title>([^<]+)</title>", r'(?i)<meta property="og:title" content="([^"]+)"', r'(?i)<meta name="title" content="([^"]+)"')
YT_TEXTS = (r'(?i)"description":\{"simpleText":"([^"]+)"\}', r'(?i)"shortDescription":"([^"]+)"', r'(?i)<meta property="og:description" content="([^"]+)"', r'(?i)<meta name="description" content="([^"]+)"')
YT_AUTHORS = (r'(?i)"author":"([^"]+)"', r'(?i)"ownerChannelName":"([^"]+)"', r'(?i)<link itemprop="name" content="([^"]+)"')
YT_DATES = (r'(?i)"publishDate":"([^"]+)"', r'(?i)"uploadDate":"([^"]+)"', r'(?i)<meta itemprop="uploadDate" content="([^"]+)"')
VIDEO_TITLES = (r"(?i)<title>([^<]+)</title>", r'(?i)<meta property="og:title" content="([^"]+)"', r'(?i)<meta name="twitter:title" content="([^"]+)"', r'(?i)<meta name="title" content="([^"]+)"')
VIDEO_TEXTS = (r'(?i)<meta property="og:description" content="([^"]+)"', r'(?i)<meta name="twitter:description" content="([^"]+)"', r'(?i)<meta name="description" content="([^"]+)"')
VIDEO_AUTHORS = (r'(?i)<meta name="author" content="([^"]+)"', r'(?i)<meta property="video:actor" content="([^"]+)"', r'(?i)<meta property="article:author" content="([^"]+)"')
VIDEO_DATES = (r'(?i)<meta property="video:release_date" content="([^"]+)"', r'(?i)<meta property="article:published_time" content="([^"]+)"', r'(?i)<time[^>]*datetime="([^"]+)"')


def unescape(c: Column) -> Column:
    r"""Decodes \uXXXX and the short escapes by reading the text as a JSON string; other text stays as it is."""
    decoded = F.from_json(F.concat(F.lit('{"v":"'), F.regexp_replace(c, r"[\n\r\t]", " "), F.lit('"}')), "v string")["v"]
    return F.when(F.contains(c, F.lit("\\")), F.coalesce(decoded, c)).otherwise(c)


def youtube(html: Column) -> Column:
    """Title, description and channel of a video page."""
    title = unescape(squeeze(F.replace(strip(first_match(html, YT_TITLES)), F.lit(" - YouTube"), F.lit(""))))
    return F.struct(F.coalesce(title, F.lit("YouTube Video")).alias("title"), F.coalesce(squeeze(unescape(strip(first_match(html, YT_TEXTS)))), F.lit("")).alias("content"), F.coalesce(unescape(strip(first_match(html, YT_AUTHORS))), F.lit("")).alias("author"))


def youtube_date(html: Column) -> Column:
    return first_date(html, YT_DATES)


def video_date(html: Column) -> Column:
    """Of any other platform's page."""
    return first_date(html, VIDEO_DATES)


def simple_youtube(html: Column) -> Column:
    parts = (("title", r"<title>([^<]+)</title>"), ("content", r'"description":\{"simpleText":"([^"]+)"'), ("author", r'"author":"([^"]+)"'))
    return F.struct(*[(F.coalesce(match(html, p), F.lit("")) if n == "author" else clean_text(F.coalesce(match(html, p), F.lit("")))).alias(n) for n, p in parts])


def youtube_metadata(html: Column) -> Column:
    length = match(html, r'"lengthSeconds":"(\d+)"').try_cast("bigint")
    tags = F.regexp_extract_all(F.coalesce(match(html, r'"keywords":\[([^\]]+)\]'), F.lit("")), F.lit('"([^"]+)"'), F.lit(1))
    return F.struct(
        length.alias("duration_seconds"), format_duration(length).alias("duration_formatted"), match(html, r'"viewCount":"(\d+)"').try_cast("bigint").alias("view_count"), match(html, r'"likes":\{"simpleText":"([^"]+)"\}').alias("like_count_text"),
        match(html, r'"category":"([^"]+)"').alias("category"), tags.alias("tags"), match(html, r'"thumbnails":\[\{"url":"([^"]+)"').alias("thumbnail_url"),
    )


def vimeo(html: Column, url: Column) -> Column:
    length = match(html, r'"duration":(\d+)').try_cast("bigint")
    author = F.coalesce(strip(first_match(html, (r'(?i)"name":"([^"]+)"', r'(?i)<meta property="video:actor" content="([^"]+)"'))), F.lit(""))
    return F.struct(urls.vimeo_id(url).alias("video_id"), author.alias("author"), length.alias("duration_seconds"), format_duration(length).alias("duration_formatted"))


def any_video(html: Column) -> Column:
    get = lambda patterns, default, tidy=squeeze: F.coalesce(tidy(strip(first_match(html, patterns))), F.lit(default))
    return F.struct(get(VIDEO_TITLES, "Video").alias("title"), get(VIDEO_TEXTS, "").alias("content"), get(VIDEO_AUTHORS, "", lambda c: c).alias("author"))


def video_page(html: Column, url: Column) -> Column:
    """Title, content, author and time of a video's page by its platform: one platform's own patterns, else those of any
    page."""
    platform, tube, other = urls.platform(url), youtube(html), any_video(html)
    own = platform == "youtube"
    fields = [F.when(own, tube[f]).otherwise(other[f]).alias(f) for f in ("title", "content", "author")]
    return F.struct(F.coalesce(platform, F.lit("unknown")).alias("platform"), *fields, F.when(own, youtube_date(html)).otherwise(video_date(html)).alias("created_at"))


def format_duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(seconds.isNull(), None).when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def watch_minutes(seconds: Column) -> Column:
    return F.when(seconds > 0, half_even(seconds / 60, 1))


def better_video_title(title: Column, author: Column) -> Column:
    return F.when((title == "Video") & (F.length(author) > 0), F.concat(F.lit("Video by "), author)).otherwise(title)


def video_metrics(platform: Column, seconds: Column, views: Column) -> Column:
    return F.struct(
        F.coalesce(platform, F.lit("unknown")).alias("platform"), F.coalesce(seconds, F.lit(0)).cast("bigint").alias("duration_seconds"), F.coalesce(format_duration(seconds), F.lit("0:00")).alias("duration_formatted"),
        F.coalesce(views, F.lit(0)).cast("bigint").alias("view_count"), F.coalesce(watch_minutes(seconds), F.lit(0.0)).alias("watch_time_minutes"),
    )


def is_live(title: Column, content: Column) -> Column:
    return has_any(F.lower(title), vocab.LIVE) | has_any(F.lower(content), vocab.LIVE)


def is_short(platform: Column, seconds: Column, title: Column) -> Column:
    return F.coalesce(platform == "tiktok", F.lit(False)) | F.coalesce((platform == "youtube") & (seconds > 0) & (seconds <= 60), F.lit(False)) | has_any(F.lower(title), vocab.SHORT)


def video_topics(tags: Column, title: Column, content: Column) -> Column:
    text = F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit(" "), F.lower(F.coalesce(content, F.lit(""))))
    own = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    return F.array_sort(F.array_union(F.array_compact(own), found(text, vocab.VIDEO_TOPICS)))


def video_quality(content: Column, thumbnail: Column, tags: Column, likes: Column, seconds: Column) -> Column:
    """Score of 0 to 100: a fifth each for a description, a picture, tags, likes, and a length of 30 s to 3 h or unknown."""
    signs = [
        F.coalesce(strip(content) != "", F.lit(False)), F.coalesce(thumbnail != "", F.lit(False)), F.coalesce(F.size(tags) > 0, F.lit(False)),
        F.coalesce(likes.cast("string").isNotNull() & (likes.cast("string") != "") & (likes.cast("string") != "0"), F.lit(False)), F.coalesce((seconds <= 0) | seconds.between(30, 10800), F.lit(True)),
    ]
    total = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int"))
    return half_even(total / 5 * 100, 1)


def fallback(kind: str, url: Column, content: Column, author: Column) -> Column:
    """The record kept where nothing could be extracted."""
    title = {"tweet": F.concat(F.lit("Tweet "), F.coalesce(urls.tweet_id(url), F.lit(""))), "thread": F.lit("Twitter Thread"), "video": F.concat(F.lit("Video from "), F.coalesce(urls.platform(url), F.lit("Unknown")))}[kind]
    return F.struct(title.alias("title"), F.coalesce(content, F.lit("")).alias("content"), F.coalesce(author, F.lit("")).alias("author"), F.lit("fallback").alias("extraction_method"))
