"""Addresses taken apart by patterns; they never raise and keep ports, unlike parse_url."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import has_any, match

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Fixed value: the form of a host.
DOMAIN = r"^[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def _path_and_params(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def path(url: Column) -> Column:
    """The path without the parameters that a semicolon begins in its last segment."""
    return F.regexp_replace(_path_and_params(url), r";[^/]*$", "")


def params(url: Column) -> Column:
    return F.regexp_extract(_path_and_params(url), r";([^/]*)$", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 5)


def parts(url: Column) -> Column:
    return F.struct(scheme(url).alias("scheme"), netloc(url).alias("netloc"), path(url).alias("path"), params(url).alias("params"), query(url).alias("query"), fragment(url).alias("fragment"))


def domain_valid(domain: Column) -> Column:
    """Whether a host, without its port, has labels of letters, digits and inner hyphens of at most 63 each."""
    return F.substring_index(domain, ":", 1).rlike(DOMAIN)


def bookmark_type(url: Column) -> Column:
    """tweet, thread, video or general by what the whole address contains; null for an address of a site for posts
    that is neither of a post nor of a thread."""
    social, video = has_any(url, ["twitter.com", "x.com"]), has_any(url, ["youtube.com", "youtu.be"])
    post = F.when(F.contains(url, F.lit("/status/")), "tweet").when(F.contains(url, F.lit("/thread/")), "thread")
    return F.when(url.isNotNull(), F.when(social, post).when(video, "video").otherwise("general"))


def extractor_route(url: Column) -> Column:
    host = F.lower(netloc(url))
    return F.when(has_any(host, ["twitter.com", "x.com"]), "twitter").when(has_any(host, ["youtube.com", "youtu.be"]), "youtube").otherwise("generic")


def is_twitter(url: Column) -> Column:
    return F.coalesce(F.lower(netloc(url)).isin(vocab.TWITTER_HOSTS), F.lit(False))


def platform(url: Column) -> Column:
    host = F.lower(netloc(url))
    return reduce(lambda rest, p: F.when(has_any(host, p[1]), p[0]).otherwise(rest), reversed(vocab.PLATFORMS), F.lit(None).cast("string"))


# The patterns of ids in addresses of posts and videos.


def tweet_id(url: Column) -> Column:
    return match(url, r"/status/([0-9]+)")


def youtube_id(url: Column) -> Column:
    key = "([a-zA-Z0-9_-]{11})"
    return F.coalesce(match(url, rf"(?:youtube\.com/watch\?v=|youtu\.be/){key}"), match(url, rf"youtube\.com/embed/{key}"), match(url, rf"youtube\.com/v/{key}"))


def vimeo_id(url: Column) -> Column:
    return match(url, r"vimeo\.com/([0-9]+)")
