"""Normalising times that each feed wrote in its own way."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import staged, with_utc_micros, written_parts
from ..runtime import broadcast_within, spread, table

#: A table of feeds is broadcast up to this many rows; a longer one is joined by shuffling.
MAX_FEEDS = 20_000
#: Short zone names are looked up over these years.
_YEARS = range(1970, 2038)
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def known_zones(spark: SparkSession) -> list[str]:
    """The zone names both the JVM and Python know."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    names = set(available_timezones())
    return sorted(names & set(jvm.java.time.ZoneId.getAvailableZoneIds())) if jvm else sorted(names)


def _short_names(zone: str | None) -> dict[str, list[tuple[int, int]]]:
    """Short name -> (from, offset in seconds) within one zone, in order of time: what the name means from that second
    since 1970 UTC on. The first meaning holds before it too."""
    try:
        info = ZoneInfo(zone)
    except Exception:  # unknown or null zone
        return {}

    def at(second: int) -> tuple[str, int]:
        local = (_EPOCH + timedelta(seconds=second)).astimezone(info)
        return local.tzname().upper(), int(local.utcoffset().total_seconds())

    found: dict[str, list[tuple[int, int]]] = {}
    start, end = (int((datetime(y, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds()) for y in (_YEARS[0], _YEARS[-1] + 1))
    week, now = 7 * 86_400, at(start)
    changes = [(-(1 << 40), now)]
    for then in range(start + week, end, week):
        if (new := at(then)) != now:
            low, high = then - week, then  # the second of the change
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if at(middle) == now else (low, middle)
            changes.append((high, new))
            now = new
    for second, (name, offset) in changes:
        if name.isalpha() and (name not in found or found[name][-1][1] != offset):
            found.setdefault(name, []).append((second if name in found else -(1 << 40), offset))
    return found


def feed_rules(feeds: DataFrame) -> DataFrame:
    """One row per feed: feed_id, zone, date order, and what each short zone name means there."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(short_names=[[{"name": n, "meanings": [{"since": a, "seconds": x} for a, x in m]} for n, m in _short_names(z).items()] for z in b["_zone"]])

    one = feeds.where(F.col("feed_id").isNotNull()).groupBy(F.col("feed_id").alias("_feed")).agg(F.min("zone_name").alias("_zone"), F.min("date_order").alias("_order"))
    named = one.mapInPandas(add, "_feed string, _zone string, _order string, short_names array<struct<name: string, meanings: array<struct<since: bigint, seconds: int>>>>")
    return named.select("_feed", "_zone", "_order", F.map_from_entries("short_names").alias("_short_names"))


def normalise_times(df: DataFrame, value: str, feeds: DataFrame, feed: str = "feed_id", out: str = "utc_us") -> DataFrame:
    """df with a BIGINT column `out`: the instant that column `value` names, in microseconds since 1970 UTC.

    Null where the value is null, blank, no date, an impossible date, or has neither zone nor offset and its feed has
    no zone. Of a wall time that occurs twice the first is taken; one that is skipped is read with the offset before
    the change. Rows are kept as they are, repeated ones too; an empty df or empty feeds give a defined result. df may
    have any further columns but `out` and those beginning with `_`.
    """
    rules = broadcast_within(feed_rules(feeds), MAX_FEEDS)
    joined = staged(df, {"_parts": written_parts(F.col(value))}).join(rules, F.col(feed) == F.col("_feed"), "left")
    return with_utc_micros(joined, out, known_zones(df.sparkSession)).select(*df.columns, out)


def found_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: the instant of every bookmark's created_at and every extraction's published_date that denotes one."""
    feeds = table(spark, sf_dir, "feeds")
    sources = (("bookmarks", "bm_seq", "created_at"), ("extracted_content", "extract_id", "published_date"))
    parts = [spread(table(spark, sf_dir, name)).select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("row_key"), F.col(value).alias("written"), "feed_id") for name, key, value in sources]
    every = parts[0].unionByName(parts[1])
    return normalise_times(every, "written", feeds).where("utc_us is not null").select("table_name", "row_key", "utc_us")
