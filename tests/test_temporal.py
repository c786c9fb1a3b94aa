"""Times of all forms against values worked out by hand and by the standard library."""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from linkloom.operators.temporal import normalise_times

FEEDS = [("ny", "America/New_York", "mdy"), ("be", "Europe/Berlin", "dmy"), ("ka", "Asia/Kolkata", "dmy"), ("no", None, "ymd"), ("bad", "Mars/Base", "dmy"), ("ym", "UTC", "ymd"), ("mo", "Europe/Moscow", "dmy")]


def us(*at, zone=timezone.utc, fold=0):
    t = datetime(*at, tzinfo=ZoneInfo(zone) if isinstance(zone, str) else zone, fold=fold)
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // __import__("datetime").timedelta(microseconds=1)


CASES = [
    ("ny", "2024-07-01T12:00:00Z", us(2024, 7, 1, 12)),
    ("ny", " 2024-07-01 12:00:00.123456789Z\n", us(2024, 7, 1, 12, 0, 0, 123456)),
    ("ny", "2024-07-01 12:00:00,5", us(2024, 7, 1, 12, 0, 0, 500000, zone="America/New_York")),
    ("be", "2024-07-01T12:00:00+05:45", us(2024, 7, 1, 6, 15)),
    ("be", "2024-07-01T12:00:00−0700", us(2024, 7, 1, 19)),
    ("be", "2024-07-01T12:00:00-07:00[America/Los_Angeles]", us(2024, 7, 1, 19)),
    ("be", "2024-07-01 12:00:00 GMT+02:00", us(2024, 7, 1, 10)),
    ("be", "2024-07-01 12:00:00 Asia/Tokyo", us(2024, 7, 1, 3)),
    ("be", "2024-07-01 12:00:00 No/Where", None),
    ("be", "20240701T120000Z", us(2024, 7, 1, 12)),
    ("be", "Mon, 01 Jul 2024 12:00:00 +0200", us(2024, 7, 1, 10)),
    ("ny", "Mon Jul 01 12:00:00 EDT 2024", us(2024, 7, 1, 16)),
    ("ny", "Sun Nov 03 01:30:00 EST 2024", us(2024, 11, 3, 6, 30)),
    ("ka", "Mon Jul 01 12:00:00 IST 2024", us(2024, 7, 1, 6, 30)),
    ("ny", "Apr 10, 2023 4:27:55 AM GMT", us(2023, 4, 10, 4, 27, 55)),
    ("ny", "April 1, 2023 12:05pm", us(2023, 4, 1, 12, 5, zone="America/New_York")),
    ("ny", "April 1, 2023 12:05 AM", us(2023, 4, 1, 0, 5, zone="America/New_York")),
    ("be", "1 Apr 2023, 09:34", us(2023, 4, 1, 9, 34, zone="Europe/Berlin")),
    ("ny", "03/04/2024 10:00:00", us(2024, 3, 4, 10, zone="America/New_York")),
    ("be", "03/04/2024 10:00:00", us(2024, 4, 3, 10, zone="Europe/Berlin")),
    ("be", "31.12.2023", us(2023, 12, 31, zone="Europe/Berlin")),
    ("ny", "31/12/2023", None),
    ("ym", "03/04/2024", None),
    ("be", "2024-10-27 02:30:00", us(2024, 10, 27, 0, 30)),
    ("be", "2024-03-31 02:30:00", us(2024, 3, 31, 1, 30)),
    ("no", "2024-07-01 12:00:00", None),
    ("no", "2024-07-01 12:00:00Z", us(2024, 7, 1, 12)),
    ("bad", "2024-07-01 12:00:00", None),
    (None, "2024-07-01", None),
    (None, "1719835200", us(2024, 7, 1, 12)),
    (None, "1719835200123", us(2024, 7, 1, 12, 0, 0, 123000)),
    (None, "1719835200123456", us(2024, 7, 1, 12, 0, 0, 123456)),
    (None, "1719835200.25", us(2024, 7, 1, 12, 0, 0, 250000)),
    ("be", "2023-02-30T08:15:00Z", None),
    ("be", "2021-02-29 07:00:00+01:00", None),
    ("be", "2024-02-29T07:00:00+01:00", us(2024, 2, 29, 6)),
    ("be", "2022-11-05T25:10:00Z", None),
    ("be", "0000-00-00 00:00:00", None),
    ("be", "20223-01-05", None),
    ("be", "12:45", None),
    ("be", "2 hours ago", None),
    ("be", "13:00 PM", None),
    ("be", "", None),
    ("be", " ", None),
    ("be", None, None),
    ("be", "1970-01-01T00:00:00Z", 0),
    ("be", "x" * 20000, None),
]


def test_forms(spark):
    feeds = spark.createDataFrame(FEEDS, "feed_id string, zone_name string, date_order string")
    rows = spark.createDataFrame([(i, f, v, "clash") for i, (f, v, _) in enumerate(CASES)], "i int, feed_id string, v string, zone_name string")
    got = {r["i"]: r["utc_us"] for r in normalise_times(rows, "v", feeds).collect()}
    wrong = [(v, want, got[i]) for i, (_, v, want) in enumerate(CASES) if got[i] != want]
    assert not wrong


def test_repeated_rows_and_extra_columns_stay(spark):
    feeds = spark.createDataFrame(FEEDS[:1] * 2, "feed_id string, zone_name string, date_order string")
    rows = spark.createDataFrame([("ny", "2024-01-01", 1)] * 3, "feed_id string, v string, date_order int")
    out = normalise_times(rows, "v", feeds)
    assert out.columns == ["feed_id", "v", "date_order", "utc_us"] and out.count() == 3


@pytest.mark.parametrize("empty", ["rows", "feeds"])
def test_empty_tables(spark, empty):
    feeds = spark.createDataFrame([] if empty == "feeds" else FEEDS, "feed_id string, zone_name string, date_order string")
    rows = spark.createDataFrame([] if empty == "rows" else [("ny", "2024-01-01T00:00:00Z")], "feed_id string, v string")
    assert normalise_times(rows, "v", feeds).where(F.col("utc_us").isNotNull()).count() == (empty == "feeds")


def test_found_on_data(spark, sf_dir):
    from linkloom.operators.temporal import found_times

    df = found_times(spark, sf_dir)
    assert df.dtypes == [("table_name", "string"), ("row_key", "bigint"), ("utc_us", "bigint")] and df.count() > 0
