"""Reading bookmarks from files, and pages and responses through injected transports."""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens_by_length

BOOKMARK = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "url", "title", "content", "author", "created_at", "metadata")])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Bookmarks of JSON documents that are a list, or an object with a list `bookmarks`; both forms may be mixed in one
    folder. A document that is neither, or broken, gives no rows. metadata stays JSON text."""
    wrapped = T.StructType([*BOOKMARK.fields, T.StructField("bookmarks", T.ArrayType(BOOKMARK)), T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(wrapped).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path, multiLine=True).where("_broken is null")
    inner = rows.where("bookmarks is not null").select(F.inline("bookmarks"))
    any_field = " or ".join(f"{f.name} is not null" for f in BOOKMARK.fields)
    return rows.where(f"bookmarks is null and ({any_field})").select(*[f.name for f in BOOKMARK.fields]).unionByName(inner)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One bookmark a line: splittable, for collections too large for one document. Broken lines are left out."""
    schema = T.StructType([*BOOKMARK.fields, T.StructField("_broken", T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").json(path).where("_broken is null").drop("_broken")


def fetch(df: DataFrame, key: str, url: str, transport: Callable[[str], str], out: str = "html") -> DataFrame:
    """(key, url, out, error): what `transport` returns for each address. An exception becomes the row's error, so one bad
    address fails no other; retries and rate limits belong into the transport. Rows go out batch by batch."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, errors = [], []
            for u in b["_url"]:
                try:
                    found.append(transport(u) if u else None)
                    errors.append(None if u else "no address")
                except Exception as e:  # noqa: BLE001 - any failure of one row is data
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: b["_key"], url: b["_url"], out: found, "error": errors})

    return df.select(F.col(key).alias("_key"), F.col(url).alias("_url")).mapInPandas(run, f"{key} {kind}, {url} string, {out} string, error string")


def from_pages(df: DataFrame, pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """df with the page stored for its address, null where there is none: fetching without a network. pages has one row
    for each address, or several of which the greatest page is taken."""
    one = pages.where(F.col(url).isNotNull()).groupBy(url).agg(F.max(html).alias(html))
    return df.join(one, url, "left")


def fetched_only(df: DataFrame) -> DataFrame:
    """Rows of fetch that came back; failures are dropped."""
    return df.where("error IS NULL").drop("error")


def token_counts(df: DataFrame, key: str, text: str, transport: Callable[[str], str], out: str = "tokens") -> DataFrame:
    """(key, out): tokens of each text as a remote counter gives them, or by the text's length where it fails or its
    answer is no number."""
    asked = fetch(df, key, text, transport, "_answer")
    return asked.select(key, F.coalesce(F.col("_answer").try_cast("int"), tokens_by_length(F.coalesce(text, F.lit("")))).alias(out))


class HttpError(Exception):
    """An answer other than 200."""

    def __init__(self, status: int, text: str = "") -> None:
        super().__init__(f"HTTP {status}: {text}")
        self.status = status


def checked(call: Callable[[str], tuple[int, str]]) -> Callable[[str], str]:
    """A transport from one that returns (status, text): any status but 200 is an HttpError, and an address that isn't
    http or https is refused before the call."""

    def run(url: str) -> str:
        if not re.match(r"https?://[^/?#]", url):
            raise ValueError("Invalid URL")
        status, text = call(url)
        if status != 200:
            raise HttpError(status, text)
        return text

    return run


def retrying(call: Callable[[str], str], attempts: int = 3, wait: Callable[[float], None] = time.sleep, delay: float = 1.0, again: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)) -> Callable[[str], str]:
    """A transport that tries again on errors of the connection and on status 429, waiting twice as long each time; other
    errors fail at once."""

    def run(url: str) -> str:
        for n in range(attempts):
            try:
                return call(url)
            except Exception as e:
                if n + 1 == attempts or not (isinstance(e, again) or getattr(e, "status", None) == 429):
                    raise
                wait(delay * 2**n)
        raise ValueError("no attempts")

    return run


def throttled(call: Callable[[str], str], per_minute: int, now: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """A transport that waits until fewer than per_minute calls lie in the last minute. It counts its own worker's calls:
    divide a provider's limit by the number of tasks that run at a time."""
    made: deque[float] = deque()

    def run(url: str) -> str:
        while True:
            while made and now() - made[0] >= 60:
                made.popleft()
            if len(made) < per_minute:
                break
            wait(60 - (now() - made[0]))
        made.append(now())
        return call(url)

    return run


def posted(df: DataFrame, key: str, body: str, transport: Callable[[str], str], out: str = "response") -> DataFrame:
    """(key, out, error): the answers to request bodies, as fetch does for addresses; bodies go through the same
    transports."""
    return fetch(df, key, body, transport, out).drop(body)
