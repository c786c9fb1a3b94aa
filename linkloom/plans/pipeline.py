"""The whole enrichment as one lazy plan: check, first seen, route, analyse, categorise, tag."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import strip
from ..operators import analysis, categories, pages, state, tags, validate


@dataclass(frozen=True)
class Options:
    analyse: bool = True
    categorise: bool = True
    tag: bool = True
    #: What stands for the time of a row without any; the time of the run by default.
    now: str | None = None


def routed(df: DataFrame, html: str = "html", now: str | None = None) -> DataFrame:
    """df with bookmark_type, and with title, content, author and created_at taken from the page in column `html` for
    posts, threads and videos. Other types, and rows without a page, keep their own; what a page lacks is filled from the
    row. The time of a row without any is `now`. Without such a column only the type is added."""
    kind = F.col("bookmark_type")
    rows = df.withColumn("bookmark_type", urls.bookmark_type(F.col("url")))
    if html in df.columns:
        page = F.col(html)
        video = pages.video_page(page, F.col("url"))
        post = kind.isin("tweet", "thread")
        found = {
            "title": F.when(post, pages.better_post_title(pages.post_title(page), pages.post_text(page), pages.post_author(page))).when(kind == "video", video["title"]),
            "content": F.when(post, pages.post_text(page)).when(kind == "video", video["content"]),
            "author": F.when(post, pages.post_author(page)).when(kind == "video", video["author"]),
            "created_at": F.when(post, pages.post_date(page)).when(kind == "video", video["created_at"]).cast("string"),
        }
        own = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
        rows = rows.withColumns({c: F.coalesce(F.when(page.isNotNull() & (f != ""), f), own(c)) for c, f in found.items()})
    if "created_at" in rows.columns:
        rows = rows.withColumn("created_at", F.coalesce(F.nullif("created_at", F.lit("")), F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))
    return rows


def outcomes(df: DataFrame, options: Options = Options()) -> DataFrame:
    """Every row of df with `status` (successful, failed or skipped), `errors`, and the columns that are wanted, which
    are null where a row isn't successful. A row that fails its checks is skipped, one without content fails; neither
    stops another. No shuffle: a projection of built-in expressions, so unwanted columns cost nothing."""
    errors = validate.bookmark_errors(df)
    rows = routed(df.withColumn("errors", errors), now=options.now)
    blank = F.coalesce(strip(F.col("content")) == "", F.lit(True))
    rows = rows.withColumn("status", F.when(F.size("errors") > 0, "skipped").when(blank, "failed").otherwise("successful"))
    rows = rows.withColumn("errors", F.when(F.col("status") == "failed", F.array(F.lit("Content cannot be empty"))).otherwise(F.col("errors")))
    good = lambda c: F.when(F.col("status") == "successful", c)
    if options.analyse:
        rows = rows.withColumn("analysis_results", good(analysis.analysis(F.col("content"))))
    if options.categorise:
        category = categories.by_keywords(F.col("content"))
        rows = rows.withColumn("categories", good(categories.category_list(category["primary"], category["secondary"])))
    if options.tag:
        rows = rows.withColumn("tags", good(tags.by_keywords(F.col("content"))))
    return rows


def enrich(df: DataFrame, options: Options = Options()) -> DataFrame:
    """The successful rows of outcomes."""
    return outcomes(df, options).where("status = 'successful'").drop("status", "errors")


def rejected(df: DataFrame) -> DataFrame:
    """The rows that are skipped or fail, with status and errors: the output for what went wrong."""
    return outcomes(df, Options(False, False, False)).where("status <> 'successful'")


def process(df: DataFrame, order: list[str], done: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """enrich of the first row of each id that isn't done yet."""
    rows = state.first_seen(df, "id", order)
    return enrich(state.unprocessed(rows, done, "id") if done is not None else rows, options)


def observed(rows: DataFrame, name: str = "linkloom") -> tuple[DataFrame, Observation]:
    """(rows, counts): the rows of outcomes, and how many were successful, failed and skipped, known once the rows have
    been written. On a stream a StreamingQueryListener gets the same counts with every batch."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("successful", "failed", "skipped")]
    seen = Observation(name)
    return rows.observe(name if rows.isStreaming else seen, F.count("*").alias("total_processed"), *counts), seen
