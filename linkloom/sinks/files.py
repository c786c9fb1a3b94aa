"""Writing the knowledge base. Every format is written by the executors; nothing is gathered on the driver."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import analysis, knowledge

log = logging.getLogger(__name__)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields kept, in path/bookmarks, and one line about the collection in path/metadata:
    a single document would have to be written by one task."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/bookmarks")
    knowledge.header(df).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_csv(df: DataFrame, path: str) -> None:
    """The columns of knowledge.csv_rows, with metadata and analysis_results as JSON where df has them."""
    more = any(c in df.columns for c in knowledge.MORE)
    knowledge.csv_rows(df, more).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_markdown(df: DataFrame, path: str, title: str = "Knowledge Base", order: str | None = None) -> None:
    """A title with date and count, a table of contents, then blocks of records by category, each category under its
    heading; split over files by range of category. order names a column that orders the records of a category, by
    default `id` where there is one.

    df has title, author, url, bookmark_type, tags, created_at, content, categories and key_insights."""
    c = F.col
    order = order or ("id" if "id" in df.columns else "url")
    block = knowledge.markdown_record(c("title"), c("author"), c("url"), c("bookmark_type"), F.array_compact("tags"), c("created_at").cast("string"), c("content"), F.array_compact("key_insights"))
    number = isinstance(df.schema[order].dataType, T.NumericType)
    at = lambda kind, o, n=F.lit(None): (F.lit(kind).alias("kind"), n.cast("decimal(38,9)").alias("number"), o.cast("string").alias("at"))
    rows = df.select(F.lit(1).alias("section"), knowledge.primary(c("categories")).alias("category"), *at(1, c(order), c(order) if number else F.lit(None)), block.alias("value"))
    contents = knowledge.contents_table(df)
    heads = contents.select(F.lit(1).alias("section"), "category", *at(0, F.lit("")), F.concat(F.lit("## "), c("category"), F.lit("\n")).alias("value"))
    entries = contents.select(F.lit(0).alias("section"), c("category"), *at(1, F.lit("")), c("entry").alias("value"))
    top = knowledge.header(df).select(F.lit(0).alias("section"), F.lit("").alias("category"), *at(-1, F.lit("")), F.concat(F.lit(f"# {title}\n\nGenerated on: "), F.substring("generated_at", 1, 19), F.lit("\nTotal bookmarks: "), c("total_bookmarks").cast("string"), F.lit("\n\n---\n\n## Table of Contents\n")).alias("value"))
    end = df.sparkSession.createDataFrame([(0, "\U0010ffff", 2, None, "", "\n---\n")], "section int, category string, kind int, number decimal(38,9), at string, value string")
    rows.unionByName(heads).unionByName(entries).unionByName(top).unionByName(end).orderBy("section", "category", "kind", "number", "at", F.xxhash64("value")).select("value").write.mode("overwrite").text(path)


def write_training(df: DataFrame, path: str, least: int = 11) -> bool:
    """Training samples, if there are at least `least` records; whether anything was written."""
    if df.limit(least).count() < least:
        return False
    c = F.col
    sample = knowledge.training_rows(c("content"), c("categories"), c("tags"), c("analysis_results"), c("url"), c("title"), c("author"), c("bookmark_type"))
    df.select(sample.alias("value")).write.mode("overwrite").text(path)
    return True


def write_statistics(df: DataFrame, path: str) -> None:
    """(kind, value, n) of types, categories, tags and authors, and the times as further kinds."""
    c = F.col
    counts = [
        analysis.histogram(df, c("bookmark_type")).select(F.lit("bookmark_types").alias("kind"), "value", c("n").cast("double").alias("n")),
        analysis.item_counts(df, c("categories")).select(F.lit("categories").alias("kind"), c("item").alias("value"), c("n").cast("double").alias("n")),
        analysis.item_counts(df, c("tags")).select(F.lit("tags").alias("kind"), c("item").alias("value"), c("n").cast("double").alias("n")),
        knowledge.counts(df, c("author"), "value").select(F.lit("authors").alias("kind"), "value", c("n").cast("double").alias("n")),
    ]
    times = knowledge.time_statistics(df).select(F.inline(F.array(*[F.struct(F.lit("processing_times").alias("kind"), F.lit(n).alias("value"), c(n).cast("double").alias("n")) for n in ("total", "average", "min", "max")])))
    out = times
    for part in counts:
        out = out.unionByName(part)
    out.write.mode("overwrite").json(path)


WRITERS: dict[str, Callable[[DataFrame, str], object]] = {"json": write_json, "csv": write_csv, "markdown": write_markdown, "training": write_training}


def write_knowledge_base(df: DataFrame, base: str, formats: tuple[str, ...] = ("json", "csv", "markdown")) -> dict[str, str]:
    """Format -> folder of what was written; a format that fails is logged and left out. Statistics are always written.
    df is read once a format: persist it if it is costly."""
    done = {}
    for name in formats:
        try:
            WRITERS[name](df, f"{base}/{name}")
            done[name] = f"{base}/{name}"
        except KeyError:
            log.error("unknown format %s", name)
        except Exception:  # noqa: BLE001 - one format mustn't stop the others
            log.exception("could not write %s", name)
    write_statistics(df, f"{base}/statistics")
    return done | {"statistics": f"{base}/statistics"}
