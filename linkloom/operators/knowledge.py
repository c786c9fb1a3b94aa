"""The knowledge base: rows of its formats and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug


def primary(categories: Column) -> Column:
    return F.coalesce(F.get(categories, F.lit(0)), F.lit("Uncategorized"))


def json_rows(df: DataFrame) -> DataFrame:
    """(id, json): one JSON object per record, null fields kept."""
    return df.select("id", F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


#: Columns of a CSV file and of JSON rows, in order; those after the first that a table lacks are null.
COLUMNS = ("id", "title", "url", "author", "content", "bookmark_type", "categories", "tags", "created_at", "processed_at", "processing_time")
MORE = ("metadata", "analysis_results")


def header(df: DataFrame, version: str = "1") -> DataFrame:
    """One row about a collection: when it was made, its number of records, the maker and its version."""
    return df.agg(F.count("*").alias("total_bookmarks")).select(F.current_timestamp().cast("string").alias("generated_at"), "total_bookmarks", F.lit("linkloom").alias("generator"), F.lit(version).alias("version"))


def csv_rows(df: DataFrame, with_more: bool = False) -> DataFrame:
    """COLUMNS as flat values: texts cut at 1000 characters, lists joined by semicolons, null lists empty, times as ISO
    text. with_more adds MORE as JSON."""
    lists = {c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "; ") for c in ("categories", "tags") if c in df.columns}
    flat = df.withColumns(lists | {"content": F.substring("content", 1, 1000)} if "content" in df.columns else lists)
    times = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c, kind in flat.dtypes if c in COLUMNS and kind.startswith("timestamp")}
    nested = {c: F.to_json(c) for c, kind in flat.dtypes if c in MORE and kind.startswith(("struct", "map", "array"))}
    flat = flat.withColumns(times | nested)
    return flat.select(*[F.col(c) if c in flat.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS + (MORE if with_more else ())])


def exported(df: DataFrame, format: str = "json") -> DataFrame:
    """(value): the records as text, one object a row. CSV isn't exported in this way; other formats are unknown."""
    if format == "csv":
        raise NotImplementedError("CSV export not yet implemented")
    if format != "json":
        raise ValueError(f"Unsupported export format: {format}")
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def markdown_record(title: Column, author: Column, url: Column, kind: Column, tags: Column, created: Column, content: Column, insights: Column) -> Column:
    """A record's block. Content is cut at 500 characters and always gets dots; up to three insights."""
    body = F.when(F.length(content) > 0, F.concat(F.lit("\n**Content:**\n"), F.substring(content, 1, 500), F.lit("...")))
    told = F.when(F.size(insights) > 0, F.concat(F.lit("\n**Key Insights:**\n"), F.array_join(F.transform(F.slice(insights, 1, 3), lambda i: F.concat(F.lit("- "), i)), "\n")))
    return F.concat_ws(
        "\n", F.concat(F.lit("### "), F.coalesce(title, F.lit(""))), F.concat(F.lit("**Author:** "), F.coalesce(author, F.lit(""))), F.concat(F.lit("**URL:** ["), F.coalesce(url, F.lit("")), F.lit("]("), F.coalesce(url, F.lit("")), F.lit(")")),
        F.concat(F.lit("**Type:** "), F.coalesce(kind, F.lit(""))), F.concat(F.lit("**Tags:** "), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", ")), F.concat(F.lit("**Created:** "), F.coalesce(created, F.lit(""))), body, told, F.lit("\n---\n"),
    )


def contents_table(df: DataFrame, categories: str = "categories") -> DataFrame:
    """(category, entry): the table of contents, in order of category."""
    c = F.col("category")
    return df.select(primary(F.col(categories)).alias("category")).distinct().select(c, F.concat(F.lit("- ["), c, F.lit("](#"), slug(c), F.lit(")")).alias("entry")).orderBy("category")


def training_rows(content: Column, categories: Column, tags: Column, analysis: Column, url: Column, title: Column, author: Column, kind: Column) -> Column:
    """A training sample as JSON."""
    meta = F.struct(url.alias("url"), title.alias("title"), author.alias("author"), kind.alias("type"))
    out = F.struct(categories.alias("categories"), tags.alias("tags"), analysis.alias("analysis"))
    return F.to_json(F.struct(content.alias("input"), out.alias("output"), meta.alias("metadata")), {"ignoreNullFields": "false"})


def time_statistics(df: DataFrame, seconds: str = "processing_time") -> DataFrame:
    """One row of sum, mean, least and most; nulls for an empty df."""
    return df.agg(F.sum(seconds).alias("total"), F.avg(seconds).alias("average"), F.min(seconds).alias("min"), F.max(seconds).alias("max"))


def counts(df: DataFrame, value: Column, name: str) -> DataFrame:
    """(name, n) of values that are neither null nor empty."""
    return df.select(value.alias(name)).where((F.col(name).isNotNull()) & (F.col(name) != "")).groupBy(name).agg(F.count("*").alias("n"))
