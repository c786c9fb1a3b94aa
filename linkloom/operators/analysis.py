"""Tone, depth, kind, topics and insights of a text by keywords; every function is one Column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import half_even, has_any, hits, let, strip, word_count


def _more(c: Column, above: list[str], below: list[str], names: tuple[str, str, str]) -> Column:
    difference = let(F.lower(c), lambda low: hits(low, above) - hits(low, below))
    return let(difference, lambda d: F.when(d > 0, names[0]).when(d < 0, names[1]).otherwise(names[2]))


def sentiment(c: Column) -> Column:
    return _more(c, vocab.POSITIVE, vocab.NEGATIVE, ("Positive", "Negative", "Neutral"))


def complexity(c: Column) -> Column:
    return _more(c, vocab.COMPLEX, vocab.SIMPLE, ("High", "Low", "Medium"))


def content_type(c: Column) -> Column:
    """The first kind one of whose words occurs; Article for none and for null."""

    def of(low: Column) -> Column:
        out = None
        for name, words in vocab.CONTENT_TYPES:
            cond = has_any(low, words)
            out = F.when(cond, name) if out is None else out.when(cond, name)
        return out.otherwise("Article")

    return let(F.lower(c), of)


def title_case(word: str) -> str:
    return word.title()


def topics_by_keyword(c: Column, most: int = 5) -> Column:
    named = lambda low: F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(title_case(w))) for w in vocab.TECH_TOPICS + vocab.BUSINESS_TOPICS])
    return F.slice(F.array_compact(let(F.lower(c), named)), 1, most)


def insights_by_keyword(c: Column, most: int = 3) -> Column:
    """Sentences of more than 20 characters that hold a telling word."""
    sentences = F.transform(F.split(F.coalesce(c, F.lit("")), r"\."), strip)
    return F.slice(F.filter(sentences, lambda s: (F.length(s) > 20) & has_any(F.lower(s), vocab.INSIGHT_WORDS)), 1, most)


def reading_minutes(c: Column) -> Column:
    return word_count(c) / F.lit(200.0)


def analysis(c: Column) -> Column:
    """All keyword analysis of a text as one struct."""
    return F.struct(
        topics_by_keyword(c).alias("main_topics"), insights_by_keyword(c).alias("key_insights"), sentiment(c).alias("sentiment"), complexity(c).alias("complexity_level"),
        content_type(c).alias("content_type"), word_count(c).alias("word_count"), reading_minutes(c).alias("reading_time_minutes"),
    )


def default_analysis(error: Column) -> Column:
    """What stands for an analysis that failed; its fields are fixed values."""
    return F.struct(F.lit(1.0).alias("relevance_score"), F.lit("Neutral").alias("sentiment"), F.lit("Medium").alias("complexity_level"), F.lit("Article").alias("content_type"), F.lit(0).alias("word_count"), F.lit(0.0).alias("reading_time_minutes"), error.alias("error"))


def summary(df: DataFrame, a: str = "analysis_results") -> DataFrame:
    """One row of means over rows that have an analysis; no row for none, as null means stand for nothing."""
    c = F.col(a)
    return df.where(c.isNotNull()).agg(
        F.count("*").alias("total_analyzed"), half_even(F.avg(c["relevance_score"]), 2).alias("average_relevance_score"), half_even(F.avg(c["word_count"]), 0).alias("average_word_count"), half_even(F.avg(c["reading_time_minutes"]), 1).alias("average_reading_time"),
    ).where("total_analyzed > 0")


def histogram(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """(name, n), most frequent first, ties by value; null values count as null."""
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def item_counts(df: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """(name, n): how often each item of an array occurs over all rows."""
    return df.select(F.explode(items).alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def top_items(df: DataFrame, items: Column, n: int, name: str = "item", order: str | None = None) -> DataFrame:
    """(name, n) of the n most frequent items. Of equally frequent ones the first seen comes first where `order` names a
    column that orders the rows, else the smaller value."""
    if order is None:
        return item_counts(df, items, name).orderBy(F.desc("n"), name).limit(n)
    each = df.select(F.col(order).alias("_order"), F.posexplode(items).alias("_pos", name)).where(F.col(name).isNotNull())
    counts = each.groupBy(name).agg(F.count("*").alias("n"), F.min(F.struct("_order", "_pos")).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(n).select(name, "n")
