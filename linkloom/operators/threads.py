"""Threads of posts: assembly, totals and what their texts say.

A thread is rows of posts with one thread key. Assembly groups them once; the hot keys of a few very long threads are
bounded by what one record may hold, as the result has one row per thread.

Fixed values: the titles of threads and posts, as they are part of the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import found, half_even, has_any, sorted_set, strip


def is_self_reply(content: Column, author: Column) -> Column:
    return F.coalesce((author != "") & F.contains(content, F.concat(F.lit("@"), author)), F.lit(False))


def is_thread(content: Column, author: Column) -> Column:
    """Whether a post looks like part of a thread."""
    return has_any(F.lower(content), vocab.THREAD_MARKS) | is_self_reply(content, author) | F.coalesce(content.rlike(r"(?U)\b\d+/\d*\b"), F.lit(False))


def numbered(df: DataFrame, thread: str, pos: str) -> DataFrame:
    """df with `number`: the place of a post in its thread from 1 on."""
    return df.withColumn("number", F.row_number().over(Window.partitionBy(thread).orderBy(pos)))


def assemble(df: DataFrame, thread: str = "thread_id", pos: str = "pos") -> DataFrame:
    """One row per thread: (thread, author, title, content, thread_length, tweets, totals, hashtags, mentions).

    df has content, author, replies, retweets, likes, hashtags and mentions. Posts without text keep their number but
    add nothing to the content. Null counts are 0; null lists are empty. Posts without a thread are none: their null key
    would bring them together in one row.
    """
    df = df.where(F.col(thread).isNotNull())
    tweet = F.struct(F.col(pos).alias("pos"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("author", F.lit("Unknown")).alias("author"), *[F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in ("replies", "retweets", "likes")])
    empty = F.array().cast("array<string>")
    marks = [sorted_set(F.flatten(F.collect_list(F.coalesce(c, empty)))).alias(c) for c in ("hashtags", "mentions")]
    one = df.groupBy(thread).agg(F.array_sort(F.collect_list(tweet)).alias("tweets"), *marks)
    t, n = F.col("tweets"), F.size("tweets")
    author = F.get(t, F.lit(0))["author"]
    lines = F.filter(F.transform(t, lambda x, i: F.when(x["content"] != "", F.when(n > 1, F.concat((i + 1).cast("string"), F.lit(". "), x["content"])).otherwise(x["content"]))), lambda x: x.isNotNull())
    total = lambda name: F.aggregate(t, F.lit(0).cast("bigint"), lambda a, x: a + x[name])
    return one.select(
        thread, author.alias("author"), F.when(n > 1, F.format_string("Twitter Thread by %s (%d tweets)", author, n)).otherwise(F.concat(F.lit("Tweet by "), author)).alias("title"),
        F.array_join(lines, "\n\n").alias("content"), n.alias("thread_length"), "tweets", total("replies").alias("total_replies"), total("retweets").alias("total_retweets"), total("likes").alias("total_likes"), "hashtags", "mentions",
    )


def summary(threads: DataFrame, thread: str = "thread_id") -> DataFrame:
    """Characters, their mean a post, the post with most engagement (the first of several; none if all have none)."""
    t = F.col("tweets")
    chars = F.aggregate(t, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["content"]))
    engaged = F.filter(F.transform(t, lambda x: F.struct((-(x["replies"] + x["retweets"] + x["likes"])).alias("less"), x["pos"].alias("pos"))), lambda x: x["less"] < 0)
    return threads.select(
        thread, "thread_length", chars.alias("total_characters"), half_even(chars / F.size(t), 1).alias("average_characters"), F.array_min(engaged)["pos"].alias("most_engaged_pos"),
        F.size("hashtags").alias("hashtags_count"), F.size("mentions").alias("mentions_count"), half_even(chars / 1000, 1).alias("estimated_reading_time"),
    )


def key_points(content: Column, most: int = 10) -> Column:
    """First sentences of the numbered pieces of more than 20 characters."""
    pieces = F.filter(F.transform(F.split(content, r"\n\n\d+\.\s*"), strip), lambda p: F.length(p) > 20)
    return F.slice(F.filter(F.transform(pieces, lambda p: strip(F.substring_index(p, ".", 1))), lambda p: p != ""), 1, most)


def topics(hashtags: Column, content: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(hashtags, F.array().cast("array<string>")), found(F.lower(content), vocab.THREAD_TOPICS)))


def is_complete(tweets: Column) -> Column:
    return F.coalesce((F.size(tweets) > 0) & ~has_any(F.lower(F.try_element_at(tweets, F.lit(-1))["content"]), vocab.CONTINUES), F.lit(False))


def structure(tweets: Column, content: Column) -> Column:
    n = F.size(tweets)
    first, last = F.lower(F.get(tweets, F.lit(0))["content"]), F.lower(F.try_element_at(tweets, F.lit(-1))["content"])
    return F.struct(
        n.alias("total_tweets"), has_any(first, vocab.INTRODUCES).alias("has_introduction"), ((n > 1) & has_any(last, vocab.CONCLUDES)).alias("has_conclusion"),
        F.coalesce(content.rlike(r"\d+\.\s"), F.lit(False)).alias("has_numbered_points"), F.exists(tweets, lambda t: has_any(F.lower(t["content"]), vocab.CALLS)).alias("has_call_to_action"),
    )
