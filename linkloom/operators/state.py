"""State of runs: what is done, which saved states to keep, and how much a window of time has used."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import human_size
from ..runtime import cut_lineage

#: Parts that the rows of one key are ranked in before the key as a whole.
SPLITS = 64


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by `order`; rows without a key are dropped. A key with very many rows is reduced before
    the shuffle, as the least struct of a group is a partial aggregate."""
    rest = [c for c in df.columns if c != key]
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return least.select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in df.columns])


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet. A null key is never done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def done_ids(key: str, *parts: DataFrame) -> DataFrame:
    """(key): what is done after several runs, each once; null is never done."""
    every = parts[0].select(key)
    for p in parts[1:]:
        every = every.unionByName(p.select(key))
    return every.where(F.col(key).isNotNull()).distinct()


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key, nulls last; a partial aggregate, so a key with very many rows is reduced first."""
    rest = [c for c in df.columns if c != key]
    newest = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_row"))
    return newest.select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in df.columns])


def beyond_newest(df: DataFrame, key: str, at: str, tie: str, keep: int) -> DataFrame:
    """Rows to prune: all but the newest `keep` of each key, nulls last.

    A key may have a third of all rows, so its rows are first ranked in SPLITS parts. What is beyond `keep` in its part is
    to prune; only the rest, at most keep * SPLITS rows, is ranked for the key as a whole.
    """
    newest = [F.desc(at), F.desc(tie)]
    part = F.pmod(F.xxhash64(at, tie), F.lit(SPLITS))
    split = df.withColumn("_split", part).withColumn("_n", F.row_number().over(Window.partitionBy(key, "_split").orderBy(*newest)))
    whole = split.withColumn("_split", F.when(F.col("_n") > keep, F.col("_split")).otherwise(-1))
    ranked = whole.withColumn("_m", F.row_number().over(Window.partitionBy(key, "_split").orderBy(*newest)))
    return ranked.where((F.col("_n") > keep) | (F.col("_m") > keep)).drop("_split", "_n", "_m")


def expired(df: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    return df.where(F.col(at) < now - F.expr(f"INTERVAL {days} DAYS"))


def statistics(df: DataFrame, at: str, size: str, *kinds: str) -> DataFrame:
    """One row: how many, their bytes, the oldest and the newest; of each column in `kinds` a MAP of its values' counts."""
    one = df.agg(F.count("*").alias("total"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("total_size_bytes"), F.min(at).alias("oldest"), F.max(at).alias("newest"))
    for k in kinds:
        counts = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n")))).alias(f"by_{k}"))
        one = one.join(F.broadcast(counts), F.lit(True))  # one row each
    return one.withColumn("total_size_human", human_size(F.col("total_size_bytes")))


def batch_number(df: DataFrame, order: str, size: int) -> DataFrame:
    """Position div size, for reports only. Positions count within range partitions of the order plus what stands before
    them, so no single task numbers all rows."""
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1))
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row per partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    start = F.element_at(F.create_map(*[F.lit(x) for p, b in before.items() for x in (p, b)]), F.col("_part")) if before else F.lit(0)
    return ranged.withColumn("batch", F.floor((start + F.col("_at")) / size).cast("bigint")).drop("_part", "_at")


def window_usage(df: DataFrame, key: str, at: str, amount: str, seconds: int = 60) -> DataFrame:
    """Requests and amount of the last `seconds` before and with each row, per key; a row just `seconds` old is out.

    Time is cut into spans of `seconds`; what a row looks back at is in its span or the one before, so each row is sent
    to its own span and, as a witness, to the next. A key with very many rows is spread over its spans.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    span = F.floor(F.col("_us") / (seconds * 1_000_000))
    timed = df.withColumn("_us", us).withColumn("_own", span).withColumn("_span", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(key, "_span").orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    counted = timed.withColumn("requests", F.count("*").over(w)).withColumn("used", F.sum(amount).over(w))
    return counted.where(F.col("_own").eqNullSafe(F.col("_span"))).drop("_us", "_own", "_span")


def admitted(df: DataFrame, key: str, at: str, order: str, amount: str, per_window: int, most: float, seconds: int = 60) -> DataFrame:
    """df with `admitted`: whether a request goes through a limiter that counts only what it let through.

    That depends on all decisions before, so a stretch of requests is walked in order. A pause of a whole window makes
    the limiter forget: where a key has no request in a span of `seconds`, its stretch ends. Stretches are found over
    the spans of each key, not over its rows, and walked as a stream that holds the window's requests only, so a key
    that never pauses takes one task's time but not its memory. A request larger than the limit is rejected for good.
    Rows without a time are rejected; a null amount is none.
    """
    own = list(df.columns)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    timed = df.withColumn("_us", us).withColumn("_span", F.floor(F.col("_us") / (seconds * 1_000_000)))
    spans = timed.where("_span is not null").select(F.col(key).alias("_key"), "_span").distinct()
    w = Window.partitionBy("_key").orderBy("_span")
    stretches = spans.withColumn("_new", F.when(F.col("_span") - F.lag("_span").over(w) > 1, 1).otherwise(0)).withColumn("_stretch", F.sum("_new").over(w)).drop("_new").withColumnRenamed("_span", "_of")
    cut = timed.join(stretches, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_of")), "left").withColumn("_group", F.to_json(F.struct(key, "_stretch")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, used = None, deque(), 0.0
        for b in batches:
            out = []
            for group, t, a in zip(*(b.column(c).to_pylist() for c in ("_group", "_us", "_amount"))):
                if group != now:
                    now, used = group, 0.0
                    kept.clear()
                while kept and t is not None and t - kept[0][0] >= seconds * 1_000_000:
                    used -= kept.popleft()[1]
                ok = t is not None and len(kept) < per_window and used + a <= most
                if ok:
                    kept.append((t, a))
                    used += a
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], pa.array(out, pa.bool_())], [*own, "admitted"])

    schema = df.withColumn("admitted", F.lit(True)).schema
    ordered = cut.repartition("_group").sortWithinPartitions("_group", "_us", order)
    return ordered.select(*own, "_group", "_us", F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("_amount")).mapInArrow(walk, schema)


def run_counters(df: DataFrame, ok: Column, skipped: Column) -> DataFrame:
    """One row: successful, failed and skipped; what is skipped also counts as failed."""
    return df.agg(F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.count_if(skipped).alias("skipped"), F.count("*").alias("total_processed"))
