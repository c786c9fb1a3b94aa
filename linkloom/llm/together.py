"""Items that occur together: packed 64-bit pair codes, sorted externally and counted as runs.

Each item gets a 32-bit code; a pair is one 64-bit integer, the smaller code in the upper half. Tasks write their pairs
as sorted runs with counts, so a pair that every third record holds leaves a task as one row a run. Spark's sort spills
and merges the runs of a share of the codes; equal codes then stand together and are added up in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage, table

#: Pairs that a task sorts at a time.
RUN_PAIRS = 1 << 21
#: Items, or keys that occur again, that may be broadcast, and the items' bytes; longer lists are joined by shuffling.
MAX_BROADCAST, MAX_BYTES = 1_000_000, 32_000_000


def clean_items(items: Column) -> Column:
    """Items trimmed of white space and lower-cased, each once; null and blank ones left out."""
    plain = F.transform(items, lambda x: F.lower(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    return F.array_distinct(F.filter(plain, lambda x: x.isNotNull() & (x != "")))


_RUN = pa.schema([("pair", pa.int64()), ("n", pa.int64())])


def _runs(codes: np.ndarray) -> pa.RecordBatch:
    codes, n = np.unique(codes, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], schema=_RUN)


class _Held:
    """Pairs of a task; given out as a sorted run whenever there are RUN_PAIRS of them, also within one record."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.size = 0

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.codes:
            yield _runs(np.concatenate(self.codes))
        self.codes, self.size = [], 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of lists of ascending codes, one list after the other."""
        starts = np.cumsum(sizes) - sizes
        for k in np.unique(sizes[sizes > 1]):  # all records of one size at once
            rows = values[starts[sizes == k][:, None] + np.arange(k)]
            for i in range(k - 1):
                width = k - 1 - i
                step = max(1, RUN_PAIRS // width)
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    self.codes.append(((part[:, i : i + 1] << 32) | part[:, i + 1 :]).ravel())
                    self.size += self.codes[-1].size
                    if self.size >= RUN_PAIRS:
                        yield from self.take()


def _pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of (pair, n) from lists of ascending codes."""
    held = _Held()
    for b in batches:
        lists = b.column("codes")
        yield from held.add(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy()))
    yield from held.take()


def _coded_runs(sent):
    """As _pair_runs, from lists of items, one column a field. sent: of each field its items in order of their codes and
    the first code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for b in batches:
            for k, (items, first) in enumerate(sent.value):
                lists = b.column(k)
                record = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                at = pc.index_in(lists.flatten(), value_set=items)
                there = at.is_valid().to_numpy(zero_copy_only=False)
                record, codes = record[there], at.drop_null().to_numpy().astype(np.int64) + first
                order = np.lexsort((codes, record))
                yield from held.add(codes[order], np.bincount(record, minlength=len(lists)))
        yield from held.take()

    return run


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per pair from a partition sorted by pair."""
    last, total = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        pairs, n = b.column("pair").to_numpy(), b.column("n").to_numpy()
        starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        codes, sums = pairs[starts], np.add.reduceat(n, starts)
        if last is not None:
            if codes[0] == last:
                sums[0] += total
            else:
                codes, sums = np.append(last, codes), np.append(total, sums)
        last, total = codes[-1], sums[-1]
        yield pa.RecordBatch.from_arrays([pa.array(codes[:-1]), pa.array(sums[:-1])], schema=_RUN)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total], pa.int64())], schema=_RUN)


def records(df: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, int]:
    """One row per record with the items of each field, and the number of records. A key that occurs again is the same
    record; of rows that differ under one key each field's union is taken. Rows without a key are no records.

    Only keys are shuffled, and the rows of those that occur again: where these are few, all others stay where they are.
    """
    df = df.where(F.col(key).isNotNull())
    keys = df.groupBy(F.col(key).alias("_key")).agg((F.count("*") > 1).alias("again"))
    n = keys.agg(F.count("*"), F.count_if("again")).first()
    again = cut_lineage(keys.where("again").select("_key"))
    again = F.broadcast(again) if n[1] <= MAX_BROADCAST else again
    names = [f"_{i}" for i in range(len(fields))]
    rows = df.select(F.col(key).alias("_key"), *[F.coalesce(clean_items(F.col(f)), F.array().cast("array<string>")).alias(x) for f, x in zip(fields, names)])
    once = rows.join(again, "_key", "left_anti").select(*names)
    each = F.array(*[F.struct(F.lit(x).alias("f"), F.col(x).alias("items")) for x in names])
    several = rows.join(again, "_key", "left_semi").select("_key", F.inline(each)).select("_key", "f", F.explode("items").alias("item")).distinct()
    several = several.groupBy("_key").agg(*[F.collect_list(F.when(F.col("f") == x, F.col("item"))).alias(x) for x in names]).select(*names)
    return once.unionByName(several), n[0]


def numbered(counts: DataFrame) -> tuple[DataFrame, int]:
    """counts with a code of 31 bits that ascends with field and item, and the number of codes."""
    ordered = cut_lineage(counts.orderBy("field", "item").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
    sizes = {r["_part"]: r["n"] for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if total >= 1 << 31:
        raise ValueError("more items than codes of 31 bits")
    start = F.element_at(F.create_map(*[F.lit(x) for p, b in before.items() for x in (p, b)]), F.col("_part")) if before else F.lit(0)
    return cut_lineage(ordered.select("field", "item", "n_item", (start + F.col("_at")).cast("bigint").alias("code"))), total


def _all_runs(each: DataFrame, items: DataFrame, fields: list[str], small: bool) -> DataFrame:
    """Sorted runs of the records' pairs. A small dictionary goes to the executors, and no record leaves its task; with
    a larger one, items are joined with their codes and records put together again."""
    if small:
        by_code = items.orderBy("code").toArrow()
        sent, first = [], 0
        for f in fields:
            own = by_code.filter(pc.equal(by_code["field"], f))
            sent.append((own["item"].combine_chunks(), own["code"][0].as_py() if len(own) else 0))
        return each.mapInArrow(_coded_runs(each.sparkSession.sparkContext.broadcast(sent)), "pair bigint, n bigint")
    one = cut_lineage(each.withColumn("_row", F.monotonically_increasing_id()))
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("items")) for i, f in enumerate(fields)])
    coded = one.select("_row", F.inline(parts)).select("_row", "field", F.explode("items").alias("item")).join(items.select("field", "item", "code"), ["field", "item"])
    lists = coded.groupBy("_row", "field").agg(F.array_sort(F.collect_list("code")).alias("codes")).where(F.size("codes") > 1).select("codes")
    return lists.mapInArrow(_pair_runs, "pair bigint, n bigint")


def pairs_together(df: DataFrame, key: str, fields: list[str], min_count: int = 1, min_share: float = 0.0) -> DataFrame:
    """(field, item_a, item_b, n_ab, n_a, n_b, n, lift, odds_ratio, log_odds_error): pairs in the same record.

    item_a is the smaller string. n is the number of records, n_a and n_b count those with each item, n_ab those with
    both. A pair is left out if n_ab is below min_count or min_share * n. An item on fewer records can't be in a pair
    that is kept, so it gets no code; that loses nothing, and with a share the items are few whatever the data: at most
    the mean number of items of a record divided by the share. More than 2**31 items with a code raise ValueError.
    lift is n_ab * n / (n_a * n_b). odds_ratio has half a record added to each of the four cells, so it is finite;
    log_odds_error is the standard error of its logarithm. All three are doubles, so no product overflows.

    Null or blank items and null lists count for nothing; a record with none still counts in n. An empty table gives
    no rows. Columns other than key and fields play no part.
    """
    each, n = records(df, key, fields)
    least = max(min_count, int(np.ceil(min_share * n)), 1)
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("items")) for i, f in enumerate(fields)])
    singly = each.select(F.inline(parts)).select("field", F.explode("items").alias("item"))
    items, total = numbered(singly.groupBy("field", "item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= least))
    small = total <= MAX_BROADCAST and (items.agg(F.sum(F.octet_length("item"))).first()[0] or 0) <= MAX_BYTES
    # Runs hold each pair once, so that one in every third record is a row a run; each task adds up its share of the codes.
    runs = _all_runs(each, items, fields, small)
    summed = runs.repartition(F.col("pair")).sortWithinPartitions("pair").mapInArrow(_count_runs, "pair bigint, n bigint")
    kept = summed.where(F.col("n") >= least).select(F.shiftright("pair", 32).alias("_a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("_b"), F.col("n").alias("n_ab"))
    a = items.select(F.col("code").alias("_a"), "field", F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = items.select(F.col("code").alias("_b"), F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    if small:
        a, b = F.broadcast(a), F.broadcast(b)
    ab, x, y, every = (c.cast("double") for c in (F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.lit(n)))
    cells = [ab + 0.5, x - ab + 0.5, y - ab + 0.5, every - x - y + ab + 0.5]
    return kept.join(a, "_a").join(b, "_b").select(
        "field", "item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"),
        (ab * every / (x * y)).alias("lift"), (cells[0] * cells[3] / (cells[1] * cells[2])).alias("odds_ratio"),
        F.sqrt(1 / cells[0] + 1 / cells[1] + 1 / cells[2] + 1 / cells[3]).alias("log_odds_error"),
    )


def above_chance(pairs: DataFrame, times: int) -> DataFrame:
    """The pairs that occur together at least so many times as often as by chance, in whole numbers of up to 38 digits."""
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    return pairs.where(whole("n_ab") * whole("n") >= whole("n_a") * whole("n_b") * F.lit(times).cast("decimal(2,0)"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_together(table(spark, sf_dir, "processed_bookmarks"), "proc_id", ["tags", "categories"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairs_together(table(spark, sf_dir, "processed_bookmarks"), "proc_id", ["tags", "categories"], 6, 0.001)
    return above_chance(pairs, 4).select("field", "item_a", "item_b")
