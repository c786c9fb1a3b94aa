"""Copies that differ only in how they are written: recursive radix partitioning and counting in tries.

A record's canonical form keeps letters, marks and digits of one case. Its SHA-256 is the canonical bytes that are
partitioned: 32 bytes of even spread, so a bucket never grows because addresses begin alike, and no text is shuffled.
Each task first merges equal keys within its own rows, so a group that holds a third of all rows reaches its bucket as
one row a run. Buckets with too many rows are split by their next byte until each fits; each is then counted in a trie
whose terminals hold the number of copies and the smallest sequence number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage, spread, table

#: Bytes of a canonical key.
WIDTH = 32
#: Rows that a bucket may have; those with more are split by a further byte.
BUCKET_ROWS = 100_000
#: Rows that a task merges at a time before the shuffle.
RUN_ROWS = 1 << 17
#: A group is hot from this share of all records on; there are at most 1 / HOT_SHARE such groups.
HOT_SHARE = 0.001

#: Characters that show nothing though Unicode has them as letters or marks (fillers, variation selectors).
_UNSEEN = r"\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}"
_DROPPED = rf"[^\p{{L}}\p{{M}}\p{{N}}]+|[{_UNSEEN}]+"
_SHOWN = rf"[^\s\p{{Z}}\p{{C}}{_UNSEEN}]"


def canonical_text(c: Column) -> Column:
    """Letters, marks and digits alone, in one case. Upper case comes first so that letters whose upper case has
    several letters agree with them; it isn't next to lower(), as the optimizer would drop it."""
    return F.lower(F.regexp_replace(F.upper(c), _DROPPED, ""))


def canonical_url(c: Column) -> Column:
    """As canonical_text, with the parameters of the query in sorted order."""
    address = F.substring_index(c, "#", 1)
    fragment = F.substr(c, F.length(address) + 1)
    path = F.substring_index(address, "?", 1)
    query = F.substr(address, F.length(path) + 2)
    params = F.array_join(F.array_sort(F.transform(F.split(query, "&"), canonical_text)), "")
    return F.concat(canonical_text(path), params, canonical_text(fragment))


def _seen(c: Column) -> Column:
    """Whether there is anything but white space and invisible characters."""
    return F.coalesce(c.rlike(_SHOWN), F.lit(False))


def keyed(df: DataFrame, seq: str, forms: list[Column], seen: list[Column]) -> DataFrame:
    """(seq, key): the canonical bytes of each row all of whose `seen` columns show something."""
    there = F.lit(True)
    for c in seen:
        there = there & _seen(c)
    return df.where(there & F.col(seq).isNotNull()).select(F.col(seq).cast("bigint").alias("seq"), F.unhex(F.sha2(F.concat_ws("\u0001", *forms), 256)).alias("key"))


def _order(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorting order of keys of WIDTH bytes, and where a new key begins in it."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), dtype=">u8").reshape(-1, WIDTH // 8)
    order = np.lexsort(raw.T[::-1])
    rows = raw[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return order, np.flatnonzero(new)


_RUN = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("seqs", pa.list_(pa.int64()))])
_COUNTED = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("n", pa.int64())])


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key and run of at most RUN_ROWS rows and a batch: its smallest number, its count and all its numbers."""

    def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        keys, seqs = t["key"].combine_chunks(), t["seq"].to_numpy()
        order, starts = _order(keys)
        ends, seqs = np.append(starts[1:], len(order)), seqs[order]
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(seqs))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(order[starts])), pa.array(np.minimum.reduceat(seqs, starts)), pa.array(ends - starts), lists], schema=_RUN)

    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= RUN_ROWS:
            yield merged(held)
            held, rows = [], 0
    if held:
        yield merged(held)


class Trie:
    """A trie over byte strings. A node is a dict from the next byte to a node or to a terminal; a terminal [key,
    first, n] stands as high as it can and moves down when another key comes by."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, first: int, n: int) -> None:
        node, depth = self.root, 0
        while True:
            there = node.get(key[depth])
            if there is None:
                node[key[depth]] = [key, first, n]
                return
            if isinstance(there, list):
                if there[0] == key:
                    there[1] = min(there[1], first)
                    there[2] += n
                    return
                there = node[key[depth]] = {there[0][depth + 1] : there}
            node, depth = there, depth + 1

    def terminals(self) -> Iterator[list]:
        open_nodes = [self.root]
        while open_nodes:
            for x in open_nodes.pop().values():
                if isinstance(x, list):
                    yield x
                else:
                    open_nodes.append(x)


def radix_buckets(runs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """runs with a column `bucket`: the shortest prefix of its key whose bucket has at most bucket_rows rows, or the
    whole key where all are equal. The driver only holds counts of buckets: 256 for each that was split, of which
    there are at most rows / bucket_rows at each depth."""
    split: list[list[str]] = []
    if runs.count() > bucket_rows:
        split.append([""])
    while split and len(split) < WIDTH:
        depth = len(split)
        parent = F.hex(F.substring("key", 1, depth - 1))
        below = runs.where(parent.isin(split[-1])) if depth > 1 else runs
        counts = below.groupBy(F.hex(F.substring("key", 1, depth)).alias("prefix")).count()
        over = sorted(r["prefix"] for r in counts.where(F.col("count") > bucket_rows).select("prefix").collect())
        if not over:
            break
        split.append(over)
    bucket = F.lit("")
    for depth in range(len(split)):  # a bucket that was split passes its rows on to those one byte deeper
        bucket = F.when(F.hex(F.substring("key", 1, depth)).isin(split[depth]), F.hex(F.substring("key", 1, depth + 1))).otherwise(bucket)
    return runs.withColumn("bucket", bucket)


def _counter(min_copies: int):
    def count(t: pa.Table) -> pa.Table:
        trie = Trie()
        for key, first, n in zip(t["key"].to_pylist(), t["first"].to_pylist(), t["n"].to_pylist()):
            trie.add(key, first, n)
        rows = [x for x in trie.terminals() if x[2] >= min_copies]
        return pa.Table.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_COUNTED)], schema=_COUNTED)

    return count


def merged_runs(keys: DataFrame) -> DataFrame:
    """(key, first, n, seqs) of (seq, key), written to the shared folder: all later steps read it."""
    return cut_lineage(keys.mapInArrow(_merge_runs, "key binary, first bigint, n bigint, seqs array<bigint>"))


def count_copies(runs: DataFrame, min_copies: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, first, n): one row for each distinct key with at least min_copies copies.

    Equal keys are ties of the smallest `first`. An empty input gives no rows. A bucket of one key can't be split, but
    runs hold each key once: a key of n copies comes as n / RUN_ROWS rows of 48 bytes and one a task, a few MB for 10**10.
    """
    buckets = radix_buckets(runs, bucket_rows).select("bucket", "key", "first", "n")
    return buckets.groupBy("bucket").applyInArrow(_counter(min_copies), "key binary, first bigint, n bigint")


def bookmark_keys(df: DataFrame, seq: str = "bm_seq", url: str = "url", content: str = "content") -> DataFrame:
    """The canonical bytes of bookmarks. Rows with a null or blank url or content, or without a number, have none."""
    u, t = F.col(url), F.col(content)
    return keyed(df, seq, [canonical_url(u), canonical_text(t)], [u, t])


def collapse(df: DataFrame, seq: str = "bm_seq", url: str = "url", content: str = "content", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(first_seq, copies): one row per record however it is written, with the number of its copies, itself included."""
    return count_copies(merged_runs(bookmark_keys(df, seq, url, content)), 1, bucket_rows).select(F.col("first").alias("first_seq"), F.col("n").alias("copies"))


def copies(df: DataFrame, seq: str = "bm_seq", url: str = "url", content: str = "content", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(first_seq, copy_seq): each row that is a copy of an earlier one, beside the first of its group.

    Groups of at least HOT_SHARE of all rows, of which there are few by definition, are joined by broadcast and never
    shuffled; the others by key. Null or blank url or content: no case. A number that occurs twice in one group is
    listed as often as it occurs beyond the first number.
    """
    runs = merged_runs(bookmark_keys(df, seq, url, content))
    total = runs.agg(F.sum("n")).first()[0] or 0
    groups = cut_lineage(count_copies(runs, 2, bucket_rows))
    hot = F.broadcast(groups.where(F.col("n") >= max(2, total * HOT_SHARE)).select("key", F.col("first").alias("first_seq")))
    warm = groups.where(F.col("n") < max(2, total * HOT_SHARE)).select("key", F.col("first").alias("first_seq"))
    members = runs.select("key", "seqs")
    found = members.join(hot, "key").unionByName(members.join(hot.select("key"), "key", "left_anti").join(warm, "key"))
    return found.select("first_seq", F.explode("seqs").alias("copy_seq")).where("copy_seq <> first_seq")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(spread(table(spark, sf_dir, "bookmarks")))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(spread(table(spark, sf_dir, "bookmarks")))
