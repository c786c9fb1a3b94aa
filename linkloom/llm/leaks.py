"""Test passages in training texts: greedy string tiling with running Karp-Rabin hashes.

Words get 64-bit codes, a text is a sequence of them. A rolling hash over every window of min_tile words joins documents
with the items that share one: these are the seeds. Each such pair is tiled: the longest match is marked in both, then
the longest in what is left, until none of min_tile words remains. A document holds an item if its longest tile has
min_words words, or if its tiles, in whatever order they stand, cover min_coverage of the item.

The corpus is read once whatever the number of items. The windows of few items go to the executors as sorted hashes, and
pairs are tiled where the document is. For many items a filter of their windows goes there; what a document shares with
any of them, its stretches of windows in the filter, is joined with the items by hash and tiled after that.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage, spread, table
from .filters import Filter, filter_of

#: Consecutive words that make a passage, the shortest tile, and the share of an item that tiles must cover together.
MIN_WORDS, MIN_TILE, MIN_COVERAGE = 12, 6, 0.5
#: Words of items that go to the executors as they are, with their windows: 24 bytes each.
MAX_WORDS = 2_000_000
#: Words whose codes a worker remembers.
KEPT_WORDS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Unbroken runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


class Codes(dict):
    """Words' codes, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.__getitem__, w), np.uint64, len(w))


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes modulo 2**64 of all windows of `width` numbers, by doubling the window's length."""
    if len(codes) < width:
        return np.empty(0, np.uint64)
    done, total = 0, None
    power, part = np.array([_BASE]), codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
    length = 1
    while True:  # part has the hashes of windows of `length`, power is the base to that; total those of `done` numbers
        if width & length:
            if total is None:
                total = part
            else:
                n = len(codes) - done - length + 1
                total = total[:n] * power + part[done : done + n]
            done += length
        if length * 2 > width:
            return total[: len(codes) - width + 1]
        n = len(part) - length
        part = part[:n] * power + part[length:]
        power = power * power
        length *= 2


def tiles(doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in document, start in item, length), longest first, of at least `width` words.

    The longest match that is left is found by halving over rolling hashes, so a text that repeats itself costs no more
    than another. Of equally long matches the first in the document is taken, with the first place in the item. Marked
    words get numbers of their own, so that nothing matches them again."""
    # Only words of both texts can match; others become single, as marked ones do. Numbers are small, so sums don't wrap.
    common, at = np.unique(np.concatenate([doc, item]), return_inverse=True)
    a, b = at[: len(doc)].astype(np.int64), at[len(doc) :].astype(np.int64)
    fresh = len(common)
    out: list[tuple[int, int, int]] = []
    high = min(len(a), len(b))
    while high >= width:
        low, most = width - 1, high  # a match of `low` words is known (or too short), one of more than `most` isn't there
        while low < most:
            middle = (low + most + 1) // 2
            if np.isin(rolling(a, middle), rolling(b, middle)).any():
                low = middle
            else:
                most = middle - 1
        if low < width:
            break
        places: dict[int, list[int]] = defaultdict(list)
        for t, h in enumerate(rolling(b, low).tolist()):
            places[h].append(t)
        ha = rolling(a, low)
        end_a, taken, marked = -1, np.zeros(len(b), bool), 0
        for d in np.flatnonzero(np.isin(ha, np.fromiter(places, np.uint64, len(places)))).tolist():
            if d < end_a:
                continue
            left = places[int(ha[d])]
            while left and taken[left[0] : left[0] + low].any():
                left.pop(0)
            if left and (a[d : d + low] == b[left[0] : left[0] + low]).all():
                t = left.pop(0)
                out.append((d, t, low))
                taken[t : t + low] = True
                end_a, marked = d + low, marked + 1
                a[d : d + low] = fresh + np.arange(low)
                b[t : t + low] = fresh + low + np.arange(low)
                fresh += 2 * low
        high = low if marked else low - 1
    return out


class Items:
    """Few test items: their codes, and of each window's hash the items that have it."""

    def __init__(self, codes: list[np.ndarray], width: int) -> None:
        self.width, self.codes = width, codes
        windows = [np.unique(rolling(c, width), return_counts=True) for c in codes]
        h = np.concatenate([x for x, _ in windows] or [np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(codes), dtype=np.int32), [len(x) for x, _ in windows])
        order = np.argsort(h, kind="stable")
        self.hashes, self.items = h[order], item[order]
        self.times = np.concatenate([n for _, n in windows] or [np.empty(0, np.int64)])[order].astype(np.int32)

    def seeded(self, codes: np.ndarray, min_words: int, min_coverage: float) -> list[int]:
        """The items that share windows, enough to come to a passage or the coverage."""
        h = np.unique(rolling(codes, self.width))
        if not len(h) or not len(self.hashes):
            return []
        first = np.searchsorted(self.hashes, h)
        first[first == len(self.hashes)] = 0
        first = first[self.hashes[first] == h]
        if not len(first):
            return []
        last = np.searchsorted(self.hashes, self.hashes[first], side="right")
        at = np.concatenate([np.arange(x, y) for x, y in zip(first, last)])
        item, where = np.unique(self.items[at], return_inverse=True)
        n = np.bincount(where, self.times[at])
        return [i for i, k in zip(item.tolist(), n.tolist()) if enough(k, len(self.codes[i]), self.width, min_words, min_coverage)]


def enough(windows: float, item_words: int, width: int, min_words: int, min_coverage: float) -> bool:
    """Whether so many windows of an item can come to a passage or the coverage: a tile of n words has n - width + 1
    windows, so tiles cover at most width words for each window."""
    return windows >= min_words - width + 1 or windows * width >= min_coverage * item_words


def _verdict(found: list[tuple[int, int, int]], item_words: int, min_words: int, min_coverage: float) -> tuple[int, int, float] | None:
    longest, covered = max((x[2] for x in found), default=0), sum(x[2] for x in found)
    return (longest, covered, covered / item_words) if found and (longest >= min_words or covered >= min_coverage * item_words) else None


_FOUND = pa.schema([("_doc", pa.string()), ("_item", pa.string()), ("longest", pa.int32()), ("covered", pa.int32()), ("coverage", pa.float64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_CODED = pa.schema([("_item", pa.string()), ("codes", pa.list_(pa.int64()))])


def _code_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Codes()
    for b in batches:
        yield _batch([(i, known.of(t).view(np.int64)) for i, t in zip(b.column("_item").to_pylist(), b.column("_text").to_pylist())], _CODED)


_WINDOWS = pa.schema([("_at", pa.int64()), ("h", pa.int64()), ("times", pa.int64())])


def _windows(width: int):
    """Of each item its windows' hashes, and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, codes in zip(b.column("_at").to_pylist(), b.column("codes")):
                h, times = np.unique(rolling(codes.values.to_numpy().view(np.uint64), width), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), at)), pa.array(h.view(np.int64)), pa.array(times)], schema=_WINDOWS)

    return run


def _with_few(docs: DataFrame, items: DataFrame, width: int, min_words: int, min_coverage: float) -> DataFrame:
    got = items.select("_item", "codes").toArrow()
    codes = [np.array(x, np.int64).view(np.uint64) for x in got["codes"].to_pylist()]
    sent = docs.sparkSession.sparkContext.broadcast((got["_item"].to_pylist(), Items(codes, width)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = sent.value
        words_of = Codes()
        for b in batches:
            rows = []
            for d, t in zip(b.column("_doc").to_pylist(), b.column("_text").to_pylist()):
                own = words_of.of(t)
                for i in known.seeded(own, min_words, min_coverage):
                    v = _verdict(tiles(own, known.codes[i], width), len(known.codes[i]), min_words, min_coverage)
                    if v:
                        rows.append((d, ids[i], *v))
            yield _batch(rows, _FOUND)

    return docs.mapInArrow(find, "_doc string, _item string, longest int, covered int, coverage double")


_SHARED = pa.schema([("_doc", pa.string()), ("codes", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64()))])


def _shared_parts(width: int, sent):
    """Of each document with windows in the filter these windows' hashes, and the words of their stretches; between
    stretches stands a 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Filter = sent.value
        words_of = Codes()
        for b in batches:
            rows = []
            for d, t in zip(b.column("_doc").to_pylist(), b.column("_text").to_pylist()):
                own = words_of.of(t)
                h = rolling(own, width)
                hit = np.flatnonzero(seen.holds(h))
                if len(hit):
                    inside = np.zeros(len(own) + 1, np.int32)
                    np.add.at(inside, hit, 1)
                    np.add.at(inside, hit + width, -1)
                    inside = np.cumsum(inside)[:-1] > 0
                    own = np.where(inside, own, np.uint64(0))
                    keep = inside | np.append(inside[:-1] & ~inside[1:], False) | np.append(False, inside[:-1] & ~inside[1:])
                    rows.append((d, own[keep].view(np.int64), np.unique(h[hit]).view(np.int64)))
            yield _batch(rows, _SHARED)

    return run


def _tile_pairs(width: int, min_words: int, min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, i, own, item in zip(*(b.column(c).to_pylist() for c in ("_doc", "_item", "codes", "item_codes"))):
                v = _verdict(tiles(np.array(own, np.int64), np.array(item, np.int64), width), len(item), min_words, min_coverage)
                if v:
                    rows.append((d, i, *v))
            yield _batch(rows, _FOUND)

    return run


def _with_many(docs: DataFrame, items: DataFrame, windows: DataFrame, n: int, width: int, min_words: int, min_coverage: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(windows.select("h"), n))
    parts = docs.mapInArrow(_shared_parts(width, sent), "_doc string, codes array<bigint>, hashes array<bigint>")
    parts = cut_lineage(parts.withColumn("_row", F.monotonically_increasing_id()))
    seeds = parts.select("_row", F.explode("hashes").alias("h")).join(windows, "h").groupBy("_row", "_at").agg(F.sum("times").alias("k"))
    can = (F.col("k") >= min_words - width + 1) | (F.col("k") * width >= min_coverage * F.size("item_codes"))
    pairs = seeds.join(items.select("_at", "_item", F.col("codes").alias("item_codes")), "_at").where(can)
    tiled = pairs.join(parts.select("_row", "_doc", "codes"), "_row").select("_doc", "_item", "codes", "item_codes")
    return tiled.mapInArrow(_tile_pairs(width, min_words, min_coverage), "_doc string, _item string, longest int, covered int, coverage double")


def leaked(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, min_tile: int = MIN_TILE, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc, item, longest, covered, coverage): documents with at least min_words consecutive words of a test item, or
    with tiles of at least min_tile words that cover at least min_coverage of it.

    longest is the longest tile in words, covered the words of all tiles, coverage their share of the item's words. So a
    passage in another order is found by its coverage, in pieces of min_tile words or more. Null texts hold nothing; an
    item of fewer words than min_tile can't be found; an item or document given twice is reported as often as it is
    given. Empty tables give no rows. Above a min_coverage of 1 only min_words counts.
    """
    width = min(min_tile, min_words)
    text_of = lambda df, key, t, name: df.where(F.col(t).isNotNull()).select(F.col(key).cast("string").alias(name), F.col(t).alias("_text"))
    coded = text_of(items.where(F.col(item).isNotNull()), item, item_text, "_item").mapInArrow(_code_items, "_item string, codes array<bigint>")
    coded = cut_lineage(coded.where(F.size("codes") >= width).withColumn("_at", F.monotonically_increasing_id()))
    rows = text_of(docs, doc, text, "_doc")
    n, n_words = (x or 0 for x in coded.agg(F.sum(F.size("codes") - (width - 1)), F.sum(F.size("codes"))).first())
    if n_words <= MAX_WORDS:
        found = _with_few(rows, coded, width, min_words, min_coverage)
    else:
        windows = cut_lineage(coded.select("_at", "codes").mapInArrow(_windows(width), "_at bigint, h bigint, times bigint"))
        found = _with_many(rows, coded, windows, n, width, min_words, min_coverage)
    as_was = lambda df, key, name: F.col(name).cast(df.schema[key].dataType).alias(key)
    return found.select(as_was(docs, doc, "_doc"), as_was(items, item, "_item"), "longest", "covered", "coverage")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage plays no part here, so tiles shorter than a passage needn't be sought."""
    found = leaked(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items"), min_tile=MIN_WORDS, min_coverage=2.0)
    return found.select("doc_id", "item_id").distinct()
