"""Texts cut off before their end: hashed logistic regression on how a text closes.

Intact texts are cut artificially, in words and between them, with and without the marks and debris that cutting
leaves; these are the positives. Texts as they are, and with their last full stop taken off, are the negatives. The
features are closing characters and words, punctuation and brackets left open, the kind of the last line, whether the
last word is a known one, and the length against the limits of the source. Limits are lengths that a source has far more
often than those around them. Every text is scored. All features come from the length and the last TAIL characters, so
that much of a text reaches Python; words and lengths are counted over whole texts in the JVM.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_within, cut_lineage, spread, table
from .filters import Filter, filter_of
from .mixing import source_name

#: Intact texts that the classifier is fitted on, chosen by hash; everything else covers all texts.
SAMPLE = 12_000
#: Weights of the classifier.
DIM = 1 << 18
#: A word is known if this many texts have it with a separator after it, and no fewer than end in it. Words that were
#: cut stand at ends only, so both counts grow with the corpus and stumps stay unknown at any size. Digits are
#: masked in words, so that numbers don't fill the filter.
MIN_TEXTS = 3
#: A length is a limit if at least LIMIT_TEXTS texts of a source have it and LIMIT_TIMES as many as the lengths around.
LIMIT_TEXTS, LIMIT_TIMES, LIMIT_AROUND = 5, 6.0, 25
#: Sources whose limits are broadcast; with more, they are joined by shuffling.
MAX_SOURCES = 100_000
#: Characters of a text's end that are looked at.
TAIL = 400
THRESHOLD = 0.5

#: Marks and debris that cutting leaves, by kind.
MARKS = re.compile(
    r"\s*(?:(?P<chars>(?:…|\.\.\.)?\s*\[\+?\d+ (?:chars|characters|more)\])|(?P<bracket>\[(?:…|\.\.\.)\])|(?P<paren>\((?:more|mehr|más|…|\.\.\.)\))"
    r"|(?P<more>(?:…|\.\.\.)\s*(?:read more|see more|show more|continue reading|more|weiterlesen|mehr|leer más))|(?P<closed>\[(?:connection closed|truncated|cut|timeout|end of transmission|eof)\])"
    r"|(?P<broken>�+)|(?P<entity>&#?\w{0,8})|(?P<tag><[a-z/!][^<>]*)|(?P<ell>…)|(?P<dots>\.\.\.))$",
    re.IGNORECASE,
)
#: Characters of the longest mark that isn't an open tag.
LONGEST_MARK = 60
#: Distinct words that a task counts before it passes them on.
TASK_WORDS = 500_000
_STOPS = (".", "!", "?")
_ENDED = re.compile(r"[.!?][\"'”’»)\]]*$")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n+")
_INNER = re.compile(r"(?<=\w)[.!?](?=\s)")
_WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"\d")
_LINES = (
    ("code", re.compile(r"^(?: {4,}|\t)\S")), ("signed", re.compile(r"^--\s?\S+$")), ("item", re.compile(r"^\s*(?:[-*•>]|\d+[.)])\s+\S")), ("heading", re.compile(r"^#+\s+\S")),
)
_TOKENS = (
    ("url", re.compile(r"^(?:https?://|www\.)\S+$", re.I)), ("hash", re.compile(r"^#\w+$")), ("at", re.compile(r"^@\w+$")), ("paren", re.compile(r"^\S*@?\w+\)$")), ("smiley", re.compile(r"^(?:[:;=8]-?[)(DPpo/|]|<3)$")),
)


def _h(kind: str, value: str) -> int:
    return xxhash.xxh32_intdigest(kind + "\t" + value) & (DIM - 1)


def word_hash(word: str) -> int:
    """As F.xxhash64, without a sign."""
    return xxhash.xxh64_intdigest(word, seed=42)


def is_known(word: str, known: Filter) -> bool:
    return word_hash(_DIGITS.sub("0", word)) in known


_ZEROS = str.maketrans("123456789", "0" * 9)


def _bare_of_marks(tail: str) -> str:
    """The end of a text without the marks of cutting, as often as they stand there."""
    while (c := close_of(tail)).kind != "none":
        tail = c.core
    return c.core


@dataclass
class Close:
    """A text's end taken apart."""

    kind: str
    core: str
    spaced: bool
    segment: str
    last_line: str
    token: str
    shape: str


def close_of(text: str) -> Close:
    tail = text[-TAIL:]
    bare = tail.rstrip()
    tag = bare.rfind("<")
    # What ends in a full stop can end in no mark but dots or an open tag; other marks are short.
    at = len(bare) if bare.endswith(_STOPS) and not bare.endswith("..") else max(0, len(bare) - LONGEST_MARK)
    at = at if tag < 0 else min(at, len(bare[:tag].rstrip()))
    m = MARKS.search(bare, at) if at < len(bare) else None
    kind = m.lastgroup if m else "none"
    core = bare[: m.start()] if m else bare
    spaced = (m.end() - m.start() > len(m[0].lstrip())) if m else len(tail) > len(bare)
    core = core.rstrip()
    last_line = core.rsplit("\n", 1)[-1]
    token = core.rsplit(None, 1)[-1] if core else ""
    shape = next((n for n, p in _LINES if p.match(last_line)), None)
    if shape == "item":  # a list of names; sentences with dashes are read as sentences
        above = [x for x in core.split("\n")[:-1] if _LINES[2][1].match(x)]
        if len(last_line.split()) > 5 or any(_ENDED.search(x.rstrip()) for x in above):
            shape = None
        elif not above:
            shape = "first"
    shape = shape or next((n for n, p in _TOKENS if p.match(token)), None)
    if shape is None:
        last = core[-1:]
        shape = "empty" if not last else "ended" if _ENDED.search(core) else "letter" if last.isalpha() else "digit" if last.isdigit() else "stop" if last in ",;:-–—([{\"'“‘«/" else "symbol"
    elif shape in ("item", "first", "code") and _ENDED.search(core):
        shape += "-ended"
    pieces = [p for p in _SENTENCE.split(core) if p.strip()]
    return Close(kind, core, spaced, pieces[-1].strip() if pieces else "", last_line, token, shape)


def features(text: str, gap: str, known: Filter) -> list[int]:
    """The places of a text's features; its last TAIL characters are enough."""
    c = close_of(text)
    low = _DIGITS.sub("0", c.core[-60:].lower())
    words = _WORD.findall(low)[-3:]
    w1 = words[-1] if words else ""
    state = f"{c.kind}|{c.shape}"
    segment = c.segment.lower()
    n = len(segment.split())
    glued = bool(low) and low[-1].isalnum()
    word = "known" if not glued or is_known(_WORD.findall(c.core[-60:].lower())[-1], known) else "unknown"
    size = "short" if len(segment) <= 30 else "long"
    opened = f"{segment.count('(') > segment.count(')')}{segment.count('[') > segment.count(']')}{segment.count(chr(34)) % 2}{segment.count('“') > segment.count('”')}"
    out = [
        _h("bias", ""), _h("kind", c.kind), _h("shape", c.shape), _h("state", state), _h("spaced", f"{c.spaced}{c.kind}"), _h("gapkind", gap + c.kind), _h("gapstate", gap + state), _h("gapknown", gap + c.kind + word),
        _h("known", word + c.shape), _h("size", size + state), _h("n", f"{min(n, 12)}{c.shape}"), _h("open", opened + c.shape), _h("w1", w1 + c.shape), _h("w2", " ".join(words[-2:]) + c.shape), _h("w3", " ".join(words) + c.shape),
        _h("first", segment.split()[0] if n else ""), _h("item", f"{c.shape}{min(len(c.last_line.split()), 6)}{word}"),
    ]
    out += [_h(f"c{k}", low[-k:]) for k in range(1, 8)]
    return out


def gap_of(length: int, limits: list[int]) -> str:
    """How far below the nearest limit of its source a text ends."""
    above = [x - length for x in limits if x >= length]
    if not limits:
        return "none"
    g = min(above, default=99)
    return "0" if g == 0 else "1-3" if g <= 3 else "4-16" if g <= 16 else "far"


def looks_intact(text: str, gap: str) -> bool:
    """Whether a text may serve as one that is whole: it ends as sentences, addresses, tags, lists and the like do, and
    not at its source's limit. Dots count as an end after a few words that follow a sentence."""
    c = close_of(text)
    if gap not in ("none", "far"):
        return False
    if c.kind in ("ell", "dots"):
        return not c.spaced and 0 < len(c.segment) <= 30 and c.segment != c.core
    return c.kind == "none" and c.shape not in ("letter", "digit", "stop", "first", "empty")


#: What artificial cuts leave at the end.
TAILS = ("…", "...", " […]", " [...]", "... Read more", " ... Read more", " (more)", "… [+{n} chars]", "\n[connection closed]", "�", "&am", "&nbs", "<a hre", "<p cla", "")


def examples(text: str, gap: str, limits: bool, rng: random.Random, tails: tuple[str, ...] = TAILS) -> list[tuple[str, str, int]]:
    """Training examples, as (text, gap, label), of one intact text: itself, without its full stop, up to the ends of sentences within it, also
    without full stop, and cut in three places."""
    chance = lambda p: rng.random() < p
    out = [(text, "0" if limits and chance(0.03) else gap, 0)]
    bare = text.rstrip()
    if bare[-1:] in ".!?" and close_of(bare).kind == "none" and chance(0.5):
        out.append((bare[:-1], gap, 0))
    ends = [m.start() for m in _INNER.finditer(bare) if m.start() > 20]
    for at in rng.sample(ends, min(2, len(ends))):
        out.append((bare[:at], gap, 0))
    for plain in (True, True, False):
        if len(bare) < 40:
            break
        at = rng.randrange(12, len(bare) - 1)
        kept = bare[:at]
        if not plain and chance(0.5):
            kept = kept.rsplit(None, 1)[0] if " " in kept else kept
        if close_of(kept).shape in ("ended", "empty") or bare[at:].strip(".!?\"')") == "":
            continue
        tail = "" if plain else rng.choice(tails).format(n=rng.randrange(20, 2000))
        near = ("0" if plain else rng.choice(("0", "1-3", "4-16"))) if limits and chance(0.6) else gap
        out.append((kept + tail, near, 1))
    return out


def fit(x: np.ndarray, labels: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 0.15, decay: float = 1e-6, seed: int = 7) -> np.ndarray:
    """Logistic regression over hashed features by AdaGrad."""
    w, g2 = np.zeros(DIM), np.full(DIM, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            part = order[i : i + batch]
            f = x[part]
            error = 1 / (1 + np.exp(-w[f].sum(axis=1))) - labels[part]
            flat = f.ravel()
            at, where = np.unique(flat, return_inverse=True)
            grad = np.bincount(where, np.repeat(error, f.shape[1])) / len(part) + decay * w[at]
            g2[at] += grad * grad
            w[at] -= rate * grad / np.sqrt(g2[at])
    return w


_COUNTS = pa.schema([("source", pa.string()), ("size", pa.int32()), ("h", pa.int64()), ("n", pa.int64()), ("ends", pa.int64())])


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts: by source and length, and by word how many texts have it with a separator after it and
    how many end in it, marks of cutting aside."""
    sizes, inner, ends = Counter(), Counter(), Counter()

    def words() -> pa.RecordBatch:
        every = list(inner.keys() | ends.keys())
        h = np.array([word_hash(w) for w in every], np.uint64).view(np.int64)
        n = [pa.array([c[w] for w in every], pa.int64()) for c in (inner, ends)]
        inner.clear()
        ends.clear()
        return pa.RecordBatch.from_arrays([pa.nulls(len(every), pa.string()), pa.nulls(len(every), pa.int32()), pa.array(h), *n], schema=_COUNTS)

    for b in batches:
        for source, t in zip(b.column("source").to_pylist(), b.column("text").to_pylist()):
            sizes[source, len(t)] += 1
            core = t.rstrip()
            if not core.endswith(_STOPS) or core.endswith(".."):
                tail = core[-TAIL:]
                core = core[: len(core) - len(tail)] + _bare_of_marks(tail)
            own = _WORD.findall(core.lower().translate(_ZEROS))
            if own and core[-1].isalnum():
                ends[own.pop()] += 1
            inner.update(set(own))
        if len(inner) + len(ends) > TASK_WORDS:
            yield words()
    yield words()
    k = len(sizes)
    counted = [pa.array([x[0] for x in sizes], pa.string()), pa.array([x[1] for x in sizes], pa.int32()), pa.nulls(k, pa.int64()), pa.array(list(sizes.values()), pa.int64()), pa.nulls(k, pa.int64())]
    yield pa.RecordBatch.from_arrays(counted, schema=_COUNTS)


def corpus_counts(docs: DataFrame, text: str, source: Column) -> DataFrame:
    """(source, size, h, n, ends): of all texts how many have each length, by source, and each word. One pass."""
    texts = docs.where(F.col(text).isNotNull()).select(source.alias("source"), F.col(text).alias("text"))
    counted = texts.mapInArrow(_count_texts, "source string, size int, h bigint, n bigint, ends bigint")
    return cut_lineage(counted.groupBy("source", "size", "h").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")))


def source_limits(counts: DataFrame) -> DataFrame:
    """(source, limits): the lengths that texts of a source were cut at. The lengths around one are in its block or a
    neighbour, so each block is sent to three places and none has more than 3 * LIMIT_AROUND lengths."""
    counts = counts.where("size is not null").select("source", "size", "n")
    block = F.floor(F.col("size") / LIMIT_AROUND)
    near = Window.partitionBy("source", "block").orderBy("size").rangeBetween(-LIMIT_AROUND, LIMIT_AROUND)
    spread_out = counts.withColumn("own", block).withColumn("block", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    mean = (F.sum("n").over(near) - F.col("n")) / (2.0 * LIMIT_AROUND)
    spikes = spread_out.withColumn("mean", mean).where((F.col("own") == F.col("block")) & (F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_TIMES * F.greatest(F.lit(0.5), "mean")))
    return cut_lineage(spikes.groupBy("source").agg(F.array_sort(F.collect_list(F.col("size").cast("bigint"))).alias("limits")))


def known_words(counts: DataFrame) -> Filter:
    """The words that MIN_TEXTS texts have with a separator after them and that no more texts end in. The driver gets the
    cells of the filter."""
    hashes = cut_lineage(counts.where("h is not null").where((F.col("n") >= MIN_TEXTS) & (F.col("n") >= F.col("ends"))).select("h"))
    return filter_of(hashes, hashes.count())


def _sample(doc: str, rows: int, total: int) -> Column:
    """Whether a text is one of about `rows` chosen by a hash of their number."""
    least = (1 << 64) * rows // max(rows, total, 1) - (1 << 63)
    return F.xxhash64(F.lit(17), F.col(doc)) < min(least, (1 << 63) - 1)


@dataclass
class Model:
    weights: np.ndarray
    known: Filter

    def score(self, texts: list[str], gaps: list[str]) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        x = np.array([features(t, g, self.known) for t, g in zip(texts, gaps)])
        return 1 / (1 + np.exp(-self.weights[x].sum(axis=1)))


def train(rows: DataFrame, known: Filter, total: int, sample: int = SAMPLE, tails: tuple[str, ...] = TAILS) -> Model | None:
    """Fit on (doc, text, limits) of `total` texts. As about one text in six looks cut, a fifth more than `sample` are read. None
    where not one text looks intact, so that there is nothing to learn from."""
    part = rows.where(_sample("doc", sample * 6 // 5, total))
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = sent.value
        for b in batches:
            made = []
            for d, t, limits in zip(b["doc"], b["text"], b["limits"]):
                limits = [] if limits is None else limits.tolist()
                gap = gap_of(len(t), limits)
                if looks_intact(t, gap):
                    made += [(features(x, g, k), y) for x, g, y in examples(t, gap, bool(limits), random.Random(int(d)), tails)]
            if made:
                yield pd.DataFrame({"x": [np.array([x for x, _ in made], np.int32).tobytes()], "y": [np.array([y for _, y in made], np.int8).tobytes()]})

    got = part.mapInPandas(make, "x binary, y binary").toArrow().to_pylist()
    if not got:
        return None
    labels = np.frombuffer(b"".join(r["y"] for r in got), np.int8)
    return Model(fit(np.frombuffer(b"".join(r["x"] for r in got), np.int32).reshape(len(labels), -1), labels.astype(float)), known)


def scored(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", sample: int = SAMPLE, tails: tuple[str, ...] = TAILS) -> DataFrame:
    """(doc, source, score): of each text the probability that it was cut.

    The source is trimmed, in lower case, with underscores; null stays null and has limits of its own. Null and blank
    texts have the score 0: nothing is left that could have been cut. Where no text looks intact, so that there is
    nothing to learn from, the others have a null score: it isn't known. Empty tables give no rows. A text given twice
    is scored twice, alike.
    """
    name = source_name(F.col(source))
    counts = corpus_counts(docs, text, name)
    limits = broadcast_within(source_limits(counts).withColumnRenamed("source", "_s"), MAX_SOURCES)
    total = counts.where("size is not null").agg(F.sum("n")).first()[0] or 0
    key = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), name.alias("source"))
    rows = key.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left")
    seen = F.col("text").rlike(r"(?U)\S")
    model = train(rows.where(seen).select(F.xxhash64("doc").alias("doc"), "text", "limits"), known_words(counts), total, sample, tails)
    if model is None:
        return rows.select(F.col("doc").alias(doc), "source", F.when(F.coalesce(seen, F.lit(False)), F.lit(None)).otherwise(0.0).cast("double").alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.known))
    kind = docs.schema[doc].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            there = b["size"].notna().to_numpy()
            picked = b[there]
            out = np.zeros(len(b))
            out[there] = m.score(list(picked["tail"]), [gap_of(int(n), [] if x is None else x.tolist()) for n, x in zip(picked["size"], picked["limits"])])
            yield pd.DataFrame({doc: b["doc"], "source": b["source"], "score": out})

    # Keys travel as text: pandas would turn whole numbers beside a null into floats.
    tails_only = rows.select(F.col("doc").cast("string").alias("doc"), "source", F.when(seen, F.length("text")).alias("size"), F.expr(f"right(text, {TAIL})").alias("tail"), "limits")
    return tails_only.mapInPandas(score, f"{doc} string, source string, score double").withColumn(doc, F.col(doc).cast(kind))


def truncation_rates(docs: DataFrame, **columns) -> DataFrame:
    """(source, docs, cut_docs, cut_rate): how often each source truncates."""
    return scored(docs, **columns).groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("score") >= THRESHOLD).alias("cut_docs")).withColumn("cut_rate", F.col("cut_docs") / F.col("docs"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spread(table(spark, sf_dir, "documents"))).where(F.col("score") >= THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_rates(spread(table(spark, sf_dir, "documents")))
