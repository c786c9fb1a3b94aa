"""Mixing sources to target shares: Poisson replication.

Every document is used a number of times drawn from a Poisson distribution whose mean is its source's target rate. The
draw inverts the distribution at a number between 0 and 1 hashed from the document and a seed, so it needs no state, is
the same on every run and every executor, and no source is ever gathered in one place.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage, spread, table

#: The public tokenizer's vocabulary: a parameter of each operator, or the setting TOKENIZER_SETTING of the session, or
#: this file.
TOKENIZER, TOKENIZER_SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.linkloom.tokenizer"
#: Fixed value: the public pattern that splits a text into pieces before byte pairs are merged.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Share of its cap that a source is filled to at most: a capped Poisson count only reaches the cap itself at an
#: infinite mean.
FILL = 0.9
#: Sources with a target; their shares and distributions are worked out on the driver.
MAX_SOURCES = 100_000
#: Steps of all distributions that are broadcast (8 bytes each); more are joined by source.
MAX_STEPS = 2_000_000
SEED = 20_240_601

_encoders: dict[int, object] = {}


def source_name(c: Column) -> Column:
    """One spelling: trimmed, lower case, hyphens as underscores."""
    return F.translate(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), "-", "_")


def with_tokens(df: DataFrame, text: str, out: str, path: str | None = None) -> DataFrame:
    """df with the number of tokens of a text by a public byte-level tokenizer; null texts have none."""
    with open(path or df.sparkSession.conf.get(TOKENIZER_SETTING, TOKENIZER), "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        encoder = _encoders.get(hash(sent.value))
        if encoder is None:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines()) if a}
            encoder = _encoders[hash(sent.value)] = tiktoken.Encoding("pieces", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([0 if t is None else len(encoder.encode_ordinary(t)) for t in texts], dtype="int64")

    return df.withColumn(out, count(F.col(text)))


def _below(mean: float, cap: int) -> tuple[int, np.ndarray]:
    """(first, P(count <= k) for k from first on) of a Poisson count, as far as k is below cap and the chance neither 0
    nor 1. Worked out from logarithms, so that large means don't underflow; about 80 * sqrt(mean) numbers, whatever the
    cap."""
    reach = 40 * math.sqrt(mean) + 50
    first, end = max(0, int(mean - reach)), min(cap, int(mean + reach) + 1)
    if end <= first:
        return cap, np.empty(0)
    k = np.arange(first, end, dtype=float)
    log_factorial = math.lgamma(first + 1) + np.cumsum(np.log(np.append(1.0, k[1:])))
    return first, np.minimum(np.cumsum(np.exp(k * math.log(mean) - mean - log_factorial)), 1.0)


def capped_mean(mean: float, cap: int) -> float:
    """The mean of a Poisson count that is cut to cap."""
    if mean <= 0:
        return 0.0
    first, below = _below(mean, cap)
    return first + float((1 - below).sum())


def poisson_mean(rate: float, cap: int) -> float:
    """The Poisson mean whose count, cut to cap, has the mean `rate`. A rate near the cap is only reached at an infinite
    mean; 0.999 of the cap is the most that is aimed at."""
    if rate <= 0 or cap <= 0:
        return 0.0
    rate = min(rate, cap * 0.999)
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < rate:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if capped_mean(middle, cap) < rate else (low, middle)
    return high


def cumulative(mean: float, cap: int) -> tuple[int, list[float]]:
    """(first, steps): the count of a draw u is first and one for each step that is at most u. Steps are P(count <= k),
    without those that no draw or any draw is beyond."""
    if mean <= 0 or cap <= 0:
        return 0, [1.0]
    first, below = _below(mean, cap)
    low, high = (int(np.searchsorted(below, x)) for x in (2.0**-54, 1 - 2.0**-53))
    return first + low, below[low : high + 1].tolist()


def plan_mix(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None, fill: float = FILL) -> dict[str, dict]:
    """Per source: its share among the sources that have anything, the mean rate and the Poisson mean.

    total: tokens wanted. By default as many as the scarcest source allows if every share is to hold. Above that, the
    sources that are too small stop at fill times their cap and the report shows what they lack.
    """
    open_sources = {s: t for s, t in targets.items() if sizes.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    weight = sum(t[0] for t in open_sources.values())
    shares = {s: t[0] / weight for s, t in open_sources.items()}
    limit = {s: fill * t[1] * sizes[s] for s, t in open_sources.items()}
    wanted = total if total is not None else min((limit[s] / shares[s] for s in shares), default=0)
    plan = {}
    for s, (_, cap) in targets.items():
        rate = min(wanted * shares[s], limit[s]) / sizes[s] if s in shares else 0.0
        plan[s] = {"share": shares.get(s), "rate": rate, "mean": poisson_mean(rate, cap), "cap": cap}
    return plan


def _targets(df: DataFrame) -> dict[str, tuple[float, int]]:
    """Target share and cap by source. Spellings of one source are one target: the largest share and the smallest cap.
    A null share is none, a null cap is one use."""
    one = df.where(F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("s")).agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("t"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("m"))
    rows = one.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("too many sources with a target")
    return {r["s"]: (r["t"], r["m"]) for r in rows}


def sized(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """(doc, source, n_tokens), written to the shared folder so that each text is tokenized once."""
    rows = with_tokens(docs.select(F.col(doc).alias("doc"), source_name(F.col(source)).alias("source"), F.col(text).alias("text")), "text", "n_tokens", path)
    return cut_lineage(rows.select("doc", "source", "n_tokens"))


def drawn(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> tuple[DataFrame, dict[str, dict]]:
    """sizes with a column `uses`, and the plan. Sources without a target aren't used. Each row is a document."""
    wanted = _targets(targets)
    held = {r["source"]: r["t"] for r in sizes.where(F.col("source").isin(list(wanted))).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    plan = plan_mix(held, wanted, total)
    spark = sizes.sparkSession
    rows = [(s, *(cumulative(p["mean"], p["cap"]) if p["rate"] > 0 else (0, None))) for s, p in plan.items()]
    steps = spark.createDataFrame(rows, "source string, first int, steps array<double>")
    if sum(len(x or ()) for _, _, x in rows) <= MAX_STEPS:
        steps = F.broadcast(steps)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc")), 11) / F.lit(float(1 << 53))
    uses = F.when(F.col("steps").isNull(), 0).otherwise(F.col("first") + F.size(F.filter("steps", lambda c: c <= u)))
    return sizes.join(steps, "source", "left").select("doc", "source", "n_tokens", uses.cast("int").alias("uses")), plan


def mixed(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, doc: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """(doc, source, copy_no, n_tokens) in a globally shuffled order, one row per use of a document.

    No document is used more often than its source's max_repeats. Null sources and those without a target aren't
    used; null or empty texts have no tokens but may be drawn. Empty documents or targets give no rows.
    """
    rows, _ = drawn(sized(docs, doc, text, source, path), targets, total, seed)
    used = rows.where("uses > 0").select(F.col("doc").alias(doc), "source", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy_no"), "n_tokens")
    return used.orderBy(F.xxhash64(F.lit(seed + 1), F.col(doc), F.col("copy_no")), doc, "copy_no")


def mix_report(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, doc: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """One row per source with a target or with documents: what it has, what was wanted and what was drawn.

    (source, target_share, wanted_share, max_repeats, docs, tokens, rate, used_docs, uses, used_tokens, actual_share).
    wanted_share is the target share among sources that have anything; rate the mean number of uses of a document.
    """
    rows, plan = drawn(sized(docs, doc, text, source, path), targets, total, seed)
    used = F.col("uses") * F.col("n_tokens")
    got = rows.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("uses") > 0).alias("used_docs"),
        F.sum("uses").cast("bigint").alias("uses"), F.sum(used).cast("bigint").alias("used_tokens"), F.max("uses").alias("most_uses"),
    )
    wanted = _targets(targets)
    spark = docs.sparkSession
    plans = spark.createDataFrame([(s, wanted[s][0], p["share"], p["cap"], p["rate"]) for s, p in plan.items()], "source string, target_share double, wanted_share double, max_repeats int, rate double")
    every = rows.agg(F.sum(used)).first()[0]
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "tokens")]
    return plans.join(got, "source", "full").select(
        "source", "target_share", "wanted_share", "max_repeats", *counts, "rate", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("used_docs", "uses", "most_uses", "used_tokens")],
        F.try_divide(F.coalesce("used_tokens", F.lit(0)), F.lit(every).cast("double")).alias("actual_share"),
    )


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))
