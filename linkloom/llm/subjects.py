"""Subjects of documents: classifier chains over term, source and structure features, decoded by beam search.

Labels give each term a weight of evidence for each subject. A document is read as units (its sentences); a unit's terms
say what it is about. The features of a document and a subject are the evidence for it against the strongest other, how
many units keep to each, the length, the kind of the record, and how far its feed and its host keep to subjects. A chain of logistic classifiers, one per subject and
shrunk towards one that all share, sees these and the subjects already decided, so what occurs together counts. Beam
search over the chain finds the likeliest combination; probabilities are calibrated on labels held back. Texts are read
where they are: of the labelled sample the driver gets numbers of terms, at most as many as the sample has words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import netloc
from ..runtime import cut_lineage, spread, table

#: Labelled documents that the model is fitted on, chosen by hash; all documents are classified.
SAMPLE = 24_000
#: Characters of these documents, all together; with longer texts the sample has fewer of them.
SAMPLE_CHARS = 40_000_000
#: Subjects at most, and labelled documents times subjects that the fit holds: with many subjects the sample is smaller.
MAX_SUBJECTS, MAX_CELLS = 2_000, 600_000
#: Documents that must have a term, what a term's evidence is shrunk by, and the least evidence worth keeping.
MIN_DOCS, SHRINK, MIN_EVIDENCE = 3, 2.0, 0.8
#: What the evidence of a feed or host is shrunk by.
SOURCE_SHRINK = 20.0
#: Combinations that the beam keeps.
BEAM = 6
#: Rounds of sharing a unit's evidence out among its document's labels.
ROUNDS = 3
#: Units, or rows of features, that are worked on at a time; pairs of document and subject that the shared model sees.
CHUNK, SHARED = 8_192, 150_000
#: Words of a unit where no full stop ends it earlier.
UNIT_WORDS = 22

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_UNIT = re.compile(r"[.!?…;]+[\"'”’»)\]]*(?:\s+|$)|\n\s*\n|(?:^|\s)\d+[/)](?=\s)|\n\s*[-*•>]\s")
KINDS = ("general", "tweet", "thread", "video", "")


def units(text: str) -> list[list[str]]:
    """Words of each sentence, in lower case. Line breaks within a sentence don't end it; what no full stop ends is
    taken in pieces of about UNIT_WORDS words."""
    out = []
    for piece in _UNIT.split(text.lower()):
        w = _WORD.findall(piece)
        if len(w) > UNIT_WORDS * 3 // 2:
            n = round(len(w) / UNIT_WORDS)
            cuts = [len(w) * i // n for i in range(n + 1)]
            out += [w[a:b] for a, b in zip(cuts, cuts[1:])]
        elif w:
            out.append(w)
    return out


def terms(words: list[str]) -> list[str]:
    """Words and neighbouring pairs of words."""
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(blocks: list[tuple[np.ndarray, np.ndarray]], centre: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Logistic regression by Newton's method, shrunk towards `centre`, over blocks of (features, labels)."""
    w = centre.copy()
    for _ in range(steps):
        grad, curve = ridge * (w - centre), ridge * np.eye(len(w))
        for block, y in blocks:
            for i in range(0, len(y), CHUNK):
                x = block[i : i + CHUNK].astype(float)
                p = _sigmoid(x @ w)
                grad += x.T @ (p - y[i : i + CHUNK])
                curve += (x * (p * (1 - p) + 1e-6)[:, None]).T @ x
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


@dataclass
class Corpus:
    """Labelled documents as numbers: the known terms of each unit, where units begin, whose they are."""

    index: dict[str, int]
    terms: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(index: dict[str, int], sizes: np.ndarray, units_each: np.ndarray, every: np.ndarray, lengths: np.ndarray) -> Corpus:
        """From all units' sizes, how many each document has, all terms unit by unit, and all documents' units in all."""
        docs = np.repeat(np.arange(len(units_each), dtype=np.int32), units_each)
        return Corpus(index, every, (np.cumsum(sizes) - sizes).astype(np.int32), docs, lengths.astype(float))

    def learn(self, own: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Each term's log odds for each subject, zeros where it says nothing, from the documents in `use`.

        own: (documents, subjects), 1 for a label. A document's units are first shared evenly among its labels, then,
        round by round, by what their terms already say, where a unit may also be about none of them."""
        v, k = len(self.index), own.shape[1]
        prior = own[use].sum(axis=0) + 1.0
        prior /= prior.sum()
        mine = own / np.maximum(own.sum(axis=1, keepdims=True), 1)
        picked = np.flatnonzero(use[self.docs])
        ends = np.append(self.starts[1:], len(self.terms))
        weights = np.zeros((v, k), np.float32)
        for r in range(ROUNDS):
            counts = np.zeros((v, k))
            for i in range(0, len(picked), CHUNK):
                part = picked[i : i + CHUNK]
                sizes = ends[part] - self.starts[part]
                unit = np.repeat(np.arange(len(part)), sizes)
                begin = np.cumsum(sizes) - sizes
                t = self.terms[np.arange(sizes.sum()) - begin[unit] + self.starts[part][unit]]
                share = mine[self.docs[part]]
                if r:
                    s = np.add.reduceat(weights[t], begin, axis=0)
                    share = np.exp(np.clip(s, -8, 8)) * (0.04 * prior + 0.96 * share)
                    share /= share.sum(axis=1, keepdims=True)
                # a term counts once in a document, with the largest share of its units there
                key = self.docs[part][unit].astype(np.int64) * v + t
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
                most = np.maximum.reduceat(share[unit[order]], first, axis=0)
                at = t[order][first]
                by = np.argsort(at, kind="stable")
                new = np.flatnonzero(np.append(True, np.diff(at[by]) != 0))
                counts[at[by][new]] += np.add.reduceat(most[by], new, axis=0)
            n = counts.sum(axis=1, keepdims=True)
            log_odds = np.log((counts + SHRINK * prior) / (n + SHRINK) / prior)
            keep = (n[:, 0] >= MIN_DOCS) & (log_odds.max(axis=1) >= MIN_EVIDENCE)
            weights = np.where(keep[:, None], np.clip(log_odds, -3, 3), 0).astype(np.float32)
        return weights

    def read(self, weights: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the documents in `use`: evidence of all units by subject, units about each subject, units in all."""
        picked = np.flatnonzero(use[self.docs])
        ends = np.append(self.starts[1:], len(self.terms))
        n, k = len(use), weights.shape[1]
        total, about = np.zeros((n, k)), np.zeros((n, k))
        for i in range(0, len(picked), CHUNK):
            part = picked[i : i + CHUNK]
            sizes = ends[part] - self.starts[part]
            begin = np.cumsum(sizes) - sizes
            t = self.terms[np.arange(sizes.sum()) - np.repeat(begin - self.starts[part], sizes)]
            _tally(np.add.reduceat(weights[t], begin, axis=0), self.docs[part], total, about)
        return total[use], about[use], self.lengths[use]


def _tally(units_said: np.ndarray, docs: np.ndarray, total: np.ndarray, about: np.ndarray) -> None:
    """Adds each unit's evidence to its document, and the unit to the subject that it is clearly about."""
    best = units_said.argmax(axis=1)
    clear = units_said[np.arange(len(best)), best] >= 1.0
    np.add.at(about, (docs[clear], best[clear]), 1)
    np.add.at(total, docs, np.clip(units_said, 0, 6))


@dataclass
class Evidence:
    """What terms say: for each known term its log odds for each subject."""

    index: dict[str, int]
    weights: np.ndarray

    @staticmethod
    def of(corpus: Corpus, weights: np.ndarray) -> Evidence:
        rows = np.flatnonzero(weights.any(axis=1))
        at = {int(r): i for i, r in enumerate(rows)}
        return Evidence({t: at[i] for t, i in corpus.index.items() if i in at}, weights[rows])

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As Corpus.read, for texts that are new."""
        k = self.weights.shape[1]
        at, starts, docs, lengths = [], [], [], np.zeros(len(texts))
        get = self.index.get
        for d, text in enumerate(texts):
            u = units(text)
            lengths[d] = len(u)
            for words in u:
                hits = {i for t in terms(words) if (i := get(t)) is not None}
                if hits:
                    starts.append(len(at))
                    docs.append(d)
                    at += hits
        total, about = np.zeros((len(texts), k)), np.zeros((len(texts), k))
        if at:
            _tally(np.add.reduceat(self.weights[at], starts, axis=0), np.array(docs), total, about)
        return total, about, lengths


def source_odds(values: np.ndarray, own: np.ndarray, use: np.ndarray) -> dict[str, np.ndarray]:
    """Of each feed or host the log odds of each subject, from the documents in `use`."""
    prior = (own[use].sum(axis=0) + 1.0) / (own[use].sum() + own.shape[1])
    names, at = np.unique(values[use].astype(str), return_inverse=True)
    counts = np.zeros((len(names), own.shape[1]))
    np.add.at(counts, at, own[use])
    n = counts.sum(axis=1, keepdims=True)
    odds = np.log((counts + SOURCE_SHRINK * prior) / (n + SOURCE_SHRINK) / prior).astype(np.float32)
    return {x: odds[i] for i, x in enumerate(names) if x}


def read_odds(odds: dict[str, np.ndarray], values: np.ndarray, k: int) -> np.ndarray:
    none = np.zeros(k, np.float32)
    return np.stack([odds.get(x, none) for x in values]) if len(values) else np.zeros((0, k), np.float32)


def _structure(total: np.ndarray, about: np.ndarray, lengths: np.ndarray, kinds: np.ndarray, sources: list[np.ndarray]) -> np.ndarray:
    """Features of each document and subject, without those of the chain: (documents, subjects, features)."""
    n, k = about.shape
    other_units, other_total = np.empty((n, k)), np.empty((n, k))
    for x, out in ((about, other_units), (total, other_total)):  # the strongest other subject
        top2 = np.sort(x, axis=1)[:, -2:] if k > 1 else np.hstack([np.zeros((n, 1)), x])
        first = x.argmax(axis=1)
        out[:] = top2[:, 1:]
        out[np.arange(n), first] = top2[:, 0]
    units_all, total_all = about.sum(axis=1, keepdims=True), total.sum(axis=1, keepdims=True)
    share, weight = about / np.maximum(units_all, 1), total / np.maximum(total_all, 1e-9)
    a, o = np.minimum(about, 5).astype(int), np.minimum(other_units, 6).astype(int)
    cell = np.eye(42)[a * 7 + o]  # how many units are about it, against the strongest other
    ratio = about / np.maximum(other_units, 0.5)
    long = np.broadcast_to(np.log1p(lengths)[:, None], (n, k))
    dense = np.stack([np.ones((n, k)), share, weight, share**2, weight**2, np.minimum(ratio, 4), np.minimum(total / np.maximum(other_total, 0.5), 4), np.log1p(total), (about > 0).astype(float), (total > 1).astype(float), long, long * share, long * weight, *sources, *[x * share for x in sources]], axis=2)
    kind = np.broadcast_to((kinds[:, None] == np.arange(len(KINDS))[None, :]).astype(float)[:, None, :], (n, k, len(KINDS))) * share[:, :, None]
    return np.concatenate([dense, cell, kind], axis=2)


@dataclass
class Chain:
    subjects: list[str]
    evidence: Evidence
    sources: list[dict[str, np.ndarray]]
    order: list[int]
    weights: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def _chain_features(self, given: np.ndarray, about: np.ndarray, j: int) -> np.ndarray:
        """What has been decided before subject j: how many subjects, how much of the text they have, how often j goes
        with them."""
        count = given.sum(axis=1)
        taken = (given * about).sum(axis=1) / np.maximum(about.sum(axis=1), 1)
        return np.column_stack([count == 1, count >= 2, taken, np.where(count > 0, given @ self.pairs[:, j] / np.maximum(count, 1), 0)])

    def decode(self, texts: list[str], kinds: np.ndarray, sources: list[np.ndarray]) -> list[list[int]]:
        """The likeliest combination of each document."""
        total, about, lengths = self.evidence.read(texts)
        said = [read_odds(odds, values, len(self.subjects)) for odds, values in zip(self.sources, sources)]
        return self.decode_features(_structure(total, about, lengths, kinds, said), about)

    def decode_features(self, x: np.ndarray, about: np.ndarray) -> list[list[int]]:
        n, k = about.shape
        beams = [(np.zeros((n, k)), np.zeros(n))]  # decided subjects, log probability; beams of all documents side by side
        for j in self.order:
            fixed = x[:, j] @ self.weights[j][: x.shape[2]]
            grown = []
            for given, logp in beams:
                z = fixed + self._chain_features(given, about, j) @ self.weights[j][x.shape[2] :]
                z = self.scale[0] * z + self.scale[1]
                yes = given.copy()
                yes[:, j] = 1
                grown += [(given, logp - np.logaddexp(0, z)), (yes, logp - np.logaddexp(0, -z))]
            if len(grown) > BEAM:
                score = np.stack([p for _, p in grown])
                best = np.argsort(-score, axis=0, kind="stable")[:BEAM]
                every = np.stack([g for g, _ in grown])
                rows = np.arange(n)
                grown = [(every[b, rows], score[b, rows]) for b in best]
            beams = grown
        score = np.stack([p for _, p in beams])
        chosen = np.stack([g for g, _ in beams])[score.argmax(axis=0), np.arange(n)]
        return [np.flatnonzero(r).tolist() for r in chosen]


def fit_chain(corpus: Corpus, kinds: np.ndarray, sources: list[np.ndarray], labels: list[set[int]], subjects: list[str], seed: int = 5) -> Chain:
    """Every third of the labels is read with evidence from the other two, so the chain never sees evidence fitted to its
    own labels. It is fitted on two thirds and calibrated on the last; the evidence that it keeps is from all."""
    k, n = len(subjects), len(labels)
    y = np.zeros((n, k))
    for i, own in enumerate(labels):
        y[i, list(own)] = 1
    order = np.argsort(-y.sum(axis=0), kind="stable").tolist()
    together = y.T @ y + 1.0
    np.fill_diagonal(together, 1.0)
    chain = Chain(subjects, Evidence({}, np.zeros((0, k))), [], order, np.zeros((k, 0)), pairs=np.log(together / together.mean()) / 3)
    rng = np.random.default_rng(seed)
    fold = rng.integers(0, 3, n)
    x, about, every = None, np.zeros((n, k)), np.ones(n, bool)

    def learnt(use: np.ndarray) -> tuple[np.ndarray, tuple]:
        weights = corpus.learn(y, use)
        return weights, corpus.read(weights, ~use)

    with ThreadPoolExecutor(4) as pool:  # the four fits don't depend on each other, and numpy leaves the interpreter free
        *folds, (final, _) = pool.map(learnt, [fold != f for f in range(3)] + [every])
    for f in range(3):
        here = fold == f
        if not here.any():
            continue
        t, a, lengths = folds[f][1]
        said = [read_odds(source_odds(values, y, ~here), values[here], k) for values in sources]
        about[here] = a
        rows = np.flatnonzero(here)
        for i in range(0, len(rows), CHUNK // 4):
            some = slice(i, i + CHUNK // 4)
            part = _structure(t[some], a[some], lengths[some], kinds[here][some], [s[some] for s in said])
            if x is None:
                x = np.zeros((n, k, part.shape[2]), np.float32)
            x[rows[some]] = part
    train, held = np.flatnonzero(fold != 2), np.flatnonzero(fold == 2)
    if not len(train) or not len(held):
        train = held = np.arange(n)
    given, links = np.zeros((n, k)), {}
    for j in order:
        links[j] = chain._chain_features(given, about, j).astype(np.float32)
        given[:, j] = y[:, j]
    block = lambda j, rows: (np.hstack([x[rows, j], links[j][rows]]), y[rows, j])
    width = x.shape[2] + links[order[0]].shape[1]
    some = rng.permutation(train)[: max(1, SHARED // k)]
    shared = logistic([block(j, some) for j in order], np.zeros(width), 1.0)
    weights = np.zeros((k, width))
    for j in order:
        weights[j] = logistic([block(j, train)], shared, 20.0)
    z, labels_held = [], []
    for j in order:
        m, own = block(j, held)
        z.append(m @ weights[j])
        labels_held.append(own)
    scale = logistic([(np.column_stack([np.concatenate(z), np.ones(len(held) * k)]), np.concatenate(labels_held))], np.array([1.0, 0.0]), 1.0)
    chain.weights, chain.scale = weights, (float(scale[0]), float(scale[1]))
    chain.evidence = Evidence.of(corpus, final)
    chain.sources = [source_odds(values, y, every) for values in sources]
    return chain


def labelled(docs: DataFrame, labels: DataFrame, subjects: list[str], key: str, sample: int = SAMPLE) -> DataFrame:
    """A bounded sample of labelled documents (with _key, _text and the rest of docs), chosen by a hash of the key, and
    _own, their subjects' numbers. Labels are read without regard to case and space; those that name no subject and
    documents without text are left out. Of rows with one key the one with the smallest text is taken."""
    known = F.create_map(*[F.lit(x) for i, s in enumerate(subjects) for x in (s.lower(), i)])
    own = labels.select(F.col(key).alias("_key"), F.try_element_at(known, F.lower(F.regexp_replace("subject", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))).alias("_s")).where("_key is not null and _s is not null")
    own = own.groupBy("_key").agg(F.array_sort(F.collect_set("_s")).alias("_own"))
    own = own.orderBy(F.xxhash64(F.lit(3), "_key"), "_key").limit(sample)  # this bound makes the broadcast below safe
    rows = docs.join(F.broadcast(own), "_key").where(F.col("_text").rlike(r"\S"))
    rest = [c for c in rows.columns if c not in ("_key", "_text")]
    one = rows.groupBy("_key").agg(F.min(F.struct("_text", *rest)).alias("r"))
    one = cut_lineage(one.select("_key", "r.*").repartition(docs.sparkSession.sparkContext.defaultParallelism, "_key"))
    by_hash = Window.orderBy(F.xxhash64(F.lit(3), "_key"), "_key").rowsBetween(Window.unboundedPreceding, 0)
    sizes = one.select("_key", F.length("_text").alias("n")).withColumn("so_far", F.sum("n").over(by_hash))  # at most `sample` rows
    longer = sizes.where(F.col("so_far") > SAMPLE_CHARS).select("_key")
    return one.join(F.broadcast(longer), "_key", "left_anti") if longer.head() else one


_COUNTED = pa.schema([("term", pa.string()), ("n", pa.int64())])
_ENCODED = pa.schema([("key", pa.string()), ("kind", pa.string()), ("feed", pa.string()), ("host", pa.string()), ("own", pa.list_(pa.int32())), ("units", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32())), ("length", pa.int32())])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for b in batches:
        for t in b.column("_text").to_pylist():
            counts.update({x for u in units(t) for x in terms(u)})
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=_COUNTED)


def _encode(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for b in batches:
            sizes, every, lengths = [], [], []
            for text in b.column("_text").to_pylist():
                u = units(text)
                hits = [x for w in u if (x := sorted({i for t in terms(w) if (i := get(t)) is not None}))]
                sizes.append([len(x) for x in hits])
                every.append([i for x in hits for i in x])
                lengths.append(len(u))
            columns = [b.column(c).cast(f.type) for c, f in zip(("_key", "_kind", "_feed", "_host", "_own"), _ENCODED)]
            columns += [pa.array(x, f.type) for x, f in zip((sizes, every, lengths), list(_ENCODED)[5:])]
            yield pa.RecordBatch.from_arrays(columns, schema=_ENCODED)

    return run


def fitted(rows: DataFrame, subjects: list[str]) -> Chain | None:
    """The chain of a labelled sample; None where there is none."""
    counts = rows.select("_text").mapInArrow(_count_terms, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    known = counts.where(F.col("n") >= MIN_DOCS).select("term").toArrow()["term"].to_pylist()
    index = {t: i for i, t in enumerate(sorted(known))}
    encoded = rows.mapInArrow(_encode(rows.sparkSession.sparkContext.broadcast(index)), "key string, kind string, feed string, host string, own array<int>, units array<int>, terms array<int>, length int")
    got = encoded.toArrow().sort_by("key")
    if not got.num_rows:
        return None
    units_of, terms_of = got["units"].combine_chunks(), got["terms"].combine_chunks()
    corpus = Corpus.of(index, units_of.flatten().to_numpy(), units_of.value_lengths().to_numpy(), terms_of.flatten().to_numpy(), got["length"].to_numpy())
    text = {c: pd.Series(got[c].to_pylist(), dtype=object) for c in ("kind", "feed", "host")}
    return fit_chain(corpus, _kinds(text["kind"]), [_values(text["feed"]), _values(text["host"])], [set(x) for x in got["own"].to_pylist()], subjects)


def _kinds(c: pd.Series) -> np.ndarray:
    at = {s: i for i, s in enumerate(KINDS)}
    return np.array([at.get((x or "").strip().lower() if isinstance(x, str) else "", len(KINDS) - 1) for x in c], dtype=int)


def _values(c: pd.Series) -> np.ndarray:
    return np.array([x.strip() if isinstance(x, str) else "" for x in c], dtype=object)


def with_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "bm_seq", text: str = "content", kind: str = "bookmark_type", feed: str | None = "feed_id", url: str | None = "url", sample: int = SAMPLE) -> DataFrame:
    """(key, subjects): of each document the subjects it is about, sorted, as they are spelled in `subjects`.

    An empty list where the text is null, blank or about none of them, or where there are no labels to learn from.
    Repeated rows are each classified, alike. feed and url name columns that tell the source; null or missing ones tell
    nothing. Other columns play no part. More than MAX_SUBJECTS subjects raise ValueError.
    """
    names = [r[0] for r in subjects.where("subject is not null").select("subject").distinct().orderBy("subject").limit(MAX_SUBJECTS + 1).collect()]
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    key_type = docs.schema[key].dataType.simpleString()
    there = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), there(kind).alias("_kind"), there(feed).alias("_feed"), F.lower(netloc(there(url))).alias("_host"))
    chain = fitted(labelled(rows, labels, names, key, min(sample, MAX_CELLS // len(names))), names) if names else None
    if chain is None:
        return docs.select(F.col(key), F.array().cast("array<string>").alias("subjects"))
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = sent.value
        for b in batches:
            there = np.array([isinstance(t, str) and bool(t.strip()) for t in b["_text"]], bool)
            out: list[list[str]] = [[] for _ in range(len(b))]
            picked = b[there]
            for i, own in zip(np.flatnonzero(there), chain.decode(list(picked["_text"]), _kinds(picked["_kind"]), [_values(picked["_feed"]), _values(picked["_host"])]) if len(picked) else []):
                out[i] = [chain.subjects[j] for j in own]
            yield pd.DataFrame({key: b["_key"], "subjects": out})

    # Keys travel as text: pandas would turn whole numbers beside a null into floats.
    return rows.withColumn("_key", F.col("_key").cast("string")).mapInPandas(classify, f"{key} string, subjects array<string>").withColumn(key, F.col(key).cast(key_type))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_subjects(spread(table(spark, sf_dir, "bookmarks")), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("bm_seq", F.explode("subjects").alias("subject"))


def p2_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subjects, docs, share): the collection by combination of subjects; an empty combination is content on none."""
    counts = _classified(spark, sf_dir).groupBy("subjects").agg(F.count("*").alias("docs"))
    return counts.select(F.array_join("subjects", ", ").alias("subjects"), "docs", (F.col("docs") / F.sum("docs").over(Window.partitionBy())).alias("share"))
