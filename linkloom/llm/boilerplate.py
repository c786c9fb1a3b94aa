"""Main text of web pages: equivalence-class template deduction over the pages of hosts.

The tokens are lines with digits and the host's name masked, the parts of a line of links, and the fixed beginning of a
line such as a breadcrumb. A token of a host has an occurrence vector over the host's distinct pages, kept as a count
and a fingerprint (the exclusive or of page hashes); both merge in any order, so a host with a third of all pages is
aggregated like any other. Tokens are told apart by the part they play on other hosts: of templates, of texts, or
unknown there. Tokens of one host and part with the same vector form an equivalence class.

A class is valid if it is frequent and large enough: its tokens' recurrences, together with those they have on other
hosts (TIMES as many pages and PRIOR more), must come to MIN_SHARE of the pages they could recur on and to
MIN_RECURRENCES in all. So two lines that stand on both pages of a host confirm each other where one alone proves
nothing, and what is text on other hosts is of the template where a host has it on most of its pages. Valid classes nest by the stretch of the page that they span and by support; together they are the template. What is between its
tokens are slots: those under a heading that always heads a list are lists of the template, the rest is the main text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import broadcast_within, cut_lineage, spread, table

#: A class is valid from this share of the pages its tokens could recur on: one page with the token is set aside on each
#: host, or rare tokens would look frequent on small hosts. Headings within texts come to about 0.04, parts of a
#: template to 0.25 and more.
MIN_SHARE = 0.12
#: Recurrences that a class must have, all tokens together.
MIN_RECURRENCES = 2.0
#: Pages of other hosts that count beside each of the host's own, and beside a host of one page.
TIMES, PRIOR = 3.0, 20.0
#: A token is on this share of its host's pages at least. So a host's template has at most 1 / LEAST_SHARE times as many
#: tokens as its pages have in the mean.
LEAST_SHARE = 0.01
#: A heading heads a list of the template if it is followed by one from this share of its pages on.
LIST_SHARE = 0.6
#: Templates are broadcast up to this many tokens (8 bytes each); more are joined by host, skewed hosts split.
MAX_BROADCAST = 2_000_000
#: Tokens of a template that the search for headings of lists may broadcast.
MAX_TOKENS = 1_000_000
#: Short lines whose tokens a worker remembers.
KEPT_LINES = 200_000

_DIGITS = re.compile(r"\d+")
_BULLET = re.compile(r"^\s*(?:[-*+>•–·]|\d+[.)])\s+")
_BETWEEN = re.compile(r"\s+[|/·•>»–-]\s+|\s{2,}")
_LEAD = re.compile(r"^([^:|/]{2,30}):\s")
_END = re.compile(r"[.!?…:;][\"'”’)\]]*$")
_MINUTES = re.compile(r"\s*\([^)]*\d[^)]*\)$")


def _hash(kind: str, text: str) -> int:
    return xxhash.xxh64_intdigest(kind + text) - (1 << 63)


def _masked(line: str, names: tuple[str, ...]) -> str:
    x = line.lower()
    for n in names:
        x = x.replace(n, "@")
    return " ".join(_DIGITS.sub("#", x).split())


def _names(site: str) -> tuple[str, ...]:
    stem = site.lower().rsplit(".", 1)[0]
    return tuple(n for n in (site.lower(), re.sub(r"[-._]+", " ", stem), stem) if n)


def _parts(line: str) -> list[str]:
    """The parts of a line of links, if it is one. Its first part has at most 4 words, so a long line without anything
    between words by its sixth is none."""
    first = line.split(None, 6)
    if len(first) == 7 and not _BETWEEN.search(line, 0, len(line) - len(first[6])):
        return []
    p = [x for x in _BETWEEN.split(line) if x]
    return p if len(p) > 1 and all(len(x.split()) <= 4 for x in p) else []


class Line:
    """A line's tokens: of itself, of its fixed beginning up to a colon, of its parts, of its first part as the root of
    a breadcrumb; and whether it could be an item of a list."""

    __slots__ = ("own", "lead", "parts", "root", "bullet", "item", "plain")

    def __init__(self, line: str, names: tuple[str, ...]) -> None:
        bare, masked = line.strip(), _masked(line, names)
        lead, parts = _LEAD.match(masked), [_masked(x, names) for x in _parts(bare)]
        self.own, self.plain = _hash("L", masked), bare.lower()
        self.lead = _hash("B", lead[1]) if lead else None
        self.parts = [_hash("P", x) for x in parts]
        self.root = _hash("R", parts[0]) if len(parts) > 2 else None
        self.bullet = "bullet" if _BULLET.match(line) else "plain"
        self.item = self.bullet == "bullet" or (len(bare.split(None, 14)) <= 14 and not _END.search(_MINUTES.sub("", bare)))

    @property
    def could_be_below(self) -> bool:
        """Whether it could be an item under a heading; a line of links or one with a fixed beginning could not."""
        return self.item and not self.parts and self.lead is None


class Reader:
    """Splits pages into lines. Short lines recur on many pages and hosts, so their tokens are remembered; lines with
    the host's name in them are worked out anew."""

    def __init__(self) -> None:
        self.kept: dict[str, Line] = {}
        self.names: tuple[str, tuple[str, ...]] = ("", ())

    def lines(self, site: str, content: str) -> list[tuple[int, Line]]:
        if self.names[0] != site:
            self.names = (site, _names(site))
        names, kept, out = self.names[1], self.kept, []
        for i, x in enumerate(content.split("\n")):
            line = kept.get(x)
            if line is None:
                if not x or x.isspace():
                    continue
                line = Line(x, ())
                if len(x) <= 80:
                    if len(kept) >= KEPT_LINES:
                        kept.clear()
                    kept[x] = line
            for n in names:
                if n in line.plain:
                    line = Line(x, names)
                    break
            out.append((i, line))
        return out


_PAGE = "site string, page bigint, tokens array<bigint>, below array<bigint>, at array<float>"


def _page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each page in the order of the page, each once: where it stands (0 to 1), and the token below it
    where that could be an item of its list. The page's own title is no token. A page is known by all of its lines but
    for spaces and digits, so that one fetched again counts once though its counters went on."""
    reader = Reader()
    for b in batches:
        sites, pages, sizes, tokens, below, at = [], [], [0], [], [], []
        for site, title, content in zip(*(b.column(c).to_pylist() for c in ("site", "title", "content"))):
            lines, title, found = reader.lines(site, content), title.strip().lower(), {}
            for k, (i, x) in enumerate(lines):
                if title and x.plain == title:
                    continue
                under = None
                if k + 1 < len(lines) and lines[k + 1][0] == i + 1:
                    y = lines[k + 1][1]
                    under = y.own if y.could_be_below and y.plain != title else None
                if found.get(x.own, (None,))[0] is None:
                    found[x.own] = (under, found[x.own][1] if x.own in found else k)
                for t in (x.lead, x.root, *x.parts):
                    if t is not None:
                        found.setdefault(t, (None, k))
            sites.append(site)
            pages.append(xxhash.xxh64_intdigest(np.array([x.own for _, x in lines], np.int64).tobytes()) - (1 << 63))
            tokens += found
            below += [v[0] for v in found.values()]
            at += [v[1] / len(lines) for v in found.values()]
            sizes.append(len(tokens))
        ends = pa.array(sizes, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((tokens, pa.int64()), (below, pa.int64()), (at, pa.float32()))]
        yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(pages, pa.int64()), *lists], ["site", "page", "tokens", "below", "at"])


def _usable(df: DataFrame, content: str, site: str) -> DataFrame:
    """Pages with text. Those without a host stand on one host without a name."""
    return df.where(F.col(content).rlike(r"\S")).withColumns({"_content": F.col(content), "_site": F.coalesce(F.col(site), F.lit(""))})


def templates(df: DataFrame, content: str = "content", site: str = "site", title: str = "title") -> DataFrame:
    """(site, token, pages, class_size, level, heads_list): the tokens of each host's template.

    class_size is the number of tokens in the class; level counts the valid classes that it nests in, itself included:
    those on no fewer pages that span its stretch of the page.
    """
    pages = _usable(df, content, site).select(F.col("_site").alias("site"), F.coalesce(F.col(title), F.lit("")).alias("title"), F.col("_content").alias("content"))
    articles = cut_lineage(pages.mapInArrow(_page_tokens, _PAGE).dropDuplicates(["site", "page"]))
    hosts = articles.groupBy("site").agg(F.count("*").alias("host_pages"))
    each = articles.select("site", "page", F.inline(F.arrays_zip("tokens", "at")))
    vectors = each.groupBy("site", F.col("tokens").alias("token")).agg(F.count("*").alias("pages"), F.bit_xor("page").alias("vector"), F.avg("at").alias("at"))
    vectors = cut_lineage(vectors.join(hosts, "site"))
    pooled = vectors.groupBy("token").agg(F.sum(F.col("pages") - 1).alias("all_had"), F.sum(F.col("host_pages") - 1).alias("all_possible"), F.count("*").alias("on_hosts")).where("all_had > 0")
    own, possible = F.col("pages") - 1, F.col("host_pages") - 1
    elsewhere, others = F.col("all_had") - own, F.col("all_possible") - possible
    share = F.coalesce(F.try_divide(elsewhere, others), F.lit(0.0))
    part = F.when(others * MIN_SHARE < 1, 0).when(share >= MIN_SHARE, 1).otherwise(-1)
    weight = F.least(others, PRIOR + TIMES * possible)
    told = vectors.join(pooled, "token").where(F.col("pages") >= LEAST_SHARE * F.col("host_pages"))
    told = cut_lineage(told.select("site", "token", "pages", "vector", "at", part.alias("part"), (own + weight * share).alias("had"), (possible + weight).alias("could")).where("had > 0"))
    classes = told.groupBy("site", "vector", "pages", "part").agg(F.count("*").cast("int").alias("class_size"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.sum("had").alias("had"), F.sum("could").alias("could"))
    valid = cut_lineage(classes.where((F.col("had") >= MIN_SHARE * F.col("could")) & (F.col("had") >= MIN_RECURRENCES)).drop("had", "could"))
    outer = valid.groupBy("site").agg(F.collect_list(F.struct("lo", "hi", "pages")).alias("outer"))
    spans = lambda o: (o["lo"] <= F.col("lo")) & (o["hi"] >= F.col("hi")) & (o["pages"] >= F.col("pages"))
    nested = valid.join(outer, "site").select("site", "vector", "pages", "part", "class_size", F.size(F.filter("outer", spans)).alias("level"))
    kept = cut_lineage(told.select("site", "token", "vector", "pages", "part").join(nested, ["site", "vector", "pages", "part"]))
    # A slot of the template is a list where what is below its heading could be an item and is no token of a template.
    known = broadcast_within(kept.select("token").distinct(), MAX_TOKENS)
    below = articles.select(F.inline(F.arrays_zip("tokens", "below"))).where("below is not null").withColumnRenamed("tokens", "token").join(known, "token", "left_semi")
    slots = below.join(known.withColumnRenamed("token", "below"), "below", "left_anti").groupBy("token").agg(F.count("*").alias("lists"))
    heads = slots.join(pooled, "token").where(F.col("lists") >= LIST_SHARE * (F.col("all_had") + F.col("on_hosts"))).select("token", F.lit(True).alias("heads_list"))
    return kept.join(heads, "token", "left").select("site", "token", "pages", "class_size", "level", F.coalesce("heads_list", F.lit(False)).alias("heads_list"))


def _dropped(lines: list[tuple[int, Line]], title: str, tokens: set[int], lists: set[int]) -> list[int]:
    """Numbers of the lines that belong to the template or to its lists."""
    out, in_list, before = [], "", -2
    for at, x in lines:
        if x.own in tokens or x.lead in tokens or x.root in tokens or (x.parts and all(p in tokens for p in x.parts)):
            in_list = "first" if x.own in lists else ""
            out.append(at)
        elif in_list and before == at - 1 and (in_list == "first" or in_list == x.bullet) and x.item and x.plain != title:
            in_list = x.bullet
            out.append(at)
        else:
            in_list = ""
        before = at
    return out


def drop_boilerplate(df: DataFrame, key: str = "extract_id", content: str = "content", site: str = "site", title: str = "title", with_text: bool = True) -> DataFrame:
    """(key, dropped, main_text): of each row, the numbers of the non-blank lines that aren't main body, and the rest.

    Lines come from splitting at line feeds and count from 0. Null or blank content: no lines dropped, the content as
    it is. Rows fetched twice are each cleaned. An empty table gives no rows. Without with_text there is no main_text.
    """
    deduced = templates(df, content, site, title).groupBy("site").agg(F.collect_list("token").alias("_tokens"), F.collect_list(F.when(F.col("heads_list"), F.col("token"))).alias("_lists"))
    deduced = cut_lineage(deduced.withColumnRenamed("site", "_site"))
    if (deduced.select(F.sum(F.size("_tokens"))).first()[0] or 0) <= MAX_BROADCAST:
        deduced = F.broadcast(deduced)
    # Keys travel as text: pandas would turn whole numbers beside a null into floats.
    rows = df.select(F.col(key).cast("string").alias("_key"), F.col(content).alias("_content"), F.coalesce(F.col(site), F.lit("")).alias("_site"), F.coalesce(F.col(title), F.lit("")).alias("_title"))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, of_site = Reader(), {}
        for b in batches:
            dropped, kept = [], []
            for s, t, x, own, lists in zip(b["_site"], b["_title"], b["_content"], b["_tokens"], b["_lists"]):
                if x is None or own is None:
                    dropped.append([])
                    kept.append(x)
                    continue
                if s not in of_site:
                    if len(of_site) > 1000:
                        of_site.clear()
                    of_site[s] = (set(own.tolist()), set(lists.tolist()))
                d = _dropped(reader.lines(s, x), t.strip().lower(), *of_site[s])
                dropped.append(d)
                if with_text:
                    gone = set(d)
                    kept.append("\n".join(line for i, line in enumerate(x.split("\n")) if i not in gone))
            yield pd.DataFrame({key: b["_key"], "dropped": dropped} | ({"main_text": kept} if with_text else {}))

    kind = df.schema[key].dataType.simpleString()
    out = f"{key} string, dropped array<bigint>" + (", main_text string" if with_text else "")
    return rows.join(deduced, "_site", "left").mapInPandas(clean, out).withColumn(key, F.col(key).cast(kind))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_boilerplate(spread(table(spark, sf_dir, "extracted_content")), with_text=False)
    return cleaned.select("extract_id", F.explode("dropped").alias("line_no"))


def p3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(spread(table(spark, sf_dir, "extracted_content")))
