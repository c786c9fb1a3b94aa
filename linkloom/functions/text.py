"""Text functions as Column expressions of the JVM; none needs Python. What uses `let` or another function over arrays is
evaluated term by term beside the generated code, which is what keeps that code short enough to compile."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used. An expression of hundreds of terms that is merged
    into several places would outgrow what the JVM compiles."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def clean_text(c: Column) -> Column:
    """Trimmed, white space squeezed, then entities deleted."""
    return F.regexp_replace(squeeze(strip(c)), r"&[a-zA-Z0-9#]+;", "")


def decode_entities(c: Column) -> Column:
    """The four common entities, in a fixed order, so that an escaped one is decoded once more."""
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def drop_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def drop_scripts(c: Column) -> Column:
    """Without scripts and styles and what they hold."""
    return F.regexp_replace(F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")


def clean_html(c: Column) -> Column:
    """The text of a piece of HTML; empty for null."""
    text = F.replace(decode_entities(drop_tags(drop_scripts(c))), F.lit("&nbsp;"), F.lit(" "))
    return F.coalesce(strip(squeeze(text)), F.lit(""))


def has_any(c: Column, words: Iterable[str]) -> Column:
    """Whether c contains one of the words; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words]), F.lit(False))


def hits(c: Column, words: Iterable[str]) -> Column:
    """How many of the words c contains; 0 for null."""
    return reduce(lambda a, b: a + b, [F.when(F.contains(c, F.lit(w)), 1).otherwise(0) for w in words])


def found(c: Column, names: dict[str, Iterable[str]]) -> Column:
    """Names one of whose words c contains, in the order of `names`."""
    return F.array_compact(F.array(*[F.when(has_any(c, words), F.lit(n)) for n, words in names.items()]))


def words(c: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null. A group that matched nothing counts as no match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_match(c: Column, patterns: Iterable[str]) -> Column:
    """The first pattern's match that isn't null."""
    return F.coalesce(*[match(c, p) for p in patterns])


def sorted_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def hashtags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)#(\w+)"), F.lit(1))


def mentions(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)@(\w+)"), F.lit(1))


def slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c.cast("double"), digits)


def human_size(c: Column) -> Column:
    """Bytes with a unit of 1024."""
    out = None
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        text = F.format_string(f"%.1f {unit}", c.cast("double") / float(1024**power))
        out = text if out is None else F.when(c < 1024 ** (power + 1), text).otherwise(out)
    return out


def tokens_by_length(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def tokens_by_words(c: Column) -> Column:
    return F.floor(word_count(c) * F.lit(1.3)).cast("int")
