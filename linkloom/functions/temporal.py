"""Timestamps of any written form as UTC instants.

All forms stand in one alternation with named groups. A value is matched once; its parts are put in fixed order by the
groups' names, so each form only has to say which part is which. Parts are checked against the calendar and put
together by integer day arithmetic. Only the zone rules themselves (daylight saving) come from the JVM's zone tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a written time, in the order in which they leave the pattern. `one` and `two` are the leading numbers of a
#: date in digits whose order the feed decides.
PARTS = ("year", "month", "name", "day", "one", "two", "hour", "minute", "second", "frac", "half", "zone", "epoch", "decimals")

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = (
    r"(?<name>january|february|march|april|may|june|july|august|september|october|november|december"
    r"|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)\.?"
)
_WEEKDAY = r"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?"
_OFFSET = r"(?:gmt|utc|ut)?[+-]\d{1,2}(?::?\d{2})?(?::\d{2})?"
_ZONE = rf"(?<zone>{_OFFSET}(?:\[[^\]]*\])?|\[?[a-z]+(?:/[a-z0-9_+-]+)+\]?|[a-z]{{1,5}})"
_CLOCK = r"(?<hour>\d{1,2}):(?<minute>\d{2})(?::(?<second>\d{2})(?:[.,](?<frac>\d+))?)?(?: ?(?<half>[ap])\.?m\.?(?![a-z]))?"
_TIME = rf"{_CLOCK}(?: ?{_ZONE})?"

#: One entry per family of forms; all end up in one alternation.
FORMS = (
    rf"(?<year>\d{{4}})-(?<month>\d{{1,2}})-(?<day>\d{{1,2}})(?:(?:t| |, )(?:{_TIME}))?",
    rf"(?<year>\d{{4}})/(?<month>\d{{1,2}})/(?<day>\d{{1,2}})(?:(?:t| |, )(?:{_TIME}))?",
    rf"(?<year>\d{{4}})\.(?<month>\d{{1,2}})\.(?<day>\d{{1,2}})(?:(?:t| |, )(?:{_TIME}))?",
    rf"(?<year>\d{{4}})(?<month>\d{{2}})(?<day>\d{{2}})t(?<hour>\d{{2}})(?<minute>\d{{2}})(?:(?<second>\d{{2}})(?:[.,](?<frac>\d+))?)?(?: ?{_ZONE})?",
    rf"(?:{_WEEKDAY},? )?(?<day>\d{{1,2}})(?:st|nd|rd|th|\.)?[ -]{_MONTH},?[ -](?<year>\d{{4}})(?:(?:,| at)? (?:{_TIME}))?",
    rf"(?:{_WEEKDAY},? )?{_MONTH} (?<day>\d{{1,2}})(?:st|nd|rd|th)?,? (?<year>\d{{4}})(?:(?:,| at)? (?:{_TIME}))?",
    rf"{_WEEKDAY},? {_MONTH} (?<day>\d{{1,2}}) {_CLOCK}(?: {_ZONE})? (?<year>\d{{4}})",
    rf"(?<one>\d{{1,2}})/(?<two>\d{{1,2}})/(?<year>\d{{4}})(?:,? (?:{_TIME}))?",
    rf"(?<one>\d{{1,2}})\.(?<two>\d{{1,2}})\.(?<year>\d{{4}})(?:,? (?:{_TIME}))?",
    rf"(?<one>\d{{1,2}})-(?<two>\d{{1,2}})-(?<year>\d{{4}})(?:,? (?:{_TIME}))?",
    r"(?<epoch>[+-]?\d{1,19})(?:\.(?<decimals>\d+))?",
)


def _alternation() -> tuple[str, str]:
    """The one pattern, and the replacement that lists the parts between separators. A name may occur in several
    forms; each occurrence gets its own group, and the replacement joins those of one name (at most one is filled)."""
    alternatives, groups = [], {p: [] for p in PARTS}
    for i, form in enumerate(FORMS):
        for p in PARTS:
            if f"(?<{p}>" in form:
                groups[p].append(f"{p}x{i}")
                form = form.replace(f"(?<{p}>", f"(?<{p}x{i}>")
        alternatives.append(form)
    listed = "\u0001".join("".join(f"${{{g}}}" for g in groups[p]) for p in PARTS)
    return "(?i)^(?:" + "|".join(alternatives) + ")$", listed


PATTERN, LISTED = _alternation()


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers only."""
    y = year - F.when(month <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    return era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468


def month_length(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def written_parts(value: Column) -> Column:
    """ARRAY<STRING> of PARTS, or null where the value has none of the forms. Space of any kind around and between
    parts and the typographic minus are read as plain ones."""
    plain = F.regexp_replace(F.translate(value, "−–\u0001", "--"), r"[\s\p{Z}\p{Cf}]+", " ")
    parts = F.split(F.regexp_replace(F.trim(plain), PATTERN, LISTED), "\u0001", -1)
    return F.when(F.size(parts) == len(PARTS), parts)


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns, made by a generator of one row. Unlike a projection it is never merged with what is above
    or below it, so an expression that later steps use many times is worked out once and the generated code stays short."""
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))


def with_utc_micros(df: DataFrame, out: str, zones: list[str]) -> DataFrame:
    """df with the BIGINT column `out`: microseconds since 1970 UTC, or null.

    df has `_parts` (from written_parts), `_zone` (an IANA zone or null), `_order` (dmy, mdy or another, which reads no
    date in digits that doesn't begin with the year) and `_short_names` (MAP of a short zone name to what it means in
    that zone: an ARRAY of STRUCT<since, seconds>, the offset from that second since 1970 UTC on). zones: the zone names that are known. The steps are projections of their own so
    that each part is worked out once.
    """

    def part(name: str) -> Column:
        p = F.get(F.col("_parts"), F.lit(PARTS.index(name)))
        return F.when(p != "", p)

    def number(name: str) -> Column:
        return part(name).cast("bigint")

    c = F.col
    index = F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS) for x in (m, i + 1)])
    read = staged(df, {
        "_year": number("year"), "_month_no": number("month"), "_named": F.lower(F.substring(part("name"), 1, 3)), "_day_no": number("day"), "_one": number("one"), "_two": number("two"),
        "_hour": F.coalesce(number("hour"), F.lit(0)), "_minute": F.coalesce(number("minute"), F.lit(0)), "_second": F.coalesce(number("second"), F.lit(0)),
        "_half": F.lower(part("half")), "_written_zone": part("zone"), "_epoch": part("epoch"),
        "_micro": F.rpad(F.substring(F.coalesce(part("frac"), part("decimals"), F.lit("0")), 1, 6), 6, "0").cast("bigint"),
    })
    order = c("_order")
    dated = staged(read, {
        "_month": F.coalesce(c("_month_no"), F.try_element_at(index, c("_named")), F.when(order == "dmy", c("_two")).when(order == "mdy", c("_one"))),
        "_day": F.coalesce(c("_day_no"), F.when(order == "dmy", c("_one")).when(order == "mdy", c("_two"))),
        "_hour_ok": F.when(c("_half").isNotNull(), c("_hour").between(1, 12)).otherwise(c("_hour") <= 23),
        "_hour24": F.when(c("_half").isNull(), c("_hour")).otherwise(c("_hour") % 12 + F.when(c("_half") == "p", 12).otherwise(0)),
        "_offset_parts": F.split(F.regexp_replace(F.regexp_replace(c("_written_zone"), r"\[.*$", ""), r"(?i)^(?:gmt|utc|ut)?([+-])(\d{1,2}):?(\d{2})?(?::?\d{2})?$", "$1\u0001$2\u0001$3"), "\u0001", -1),
        "_region": F.regexp_replace(c("_written_zone"), r"[\[\]]", ""),
    })
    valid = (c("_year") >= 1) & c("_month").between(1, 12) & (c("_day") >= 1) & (c("_day") <= month_length(c("_year"), c("_month"))) & c("_hour_ok") & (c("_minute") <= 59) & (c("_second") <= 59)
    clock = ((c("_hour24") * 60 + c("_minute")) * 60 + c("_second")) * 1_000_000 + c("_micro")
    has_offset = F.size("_offset_parts") == 3
    upper, fixed = F.upper(c("_written_zone")), F.upper(c("_written_zone")).isin("Z", "UTC", "GMT", "UT")
    digits = F.length(F.regexp_replace(c("_epoch"), r"^[+-]?0*(?=\d)", ""))
    walled = staged(dated, {
        "_wall": F.when(valid, days_from_civil(c("_year"), c("_month"), c("_day")).cast("bigint") * 86_400_000_000 + clock),
        "_has_offset": has_offset,
        "_off_h": F.when(has_offset, F.get(c("_offset_parts"), F.lit(1))).cast("bigint"),
        "_off_m": F.when(has_offset, F.coalesce(F.nullif(F.get(c("_offset_parts"), F.lit(2)), F.lit("")), F.lit("0"))).cast("bigint"),
        "_off_sign": F.when(F.get(c("_offset_parts"), F.lit(0)) == "-", -1).otherwise(1),
        "_meanings": F.try_element_at(c("_short_names"), upper),
        # The zone whose rules apply: the one written, else the feed's; null where none is known or an offset holds.
        "_rules": F.when(has_offset | fixed, None).when(F.contains(c("_written_zone"), F.lit("/")), F.when(c("_region").isin(zones), c("_region"))).when(c("_zone").isin(zones), c("_zone")),
        "_digits": digits, "_whole": F.abs(c("_epoch").try_cast("bigint")), "_sign": F.when(F.startswith(c("_epoch"), F.lit("-")), -1).otherwise(1),
    })
    # A repeated wall time is the first of the two, a skipped one keeps the offset before the change.
    # Of what a short name meant at different times, the last whose time has come by that instant.
    short = F.try_element_at(F.filter("_meanings", lambda m: c("_wall") - m["seconds"].cast("bigint") * 1_000_000 >= m["since"] * 1_000_000), F.lit(-1))["seconds"].cast("bigint")
    by_rules = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(c("_wall")), c("_rules")))
    offset_ok = (c("_off_h") * 60 + c("_off_m") <= 18 * 60) & (c("_off_m") <= 59)
    at = (
        F.when(c("_has_offset"), F.when(offset_ok, c("_wall") - c("_off_sign") * (c("_off_h") * 60 + c("_off_m")) * 60_000_000))
        .when(fixed, c("_wall"))
        .when(c("_meanings").isNotNull(), c("_wall") - short * 1_000_000)
        .when(c("_rules").isNotNull() & c("_wall").isNotNull(), by_rules)
    )
    bare = (
        F.when(c("_digits") <= 11, c("_whole") * 1_000_000 + c("_micro"))
        .when(c("_digits") <= 14, c("_whole") * 1_000 + F.floor(c("_micro") / 1_000))
        .when(c("_digits") <= 17, c("_whole"))
        .otherwise(F.floor(c("_whole") / 1_000))
    ).cast("bigint")
    return staged(walled, {out: F.when(c("_epoch").isNotNull(), c("_sign") * bare).otherwise(at)}).select(*df.columns, out)
