"""Checks of records. A result is a struct of is_valid, errors and warnings; nothing is ever raised.

Fixed values: the messages and the limits of length, time and counts, as they are part of the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import urls
from ..functions.text import has_any, strip, word_count


def _messages(*rules: tuple[Column, Column | str]) -> Column:
    """The messages of the rules whose condition is true, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in rules]))


def _result(errors: Column, warnings: Column) -> Column:
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"))


def url_errors(url: Column) -> Column:
    """Null or empty addresses have one error and nothing else is looked at."""
    u = strip(url)
    scheme, host = urls.scheme(u), F.lower(urls.netloc(u))
    empty = url.isNull() | (url == "")
    own = _messages(
        (scheme == "", "URL missing scheme (http/https)"),
        ((scheme != "") & ~scheme.isin(vocab.SCHEMES), F.concat(F.lit("Invalid URL scheme: "), scheme)),
        (host == "", "URL missing domain"),
        ((host != "") & ~urls.domain_valid(host), F.concat(F.lit("Invalid domain format: "), host)),
    )
    return F.when(empty, F.array(F.lit("URL must be a non-empty string"))).otherwise(own)


def url_warnings(url: Column) -> Column:
    u = strip(url)
    host = F.lower(urls.netloc(u))
    suspicious = [(u.rlike("(?i)" + p), f"URL contains suspicious pattern: {p}") for p in vocab.SUSPICIOUS]
    own = _messages((has_any(host, vocab.BLOCKED), F.concat(F.lit("URL points to local/blocked domain: "), host)), *suspicious, (F.length(u) > 2000, "URL is very long (>2000 characters)"))
    return F.when(url.isNull() | (url == ""), F.array().cast("array<string>")).otherwise(own)


def check_url(url: Column) -> Column:
    return _result(url_errors(url), url_warnings(url))


def iso_date(c: Column) -> Column:
    """An ISO date or date and time, Z allowed; null where the text is something else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?\z"), F.try_to_timestamp(F.replace(c, F.lit(","), F.lit("."))))


def bookmark_errors(df: DataFrame) -> Column:
    """Errors of a bookmark's fields; a column that df lacks is a missing field, a null a field that is empty."""
    rules: list[tuple[Column, str]] = []
    for name in ("id", "title", "url"):
        if name not in df.columns:
            rules.append((F.lit(True), f"Missing required field: {name}"))
        else:
            rules.append((F.coalesce(F.col(name) == "", F.lit(True)), f"Required field is empty: {name}"))
    if "id" in df.columns:
        rules.append((F.coalesce(F.col("id") == "", F.lit(True)), "ID must be a non-empty string"))
    if "title" in df.columns:
        rules.append((F.col("title").isNull(), "Title must be a string"))
    if "created_at" in df.columns:
        rules.append((F.coalesce((F.col("created_at") != "") & iso_date(F.col("created_at")).isNull(), F.lit(False)), "Invalid created_at date format"))
    own = _messages(*rules)
    return F.concat(own, F.transform(url_errors(F.col("url")), lambda e: F.concat(F.lit("URL validation: "), e))) if "url" in df.columns else own


#: Fields of a bookmark; others are warned about.
FIELDS = ("id", "url", "title", "content", "author", "created_at", "metadata")


def bookmark_warnings(df: DataFrame, known: tuple[str, ...] = FIELDS) -> Column:
    limits = (("id", 100, "ID is very long (>100 characters)"), ("title", 500, "Title is very long (>500 characters)"), ("content", 50000, "Content is very long (>50,000 characters)"))
    rules = [(F.coalesce(F.length(name) > most, F.lit(False)), text) for name, most, text in limits if name in df.columns]
    unknown = sorted(set(df.columns) - set(known))
    if unknown:
        rules.append((F.lit(True), f"Unknown fields: {', '.join(unknown)}"))
    own = _messages(*rules)
    return F.concat(F.transform(url_warnings(F.col("url")), lambda w: F.concat(F.lit("URL validation: "), w)), own) if "url" in df.columns else own


def bookmark_facts(df: DataFrame) -> Column:
    """What a check says besides its messages: how many fields are there, and whether content and author are given."""
    there = [F.col(c).isNotNull().cast("int") for c in df.columns if c in FIELDS]
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False)) if c in df.columns else F.lit(False)
    return F.struct(sum(there[1:], there[0]).alias("field_count") if there else F.lit(0).alias("field_count"), given("content").alias("has_content"), given("author").alias("has_author"))


def check_bookmarks(df: DataFrame, known: tuple[str, ...] = FIELDS) -> DataFrame:
    """df with `checked`. Blank, null and very long fields have a defined result; rows are kept as they are."""
    return df.withColumn("checked", _result(bookmark_errors(df), bookmark_warnings(df, known)))


def valid_bookmarks(df: DataFrame) -> DataFrame:
    """The rows of df that pass; columns as they were."""
    return df.where(F.size(bookmark_errors(df)) == 0)


def check_response(content: Column, usage: Column, model: Column, seconds: Column) -> Column:
    """A model's response: content and model not blank, no negative token count or time."""
    missing = [(c.isNull(), f"Missing required field: {n}") for n, c in (("content", content), ("model", model), ("usage", usage))]
    counts = [(F.coalesce(usage[f] < 0, F.lit(False)), f"Usage field {f} must be a non-negative integer") for f in ("prompt_tokens", "completion_tokens", "total_tokens")]
    errors = _messages(*missing, (F.coalesce(strip(content) == "", F.lit(False)), "Content is empty"), *counts, (F.coalesce(strip(model) == "", F.lit(False)), "Model must be a non-empty string"), (F.coalesce(seconds < 0, F.lit(False)), "Processing time must be a non-negative number"))
    return _result(errors, _messages((F.coalesce(seconds > 300, F.lit(False)), "Processing time is very high (>5 minutes)")))


def check_response_json(json: Column) -> Column:
    """As check_response for a response as JSON text, where a field may be missing or of any kind."""
    v = F.try_parse_json(json)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    there = lambda name: F.coalesce(F.array_contains(F.json_object_keys(F.when(is_object, json)), name), F.lit(False))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    text = lambda name: F.when(kind(f"$.{name}") == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
    usage = F.coalesce(F.startswith(kind("$.usage"), F.lit("OBJECT")), F.lit(False))
    usage_keys = F.coalesce(F.json_object_keys(F.get_json_object(json, "$.usage")), F.array().cast("array<string>"))

    def count_wrong(name: str) -> Column:
        whole = F.coalesce(kind(f"$.usage.{name}") == "BIGINT", F.lit(False))
        return usage & F.array_contains(usage_keys, name) & ~(whole & F.coalesce(F.try_variant_get(v, f"$.usage.{name}", "bigint") >= 0, F.lit(False)))

    seconds = F.when(kind("$.processing_time").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(v, "$.processing_time", "double"))
    errors = _messages(
        *[(~there(n), f"Missing required field: {n}") for n in ("content", "model", "usage")],
        (there("content") & text("content").isNull(), "Content must be a string"), (F.coalesce(strip(text("content")) == "", F.lit(False)), "Content is empty"),
        (there("usage") & ~usage, "Usage must be a dictionary"), *[(count_wrong(n), f"Usage field {n} must be a non-negative integer") for n in ("prompt_tokens", "completion_tokens", "total_tokens")],
        (there("model") & F.coalesce(strip(text("model")) == "", F.lit(True)), "Model must be a non-empty string"),
        (there("processing_time") & F.coalesce(seconds < 0, F.lit(True)), "Processing time must be a non-negative number"),
    )
    errors = F.when(is_object, errors).otherwise(F.array(F.lit("LLM response must be a dictionary")))
    return _result(errors, _messages((F.coalesce(seconds > 300, F.lit(False)), "Processing time is very high (>5 minutes)")))


def response_word_count(content: Column) -> Column:
    return F.when(strip(content) != "", word_count(content))


def json_missing(json: Column, required: list[str]) -> Column:
    """Required fields that a JSON object lacks; all of them where it isn't an object."""
    keys = F.coalesce(F.json_object_keys(F.when(F.try_parse_json(json).isNotNull(), json)), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(r) for r in required]), keys)


def summarise(df: DataFrame, checked: str = "checked") -> DataFrame:
    """One row: total, valid and invalid items and those with warnings; zeros for an empty df."""
    c = F.col(checked)
    return df.agg(F.count("*").alias("total_items"), F.count_if(c["is_valid"]).alias("valid_items"), F.count_if(~c["is_valid"]).alias("invalid_items"), F.count_if(F.size(c["warnings"]) > 0).alias("items_with_warnings"))


def common(df: DataFrame, messages: Column, n: int = 10) -> DataFrame:
    """The n most frequent messages; ties by text."""
    return df.select(F.explode(messages).alias("message")).groupBy("message").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(n)
