"""Model requests and responses as data: prompts and request JSON out, parsed sections in.

There is no client here. A response is a column of text, from wherever it came; the parsers and the keyword fallbacks
are the operator. Parsing is a fold over the lines that carries the section they stand in.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, strip
from . import analysis as keyword_analysis
from . import categories, tags

PROMPTS = {
    "analysis": ("You analyse texts and report their themes, insights and advice.", "Analyse this text.\n\n{content}\n\nAnswer with the sections **Main Topics**, **Key Insights**, **Actionable Items**, **Technologies/Tools**, **Author Expertise** and **Relevance Score** (1-10)."),
    "categories": ("You sort texts into categories.", "Sort this text into categories.\n\n{content}\n\nAnswer with the sections **Primary Category**, **Secondary Categories** and **Confidence Score** (1-10)."),
    "tags": ("You give texts tags.", "Give tags for this text.\n\n{content}\n\nAnswer with the sections **Tags** and **Tag Confidence**."),
}


def prompt(kind: str, content: Column, templates: dict[str, tuple[str, str]] = PROMPTS) -> Column:
    return F.replace(F.lit(templates[kind][1]), F.lit("{content}"), F.coalesce(content, F.lit("")))


#: What one provider is asked to block unless told otherwise.
SAFETY = tuple({"category": f"HARM_CATEGORY_{c}", "threshold": "BLOCK_MEDIUM_AND_ABOVE"} for c in ("HARASSMENT", "HATE_SPEECH", "SEXUALLY_EXPLICIT", "DANGEROUS_CONTENT"))


def _json(value: object) -> Column:
    """A constant of any shape, to be put into a body as it is."""
    return F.parse_json(F.lit(json.dumps(value)))


def _image_parts(images: Column, of: Callable[[Column], Column]) -> Column:
    """Each image as a part of a message, in JSON; images is an ARRAY<STRUCT<media_type, data>>, null for none."""
    return F.transform(F.coalesce(images, F.array().cast("array<struct<media_type: string, data: string>>")), of)


def request_json(
    provider: str, model: str, prompt_text: Column, system: str | None, temperature: float = 0.3, max_tokens: int = 2000, tools: list | None = None, tool_choice: object = None,
    images: Column | None = None, response_format: dict | None = None, safety: list | tuple | None = SAFETY, stop: list[str] | None = None,
) -> Column:
    """The body of a request in the layout of one of three providers: messages with a system field (claude), messages
    alone (grok), contents with a generation config (gemini). tools, tool_choice, response_format (grok), safety and stop
    (gemini) are constants; images is an ARRAY<STRUCT<media_type, data>> of base64 data before the text (claude, gemini).
    What a provider has no place for raises ValueError."""
    text, temp, most = prompt_text, F.lit(temperature), F.lit(max_tokens)
    lacking = {"claude": {"response_format": response_format}, "grok": {"images": images}, "gemini": {"response_format": response_format, "tool_choice": tool_choice}}
    if provider not in lacking:
        raise ValueError(f"unknown provider: {provider}")
    if wrong := [n for n, x in lacking[provider].items() if x is not None]:
        raise ValueError(f"{provider} has no {wrong[0]}")
    fields: list[Column] = []
    if provider == "claude":
        content = text
        if images is not None:
            picture = lambda i: F.struct(F.lit("image").alias("type"), F.struct(F.lit("base64").alias("type"), F.coalesce(i["media_type"], F.lit("image/jpeg")).alias("media_type"), i["data"].alias("data")).alias("source"), F.lit(None).cast("string").alias("text"))
            words = F.struct(F.lit("text").alias("type"), F.lit(None).cast("struct<type: string, media_type: string, data: string>").alias("source"), text.alias("text"))
            content = F.concat(_image_parts(images, picture), F.array(words))
        fields = [F.lit(model).alias("model"), most.alias("max_tokens"), temp.alias("temperature"), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages")]
        fields += [F.lit(system).alias("system")] * bool(system) + [_json(tools).alias("tools")] * bool(tools) + [_json(tool_choice).alias("tool_choice")] * bool(tool_choice)
    elif provider == "grok":
        said = [F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(system)), ("user", text)) if r == "user" or system]
        fields = [F.lit(model).alias("model"), F.array(*said).alias("messages"), most.alias("max_tokens"), temp.alias("temperature")]
        fields += [_json(tools).alias("tools"), _json(tool_choice or "auto").alias("tool_choice")] if tools else []
        fields += [_json(response_format).alias("response_format")] if response_format else []
        fields += [F.lit(0.9).alias("top_p")] if not tools and not response_format else []
    else:
        parts = F.array(F.struct(F.lit(None).cast("struct<mime_type: string, data: string>").alias("inline_data"), text.alias("text")))
        if images is not None:
            picture = lambda i: F.struct(F.struct(F.coalesce(i["media_type"], F.lit("image/jpeg")).alias("mime_type"), i["data"].alias("data")).alias("inline_data"), F.lit(None).cast("string").alias("text"))
            parts = F.concat(_image_parts(images, picture), parts)
        config = [temp.alias("temperature"), F.lit(0.8).alias("topP"), F.lit(40).alias("topK"), most.alias("maxOutputTokens")]
        config += [F.array(*[F.lit(x) for x in stop]).alias("stopSequences")] if stop else []
        fields = [F.array(F.struct(parts.alias("parts"))).alias("contents"), F.struct(*config).alias("generationConfig")]
        fields += [F.struct(F.array(F.struct(F.lit(system).alias("text"))).alias("parts")).alias("systemInstruction")] * bool(system) + [_json(tools).alias("tools")] * bool(tools)
        fields += [_json(list(safety)).alias("safetySettings")] if safety and not tools and images is None else []
    return F.to_json(F.struct(*fields))


def response_text(provider: str, json: Column) -> Column:
    """The text of a provider's answer; null where the JSON is broken or has none."""
    if provider == "claude":
        blocks = F.from_json(json, "content array<struct<type: string, text: string>>")["content"]
        return F.when(F.size(blocks) > 0, F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), ""))
    if provider == "grok":
        choices = F.from_json(json, "choices array<struct<message: struct<content: string>>>")["choices"]
        return F.when(F.size(choices) > 0, F.coalesce(F.get(choices, F.lit(0))["message"]["content"], F.lit("")))
    if provider == "gemini":
        found = F.from_json(json, "candidates array<struct<content: struct<parts: array<struct<text: string>>>>>")["candidates"]
        return F.when(F.size(found) > 0, F.coalesce(F.array_join(F.transform(F.get(found, F.lit(0))["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit("")))
    raise ValueError(f"unknown provider: {provider}")


def usage_count(json: Column, *names: str) -> Column:
    """A token count under whichever of the names the provider uses; 0 for none."""
    return F.coalesce(*[F.get_json_object(json, f"$.{n}").try_cast("bigint") for n in names], F.lit(0).cast("bigint"))


def stream_events(text: Column) -> Column:
    """The payloads of a server-sent event stream, up to the end mark."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.startswith(x, F.lit("data: ")))
    payloads = F.transform(lines, lambda x: strip(F.substr(x, F.lit(7))))
    done = F.array_position(payloads, "[DONE]")
    return F.when(done > 0, F.slice(payloads, F.lit(1), (done - 1).cast("int"))).otherwise(payloads)


def _sections(text: Column, heads: dict[str, str], inline: bool) -> Column:
    """ARRAY<STRUCT<section, kind, value>> of the lines that stand in a section. kind: head, item (after a dash), pair
    (a colon, no dash) or line. Lines before the first section are left out."""
    lines = F.filter(F.transform(F.split(strip(F.coalesce(text, F.lit(""))), "\n"), strip), lambda x: x != "")

    def head(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, title in heads.items():
            out = F.when(F.startswith(line, F.lit(f"**{title}**")) | F.startswith(line, F.lit(f"- **{title}**")), name).otherwise(out)
        return out

    def step(state: Column, line: Column) -> Column:
        h = head(line)
        section = F.coalesce(h, state["section"])
        kind = F.when(h.isNotNull(), "head").when(F.startswith(line, F.lit("- ")), "item").when(F.contains(line, F.lit(":")), "pair").otherwise("line")
        row = F.struct(section.alias("section"), kind.alias("kind"), line.alias("value"))
        rows = F.when(section.isNotNull(), F.concat(state["rows"], F.array(row))).otherwise(state["rows"])
        return F.struct(section.alias("section"), rows.alias("rows"))

    empty = F.array().cast("array<struct<section: string, kind: string, value: string>>")
    start = F.struct(F.lit(None).cast("string").alias("section"), empty.alias("rows"))
    rows = F.aggregate(lines, start, step, lambda s: s["rows"])
    if not inline:
        return rows
    # A value on the line of its head becomes a line of its own, items at commas.
    return F.transform(rows, lambda r: F.struct(r["section"].alias("section"), F.when((r["kind"] == "head") & (after_colon(r["value"]) != ""), "pair").otherwise(r["kind"]).alias("kind"), r["value"].alias("value")))


def after_colon(c: Column) -> Column:
    return F.coalesce(strip(F.regexp_extract(c, r"(?s)^[^:]*:(.*)$", 1)), F.lit(""))


def _items(rows: Column, section: str, most: int) -> Column:
    own = F.filter(rows, lambda r: (r["section"] == section) & (r["kind"] == "item"))
    return F.slice(F.transform(own, lambda r: strip(F.substr(r["value"], F.lit(3)))), 1, most)


def _last(rows: Column, section: str, dashes: bool) -> Column:
    """The value after the colon of the last such line; dashes: whether a line with a dash counts too."""
    kinds = ["pair", "item"] if dashes else ["pair"]
    own = F.filter(rows, lambda r: (r["section"] == section) & r["kind"].isin(kinds) & F.contains(r["value"], F.lit(":")))
    return after_colon(F.try_element_at(own, F.lit(-1))["value"])


def _number(c: Column) -> Column:
    """The number before a slash, 5 where there is none; null for null."""
    return F.when(c.isNotNull() & (c != ""), F.coalesce(strip(F.substring_index(c, "/", 1)).try_cast("double"), F.lit(5.0)))


def parse_analysis(response: Column, original: Column, inline: bool = False) -> Column:
    """Sections of an analysis. By default a value on the same line as its head isn't read; inline reads it. Tone and
    depth are those of the response, kind and length those of the original text."""
    # The heads of sections.
    heads = {"main_topics": "Main Topics", "key_insights": "Key Insights", "actionable_items": "Actionable Items", "technologies_tools": "Technologies/Tools", "author_expertise": "Author Expertise", "relevance_score": "Relevance Score"}
    return let(_sections(response, heads, inline), lambda rows: _analysis(rows, response, original))


def _analysis(rows: Column, response: Column, original: Column) -> Column:
    expertise, score = _last(rows, "author_expertise", False), _number(_last(rows, "relevance_score", False))
    return F.struct(
        _items(rows, "main_topics", 10).alias("main_topics"), _items(rows, "key_insights", 10).alias("key_insights"), _items(rows, "actionable_items", 10).alias("actionable_items"), _items(rows, "technologies_tools", 15).alias("technologies_tools"),
        F.coalesce(F.nullif(expertise, F.lit("")), F.lit("Unknown")).alias("author_expertise"), F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.coalesce(score, F.lit(5.0)))).alias("relevance_score"),
        keyword_analysis.sentiment(response).alias("sentiment"), keyword_analysis.complexity(response).alias("complexity_level"), keyword_analysis.content_type(original).alias("content_type"),
    )


def parse_categories(response: Column, original: Column, inline: bool = False) -> Column:
    """struct(primary, secondary, confidence, method): normalised; by keywords of the original where nothing is found."""
    # The heads of sections.
    heads = {"primary": "Primary Category", "secondary": "Secondary Categories", "confidence": "Confidence Score"}

    def of(rows: Column) -> Column:
        return let(categories.normalise(F.nullif(_last(rows, "primary", True), F.lit(""))), lambda primary: _categories(rows, primary, original))

    return let(_sections(response, heads, inline), of)


def _categories(rows: Column, primary: Column, original: Column) -> Column:
    items = F.filter(rows, lambda r: (r["section"] == "secondary") & (r["kind"] == "item") & ~F.contains(r["value"], F.lit(":")))
    secondary = F.filter(F.transform(items, lambda r: categories.normalise(strip(F.substr(r["value"], F.lit(3))))), lambda c: c != primary)
    confidence = _number(_last(rows, "confidence", True))

    def result(first: Column, others: Column, score: Column, method: str) -> Column:
        return F.struct(first.alias("primary"), others.alias("secondary"), score.alias("confidence"), F.lit(method).alias("method"))

    fallback = let(categories.by_keywords(original), lambda f: result(f["primary"], f["secondary"], F.try_element_at(f["confidence"], f["primary"]), "keywords"))
    found = lambda others: result(primary, F.slice(others, 1, 5), confidence, "response")
    return let(secondary, lambda others: F.when((primary == "Other") & (F.size(others) == 0), fallback).otherwise(found(others)))


def parse_tags(response: Column, original: Column) -> Column:
    """struct(tags, confidence, method): listed tags, else those between commas, else short lines, else by keywords."""
    return let(_sections(response, {"tags": "Tags", "confidence": "Tag Confidence"}, False), lambda rows: _tags(rows, response, original))


def _tags(rows: Column, response: Column, original: Column) -> Column:
    listed = F.filter(_items(rows, "tags", 1000), lambda t: t != "")
    text = F.coalesce(response, F.lit(""))
    commas = F.filter(F.transform(F.split(text, ","), strip), lambda t: F.length(t) > 2)
    lines = F.transform(F.split(strip(text), "\n"), strip)
    short = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("**")) & ~F.startswith(x, F.lit("-")) & (F.size(F.split(x, r"\s+")) <= 3))
    own = tags.clean(F.when(F.size(listed) > 0, listed).when(F.contains(text, F.lit(",")), commas).otherwise(short))
    scored = F.transform(F.filter(rows, lambda r: (r["section"] == "confidence") & (r["kind"] != "head") & F.contains(r["value"], F.lit(":"))), lambda r: F.struct(strip(F.substring_index(r["value"], ":", 1)).alias("tag"), F.coalesce(F.get(F.split(after_colon(r["value"]), r"\s+"), F.lit(0)).try_cast("double"), F.lit(5.0)).alias("score")))

    def result(final: Column, default: Callable[[Column], Column], method: str) -> Column:
        score = lambda t: F.coalesce(F.try_element_at(F.filter(scored, lambda s: s["tag"] == t), F.lit(-1))["score"], default(t))
        return let(F.slice(final, 1, 15), lambda kept: F.struct(kept.alias("tags"), F.transform(kept, score).alias("confidence"), F.lit(method).alias("method")))

    by_words = result(tags.by_keywords(original), tags.confidence, "keywords")
    return let(own, lambda mine: F.when(F.size(mine) == 0, by_words).otherwise(result(mine, lambda t: F.lit(7.0), "response")))
