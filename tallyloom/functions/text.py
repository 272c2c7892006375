"""Column builders over text and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import domains


def chars(t: Column) -> Column:
    return F.coalesce(F.char_length(t), F.lit(0))


def word_count(t: Column) -> Column:
    """Runs of non-blank characters; 0 for null or blank text."""
    return F.coalesce(F.regexp_count(t, F.lit("\\S+")), F.lit(0))


def compact(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), "\\s+", " "))


def excerpt(t: Column, n: int) -> Column:
    return F.substring(compact(t), 1, n)


def guarded_int(t: Column) -> Column:
    """Integer of plain digits only (a cast alone would take blanks and signs)."""
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))


def normal_code(t: Column) -> Column:
    return F.upper(F.trim(t))


def chapter_key(code: Column, version: Column) -> Column:
    """The part of a code that chapters are ranges of."""
    c = F.replace(F.upper(F.trim(code)), F.lit("."), F.lit(""))
    nine = F.when(F.substring(c, 1, 1).isin("V", "E"), F.substring(c, 1, 1)).when(c.rlike("^[0-9]{3}"), F.substring(c, 1, 3))
    return F.when(version == 10, F.when(c.rlike("^[A-Z][0-9]{2}"), F.substring(c, 1, 3))).when(version == 9, nine)


def chapter(code: Column, version: Column) -> Column:
    key = chapter_key(code, version)
    out = F.lit(None).cast("string")
    for v, first, last, name in reversed(domains.CHAPTERS):
        out = F.when((version == v) & key.between(first, last), name).otherwise(out)
    return F.coalesce(out, F.lit(domains.UNMAPPED))


def first_words(t: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(F.split(F.lower(F.trim(t)), "\\s+"), 1, n), " ")


def escaped(t: Column) -> Column:
    """A phrase as a pattern: special characters escaped, blanks kept, word bounds if it begins and ends in letters or digits."""
    body = F.regexp_replace(t, "([()\\[\\]{}?*+\\-|^$\\\\.&~#\\t\\n\\r\\x0B\\f])", "\\\\$1")
    return F.when(t.rlike("^[\\p{L}\\p{N}](.*[\\p{L}\\p{N}])?$"), F.concat(F.lit("\\b"), body, F.lit("\\b"))).otherwise(body)


def message_content(raw: Column) -> Column:
    """choices[0].message.content of a JSON reply: a string, or the texts of a list joined."""
    at = "$.choices[0].message.content"
    listed = F.from_json(F.get_json_object(raw, at), "array<struct<text:string>>")
    return F.coalesce(F.array_join(F.transform(listed, lambda x: F.coalesce(x["text"], F.lit(""))), ""), F.get_json_object(raw, at))


def json_slice(t: Column) -> Column:
    """Text that parses as JSON: as it is, or from the first { to the last }."""
    a, rest = F.instr(t, "{"), F.instr(F.reverse(t), "}")
    inner = F.when((a > 0) & (rest > 0), F.substring(t, a, F.char_length(t) - rest + 2 - a))
    ok = lambda x: F.get_json_object(x, "$").isNotNull()
    return F.when(ok(t), t).when(ok(inner), inner)


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def cache_key(model: Column, t: Column) -> Column:
    return F.sha2(F.concat(model, F.char(F.lit(0)), t), 256)


def error_class(e: Column) -> Column:
    """Class of an error message; the first rule that fits (names and markers are fixed values)."""
    low = F.lower(e)
    has = low.contains
    return (
        F.when(low.startswith("api_error:"), F.when(has("ratelimit") | has("429"), "api_error.rate_limit").when(has("timeout"), "api_error.timeout").when(has("connection"), "api_error.connection").when(has("budget"), "api_error.budget").otherwise("api_error.other"))
        .when(has("jsondecodeerror"), F.when(has("unterminated"), "parse.json_unterminated").when(has("expecting ',' delimiter"), "parse.json_missing_delimiter").otherwise("parse.json_decode"))
        .when(has("validationerror"), F.when(has("dominant_admission_reason"), "parse.validation_dominant_not_in_tags").when(has("admission_reason_tags") & has("non-empty"), "parse.validation_empty_tags").when(has("literal"), "parse.validation_literal").otherwise("parse.validation_other"))
        .when(has("no response content"), "parse.empty_content")
        .otherwise("parse.other")
    )


def reply_shape(error: Column, raw: Column) -> Column:
    """Shape of a raw reply (names are fixed values)."""
    t = F.trim(raw)
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", F.when(F.lower(error).contains("no response content"), "empty_response").otherwise("no_raw_payload"))
        .when(t.startswith("{") & t.endswith("}"), "json_like")
        .when(t.startswith("{"), "truncated_json_like")
        .when(F.lower(t).contains("```json"), "markdown_fenced_json")
        .otherwise("non_json_text")
    )


def bucket(x: Column, bounds: list[tuple[float, str]], above: str, missing: str = "unknown") -> Column:
    """Name of the first bound that x doesn't exceed."""
    out = F.lit(above)
    for limit, name in reversed(bounds):
        out = F.when(x <= limit, name).otherwise(out)
    return F.when(x.isNull(), missing).otherwise(out)


#: Buckets of input tokens.
TOKEN_BUCKETS = [(4000, "<=4k"), (6000, "4k-6k"), (8000, "6k-8k"), (10000, "8k-10k"), (12000, "10k-12k")]
