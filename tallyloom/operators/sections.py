"""Sections of documents, and text labeling functions over them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..functions import domains, text as texts

#: Fixed value: a section header, alone on its line. UNIX_LINES, so that only \n ends a line.
HEADER = "(?md)^([A-Z][A-Za-z ()/-]{2,60}):\\s*\\n"
WHOLE = "__full_note__"
BLANK = " \t\n\r\x0b\x0c"


def sections(text: Column) -> Column:
    """Map of header to body (stripped; of repeated headers the first); without any header the whole text under WHOLE."""
    t = F.coalesce(text, F.lit(""))
    bodies = F.transform(F.slice(F.split(t, HEADER), 2, 1 << 20), lambda b: F.btrim(b, F.lit(BLANK)))
    found = F.struct(F.regexp_extract_all(t, F.lit(HEADER), F.lit(1)).alias("names"), bodies.alias("bodies"))

    def by_name(x: Column) -> Column:
        body = lambda k: F.get(x["bodies"], (F.array_position(x["names"], k) - 1).cast("int"))
        first = F.map_from_entries(F.transform(F.array_distinct(x["names"]), lambda k: F.struct(k.alias("k"), body(k).alias("v"))))
        return F.when(F.size(x["names"]) > 0, first).otherwise(F.create_map(F.lit(WHOLE), t))

    # a lambda's argument is computed once: the text isn't searched again for each of its headers
    return F.get(F.transform(F.array(found), by_name), F.lit(0))


def section(s: Column, name: str, aliases: dict[str, tuple[str, ...]] = domains.SECTION_ALIASES) -> Column:
    """A section by its canonical name or the first of its other names that is there."""
    return F.coalesce(*[F.try_element_at(s, F.lit(a)) for a in dict.fromkeys((name, *aliases.get(name, ())))])


def coverage(df: DataFrame, column: str = "sections") -> DataFrame:
    """How many documents have each section, and the median length."""
    total = df.select(column).crossJoin(F.broadcast(df.agg(F.count("*").alias("docs"))))  # one row
    g = total.select("docs", F.explode(column).alias("name", "body")).groupBy("name").agg(F.count("*").alias("present"), F.first("docs").alias("docs"), F.median(F.char_length("body")).alias("median_chars"))
    return g.select("name", "present", (F.col("docs") - F.col("present")).alias("absent"), (100.0 * F.col("present") / F.col("docs")).alias("pct"), "median_chars").orderBy(F.desc("present"), "name")


def search_text(s: Column, names: list[str]) -> Column:
    """The whole text of a document without sections, else its named sections, joined; null if there is none of them."""
    found = F.filter(F.array(*[section(s, n) for n in names]), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(s, F.lit(WHOLE)), F.when(F.size(found) > 0, F.array_join(found, "\n---\n")))


def negation_aware(pattern: str, cues: tuple[str, ...] = domains.NEGATION_CUES, window: int = domains.NEGATION_WINDOW) -> str:
    """One pattern for "matches where no cue stands in the `window` characters before": bounded look-behinds. The match itself is
    looked for first, so they are only tried where it begins, not at every character; nothing is consumed."""
    return f"(?isu)(?=(?:{pattern}))" + "".join(f"(?<!{re.escape(c)}.{{0,{window - len(c)}}})" for c in cues)


def matches(text: Column, patterns: list[str]) -> Column:
    """Name of the first pattern with a match that isn't negated."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(text.rlike(negation_aware(p)), F.lit(p)).otherwise(out)
    return out


def near_each_other(text: Column, first: str, second: str, window: int) -> Column:
    """Matches of both patterns whose starts are at most `window` characters apart."""
    a, b = f"(?=(?:{first}))", f"(?=(?:{second}))"
    return text.rlike(f"(?isu)(?:{a}.{{0,{window}}}{b}|{b}.{{0,{window}}}{a})")


def least_window(text: str, patterns: list[str], window: int) -> tuple[int, int] | None:
    """Earliest of the smallest windows of match starts that hold one match of each pattern: a sweep over sorted starts,
    linear in their number."""
    starts = sorted((m.start(), i) for i, p in enumerate(patterns) for m in re.finditer(p, text, re.IGNORECASE))
    last: dict[int, int] = {}
    best = None
    for at, i in starts:
        last[i] = at
        if len(last) == len(patterns):
            lo = min(last.values())
            if at - lo <= window and (best is None or at - lo < best[1] - best[0]):
                best = (lo, at)
    return best


def compound(patterns: list[str], window: int, cues: tuple[str, ...] = domains.NEGATION_CUES, lookback: int = domains.NEGATION_WINDOW):
    """A vectorised function for patterns of any number: the excerpt around the smallest window, null if none or negated there."""

    @pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        def one(t):
            got = least_window(t, patterns, window) if t else None
            if got is None or any(c in t[max(0, got[0] - lookback) : got[0]].lower() for c in cues):
                return None
            return t[max(0, got[0] - 10) : got[1] + 30][:200]

        return texts.map(one)

    return find


def load_patterns(spec: dict) -> dict:
    """Checked regex labeling function: field_name, target_value, regex_patterns; compound_patterns (all_of, window_chars)."""
    missing = [k for k in ("field_name", "target_value", "regex_patterns") if k not in spec]
    if missing:
        raise ValueError(f"pattern file lacks {missing}")
    if not isinstance(spec["regex_patterns"], list) or not all(isinstance(p, str) for p in spec["regex_patterns"]):
        raise ValueError("regex_patterns must be a list of strings")
    for c in spec.get("compound_patterns") or []:
        words, window = c.get("all_of"), c.get("window_chars")
        if not isinstance(words, list) or not words or not all(isinstance(p, str) for p in words) or not isinstance(window, int):
            raise ValueError("a compound pattern needs all_of (strings) and window_chars (a whole number)")
    return {**spec, "compound_patterns": spec.get("compound_patterns") or []}


def vote(text: Column, spec: dict) -> Column:
    """1 if any pattern of a loaded spec fits, -1 otherwise (also without text)."""
    hits = [matches(text, spec["regex_patterns"]).isNotNull()] if spec["regex_patterns"] else []
    hits += [compound(c["all_of"], c["window_chars"])(text).isNotNull() for c in spec["compound_patterns"]]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return F.when(F.coalesce(out, F.lit(False)), 1).otherwise(-1)


def explain(text: Column, spec: dict) -> Column:
    """A vote and its evidence, as struct(vote, evidence): the first pattern that fits, else the first compound one (by its
    description, or its words); no_section without text."""
    said = [(matches(text, [p]).isNotNull(), f"regex match: {p}") for p in spec["regex_patterns"]]
    said += [(compound(c["all_of"], c["window_chars"])(text).isNotNull(), f"compound match: {c.get('description') or c['all_of']}") for c in spec["compound_patterns"]]
    evidence = F.lit(None).cast("string")
    for fits, why in reversed(said):
        evidence = F.when(fits, F.lit(why)).otherwise(evidence)
    evidence = F.when(text.isNull(), "no_section").otherwise(evidence)
    return F.struct(F.when(evidence.isNull() | (evidence == "no_section"), -1).otherwise(1).alias("vote"), evidence.alias("evidence"))


#: Fixed value: what counts as a word of a phrase.
WORD = "[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)*"


def ngrams(phrases: DataFrame, column: str, order: str, least: int = 2, most: int = 5) -> DataFrame:
    """gram (lower case), example (as the first phrase has it), n phrases, length in words: of all n-grams in two phrases or
    more. Phrases are rows; `order` says which comes first."""
    t = phrases.select(F.col(order).alias("at"), F.expr(f"regexp_extract_all(trim(`{column}`), '{WORD}', 0)").alias("w"))
    places = F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(F.col("w"), i + 1, n), " ").alias("x"), n.alias("length")))).otherwise(F.array().cast("array<struct<i:int,x:string,length:int>>"))))
    t = t.select("at", F.explode(places).alias("p")).select("at", "p.*").withColumn("gram", F.lower("x"))
    one = t.groupBy("gram", "at").agg(F.min_by("x", "i").alias("x"), F.first("length").alias("length"))
    return one.groupBy("gram").agg(F.min_by("x", "at").alias("example"), F.count("*").alias("n"), F.first("length").alias("length")).where("n >= 2")


def longest(found: DataFrame) -> DataFrame:
    """n-grams that don't stand within another one (letter by letter: its first word may be the end of a word there, its last
    one the beginning of one). Each n-gram is joined with what may stand in others: no n-gram is compared with all."""
    w = F.split("gram", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w")), lambda k: F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.slice("w", i + 1, k))))
    t = found.select("gram", w.alias("w")).select("gram", F.explode(inner).alias("s"))
    # the ends of the first word, the beginnings of the last
    ends = F.transform(F.sequence(F.lit(1), F.length(F.element_at("s", 1))), lambda i: F.substr(F.element_at("s", 1), i))
    t = t.select("gram", "s", F.explode(ends).alias("a"))
    begins = F.transform(F.sequence(F.lit(1), F.length(F.element_at("s", -1))), lambda i: F.substr(F.element_at("s", -1), F.lit(1), i))
    t = t.select("gram", "s", "a", F.explode(begins).alias("z"))
    parts = t.select("gram", F.array_join(F.concat(F.array("a"), F.slice("s", 2, F.size("s") - 2), F.array("z")), " ").alias("part")).where("part <> gram")
    return found.join(parts.select(F.col("part").alias("gram")), "gram", "left_anti")


def mine_patterns(phrases: DataFrame, column: str, order: str, top: int = 15) -> DataFrame:
    """place, pattern, gram, n: the most frequent n-grams of 2 to 5 words that don't stand in longer ones, as patterns."""
    t = longest(ngrams(phrases, column, order)).orderBy(F.desc("n"), F.desc("length"), "gram").limit(top)
    place = F.row_number().over(Window.orderBy(F.desc("n"), F.desc("length"), "gram"))  # of `top` rows
    return t.select(place.alias("place"), texts.escaped(F.col("example")).alias("pattern"), "gram", "n")
