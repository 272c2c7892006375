"""Column builders over labels: normalising, encoding, classifying votes and disagreements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import domains


def tristate(value: Column, collapsed: bool = False) -> Column:
    """Normalised tri-state value; null-like text is null, anything unknown is not documented (collapsed: not yes)."""
    v = F.lower(F.trim(value))
    rest = "not_yes" if collapsed else "not_documented"
    keep = ("yes",) if collapsed else domains.TRISTATE
    return F.when(value.isNull() | v.isin("", "none", "null"), F.lit(None)).when(v.isin(*keep), v).otherwise(F.lit(rest))


def collapse(value: Column) -> Column:
    return F.when(value.isNull(), F.lit(None)).when(value == "yes", "yes").otherwise("not_yes")


def code(value: Column) -> Column:
    """yes 1, no 0, not documented -1, null 2."""
    return F.when(value.isNull(), 2).when(value == "yes", 1).when(value == "no", 0).otherwise(-1)


def field_class(field: Column) -> Column:
    return F.when(field.startswith("admission_reason_tags"), "tag").when(field == "dominant_admission_reason", "dominant").when(field.isin(*domains.ENUMS), "enum").otherwise("tristate")


def vote_pattern(a: Column, b: Column, c: Column) -> Column:
    """struct(pattern, outlier, consensus, odd): which of three raters stands alone, and with what."""
    def odd(pattern: str, who: str, consensus: Column, value: Column) -> Column:
        return F.struct(F.lit(pattern).alias("pattern"), F.lit(who).alias("outlier"), consensus.alias("consensus"), value.alias("odd"))

    none = F.lit(None).cast("string")
    plain = lambda p, v: F.struct(F.lit(p).alias("pattern"), none.alias("outlier"), v.alias("consensus"), none.alias("odd"))
    return (
        F.when(a.eqNullSafe(b) & b.eqNullSafe(c), plain("all_equal", a))
        .when(a.eqNullSafe(b), odd("a=b!=c", "C", a, c))
        .when(a.eqNullSafe(c), odd("a=c!=b", "B", a, b))
        .when(b.eqNullSafe(c), odd("b=c!=a", "A", b, a))
        .otherwise(plain("all_different", none))
    )


def disagreement(left: Column, right: Column) -> Column:
    """Category of a pair of tri-state values."""
    both = F.array_sort(F.array(left, right))
    return (
        F.when(left.isNull() | right.isNull(), "null")
        .when(left == right, "full_agreement")
        .when(both == F.array(F.lit("no"), F.lit("not_documented")), "soft_no_nd")
        .when(both == F.array(F.lit("not_documented"), F.lit("yes")), "soft_yes_nd")
        .otherwise("hard_yes_no")
    )


def collapsed_disagreement(left: Column, right: Column) -> Column:
    a, b = collapse(left), collapse(right)
    return F.when(a.isNull() & b.isNull(), "full_agreement").when(a.isNull() | b.isNull(), "null_disagreement").when(a == b, "full_agreement").otherwise("disagreement")


def confusion_kind(left: Column, right: Column, domain_of: dict[str, str] | None = None) -> Column:
    """Whether two different labels are close: they share a part of their name or a domain."""
    close = F.arrays_overlap(F.split(left, "_"), F.split(right, "_"))
    if domain_of:
        m = F.create_map(*[F.lit(x) for kv in domain_of.items() for x in kv])
        close = close | F.coalesce(m[left] == m[right], F.lit(False))
    return F.when(left == right, "same").when(close, "related").otherwise("unrelated")


def normal_tags(tags: Column, vocabulary: tuple[str, ...] = domains.TAGS) -> Column:
    """Trimmed tags of the vocabulary, each once, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t.isin(*vocabulary)))


def canonical_list(x: Column) -> Column:
    return F.array_sort(F.array_distinct(x))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def problems(c) -> Column:
    """Names of the rules that a structured record breaks (empty: valid). c gives a column by its name."""
    tags, first = c("admission_reason_tags"), c("dominant_admission_reason")
    rules = [
        (tags.isNull() | (F.size(tags) == 0), "empty_tags"),
        (~F.forall(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isin(*domains.TAGS)), "unknown_tag"),
        (first.isNull() | ~F.array_contains(tags, first), "dominant_not_in_tags"),
        (F.coalesce(c("new_meds_started_count") < 0, F.lit(False)) | F.coalesce(c("meds_stopped_count") < 0, F.lit(False)), "negative_count"),
        (F.coalesce(F.char_length(c("primary_diagnosis_text")) > 300, F.lit(True)), "diagnosis_length"),
        (F.coalesce(F.char_length(c("reasoning")) > 2000, F.lit(False)), "reasoning_length"),
        (any_of([c(f).isNull() | ~c(f).isin(*domains.TRISTATE) for f in domains.TRISTATE_FIELDS]), "tristate_literal"),
        (any_of([c(f).isNull() | ~c(f).isin(*v) for f, v in domains.ENUMS.items()]), "enum_literal"),
    ]
    return F.filter(F.array(*[F.when(bad, name) for bad, name in rules]), lambda x: x.isNotNull())
