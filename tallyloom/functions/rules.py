"""Rules given as data: first match, value maps, typed attributes, key picks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPECIAL = set(".^$*+?{}[]\\|()")


def hit(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs in a lower-cased text, ignoring case.

    A plain word list entry is a substring search, several times cheaper than a
    regular expression; alternations of plain words become several of them.
    """
    options = pattern.split("|")
    if not SPECIAL & set("".join(options)):
        out = text.contains(options[0].lower())
        for option in options[1:]:
            out = out | text.contains(option.lower())
        return out
    return text.rlike("(?i)" + pattern)


def any_hit(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern occurs, as one alternation (one small expression,
    however long the list is)."""
    plain = lambda p: "".join("\\" + c if c in SPECIAL - set("|") else c for c in p)
    return text.rlike("(?i)(" + "|".join(plain(p) for p in patterns) + ")")


def matched(text: Column, patterns: Sequence[str]) -> Column:
    """The patterns that occur, in their given order."""
    found = [F.when(hit(text, p), F.lit(p)) for p in patterns]
    return F.array_compact(F.array(*found))


def hit_count(text: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(0)
    for pattern in patterns:
        out = out + hit(text, pattern).cast("int")
    return out


def weighted_hits(text: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(0.0)
    for pattern, weight in weights.items():
        out = out + F.when(hit(text, pattern), F.lit(float(weight))).otherwise(0.0)
    return out


def first_rule(text: Column, rules: Sequence[tuple[str, object]], otherwise) -> Column:
    """Label of the first rule whose pattern occurs."""
    out = F
    for pattern, label in rules:
        out = out.when(text.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def first_extract(text: Column, patterns: Sequence[str]) -> Column:
    """First group of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def mapped(value: Column, mapping: Mapping, otherwise) -> Column:
    """Value looked up in a constant map."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(otherwise))


def typed_attributes(attributes: DataFrame, keys: Sequence[str], text: str, rules: Mapping[str, str]) -> DataFrame:
    """One column per rule: the sample's (first in order of text) attribute
    that the rule's pattern names."""
    lower = F.lower(text)
    return attributes.groupBy(*keys).agg(
        *[F.min(F.when(lower.rlike(pattern), F.col(text))).alias(name) for name, pattern in rules.items()]
    )
