"""Column functions over a sample's free-text attributes.

A sample's attributes are an ordered array of texts (``items``), most of them
``key: value`` or ``key = value``.  Everything here is a Spark expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key names and words that decide how a sample is read.
GROUP_KEYS = ("group", "condition", "status", "phenotype", "diagnosis")
SUBTYPE_KEYS = ("subtype", "cluster", "phenotype", "class", "group")
TIME_KEYS = ("time", "timepoint", "day", "hour", "week", "month")
TRAIT_KEYS = ("age", "bmi", "score", "hba1c", "crp", "esr", "nihss", "mmse", "severity")
PAIR_KEYS = ("pair_id", "patient_id", "subject")
PHASE_KEYS = ("phase", "condition", "timepoint")
RESPONSE_KEYS = ("response", "responder", "outcome")
SEVERITY_KEYS = ("severity", "stage", "grade")
CONTROL_WORDS = ("control", "healthy", "normal", "wt", "wild type")
DISEASE_WORDS = ("disease", "patient", "tumor", "case")
PRE_WORDS = ("pre", "before", "baseline")
POST_WORDS = ("post", "after", "followup", "follow-up")
RESPONDER_WORDS = ("responder", "response", "sensitive", "remission")
NON_RESPONDER_WORDS = ("non-responder", "refractory", "resistant", "progression")
LABEL_LENGTH = 40
DAYS_PER_UNIT = {"h": 1 / 24.0, "d": 1.0, "wk": 7.0, "week": 7.0, "mo": 30.0}

NUMBER = r"(-?[0-9]+(\.[0-9]+)?)"
TIME = NUMBER + r"\s*(h|d|wk|week|mo)?"


def any_word(text: Column, words: Sequence[str], loose: bool = False) -> Column:
    """Whether a word occurs; whole words (plural allowed) unless ``loose``."""
    if loose:
        return text.rlike("(" + "|".join(words) + ")")
    return text.rlike(r"\b(" + "|".join(words) + r")s?\b")


def any_tag(text: Column, tags: Sequence[str]) -> Column:
    return text.rlike("(" + "|".join(tags) + ")")


def sample_items(attributes: DataFrame, keys: Sequence[str], order: str = "pos", text: str = "text") -> DataFrame:
    """Attribute rows turned over: one row per sample with its ordered items.

    A sample has as many items as its file has attribute lines.
    """
    packed = attributes.filter(F.col(text).isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(order, text))).alias("_items")
    )
    return packed.select(*keys, F.transform("_items", lambda e: e[text]).alias("items"))


def key_values(items: Column) -> Column:
    """``[{key, value}]`` of the items, split at the first ``:``, else ``=``."""
    def split(text: Column) -> Column:
        mark = F.when(text.contains(":"), F.lit(":")).when(text.contains("="), F.lit("="))
        at = F.instr(text, mark)
        return F.struct(
            F.lower(F.trim(F.substring(text, F.lit(1), at - 1))).alias("key"),
            F.trim(F.substring(text, at + 1, F.length(text))).alias("value"),
            mark.isNotNull().alias("split"),
        )
    return F.filter(F.transform(items, lambda t: split(F.trim(t))), lambda e: e["split"])


def value_of(kv: Column, key: Column) -> Column:
    """Value of a key, the last one on repeats; empty counts as missing."""
    hits = F.filter(kv, lambda e: e["key"] == key)
    return F.nullif(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))


def first_value(kv: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[value_of(kv, F.lit(k)) for k in keys])


def merged(items: Column) -> Column:
    return F.array_join(items, " ")


def number_in(text: Column) -> Column:
    """First signed decimal number of the text."""
    return F.regexp_extract(text, NUMBER, 1).try_cast("double")


def days_in(text: Column) -> Column:
    """First number of the text with its unit, in days; no unit means days."""
    lower = F.lower(text)
    unit = F.regexp_extract(lower, TIME, 3)
    factor = F.lit(1.0)
    for name, days in DAYS_PER_UNIT.items():
        factor = F.when(unit == name, F.lit(days)).otherwise(factor)
    return F.regexp_extract(lower, TIME, 1).try_cast("double") * factor


def unit_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), TIME, 3), F.lit(""))


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(text), r"\s+", "_"), 1, LABEL_LENGTH)


def group_label(text: Column, loose: bool = False) -> Column:
    lower = F.lower(text)
    return (
        F.when(any_word(lower, CONTROL_WORDS, loose), "control")
        .when(any_word(lower, DISEASE_WORDS, loose), "disease")
        .when(F.length(lower) > 0, slug(lower))
        .otherwise("unknown")
    )


def sample_group(items: Column, kv: Column, loose: bool = False) -> Column:
    return group_label(F.coalesce(first_value(kv, GROUP_KEYS), merged(items)), loose)


def sample_subtype(kv: Column) -> Column:
    named = F.try_element_at(F.filter(kv, lambda e: any_tag(e["key"], SUBTYPE_KEYS)), F.lit(1))["key"]
    return F.coalesce(slug(value_of(kv, named)), F.lit("unknown"))


def sample_days(items: Column, kv: Column) -> Column:
    timed = F.filter(kv, lambda e: any_tag(e["key"], TIME_KEYS))
    found = F.filter(F.transform(timed, lambda e: days_in(e["value"])), lambda d: d.isNotNull())
    text = merged(items)
    worded = F.lower(text).rlike(r"\b(time|day|hour|week|month)\b")
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.when(worded, days_in(text)))


def sample_trait(items: Column, kv: Column, trait: str) -> Column:
    """Number behind the first key that names the trait, else the first number
    of a text that mentions it."""
    keyed = F.try_element_at(F.filter(kv, lambda e: e["key"].contains(trait)), F.lit(1))["value"]
    text = F.lower(merged(items))
    return F.coalesce(number_in(keyed), F.when(text.contains(trait), number_in(text)))


def sample_severity(items: Column, kv: Column) -> Column:
    """Number behind a severity key; other texts count only when they mention one."""
    keyed = F.try_element_at(F.filter(kv, lambda e: any_tag(e["key"], SEVERITY_KEYS)), F.lit(1))["value"]
    text = F.lower(merged(items))
    return number_in(F.coalesce(keyed, F.when(any_tag(text, SEVERITY_KEYS), text)))


def sample_phase(kv: Column) -> Column:
    text = F.lower(first_value(kv, PHASE_KEYS))
    return F.when(any_tag(text, PRE_WORDS), "pre").when(any_tag(text, POST_WORDS), "post").otherwise(text)


def sample_response(kv: Column) -> Column:
    """The negative words are asked first, as they contain the positive ones."""
    text = F.lower(first_value(kv, RESPONSE_KEYS))
    return (
        F.when(any_tag(text, NON_RESPONDER_WORDS), "non_responder")
        .when(any_tag(text, RESPONDER_WORDS), "responder")
        .otherwise("unknown")
    )


def sample_design(samples: DataFrame) -> DataFrame:
    """All design columns of each sample from its ``items``."""
    kv = samples.withColumn("_kv", key_values(F.col("items")))
    items, pairs = F.col("items"), F.col("_kv")
    return kv.withColumns(
        {
            "group": sample_group(items, pairs),
            "subtype": sample_subtype(pairs),
            "days": sample_days(items, pairs),
            "traits": F.array(
                *[F.struct(F.lit(i).alias("priority"), F.lit(t).alias("trait"),
                           sample_trait(items, pairs, t).alias("value")) for i, t in enumerate(TRAIT_KEYS)]
            ),
            "pair": first_value(pairs, PAIR_KEYS),
            "phase": sample_phase(pairs),
            "response": sample_response(pairs),
            "severity": sample_severity(items, pairs),
        }
    ).drop("_kv", "items")
