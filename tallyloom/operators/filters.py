"""Ordered rejection rules, identifier profiles and keyword filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.rules import any_hit
from tallyloom.operators.ordering import top_rows

# What makes a catalogue entry usable.
VALID_TYPES = [
    "expression profiling by array",
    "expression profiling by high throughput sequencing",
    "expression profiling by genome tiling array",
]
INVALID_TYPES = [
    "genome binding", "occupancy profiling", "chip-seq", "chip seq", "atac-seq", "atac seq",
    "methylation profiling", "bisulfite", "hi-c", "cut&run", "cut&tag", "snp genotyping", "cnv",
    "non-coding rna profiling",
]
TITLE_KEYWORDS = [
    "disease", "cancer", "syndrome", "alzheimer", "parkinson", "diabetes", "autoimmune", "infection",
]
EXCLUDED_KEYWORDS = [
    "mirna", "micro rna", "micro-rna", "microrna", "non-coding", "non coding", "lncrna", "long non-coding",
]
NON_EXPRESSION_TYPES = [
    "chip-seq", "atac-seq", "chip seq", "genome binding", "occupancy profiling", "hi-c", "cut&run",
    "cut&tag", "bisulfite", "methylation", "snp array", "cnv",
]
MIN_SAMPLES = 20
MIN_SAMPLES_SINGLE = 10
MIN_SAMPLES_MATRIX = 6
PLACEHOLDERS = ["", "---", "null", "nan"]
LOW_INFORMATION = ["coding", "multiple_complex", "multiple", "complex", "control", "main"]

# Identifier families.
SYMBOL_ID = r"^[A-Za-z][A-Za-z0-9._-]{1,24}$"
ENSEMBL_ID = r"^ENS[A-Z]*G\d+(\.\d+)?$"
REFSEQ_ID = r"^[NXYWZ][MR]_\d+(\.\d+)?$"
PROBE_PREFIXES = ["ILMN_", "AFFX", "A_", "cg", "TC"]
PROBE_IDS = [
    r"^\d+$", r"[|:]", r"^[A-Za-z]{1,4}\d{5,}$", r"(?i)_(at|s_at|x_at|st)$", r"(?i)^HTA\d+-",
    r"(?i)^TC\d+\..*hg\.\d+$", r"(?i)^TSUnmapped\d+",
]
PROBE_MARKS = [r"(?i)_(at|s_at|x_at|st)$", r"(?i)^TC\d+\..*hg\.\d+$", r"(?i)^TSUnmapped\d+", r"[|:]"]


def first_failing(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds against the row, null when none does."""
    out = F
    for reason, fails in rules:
        out = out.when(F.coalesce(fails, F.lit(True)), reason)
    return out.otherwise(F.lit(None).cast("string"))


def catalogue_rules(least_samples: int = MIN_SAMPLES) -> list[tuple[str, Column]]:
    kind = F.lower("gdstype")
    return [
        ("entry_type", (F.upper("entrytype") != "GSE") | ~F.col("accession").startswith("GSE")),
        ("organism", ~F.lower("taxon").contains("homo sapiens")),
        ("data_type", any_hit(kind, INVALID_TYPES) | ~any_hit(kind, VALID_TYPES)),
        ("too_few_samples", F.col("n_samples") < least_samples),
        ("superseries", F.col("subseries") > 0),
    ]


def single_entry_rules() -> list[tuple[str, Column]]:
    """The laxer rules for one entry looked up by name."""
    kind = F.lower("gdstype")
    taxon = F.coalesce(F.lower("taxon"), F.lit(""))
    return [
        ("organism", (taxon != "") & ~taxon.contains("homo sapiens")),
        ("data_type", any_hit(kind, INVALID_TYPES) | ~any_hit(kind, VALID_TYPES)),
        ("too_few_samples", F.col("n_samples") < MIN_SAMPLES_SINGLE),
        ("superseries", (F.col("subseries") > 0) & (F.col("n_samples") == 0)),
    ]


def has_keyword(title: str, summary: str, words: Sequence[str]) -> Column:
    return any_hit(F.lower(F.concat_ws(" ", title, summary)), words)


def refresh_rules(least_samples: int = MIN_SAMPLES) -> list[tuple[str, Column]]:
    """Cascade of a catalogue refresh; each entry is counted at its first failure."""
    invalid = F.lit(False)
    for _, fails in catalogue_rules(least_samples):
        invalid = invalid | F.coalesce(fails, F.lit(True))
    return [
        ("invalid_metadata", invalid),
        ("excluded_keywords", has_keyword("title", "summary", EXCLUDED_KEYWORDS)),
        ("non_disease_text", ~has_keyword("title", "summary", TITLE_KEYWORDS)),
        ("missing_matrix", ~F.col("has_matrix")),
        ("platform_unavailable", ~F.col("has_platform")),
    ]


def rejection_counts(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    reason = F.coalesce(first_failing(rules), F.lit("accepted"))
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def useful_symbols(mapping: DataFrame, symbol: str) -> DataFrame:
    """Rows whose symbol is neither a placeholder nor a low-information label."""
    word = F.lower(F.trim(symbol))
    return mapping.filter(
        F.col(symbol).isNotNull() & ~word.isin(PLACEHOLDERS) & ~word.isin(LOW_INFORMATION)
    )


def to_number(values: DataFrame, feature: str, text: str, value: str = "value") -> DataFrame:
    """Text cells as numbers; cells that are none, and so features that have
    none, drop out of the long table."""
    number = F.expr(f"try_cast(trim(`{text}`) AS double)")
    return values.withColumn(value, number).drop(text).filter(
        F.col(value).isNotNull() & ~F.isnan(value)
    ) if text != value else values.withColumn(value, number).filter(
        F.col(value).isNotNull() & ~F.isnan(value)
    )


def probe_like(feature: Column) -> Column:
    out = F.lit(False)
    for prefix in PROBE_PREFIXES:
        out = out | feature.startswith(prefix)
    for pattern in PROBE_IDS:
        out = out | feature.rlike(pattern)
    return out


def probe_marked(feature: Column) -> Column:
    """The stricter test that forces a mapping."""
    out = F.lit(False)
    for prefix in [*PROBE_PREFIXES, "HTA"]:
        out = out | feature.startswith(prefix)
    for pattern in PROBE_MARKS:
        out = out | feature.rlike(pattern)
    return out


def identifier_profile(features: DataFrame, feature: str = "feature", by: Sequence[str] = ()) -> DataFrame:
    """Shares of the identifier families over all features, and the kind they
    make: ``probe``, ``gene`` or ``unknown``."""
    ids = features.select(*by, F.trim(F.col(feature).cast("string")).alias("_id")).filter("_id <> ''").distinct()
    share = lambda condition: F.avg(condition.cast("double"))
    out = ids.groupBy(*by).agg(
        F.count(F.lit(1)).alias("ids"),
        share(F.col("_id").rlike(SYMBOL_ID)).alias("symbol"),
        share(F.col("_id").rlike(ENSEMBL_ID)).alias("ensembl"),
        share(F.col("_id").rlike(REFSEQ_ID)).alias("refseq"),
        share(probe_like(F.col("_id"))).alias("probe"),
        share(probe_marked(F.col("_id"))).alias("marked"),
    )
    gene = F.greatest("symbol", "ensembl", "refseq")
    kind = (
        F.when(F.col("probe") >= 0.10, "probe")
        .when(gene >= 0.6, "gene")
        .when(F.col("probe") >= 0.05, "probe")
        .otherwise("unknown")
    )
    return out.withColumn("kind", kind)


def mapping_decision(profile: DataFrame, has_platform: Column) -> DataFrame:
    """``map``, ``keep`` or ``stop``: gene-level identifiers are kept unless a
    notable share is marked as probes."""
    forced = (F.col("kind") == "gene") & (F.col("marked") >= 0.08)
    decision = (
        F.when(forced & has_platform, "map").when(forced, "stop")
        .when(F.col("kind") == "gene", "keep").when(has_platform, "map").otherwise("stop")
    )
    return profile.withColumn("decision", decision)


def filter_with_counts(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows no rule rejects, and the count per first rejecting rule."""
    reason = first_failing([(name, F.coalesce(c, F.lit(False))) for name, c in rules])
    tagged = rows.withColumn("_reason", reason)
    return tagged.filter("_reason IS NULL").drop("_reason"), tagged.groupBy(
        F.coalesce("_reason", F.lit("kept")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("n"))


def pathway_filter(rows: DataFrame, class_a: Sequence[str] | None = None, class_b: Sequence[str] | None = None,
                   include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    out = rows
    if class_a:
        out = out.filter(F.col("class_a").isin(list(class_a)))
    if class_b:
        out = out.filter(F.col("class_b").isin(list(class_b)))
    if include:
        out = out.filter(F.col("name").rlike("(?i)(" + "|".join(include) + ")"))
    if exclude:
        out = out.filter(~F.col("name").rlike("(?i)(" + "|".join(exclude) + ")"))
    return out


def search(rows: DataFrame, text: str, fields: Sequence[str]) -> DataFrame:
    """Rows where any of the fields contains the text, ignoring case."""
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.coalesce(F.lower(field).contains(text.lower()), F.lit(False))
    return rows.filter(hit)


def sized_sets(members: DataFrame, least: int = 5, most: int | None = None) -> DataFrame:
    sizes = members.groupBy("set_id").agg(F.count_distinct("feature").alias("size"))
    kept = sizes.filter(F.col("size") >= least)
    return kept if most is None else kept.filter(F.col("size") <= most)


def focus_sets(ranked: DataFrame, n: int = 16) -> DataFrame:
    """First ``n`` distinct sets over lists given in order: ``ranked`` is
    (set_id, list_no, place); a set counts where it first appears."""
    first = ranked.groupBy("set_id").agg(F.min(F.struct("list_no", "place")).alias("_at"))
    return first.orderBy("_at", "set_id").limit(n).select("set_id", "_at.list_no", "_at.place")


def confident_examples(rows: DataFrame, group: Sequence[str], confidence: str, key: str,
                       least: float = 0.9, n: int = 3) -> DataFrame:
    sure = rows.filter(F.col(confidence) >= least)
    return top_rows(sure, group, [F.col(confidence).desc(), F.col(key)], n)


def column_report(rows: DataFrame, required: dict[str, str], key: str) -> DataFrame:
    """One row per required column: present, of the wanted kind, nulls, and for
    the key the surplus of rows over distinct keys; verdict PASS or FAIL.

    ``required`` maps a column to ``number`` or ``text``.
    """
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    types = dict(rows.dtypes)
    parts = []
    for name, kind in required.items():
        present = name in types
        fits = present and ((types[name] in numeric or types[name].startswith("decimal")) == (kind == "number"))
        nulls = F.count_if(F.col(name).isNull()) if present else F.lit(0).cast("long")
        extra = F.count(F.lit(1)) - F.count_distinct(key) if present and name == key else F.lit(0).cast("long")
        parts.append(F.struct(F.lit(name).alias("column"), F.lit(present).alias("present"),
                              F.lit(bool(fits)).alias("fits"), nulls.alias("nulls"), extra.alias("duplicates")))
    out = rows.agg(F.array(*parts).alias("_c")).select(F.inline("_c"))
    good = F.col("present") & F.col("fits") & (F.col("duplicates") == 0)
    return out.withColumn("verdict", F.when(good, "PASS").otherwise("FAIL"))


# The words of the immune pathways, the class of metabolism, results that are none.
IMMUNE_WORDS = [
    "immune", "immunity", "immunodeficiency", "complement", "antigen", "antibody", "cytokine", "chemokine",
    "toll-like", "nf-kappa", "inflammatory",
]
METABOLISM = "Metabolism"
NO_SYSTEM = ["unclassified", "general"]


def metabolism_pathways(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("class_a") == METABOLISM)


def immune_pathways(rows: DataFrame) -> DataFrame:
    """Pathways whose name or class b has an immune word."""
    return rows.filter(any_hit(F.lower(F.concat_ws(" ", "name", "class_b")), IMMUNE_WORDS))


def is_obsolete() -> Column:
    """Entry whose name or definition says so."""
    return F.lower(F.concat_ws(" ", "name", "definition")).contains("obsolete")


def is_unclassified(kind: str = "kind") -> Column:
    return F.lower(kind).isin(NO_SYSTEM)


def has_polarity(polarity: str = "polarity") -> Column:
    return F.col(polarity).isNotNull()
