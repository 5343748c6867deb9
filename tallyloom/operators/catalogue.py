"""Dataset catalogue: derived columns, coverage of analysed runs, next dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.rules import any_hit, mapped

# Words of each disease type in order of precedence, and what
# follows from the type.
DISEASE_WORDS = [
    ("cancer", ["cancer", "carcinoma", "tumor", "tumour", "leukemia", "lymphoma", "melanoma", "glioma"]),
    ("neurodegenerative", ["alzheimer", "parkinson", "huntington", "als ", "amyotrophic", "neurodegenerat"]),
    ("autoimmune", ["lupus", "rheumatoid", "multiple sclerosis", "autoimmune", "sjogren", "psoriasis", "crohn"]),
    ("cardiovascular", ["heart failure", "cardiac", "myocardial", "atherosclerosis", "coronary", "cardiomyopathy"]),
    ("metabolic", ["diabetes", "obesity", "fatty liver", "nafld", "nash", "metabolic syndrome", "kidney", "renal"]),
    ("infection", ["sepsis", "influenza", "tuberculosis", "hiv", "covid", "sars", "bacterial", "viral infection"]),
    ("psychiatric", ["schizophrenia", "depression", "bipolar", "autism", "adhd", "anxiety"]),
    ("respiratory", ["asthma", "copd", "pulmonary", "lung disease", "fibrosis"]),
    ("repair", ["wound healing", "regeneration", "tissue repair"]),
    ("liver", ["cirrhosis", "hepatitis", "liver fibrosis", "hepatocellular"]),
]
STRATEGY_BY_DISEASE = {"cancer": "subtype_comparison", "repair": "time_series"}
SYSTEMS_BY_DISEASE = {
    "cancer": ["System A", "System B"],
    "neurodegenerative": ["System D", "System A"],
    "autoimmune": ["System B", "System A"],
    "cardiovascular": ["System C", "System A", "System D"],
    "metabolic": ["System C", "System D"],
    "infection": ["System B", "System C"],
    "psychiatric": ["System D", "System B"],
    "respiratory": ["System B", "System C"],
    "repair": ["System A", "System B"],
    "liver": ["System C", "System A"],
}
DEFAULT_STRATEGY = "case_control"
DEFAULT_SYSTEMS = ["System A", "System B"]
PRIORITY_TYPES = ["cancer", "neurodegenerative", "metabolic"]
NAME_LENGTH, SHORT_NAME_LENGTH, DESCRIPTION_LENGTH = 120, 40, 300


def platform_list(raw: Column, separator: str = ";") -> Column:
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), separator), lambda x: F.upper(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def bare_platforms(raw: Column) -> Column:
    """``;``-joined platform numbers without their prefix."""
    return F.array_join(F.transform(platform_list(raw), lambda x: F.regexp_replace(x, "^GPL", "")), ";")


def platform_ids(raw: Column, separator: str = ";") -> Column:
    """Platform ids, each with its prefix."""
    return F.transform(platform_list(raw, separator), lambda x: F.when(x.startswith("GPL"), x).otherwise(F.concat(F.lit("GPL"), x)))


def disease_type(title: str, summary: str) -> Column:
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))
    out = F
    for name, words in DISEASE_WORDS:
        out = out.when(any_hit(text, words), name)
    return out.otherwise("other")


def catalogue_rows(entries: DataFrame) -> DataFrame:
    """Entry summaries as catalogue rows."""
    typed = entries.withColumn("disease_type", disease_type("title", "summary"))
    systems = {k: ";".join(v) for k, v in SYSTEMS_BY_DISEASE.items()}
    return typed.select(
        F.col("accession").alias("dataset_id"),
        F.substring("title", 1, NAME_LENGTH).alias("name"),
        F.substring("title", 1, SHORT_NAME_LENGTH).alias("short_name"),
        "disease_type",
        mapped(F.col("disease_type"), STRATEGY_BY_DISEASE, DEFAULT_STRATEGY).alias("expected_strategy"),
        mapped(F.col("disease_type"), systems, ";".join(DEFAULT_SYSTEMS)).alias("expected_systems"),
        F.substring("summary", 1, DESCRIPTION_LENGTH).alias("description"),
        bare_platforms(F.col("gpl")).alias("platform"),
        F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
        F.coalesce("gdstype", F.lit("")).alias("gdstype"),
    )


def system_coverage(runs: DataFrame) -> DataFrame:
    """How often each system led in the finished runs."""
    return runs.select(F.explode("top_systems").alias("system")).groupBy("system").agg(
        F.count(F.lit(1)).alias("runs"))


def next_dataset_scores(catalogue: DataFrame, runs: DataFrame) -> DataFrame:
    """Catalogue rows not yet analysed, scored by what they would add: +3 for a
    new disease type, per expected system +2 if new and +1 if seen once, +1 for
    a priority type.  ``catalogue`` has ``systems``, ``runs`` ``top_systems``."""
    unanalysed = catalogue.join(runs.select("dataset_id"), "dataset_id", "left_anti")
    seen = runs.select("disease_type").filter("disease_type IS NOT NULL").distinct().withColumn("_seen", F.lit(True))
    gain = F.when(F.col("runs").isNull(), 2).when(F.col("runs") < 2, 1).otherwise(0)
    gains = (
        unanalysed.select("dataset_id", F.explode("systems").alias("system"))
        .join(system_coverage(runs), "system", "left")
        .groupBy("dataset_id").agg(F.sum(gain).alias("_gain"))
    )
    score = (
        F.when(F.col("_seen").isNull(), 3).otherwise(0) + F.coalesce("_gain", F.lit(0))
        + F.when(any_hit(F.lower("disease_type"), PRIORITY_TYPES), 1).otherwise(0)
    )
    return unanalysed.join(seen, "disease_type", "left").join(gains, "dataset_id", "left").withColumn(
        "score", score.cast("long")).drop("_seen", "_gain")


def best_dataset(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), "dataset_id").limit(1)


def move_to_archive(catalogue: DataFrame, dataset_id: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """The catalogue without the row, and the row with reason and time stamp."""
    hit = F.trim("dataset_id") == dataset_id
    archived = catalogue.filter(hit).withColumns(
        {"removed_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "remove_reason": F.lit(reason)}
    )
    return catalogue.filter(~hit), archived
