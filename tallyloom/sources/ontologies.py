"""Ontology, pathway and annotation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags of a term stanza.
TAG = r"(?m)^{tag}:\s*(.*?)\s*$"
PATHWAY_LINE = r"^(\d{4,5})\s+(.+)$"


def read_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """One blank-line-separated stanza per row, split-parallel."""
    return spark.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("stanza"))


def _one(tag: str) -> Column:
    return F.nullif(F.regexp_extract("stanza", TAG.format(tag=tag), 1), F.lit(""))


def _many(tag: str, pattern: str = r"(.*?)") -> Column:
    return F.regexp_extract_all("stanza", F.lit(rf"(?m)^{tag}:\s*{pattern}\s*(?:!.*)?$"), F.lit(1))


def terms(stanzas: DataFrame) -> DataFrame:
    """Term stanzas as rows; stanzas of other kinds or without an id drop out."""
    rows = stanzas.filter(F.regexp_replace("stanza", r"^\s+", "").startswith("[Term]"))
    quoted = lambda tag: F.regexp_extract("stanza", rf'(?m)^{tag}:\s*"([^"]*)"', 1)
    return rows.select(
        _one("id").alias("id"), _one("name").alias("name"), _one("namespace").alias("namespace"),
        quoted("def").alias("definition"),
        F.regexp_extract_all("stanza", F.lit(r'(?m)^synonym:\s*"([^"]*)"'), F.lit(1)).alias("synonyms"),
        _many("is_a", r"(GO:\d+)").alias("is_a"),
        _many("relationship", r"part_of\s+(GO:\d+)").alias("part_of"),
        _many("relationship", r"(?:positively_|negatively_)?regulates\s+(GO:\d+)").alias("regulates"),
        F.coalesce(_one("is_obsolete") == "true", F.lit(False)).alias("obsolete"),
        _many("alt_id").alias("alt_ids"), _many("subset").alias("subsets"), _many("xref").alias("xrefs"),
    ).filter("id IS NOT NULL")


def read_pathway_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole hierarchy files, one per row; they are a few hundred lines each."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def pathways(files: DataFrame) -> DataFrame:
    """(id, name, class_a, class_b, description) of the C lines.

    The file is cut at its A lines, each piece at its B lines: a pathway takes
    the classes of the pieces it lies in, and a new A has no B until one comes.
    """
    pieces = files.select(F.explode(F.split(F.concat(F.lit("\n"), F.regexp_replace("text", "\r", "")), "\nA")).alias("a"))
    first = lambda c: F.trim(F.split_part(c, F.lit("\n"), F.lit(1)))
    blocks = pieces.select(first("a").alias("class_a"), F.posexplode(F.split("a", "\nB  ")).alias("i", "b"))
    rows = blocks.select("class_a", F.when(F.col("i") > 0, first("b")).otherwise("").alias("class_b"),
                         F.explode(F.regexp_extract_all("b", F.lit(r"(?m)^C    (.*?)\s*$"), F.lit(1))).alias("line"))
    rows = rows.filter(F.col("line").rlike(PATHWAY_LINE))
    name = F.regexp_extract("line", PATHWAY_LINE, 2)
    return rows.select(F.regexp_extract("line", PATHWAY_LINE, 1).alias("id"), name.alias("name"), "class_a", "class_b",
                       F.concat_ws(" > ", "class_a", "class_b", name).alias("description"))


def annotations(lines: DataFrame) -> DataFrame:
    """(term_id, feature) of an annotation file: columns 5 and 3, distinct."""
    cells = lines.filter(~F.col("line").startswith("!")).select(F.split("line", "\t").alias("c")).filter(F.size("c") >= 5)
    return cells.select(F.col("c")[4].alias("term_id"), F.col("c")[2].alias("feature")).filter(
        F.col("term_id").startswith("GO:") & (F.col("feature") != "")).distinct()


def record_features(records: DataFrame) -> DataFrame:
    """(term_id, feature) of flat records: symbols of the GENE section."""
    section = F.regexp_extract("record", r"(?m)^GENE((?:.*\n?)(?: {12}.*\n?)*)", 1)
    symbols = F.regexp_extract_all(section, F.lit(r"(?m)^ *\d+\s+([^;\s]+)"), F.lit(1))
    key = F.regexp_extract("record", r"(?m)^ENTRY\s+\D*(\d+)", 1)
    return records.select(key.alias("term_id"), F.explode(symbols).alias("feature")).filter("term_id <> ''").distinct()


def json_sets(texts: DataFrame, column: str = "text") -> DataFrame:
    """(set_id, feature) of JSON objects that map a set to a list."""
    parsed = F.from_json(column, "map<string,array<string>>")
    return texts.select(F.explode(parsed).alias("set_id", "_f")).select("set_id", F.explode("_f").alias("feature")).distinct()


def bare_pathway_id(text: Column) -> Column:
    """Pathway ids of every spelling reduced to their digits."""
    return F.regexp_extract(text, r"(\d{4,5})$", 1)
