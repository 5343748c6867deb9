"""Feature annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.rules import first_extract
from tallyloom.operators.joins import small_side
from tallyloom.session import cut

# Forms in which a symbol stands in a free-text annotation.
SYMBOL_FORMS = [
    r"Homo sapiens [^(]+\(([A-Za-z0-9\-]+)\),",
    r"\(([A-Za-z0-9\-]+)\)\[gene_biotype:",
    r"\b([A-Z0-9\-]{2,15}) \[Source:HGNC Symbol;Acc:HGNC:",
]
PLAIN_SYMBOL = r"^[A-Za-z][A-Za-z0-9._-]{1,24}$"


def symbol_in(text: Column) -> Column:
    """Symbol named in an annotation text, the text itself when it is one, else ''."""
    plain = F.trim(text)
    return F.coalesce(first_extract(text, SYMBOL_FORMS), F.when(plain.rlike(PLAIN_SYMBOL), plain), F.lit(""))


# Column names by which a platform table is read.
ID_COLUMNS = ["ID", "PROBE_ID", "PROBEID"]
SYMBOL_COLUMNS = [
    "Gene Symbol", "GENE_SYMBOL", "Gene_Symbol", "Symbol", "SYMBOL", "gene_symbol", "Gene", "GENE",
    "gene_assignment", "Gene Assignment", "GENE_ASSIGNMENT",
]
ILLUMINA_SYMBOL_COLUMNS = ["ILMN_Gene", "Symbol", "SYMBOL", "Gene Symbol"]
SPOT_COLUMN = "SPOT_ID"
PLATFORM_BEGIN, PLATFORM_END = "!platform_table_begin", "!platform_table_end"
# What the contents of a column must look like, and how often.
ENSEMBL_START = "^ENS[A-Z]*G"
SHORT_LABEL = r"^[A-Za-z0-9][A-Za-z0-9._-]{1,19}$"
NUMBER = r"^\d+(\.\d+)?$"
SPOT_LABELS = ["coding", "multiple_complex", "multiple", "complex", "control", "main", "antisense", "sense"]
MOST, NEARLY_ALL, LEAST_UNIQUE, MOST_LABELS = 0.6, 0.9, 0.15, 0.3
SEPARATORS = ["///", "//", ";", ",", "|"]


def platform_tables(lines: DataFrame) -> DataFrame:
    """(file, header, cells): the rows of each file's platform table, many files in one scan.

    A table stands between its markers by line number; a file without markers
    is one table, comments left out.  Short rows are padded with empty cells,
    rows longer than the header drop out.
    """
    named = lines if "file" in lines.columns else lines.withColumn("file", F.lit(""))
    line, at = F.col("line"), F.col("line_no")
    marks = named.groupBy("file").agg(
        F.min(F.when(line.startswith(PLATFORM_BEGIN), at)).alias("_begin"), F.min(F.when(line.startswith(PLATFORM_END), at)).alias("_end"))
    inside = named.filter(~line.rlike("^[!#^]") & (F.trim(line) != "")).join(small_side(marks), "file").filter(
        (at > F.coalesce("_begin", F.lit(-1))) & (at < F.coalesce("_end", F.lit((1 << 63) - 1))))
    heads = inside.groupBy("file").agg(F.min("line_no").alias("_first"), F.split(F.min_by("line", "line_no"), "\t").alias("header"))
    rows = inside.join(small_side(heads), "file").filter(at > F.col("_first")).select("file", "header", F.split("line", "\t").alias("cells"))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.size("header") - F.size("cells")))
    return rows.filter(F.size("cells") <= F.size("header")).withColumn("cells", padded)


def cell(name: Column) -> Column:
    """Cell of a row under a header word; null if the header lacks it."""
    return F.get("cells", (F.array_position("header", name) - 1).cast("int"))


def header_word(words: list[str]) -> Column:
    """First of ``words`` that the header has."""
    return F.coalesce(*[F.when(F.array_contains("header", w), w) for w in words])


def symbol_columns(rows: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """(file, key, symbol, texts) of ``platform_tables`` rows: which header words name the identifier and the symbol.

    A known name, a name with ``gene`` in it, or the spot column where its
    contents look like symbols, by one profile of each file's whole table.
    ``symbol`` is null if there is none; ``texts`` is then the free-text column
    with the longest texts.
    """
    key = F.coalesce(F.get(F.filter("header", lambda h: F.upper(h).isin(ID_COLUMNS)), 0), F.col("header")[0])
    known = F.coalesce(header_word(candidates or SYMBOL_COLUMNS), F.get(F.filter("header", lambda h: F.contains(F.lower(h), F.lit("gene"))), 0))
    free = F.filter("header", lambda h: F.upper(h).startswith(SPOT_COLUMN) | F.lower(h).contains("description") | F.lower(h).contains("transcript"))
    spot, share = cell(F.lit(SPOT_COLUMN)), lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    marked = rows.withColumns({"_key": key, "_known": known, "_free": free})
    profile = marked.groupBy("file").agg(
        F.first("_key").alias("key"), F.first("_known").alias("known"), F.first("_free").alias("free"),
        share(cell(F.col("_key")).rlike(ENSEMBL_START)).alias("id_ensembl"), share(cell(F.col("_known")).rlike(ENSEMBL_START)).alias("known_ensembl"),
        share(spot.rlike(SHORT_LABEL)).alias("spot_short"), share(spot.rlike(PLAIN_SYMBOL)).alias("spot_symbol"),
        share(~spot.rlike(NUMBER)).alias("spot_text"), F.coalesce(F.try_divide(F.count_distinct(spot), F.count(F.lit(1))), F.lit(0.0)).alias("spot_unique"),
        share(F.lower(spot).isin(SPOT_LABELS)).alias("spot_labels"))
    lengths = marked.select("file", F.explode("_free").alias("_word"), "header", "cells").groupBy("file", "_word").agg(
        F.avg(F.length(cell(F.col("_word")))).alias("_length")).groupBy("file").agg(F.max_by("_word", F.struct("_length", "_word")).alias("texts"))
    by_ensembl = (F.col("id_ensembl") > MOST) & (F.col("spot_short") > MOST) & (F.col("known").isNull() | (F.col("known_ensembl") > MOST))
    by_looks = (F.col("known").isNull() & (F.col("spot_symbol") > MOST) & (F.col("spot_text") > NEARLY_ALL) & (F.col("spot_unique") > LEAST_UNIQUE)
                & (F.col("spot_labels") < MOST_LABELS))
    symbol = F.when(by_ensembl | by_looks, SPOT_COLUMN).otherwise(F.col("known"))
    return profile.join(lengths, "file", "left").select("file", "key", symbol.alias("symbol"), "texts")


def _usable(free_text: bool) -> Column:
    return F.col("symbol").isNotNull() | (F.col("texts").isNotNull() if free_text else F.lit(False))


def _placed(lines: DataFrame, candidates: list[str] | None, free_text: bool) -> DataFrame:
    """Rows of the files that have a symbol column; the others are named by ``platform_verdicts``."""
    rows = platform_tables(lines)
    chosen = cut(symbol_columns(rows, candidates))  # one row for each file
    counts = chosen.agg(F.count(F.lit(1)).alias("n"), F.count_if(_usable(free_text)).alias("usable")).first()
    if not counts["n"]:
        raise ValueError("no platform table found")
    if not counts["usable"]:
        raise ValueError(f"no symbol column in any of {counts['n']} platform tables")
    return rows.join(small_side(chosen.filter(_usable(free_text))), "file")


def platform_verdicts(lines: DataFrame, candidates: list[str] | None = None, free_text: bool = True) -> DataFrame:
    """(file, key, symbol, texts, usable, reason): how each file with lines would be read, and why one is left out."""
    named = lines if "file" in lines.columns else lines.withColumn("file", F.lit(""))
    chosen = symbol_columns(platform_tables(lines), candidates)
    known = named.select("file").distinct().join(chosen.withColumn("_table", F.lit(True)), "file", "left")
    reason = F.when(F.col("_table").isNull(), "no_table").when(~_usable(free_text), "no_symbol_column").otherwise("ok")
    return known.withColumn("reason", reason).withColumn("usable", F.col("reason") == "ok").select("file", "key", "symbol", "texts", "usable", "reason")


def _own_columns(out: DataFrame, lines: DataFrame) -> DataFrame:
    return out if "file" in lines.columns else out.drop("file")


def platform_map(lines: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """(file, feature, target): first symbol of each annotated feature, file by
    file (no ``file`` where the lines have none)."""
    from tallyloom.operators.filters import useful_symbols

    rows = _placed(lines, candidates, free_text=True)
    named = F.trim(F.split_part(F.split_part(cell(F.col("symbol")), F.lit("///"), F.lit(1)), F.lit("//"), F.lit(1)))
    target = F.when(F.col("symbol").isNotNull(), named).otherwise(symbol_in(cell(F.col("texts"))))
    return _own_columns(useful_symbols(rows.select("file", cell(F.col("key")).alias("feature"), target.alias("target")), "target"), lines)


def all_symbols(text: Column) -> Column:
    """Every symbol of a cell, split at the first kind of separator present."""
    split = F
    for mark in SEPARATORS:
        split = split.when(text.contains(mark), F.split(text, "\\Q" + mark + "\\E"))
    parts = F.transform(split.otherwise(F.array(text)), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (s != "") & (s != "---"))


def platform_map_all(lines: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """(file, feature, targets): all symbols of each feature as an array."""
    rows = _placed(lines, candidates, free_text=False)
    out = rows.select("file", cell(F.col("key")).alias("feature"), all_symbols(cell(F.col("symbol"))).alias("targets"))
    return _own_columns(out.filter(F.size("targets") > 0), lines)
