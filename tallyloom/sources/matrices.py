"""Measurement matrices and their sample lines, many files in one scan.

Lines are numbered by file across its splits.  Header and markers are found by
these numbers, and the header, one row per file, is joined back on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.filters import MIN_SAMPLES_MATRIX, NON_EXPRESSION_TYPES, to_number
from tallyloom.functions.rules import any_hit
from tallyloom.operators.joins import small_side
from tallyloom.session import cut

# Markers and line names of the matrix format.
TABLE_BEGIN = "!series_matrix_table_begin"
TABLE_END = "!series_matrix_table_end"
SAMPLE_LINES = {
    "accession": "!Sample_geo_accession",
    "title": "!Sample_title",
    "characteristics": "!Sample_characteristics_ch1",
    "source": "!Sample_source_name_ch1",
}
STUDY_LINES = {"title": "!Series_title", "summary": "!Series_summary", "design": "!Series_overall_design"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files; gzip is read as well.

    ``line_no`` counts a file's lines from 0, however many splits it is read
    in: the lines of each split are counted first, a row for each split, and a
    line's number is its place in its split behind those of the splits before.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), "value")
    splits = cut(raw.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")))
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return raw.join(small_side(placed), ["file", "_start"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def _cells(line: str = "line") -> Column:
    return F.transform(F.split(line, "\t"), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))


def matrix_values(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """(file, feature, sample, value) of the table lines; cells that are no
    number drop out, and with them features that have none.

    The header is whatever line follows the begin marker, in a file without
    one the first line that is no comment; lines behind the end marker are not
    read.  ``lenient`` also drops lines of the wrong width and mends header
    cells that start with ``XGSM``.
    """
    line, at = F.col("line"), F.col("line_no")
    is_row = ~line.startswith("!") & (F.trim(line) != "")
    # written once: markers, header and rows all read it
    lines = cut(lines.filter(is_row | line.startswith(TABLE_BEGIN) | line.startswith(TABLE_END)).select("file", "line_no", "line"))
    marks = lines.groupBy("file").agg(
        F.min(F.when(line.startswith(TABLE_BEGIN), at)).alias("_begin"), F.min(F.when(line.startswith(TABLE_END), at)).alias("_end"))
    inside = lines.filter(is_row).join(small_side(marks), "file").filter(
        (at > F.coalesce("_begin", F.lit(-1))) & (at < F.coalesce("_end", F.lit((1 << 63) - 1)))).drop("_begin", "_end")
    header = inside.groupBy("file").agg(F.min("line_no").alias("_first"), F.min_by("line", "line_no").alias("_h")) \
        .select("file", "_first", _cells("_h").alias("header"))
    if lenient:
        header = header.withColumn("header", F.transform("header", lambda h: F.regexp_replace(h, "^XGSM", "GSM")))
    rows = inside.join(small_side(header), "file").filter(at > F.col("_first")).select("file", "header", _cells().alias("cells"))
    if lenient:
        rows = rows.filter(F.size("cells") == F.size("header"))
    # one struct per cell: position decides the sample
    pairs = F.slice(F.arrays_zip(F.col("header").alias("sample"), F.col("cells").alias("text")), 2, 1 << 30)
    long = rows.select("file", F.col("cells")[0].alias("feature"), F.inline(pairs))
    return to_number(long.filter(F.col("sample").isNotNull()), "feature", "text").select("file", "feature", "sample", "value")


def well_measured(values: DataFrame, samples: DataFrame, share: float = 0.5) -> DataFrame:
    """Features with a value in at least ``share`` of the file's samples.
    ``samples`` is (file, samples)."""
    counts = values.groupBy("file", "feature").agg(F.count("value").alias("_n"))
    kept = counts.join(samples, "file").filter(F.col("_n") >= share * F.col("samples"))
    return values.join(kept.select("file", "feature"), ["file", "feature"], "left_semi")


def sample_lines(lines: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(file, name, line_no, pos, text): one row per sample and header line."""
    names = names or SAMPLE_LINES
    label = F
    for name, prefix in names.items():
        label = label.when(F.col("line").startswith(prefix + "\t"), name)
    named = lines.withColumn("name", label.otherwise(F.lit(None).cast("string"))).filter("name IS NOT NULL")
    return named.select("file", "name", "line_no", F.posexplode(F.slice(_cells(), 2, 1 << 30)).alias("pos", "text"))


def sample_attributes(lines: DataFrame) -> DataFrame:
    """(file, sample, pos, text): characteristics of each sample, turned over
    from attribute lines to samples by position."""
    cells = sample_lines(lines)
    ids = cells.filter("name = 'accession'").select("file", F.col("pos").alias("_at"), F.col("text").alias("sample"))
    items = cells.filter("name = 'characteristics'").select("file", F.col("pos").alias("_at"), F.col("line_no").alias("pos"), "text")
    return items.join(ids, ["file", "_at"]).filter(F.trim("text") != "").drop("_at")


def sample_table(lines: DataFrame) -> DataFrame:
    """(file, sample, title, source) with the sample's name for a missing title."""
    cells = sample_lines(lines)
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("text")))
    wide = cells.filter("name <> 'characteristics'").groupBy("file", "pos").agg(
        at("accession").alias("sample"), at("title").alias("title"), at("source").alias("source"))
    return wide.select("file", "sample", F.coalesce("title", "sample").alias("title"), "source")


def study_texts(lines: DataFrame) -> DataFrame:
    """(file, title, summary, design), repeated lines joined by a space."""
    named = lines.filter(F.col("line").startswith("!Series_"))
    text = lambda prefix: F.array_join(F.array_sort(F.collect_list(
        F.when(F.split_part("line", F.lit("\t"), F.lit(1)) == prefix,
               F.regexp_replace(F.split_part("line", F.lit("\t"), F.lit(2)), '^"|"$', "")))), " ")
    return named.groupBy("file").agg(*[text(p).alias(n) for n, p in STUDY_LINES.items()])


def matrix_verdicts(lines: DataFrame) -> DataFrame:
    """One row per file: whether the matrix is usable, and the first reason
    against it."""
    line, lower = F.col("line"), F.lower("line")
    taxon = line.startswith("!Series_platform_taxid") | line.startswith("!Series_sample_taxid")
    end = lines.groupBy("file").agg(F.min(F.when(line.startswith(TABLE_END), F.col("line_no"))).alias("_end"))
    table_line = ~line.startswith("!") & (F.trim("line") != "") & (F.col("line_no") < F.coalesce("_end", F.lit((1 << 63) - 1)))
    has = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) == 1
    out = lines.join(small_side(end), "file").groupBy("file").agg(
        has(lower.contains(TABLE_BEGIN)).alias("has_table"),
        F.count_if(table_line).alias("table_lines"),
        has(line.contains("SuperSeries")).alias("superseries"),
        has(line.startswith("!Series_type") & any_hit(lower, NON_EXPRESSION_TYPES)).alias("other_type"),
        has(taxon & line.contains("10090")).alias("mouse"),
        F.coalesce(F.max(F.when(line.startswith("!Series_sample_id"), F.size(F.filter(
            F.split(F.regexp_replace(line, '^!Series_sample_id\t|"', ""), "\\s+"), lambda x: x != "")))), F.lit(0)).alias("samples"),
    )
    reason = (
        F.when(F.col("superseries") & ~F.col("has_table"), "superseries_without_table")
        .when(~F.col("has_table"), "no_table").when(F.col("table_lines") <= 1, "empty_table")
        .when(F.col("other_type"), "not_expression").when(F.col("mouse"), "mouse")
        .when(F.col("samples") < MIN_SAMPLES_MATRIX, "too_few_samples").otherwise("ok"))
    return out.withColumn("reason", reason).withColumn("usable", F.col("reason") == "ok")


def positional_samples(columns: DataFrame, lines: DataFrame, group: Column | None = None) -> DataFrame:
    """(file, pos, sample, title, source, group): score columns with what the sample lines of their file say at the same place.

    ``columns (file, pos, sample)`` are the columns of a score table, from 0.
    A place without a line keeps the column's name as its title and ``Unknown``
    as its group; ``group`` is worked out of title and source.
    """
    cells = sample_lines(lines)
    at = lambda name: F.max(F.when(F.col("name") == name, F.nullif(F.trim("text"), F.lit(""))))
    known = cells.filter("name IN ('title', 'source')").groupBy("file", "pos").agg(at("title").alias("title"), at("source").alias("source"))
    joined = columns.select("file", "pos", "sample").join(known, ["file", "pos"], "left")
    return joined.withColumn("group", F.coalesce(group if group is not None else F.lit(None).cast("string"), F.lit("Unknown"))).withColumn(
        "title", F.coalesce("title", "sample")).select("file", "pos", "sample", "title", "source", "group")


def imputed_matrix(lines: DataFrame, vendor: Column) -> DataFrame:
    """(file, feature, sample, value): a matrix read, repeated features averaged, gaps filled with the sample's mean, vendor ids left out.

    ``vendor`` says of a column ``feature`` whether it is one of the vendor's
    own ids; those count for the means no more than for the result.
    """
    values = matrix_values(lines).filter(~vendor).groupBy("file", "feature", "sample").agg(F.avg("value").alias("value"))
    values = cut(values)
    features, samples = (values.select("file", c).distinct() for c in ("feature", "sample"))
    means = values.groupBy("file", "sample").agg(F.avg("value").alias("_mean"))
    # as many rows as the full matrix, which is the result
    return features.join(samples, "file").join(values, ["file", "feature", "sample"], "left").join(means, ["file", "sample"]).select(
        "file", "feature", "sample", F.coalesce("value", "_mean").alias("value"))
