"""Quality rules: word and line counts, and bands for zstandard ratios.

Text that says little compresses too well, noise hardly at all.  A document is
compressed whole and in fixed chunks; both ratios (bytes before over bytes
after) must lie in a band that depends on the length, since a frame header
weighs on short texts and a longer window finds more in long ones.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = 3
CHUNK = 2048
#: Chunks shorter than this (only a last one can be) are not judged.
LEAST_CHUNK = 512
#: Least and most ratio of a whole document from so many bytes on.  The lower
#: limits lie close under clean prose (at least 1.7 at 1 KB, 1.9 at 2 KB, 2.1 at
#: 4 KB, 2.3 at 16 KB) and above words of random letters (1.6 to 1.7 from 1 KB)
#: and, from 4 KB, of random hex digits (1.9).
WHOLE_BANDS = ((0, 0.0, 8.0), (128, 0.99, 2.6), (192, 1.12, 2.6), (256, 1.2, 2.8), (512, 1.36, 3.2), (768, 1.46, 3.2), (1024, 1.64, 3.6), (1280, 1.67, 3.6),
               (1536, 1.72, 3.6), (2048, 1.75, 3.8), (4096, 1.92, 4.5),
               (16384, 2.06, 5.5), (1 << 16, 2.17, 6.0), (1 << 18, 2.2, 7.0), (1 << 22, 2.2, 9.0))
#: The same for one chunk; up to this share of a document's judged chunks may lie outside.
CHUNK_BANDS = ((LEAST_CHUNK, 1.25, 3.2), (1024, 1.64, 4.0), (CHUNK, 1.75, 4.0))
CHUNK_SHARE = 0.2
#: Scripts of several bytes a character compress less by the byte: from so many
#: bytes a character on the lower limits are these instead.
WIDE_CHARS = 1.5
WIDE_LEAST = ((0, 0.0), (128, 0.9), (256, 1.1), (512, 1.2), (1024, 1.3), (4096, 1.4))

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
REPEAT_PERCENT = 20
REPEAT_WORDS = 5

REPORT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "ratio double, odd_chunks long, n_chunks long, kept boolean")


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur twice or more."""
    n, k = len(words), REPEAT_WORDS
    if n <= k:
        return 0
    windows = lambda: zip(*(words[i:] for i in range(k)))
    if len(set(windows())) == n - k + 1:
        return 0
    number = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in windows()), np.int64, n - k + 1)
    marks = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    marks[:-k] += np.bincount(starts, minlength=n + 1 - k)
    marks[k:] -= np.bincount(starts, minlength=n + 1 - k)
    return int((np.cumsum(marks) > 0).sum())


@functools.cache
def compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL)


def ratio(data: bytes) -> float:
    return len(data) / len(compressor().compress(data))


def in_band(size: int, value: float, bands, wide: bool = False) -> bool:
    low, high = [(low, high) for least, low, high in bands if size >= least][-1]
    if wide:
        low = [low for least, low in WIDE_LEAST if size >= least][-1]
    return low <= value <= high


def report(text: str | None) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    n_words, repeated = len(words), repeat_words(words)
    failed = n_words < LEAST_WORDS or 100 * repeated > REPEAT_PERCENT * n_words
    whole = ratio(data) if data else 0.0
    chunks = [c for c in (data[i:i + CHUNK] for i in range(0, len(data), CHUNK)) if len(c) >= LEAST_CHUNK]
    wide = len(data) >= WIDE_CHARS * len(text)
    odd = sum(not in_band(len(c), ratio(c), CHUNK_BANDS, wide) for c in chunks)
    return (
        n_words, len(text) - (len(data) - sum(map(len, words))), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated, failed, whole, odd, len(chunks),
        not failed and in_band(len(data), whole, WHOLE_BANDS, wide) and odd <= CHUNK_SHARE * len(chunks),
    )


def quality_report(text: Column) -> Column:
    """Struct of the counts, the whole ratio, the chunks outside their band and the verdict.

    A null text counts as empty: no words, so it fails the base rules.
    """
    names = [field.split()[0] for field in REPORT.split(", ")]

    @F.pandas_udf(REPORT)
    def reports(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([report(t) for t in texts], columns=names)

    return reports(text)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id and the report's columns.  No shuffle."""
    return docs.select(F.col(id_col).alias("id"), quality_report(F.col(text_col)).alias("report")) \
        .select(F.col("id").alias(id_col), "report.*")


def passes(text: Column) -> Column:
    return quality_report(text)["kept"]
