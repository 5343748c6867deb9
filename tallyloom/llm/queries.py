"""One query for each operator over its whole table, with the SQL where SQL can state it."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import codec, language, minhash, mixing, packing, quality, repeats, secret_scan, simhash, toxicity, trie, variants, winnow
from tallyloom.llm.sql import OP11_SQL, OP12_SQL, OP13_SQL
from tallyloom.session import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query("op1_token_files")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    codec.write_tokens(table(spark, folder, "documents"), path, tokenizer_path(), end_id=2)
    return codec.token_digests(spark, path)


@query("op9_packed_sequences")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.document_pieces(table(spark, folder, "documents"), tokenizer_path(), end_id=0, capacity=2048)
    packed = packing.pack(pieces, 2048)

    def digest(batches):
        for batch in batches:
            lengths, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            crcs = [zlib.crc32(np.frombuffer(b, f"<u{len(b) // n}").astype("<u4").tobytes()) for n, b in zip(lengths, ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), pa.array(crcs, pa.int64())],
                                             names=[*batch.schema.names[2:], "length", "ids_crc32"])

    return packed.select("length", "ids", "doc_id", "piece", "start", "sequence_id", "offset").mapInArrow(
        digest, "doc_id long, piece int, start long, sequence_id long, offset long, length long, ids_crc32 long")


@query("op2_simhash_components")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, folder, "documents"), size=3, budget=2)
    return out.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


@query("op3_compression_bands")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


@query("op10_secret_spans")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    out = secret_scan.scan(table(spark, folder, "documents"))
    return out.select(
        "doc_id",
        *(F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind, *_ in secret_scan.BASE),  # noqa: B023
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


@query("op6_source_mixture")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text"), budget_share=1.0,
                      target_entropy_share=0.98, most_passes=4.0)
    return rows.select("row.doc_id", "row.source", "weight", "tokens", "epoch", "block", "place")


@query("op7_repeated_spans")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, folder, "documents"), span=200)


@query("op4_winnowed_prints")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    pairs = winnow.edited_pairs(table(spark, folder, "documents"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        winnow.written(F.col("prints")).alias("fingerprint"),
        winnow.let(F.col("edited_prints"), lambda e: F.struct(
            winnow.written(e).alias("edited_fingerprint"), winnow.likeness(F.col("prints"), e).alias("near_edited"))).alias("edited"),
        winnow.likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    ).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited.*", "near_next")


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = toxicity.training_rows(docs, table(spark, folder, "labels"), lambda doc_id: language.remainder(doc_id, 5) != 0)
    model = toxicity.train([text for text, _ in rows], [label for _, label in rows])
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(language.remainder(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_language_profiles")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    known = language.profiles(docs.where(language.remainder(F.col("doc_id"), 3) != 1))
    return language.identify(docs, known).select(
        "doc_id", F.coalesce(language.remainder(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score")


@query("op11_minhash_components", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


@query("op12_spelling_variants", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


@query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations"))
