"""Each operator over its whole table, with production parameters; columns that check results are derived here."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import sql
from voxlake.llm.bpe import decoded, encoded
from voxlake.llm.collocations import collocations
from voxlake.llm.cotraining import quality_scores
from voxlake.llm.decontaminate import contamination
from voxlake.llm.fingerprints import fingerprints
from voxlake.llm.hard_negatives import hard_negatives
from voxlake.llm.html_text import fit as fit_labeller
from voxlake.llm.html_text import main_text
from voxlake.llm.language import fit, fold, identify
from voxlake.llm.near_dedup import near_duplicates
from voxlake.llm.packing import packed
from voxlake.llm.shards import shuffled_shards
from voxlake.llm.suffix_dedup import without_repeats
from voxlake.llm.warc import read_archives, write_archives
from voxlake.session import checkpoint_ready

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document shares with the benchmark, and a digest of the items."""
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of two-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards, with a checksum of the text that arrived there."""
    placed = shuffled_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", SHARDS)
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        "grown_shard",
    )


def op4_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when repeated strings are removed."""
    return without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, edited and not, and how near they are."""
    return fingerprints(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents, with a checksum of their ids."""
    return packed(_table(spark, sf_dir, "documents"), word_tokenizer()).select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three of four folds."""
    docs = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) == 2
    found = identify(docs.select("doc_id", "text"), fit(docs.where(~held_out)), keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives in the shared folder, as read back from them."""
    pages = _table(spark, sf_dir, "pages")
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"
    kind = pages.schema["page_id"].dataType
    return read_archives(write_archives(pages, folder)).select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    return main_text(pages, fit_labeller(pages)).withColumn("n_chars", F.char_length("text").cast("long"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of each language."""
    return collocations(_table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to ids and back, as digests."""
    path = word_tokenizer()
    return decoded(encoded(_table(spark, sf_dir, "documents"), path), path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive, under labels of which a part is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_dedup": op2_near_dedup,
    "op3_sharding": op3_sharding,
    "op4_co_training": op4_co_training,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_html_text": op10_html_text,
    "op11_collocations": op11_collocations,
    "op12_bpe": op12_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL: dict[str, str] = sql.SQL
