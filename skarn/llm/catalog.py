"""The registered queries of the ten operators, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base, chat, decontam, lengths, mixing, secrets, simhash, tiff, tokenids, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives."""
    return warc.round_trip(base.table(spark, sf_dir, "pages"), least_bytes=0)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading back the formatted conversations gives, for every one of them and conversation -1."""
    turns = chat.with_probe(base.table(spark, sf_dir, "conversations"))
    return chat.read_conversations(base.written(chat.format_conversations(turns), "conversations", "zstd"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards."""
    return tokenids.token_ids(base.table(spark, sf_dir, "documents"))


#: Target weights of the query: less of the largest source, more of three small ones, the rest in proportion.
WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.08, "src3": 0.06, mixing.REST: 0.56}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, replicated to WEIGHTS and shuffled: their columns, mix_copy, mix_key."""
    return mixing.replicate(base.table(spark, sf_dir, "documents"), WEIGHTS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths (with the end id) and its suffix sums, over every document."""
    return lengths.length_histogram(lengths.encoded_lengths(base.table(spark, sf_dir, "documents"), extra=1))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_windows, matched of every leak of a benchmark item into a document."""
    return decontam.contaminated(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    return secrets.report(secrets.scan(base.table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return toxicity.toxicity(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash.near_duplicates(base.table(spark, sf_dir, "documents"))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and a feature of every document's TIFF, from the stored bytes."""
    return tiff.digests(tiff.text_images(base.table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    return {
        "op1_warc": op1_warc,
        "op2_chat": op2_chat,
        "op3_token_ids": op3_token_ids,
        "op4_mixing": op4_mixing,
        "op5_token_counts": op5_token_counts,
        "op6_decontamination": op6_decontamination,
        "op7_secrets": op7_secrets,
        "op8_toxicity": op8_toxicity,
        "op9_simhash": op9_simhash,
        "op10_tiff": op10_tiff,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.sql(), "op2_chat": chat.sql(), "op4_mixing": mixing.sql(WEIGHTS), "op6_decontamination": decontam.sql()}
