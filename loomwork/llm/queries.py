"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontamination, html_text, quality, sharding, simhash, suffix_dedup, token_files, warc
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op3_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass, with their scores."""
    found = quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.where("not rejected").drop("rejected")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.reshard(table(spark, sf_dir, "documents"), 40)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return found.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_approximate_neighbours": op3_approximate_neighbours,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_token_id_output": op5_token_id_output,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_warc": op9_warc,
    "op10_min_cost_resharding": op10_min_cost_resharding,
}

ORACLE_SQL: dict[str, str] = {
    "op9_warc": """
        with own as (select page_id, coalesce(html, '') as payload from pages),
        told as (select page_id, octet_length(encode(payload)) as payload_bytes, sha1(payload) as payload_digest from own),
        last as (select payload_digest, max(page_id) as last from told where payload_bytes >= 1000 group by payload_digest)
        select page_id, payload_bytes, told.payload_digest,
            case when last is null or last = page_id then 'response' else 'revisit' end as record_type,
            case when last <> page_id then last end as refers_to
        from told left join last on told.payload_digest = last.payload_digest and payload_bytes >= 1000
    """,
}
