"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import infill, quality, urls, warc

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer(BYTE_BPE))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(documents(spark, sf_dir))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import encode_digests

    return encode_digests(documents(spark, sf_dir), tokenizer(BYTE_BPE))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(documents(spark, sf_dir), tokenizer(PIECE_BPE), limit=4096)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = urls.judge_captures(urls.page_captures(pages), urls.dated_lists(pages))
    seconds = F.unix_timestamp("fetched_at").alias("fetched_s")
    return judged.select("page_id", "url", seconds, "host", "matched_pattern", "matched_action", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_verdicts

    return quality_verdicts(documents(spark, sf_dir))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_next

    return compare_with_next(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened_components

    return whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import removal_digests

    return removal_digests(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_bpe_encoding": op4_bpe_encoding,
    "op5_token_counts": op5_token_counts,
    "op6_url_filters": op6_url_filters,
    "op7_quality_rules": op7_quality_rules,
    "op8_near_dedup": op8_near_dedup,
    "op9_warc": op9_warc,
    "op10_fingerprints": op10_fingerprints,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_whitening": op12_whitening,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {"op6_url_filters": urls.SQL, "op7_quality_rules": quality.SQL, "op9_warc": warc.SQL, "op11_fill_in_middle": infill.SQL}
