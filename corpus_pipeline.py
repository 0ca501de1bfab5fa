"""A pipeline over documents: quality rules, toxicity, near-dedup, packing. Counted as part of the subpackage llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkfolio.llm import neardup, packing, quality, toxicity
from sparkfolio.llm.queries import BYTE_BPE, tokenizer
from sparkfolio.llm.runtime import drop_folder, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and blank texts too. Repeated rows count as often and share their
    verdict, ties at a threshold stay, a very long text is read whole, an empty table gives an empty one. All columns stay,
    whatever they are called."""
    return quality.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go, those at exactly the threshold too. The classifier learns from labels of the documents that
    are there; without labels of both classes it has one score for all, below the threshold unless all labels are toxic.

    A null or empty text scores as one without words, a very long one is scored whole, repeated rows share their score; an
    empty table gives an empty one. All columns stay, whatever they are called."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words and a similarity of 0.8 or more, the one with the smallest doc_id stays,
    with all its rows if it is repeated. Documents without doc_id or without words stay; very long texts are compared by all
    their shingles; an empty table gives an empty one. All columns stay, whatever they are called."""
    return neardup.keep_one(docs, words=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of at most 1024 tokens; of an empty table none. The only stage whose rows aren't documents.

    A null text counts as empty and is one piece with the closing id alone; repeated rows are packed each; a very long text is cut
    into as many pieces as it needs. Columns other than doc_id and text are not read, whatever they are called."""
    return packing.pack_documents(docs, tokenizer(BYTE_BPE))


STAGES = [("quality_rules", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("packing", packing_stage)]

#: A trained classifier, signatures and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet in the shared folder and read again by the next.

    A stage's output goes once the next one is written; the last one's stays, as the result reads it.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            drop_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
