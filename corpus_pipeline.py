"""A corpus pipeline: each stage takes what its predecessor kept.

STAGES: quality classifier, exact dedup, MinHash near-dedup, benchmark decontamination,
byte-level BPE. All but the last return the columns of ``documents``.

Defined results: a null or empty text is judged by the quality stage like any other, and
one of all null and empty texts passes the exact stage; it has no near copy and holds no
benchmark item. Of equal texts the row with the largest id stays, once; of near copies the
smallest id, and rows that share an id are kept or dropped together there and in
decontamination. Rows with a null id are dropped as equal to others, but never as near
copies or as contaminated. Without labels nothing is rejected, without benchmark items
nothing is contaminated, and an empty table passes as an empty one. Texts are read whole;
further columns pass through whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bloom, bpe, exact_dedup, minhash_join, pairwise_quality, template_decontam
from weftline.llm.common import checkpoint_dir, cut, delete, table
from weftline.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return pairwise_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest id."""
    return exact_dedup.keep_last(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    found = template_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    drop = cut(found.where("contaminated").select("doc_id").distinct())
    return bloom.anti_by_id(docs, drop, drop.count())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.encode_decode(docs, *tokenizer())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("bpe", tokens)]

#: No stage but exact dedup can be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    A stage's input is deleted once its output is written.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if k:
            delete(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
        docs = spark.read.parquet(out)
    return docs
