"""Helpers shared by the operators: table access, free column names, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.shared import cut, delete, discard
from weftline.shared import shared_folder as checkpoint_dir

__all__ = ["checkpoint_dir", "cut", "delete", "discard", "fresh", "held_out", "labelled_sample", "table"]


def fresh(taken: list[str], name: str) -> str:
    """``name``, or a longer one that no column of ``taken`` has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model may learn labels from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled rows outside the held-out fold.

    The rows are those with the smallest hash of their id, so the choice depends on
    neither partitioning nor order. At most ``max_rows`` ids of 16 bytes are broadcast,
    and of rows that repeat an id one text is taken, that of the smallest hash.
    """
    chosen = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))
