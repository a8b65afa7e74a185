"""Exact deduplication by two-pass Bloom filtering. Native: SQL functions only.

Pass one keeps the Bloom positions that the text hashes of two rows hit; a row moves one
position of 8 bytes there. Pass two tests every row's hash: rows whose hash surely occurs
once pass straight through, and only the possibly repeated ones (id and hash, never a
text) shuffle to be grouped exactly.

Defined results: a null text counts as empty; empty texts are equal to each other; rows
that repeat both the largest id and the text are one document and all say kept, and
``keep_last`` returns one of them; a row that repeats an id with another text is judged by
its own text; a null id never beats another and a group of null ids only keeps them; long
texts are hashed whole; an empty table gives an empty result; further columns of the input
are ignored, and ``keep_last`` returns them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.common import cut, fresh


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _judged(docs: DataFrame, id_col: str, text_col: str, bits_per_row: int) -> tuple[DataFrame, DataFrame]:
    """(rows of hashes that occur once: doc_id, sha; rows of possibly repeated ones with keep_id and group_size)."""
    hashed = cut(docs.select(F.col(id_col).alias("doc_id"), _sha(F.col(text_col)).alias("sha")))
    bits = bloom.bits_for(hashed.count(), bits_per_row)
    key = F.xxhash64("sha")
    maybe, once = bloom.split(hashed, key, bits, bloom.of_repeats(hashed, key, bits), one=True)
    # written once, so that the join deals both sides anew and can split a hot hash
    groups = cut(maybe.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return once, maybe.join(groups, "sha").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.
    """
    once, again = _judged(docs, id_col, text_col, bits_per_row)
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = once.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return alone.unionByName(again.select("doc_id", "keep_id", "group_size", "kept", sha))


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16) -> DataFrame:
    """The rows that stay, with all their columns: one of each distinct text."""
    again = _judged(docs, id_col, text_col, bits_per_row)[1]
    id_, sha, go = fresh(docs.columns, "_weft_id"), fresh(docs.columns, "_weft_sha"), fresh(docs.columns, "_weft_go")
    # rows to drop, and rows that say the same id and text more than once
    marks = again.groupBy("doc_id", "sha").agg(F.min((~F.col("kept")).cast("int")).alias(go), F.count(F.lit(1)).alias("n"))
    marks = cut(marks.where((F.col(go) == 1) | (F.col("n") > 1)).select(F.col("doc_id").alias(id_), F.col("sha").alias(sha), go))
    bits = bloom.bits_for(marks.count())
    key = F.xxhash64(id_, sha)
    own = docs.withColumns({id_: F.col(id_col), sha: _sha(F.col(text_col))})
    maybe, sure = bloom.split(own, key, bits, bloom.of_keys(marks, key, bits))
    m = marks.alias("m")
    met = maybe.alias("d").join(m, F.col(f"d.{id_}").eqNullSafe(F.col(f"m.{id_}")) & (F.col(f"d.{sha}") == F.col(f"m.{sha}")), "left")
    met = met.select("d.*", F.col(f"m.{go}").alias(go))
    stay = met.where(F.col(go).isNull()).select(*docs.columns).unionByName(met.where(F.col(go) == 0).dropDuplicates([id_, sha]).select(*docs.columns))
    return sure.select(*docs.columns).unionByName(stay)
