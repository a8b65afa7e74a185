"""Embeddings, similarities and evidence scores as column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.functions import text as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(F.try_divide(dot(a, b), norm))


def hash_features(t: Column) -> Column:
    """Tokens, and the letter triples of all tokens joined; the text itself if there are none."""
    tokens = T.ascii_tokens(t)
    joined = F.array_join(tokens, "")
    triples = F.when(F.length(joined) >= 3, F.transform(F.sequence(F.lit(1), F.length(joined) - 2), lambda i: F.substr(joined, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    both = F.concat(tokens, triples)
    return F.when((F.size(both) == 0) & (t != ""), F.array(F.lower(t))).otherwise(both)


def hash_embedding(df: DataFrame, key: str, t: Column, dims: int = 768, unit: bool = True) -> DataFrame:
    """(key, index, value): the non-zero places of the hash embedding, of unit length if ``unit``.

    Each feature is hashed once per text and weighted by its count, so the sum is one
    group-by with partial sums; values are multiples of a quarter and exact.
    """
    f = df.select(key, F.explode(hash_features(t)).alias("feature")).groupBy(key, "feature").count()
    h = F.sha2(F.col("feature").cast("binary"), 256)
    number = lambda at, n: F.conv(F.substr(F.col("h"), F.lit(2 * at + 1), F.lit(2 * n)), 16, 10).cast("long")
    parts = F.array(*[F.struct((number(o, 4) % dims).cast("int").alias("index"), F.when(number(o + 16, 1) % 2 == 0, 0.25).otherwise(-0.25).alias("sign")) for o in (0, 4, 8, 12)])
    summed = (
        f.withColumn("h", h).select(key, "count", F.explode(parts).alias("p"))
        .groupBy(key, F.col("p.index").alias("index")).agg(F.sum(F.col("count") * F.col("p.sign")).alias("value")).where("value <> 0")
    )
    if not unit:
        return summed
    norm = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return summed.join(norm, key).select(key, "index", (F.col("value") / F.col("norm")).alias("value"))


def overlap(query: Column, content: Column) -> Column:
    """Share of the query's tokens that the content has; 0 for no tokens."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query, content)).cast("double"), F.size(query).cast("double")), F.lit(0.0))


def lexical_score(q: Column, content: Column) -> Column:
    return overlap(T.query_tokens(q), F.array_distinct(T.ascii_tokens(content)))


def graph_lexical(q: Column, content: Column) -> Column:
    return overlap(T.graph_tokens(q), T.graph_tokens(content))


def hybrid_score(vector: Column, lexical: Column, metadata: Column) -> Column:
    mixed = 0.55 * vector + 0.35 * lexical + 0.10 * metadata
    return F.least(F.lit(1.0), F.greatest(mixed, 0.9 * lexical, 0.25 * metadata))


def subgraph_score(is_query_entity: Column, target_in_query: Column, n_relations: Column, lexical: Column) -> Column:
    at = F.when(is_query_entity, 1.0).otherwise(0.5) * 0.4 + F.when(target_in_query, 0.2).otherwise(0.0) * 0.2
    return F.least(F.lit(1.0), at + F.least(n_relations / 3, F.lit(1.0)) * 0.2 + lexical * 0.2)


def path_score(coverage: Column, length: Column) -> Column:
    return F.least(F.lit(1.0), coverage * 0.7 + 0.3 / F.greatest(length, F.lit(1)))


def community_score(member_overlap: Column, lexical: Column) -> Column:
    return F.least(F.lit(1.0), member_overlap * 0.7 + lexical * 0.3)


def metapath_score(path: Column, lexical: Column) -> Column:
    return F.least(F.lit(1.0), path * 0.6 + lexical * 0.4)


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-matching-blocks ratio of two names."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
