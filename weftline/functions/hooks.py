"""Places for a user's model: callables that are built once a Python worker and get batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import similarity as S


def batched(build: Callable[[], Callable[[list[str]], list]], returns: str, size: int = 64) -> Callable[[Column], Column]:
    """A column function from ``build()``, which loads the model and returns texts -> results.

    The worker process is the isolation: the model is loaded once there and serves every
    batch; results come in the order of the texts.
    """

    @F.pandas_udf(returns)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for texts in parts:
            asked = ["" if t is None else t for t in texts]
            out: list = []
            for at in range(0, len(asked), size):
                got = list(model(asked[at : at + size]))
                if len(got) != len(asked[at : at + size]):
                    raise ValueError("the model must give one result a text")
                out += got
            yield pd.Series(out, index=texts.index, dtype=object)

    return run


def embed(df: DataFrame, key: str, text: Column, build: Callable | None = None, dims: int = 768) -> DataFrame:
    """(key, embedding): by the user's model, or by hashed features where there is none."""
    if build is None:
        return S.hash_embedding(df, key, text, dims)
    return df.select(key, batched(build, "array<double>")(text).alias("embedding"))


def summarise(communities: DataFrame, build: Callable | None = None, most: int = 50) -> DataFrame:
    """Communities with the model's summary of at most ``most`` members and relations; their own one without a model."""
    if build is None:
        return communities
    asked = F.concat(F.lit("Members: "), F.array_join(F.slice("members", 1, most), ", "), F.lit("\nRelations: "), F.array_join(F.slice("relations", 1, most), "; "))
    return communities.withColumn("summary", F.coalesce(F.nullif(batched(build, "string", 5)(asked), F.lit("")), F.col("summary")))


def extract(chunks: DataFrame, build: Callable, size: int = 5) -> DataFrame:
    """(chunk_id, reply) of an extraction model, in batches of ``size`` and in order; the reply is parsed by ``parse_extraction``."""
    return chunks.select("chunk_id", batched(build, "string", size)(F.col("content")).alias("reply"))
