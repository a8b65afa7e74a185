"""Embedding tables: which rows count, and their components as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector that is not null and holds neither a null nor a non-finite entry."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def kept(df: DataFrame, vector_col: str, others: dict[str, str]) -> tuple[DataFrame, int]:
    """The columns ``others`` (name -> input column) and ``v`` of the rows that count, and their length.

    All vectors of a table have one length. Where they do not, the commonest length of at
    least one entry counts (of equally common ones the longest) and other rows are
    dropped like incomplete ones. Length 0: no row counts.
    """
    rows = df.select(*(F.col(c).alias(n) for n, c in others.items()), F.col(vector_col).cast("array<double>").alias("v")).where(finite(F.col("v")))
    length = rows.groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0
    return rows.where(F.size("v") == d if d else F.lit(False)), d


def scaled(column: pa.Array, d: int, scale: int, most: int) -> np.ndarray:
    """(rows, d) of floor(scale * entry), held within plus or minus ``most``."""
    with np.errstate(over="ignore"):
        x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) * float(scale))
    return np.clip(x, -float(most), float(most)).astype(np.int64)
