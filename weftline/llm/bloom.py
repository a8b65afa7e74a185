"""Bloom filters as small tables of bitmap segments, built and probed with SQL functions.

A filter of ``bits`` positions is a table (bucket, bitmap) of 4 KB segments. ``bits`` is
a power of two of at most ``MAX_BITS`` (32 MB), whatever the input; a filter that is too
small for its input only lets more rows through, it never loses one. That cap is the
proven bound under which the segments are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh

SEGMENT = 32768
MAX_BITS = 1 << 28


def bits_for(rows: int, per_row: int = 16, most: int = MAX_BITS) -> int:
    bits = SEGMENT
    while bits < rows * per_row and bits < most:
        bits *= 2
    return bits


def probes(key: Column, bits: int) -> list[Column]:
    """Two positions for a 64-bit key."""
    return [F.pmod(F.xxhash64(F.lit(salt), key), F.lit(bits)) for salt in (17, 71)]


def segments(positions: DataFrame) -> DataFrame:
    """(bucket, bitmap) of the column ``pos``."""
    return positions.groupBy(F.floor(F.col("pos") / SEGMENT).cast("long").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("pos") % SEGMENT).alias("bitmap")
    )


def of_keys(df: DataFrame, key: Column, bits: int, one: bool = False) -> DataFrame:
    """The filter that holds every key of ``df``; with ``one`` at one position each, which is quicker to read."""
    return segments(df.select(F.explode(F.array(*probes(key, bits)[: 1 if one else 2])).alias("pos")))


def of_repeats(df: DataFrame, key: Column, bits: int) -> DataFrame:
    """The filter of the positions that at least two rows hit: it holds every key that occurs twice.

    One position a key: a row moves a number of 8 bytes, and equal ones are counted
    where they lie before they move. ``split`` with ``one=True`` reads it.
    """
    hit = df.select(probes(key, bits)[0].alias("pos"))
    return segments(hit.groupBy("pos").count().where("count > 1").select("pos"))


def split(df: DataFrame, key: Column, bits: int, segs: DataFrame, one: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows whose key the filter may hold, all other rows). Rows and columns stay as they are."""
    taken = df.columns
    out, tests, names = df, [], []
    for i, pos in enumerate(probes(key, bits)[: 1 if one else 2]):
        at, bucket, bitmap = (fresh(taken, f"_weft_{c}{i}") for c in ("at", "bucket", "bitmap"))
        b = F.broadcast(segs.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
        out = out.withColumn(at, pos).join(b, F.floor(F.col(at) / SEGMENT).cast("long") == F.col(bucket), "left")
        byte = f"cast(conv(hex(substring({bitmap}, cast(({at} % {SEGMENT}) div 8 + 1 as int), 1)), 16, 10) as bigint)"
        tests.append(f"coalesce(getbit({byte}, cast({at} % 8 as int)) = 1, false)")
        names += [at, bucket, bitmap]
    maybe = F.expr(" and ".join(tests))
    return out.where(maybe).drop(*names), out.where(~maybe).drop(*names)


def anti_by_id(df: DataFrame, drop: DataFrame, drop_rows: int, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose id is not in ``drop`` (one column ``id_col``).

    Rows that the filter clears pass straight through; only the rest shuffle for the
    exact anti join. Rows with a null id stay.
    """
    bits = bits_for(drop_rows)
    maybe, sure = split(df, F.col(id_col), bits, of_keys(drop, F.col(id_col), bits))
    return sure.unionByName(maybe.join(drop.select(id_col).distinct(), id_col, "left_anti").select(*sure.columns))


def semi_by_id(df: DataFrame, want: DataFrame, want_rows: int, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df`` that ``want`` may hold: a superset, for an exact join to follow."""
    bits = bits_for(want_rows)
    return split(df, F.col(id_col), bits, of_keys(want, F.col(id_col), bits))[0]
