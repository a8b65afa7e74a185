"""Connected components of a link table: contraction within partitions, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.shared import cut, discard

#: Links (2 MB) that a task contracts; the number of tasks follows from it.
BLOCK = 1 << 17


def _contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (node, least node) of the components that the links (u, v) form."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[a], root[b])
        if (least == root[a]).all() and (least == root[b]).all():
            break
        up = root.copy()
        for end in (root[a], root[b]):
            np.minimum.at(up, end, least)
        while not (up[up] == up).all():
            up = up[up]
        root = up[root]
    inner = root != np.arange(len(ids))
    return ids[inner], ids[root[inner]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars. At most two blocks of links are held; what does not shrink goes out."""
    held, rows, kinds = [], 0, None

    def stars() -> tuple[np.ndarray, np.ndarray]:
        return _contract(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, kinds), pa.array(v, kinds)], ["u", "v"])

    for b in batches:
        kinds = b.schema.field("u").type
        held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
        rows += b.num_rows
        if rows > BLOCK:
            u, v = stars()
            held, rows = [(u, v)], len(u)
            if rows > BLOCK // 2:
                yield batch(u, v)
                held, rows = [], 0
    if rows:
        yield batch(*stars())


def _round(links: DataFrame) -> DataFrame:
    """A large and a small star. Every link (u, v) has u > v on entry and on return.

    Large: a link to a node that has a smaller neighbour goes to the least of those instead.
    Links to a node without one, as to the root of a large component, stay as they are; the
    least neighbours are dealt anew, so that the join has an exchange on both sides and
    adaptive execution can split such a hub. Small: all smaller neighbours of a node, and
    the node, are linked to the least of them.
    """
    least = links.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
    large = links.join(least.hint("rebalance"), F.col("v") == F.col("x"), "left").select("u", F.coalesce("m", "v").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    met = large.join(low, "u")
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _counted(links: DataFrame) -> tuple[DataFrame, tuple]:
    """``links`` written, and their number and checksum as seen while writing."""
    seen = Observation()
    out = cut(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("check")))
    return out, (seen.get["n"], seen.get["check"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id on a link with the smallest id that it reaches.

    Ids are of any one ordered type. The links are dealt to tasks of ``BLOCK`` links, which
    contract them to stars. That is all where one task holds them; else rounds of a large and
    a small star go on until no link changes. Their number is logarithmic in practice and not
    limited. A round is one job: it is written to the shared folder, which keeps the lineage
    short, and counted while it is written.

    Defined results: a link with a null end or with equal ends links nothing; repeated
    links count once; no links give an empty table.
    """
    ends, (n, _) = _counted(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    tasks = max(1, -(-n // BLOCK))
    cur, mark = _counted(ends.repartition(tasks).mapInArrow(_forest, ends.schema))
    discard(ends)
    while tasks > 1:
        last, seen = cur, mark
        cur, mark = _counted(_round(cur))
        discard(last)
        if mark == seen:
            break
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = cut(cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots))
    discard(cur)
    return out
