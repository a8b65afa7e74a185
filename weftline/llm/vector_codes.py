"""Product codes of vectors by delta-maintained Lloyd rounds.

Vectors are cut into equal parts; each part position has a codebook. A round assigns every
part to the nearest entry of its codebook and writes the assignments beside the previous
ones, from which the running integer sums of every entry are kept up: only parts whose
assignment changed contribute, plus to the new entry and minus to the old one.

Scale: contributions are added up in the task that made them, so a task sends at most one
row for each entry (positions x entries), whatever the vectors are and however many of them
are equal. The driver holds the running sums and the codebooks (positions x entries), which
go to the executors with the tasks. Each round is one table of the shared folder (integers,
codes, previous codes); the one before is deleted, and a lost executor costs its tasks.

Defined results: rows whose vector is null, empty, of another length than most (see
``vectors.kept``) or not all finite are dropped. A length that the parts do not divide is
filled up with zeros. Entries beyond 2^27 / 256 count as that. Of rows with equal ids the
lesser vector seeds first, null ids seed last; with fewer vectors than entries the
codebooks have as many entries as there are vectors. Repeated rows count each. Null labels
are one label. An empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, discard
from weftline.llm.vectors import kept, scaled

SCALE = 256
MOST = 1 << 27
SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def integers(column: pa.Array, d: int, parts: int) -> np.ndarray:
    """(rows, parts, width)."""
    x = scaled(column, d, SCALE, MOST)
    x = np.pad(x, ((0, 0), (0, -d % parts)))
    return x.reshape(len(x), parts, -1)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), each (rows, parts); ties go to the lower index. Exact."""
    rows, parts, width = x.shape
    codes, error = np.empty((rows, parts), np.uint8), np.empty((rows, parts), np.int64)
    most = 2 * int(max(np.abs(x).max(initial=0), np.abs(books).max(initial=0)))
    if width * most * most < 1 << 53:  # integers in float64 stay exact
        for p in range(parts):
            a, b = x[:, p].astype(np.float64), books[p].astype(np.float64)
            d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
            codes[:, p] = d.argmin(axis=1)
            error[:, p] = d.min(axis=1)
        return codes, error
    for at in range(0, rows, 1024):
        for p in range(parts):
            d = ((x[at : at + 1024, p, None] - books[p][None]) ** 2).sum(axis=2)
            codes[at : at + 1024, p] = d.argmin(axis=1)
            error[at : at + 1024, p] = d.min(axis=1)
    return codes, error


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _state(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def _integers(d: int, parts: int):
    """The vectors as integers, not yet assigned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = integers(b.column("v"), d, parts).reshape(b.num_rows, -1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), lists, pa.nulls(b.num_rows, pa.binary())], ["vec_id", "label", "x", "code"])

    return run


def _round(books: np.ndarray):
    """New assignments, with the previous ones as ``was``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, _ = assign(_state(b.column("x"), len(books)), books)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), _binary(codes), b.column("code")], ["vec_id", "label", "x", "code", "was"])

    return run


def _deltas(parts: int, entries: int):
    """(part, entry, n, sums): what the changed assignments of a task add to and take from the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x, new = _state(b.column("x"), parts), _codes(b.column("code")).astype(np.int64)
            first = b.column("was").null_count > 0  # of a round all rows are new or none is
            old = None if first else _codes(b.column("was")).astype(np.int64)
            if total is None:
                total = np.zeros((parts * entries, 1 + x.shape[2]), np.int64)
            moved = np.ones(new.shape, bool) if first else new != old
            row, part = np.nonzero(moved)
            values = np.column_stack((np.ones(len(row), np.int64), x[row, part]))
            np.add.at(total, part * entries + new[row, part], values)
            if not first:
                np.subtract.at(total, part * entries + old[row, part], values)
        if total is not None:
            at = np.flatnonzero(total.any(axis=1))
            cols = [pa.array(at.astype(np.int64)), *(pa.array(c) for c in total[at].T)]
            yield pa.RecordBatch.from_arrays(cols, ["slot", "n", *(f"s{i}" for i in range(total.shape[1] - 1))])

    return run


def _final(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, error = assign(_state(b.column("x"), len(books)), books)
                text = pa.array([r.tobytes().hex() for r in codes], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), text, pa.array(error.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return run


def changed(state: DataFrame) -> DataFrame:
    """The rows of a round with a part whose assignment changed."""
    return state.where(F.col("was").isNull() | (F.col("code") != F.col("was"))).select("x", "code", "was")


def train(rows: DataFrame, d: int, parts: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(the written state after the last round, the codebooks). ``rows``: vec_id, label, v."""
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    books = integers(pa.array([r["v"] for r in seeds], pa.list_(pa.float64())), d, parts).transpose(1, 0, 2).copy()
    width, k = books.shape[2], len(seeds)
    sums = np.zeros((parts * k, 1 + width), dtype=object)  # running integers of any size
    schema = f"vec_id long, label {dict(rows.dtypes)['label']}, x array<int>, code binary"
    state, last = rows.mapInArrow(_integers(d, parts), schema), None
    for _ in range(rounds):
        state = cut(state.mapInArrow(_round(books), f"{schema}, was binary"))
        discard(last)
        last = state
        fields = ["n", *(f"s{i}" for i in range(width))]
        moved = changed(state).mapInArrow(_deltas(parts, k), "slot long, " + ", ".join(f"{c} long" for c in fields))
        for r in moved.groupBy("slot").agg(*(F.sum(c).alias(c) for c in fields)).collect():
            sums[r["slot"]] += np.array([r[c] for c in fields], object)
        flat = books.reshape(parts * k, width)
        for i, (n, *s) in enumerate(sums.tolist()):
            if n:
                flat[i] = [x // n for x in s]
    return state, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each vector that counts.

    An entry c is floor(256 c); codebooks start as the parts of the vectors with the
    ``entries`` (at most 256) smallest ids. ``label_error`` is the sum of ``error`` over
    equal labels.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits names at most 256 entries")
    rows, d = kept(df, vector_col, {"vec_id": id_col, "label": label_col})
    if not d:
        return df.sparkSession.createDataFrame([], SCHEMA)
    state, books = train(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "v"), d, parts, entries, rounds)
    coded = cut(state.drop("was").mapInArrow(_final(books), f"vec_id long, label {dict(state.dtypes)['label']}, code string, error long"))
    discard(state)
    # written, so that its size is known and, where it is large, both sides are dealt anew and a hot label is split
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
