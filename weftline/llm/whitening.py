"""Whitening of embeddings with an exact covariance: digit-slice GEMM.

The integer vectors of a task are cut into limbs of ``LIMB`` bits. Products of limb
matrices are float64 BLAS calls whose entries stay under 2^53, so they are exact; those of
equal weight are added and carried into digits of ``DIGIT`` bits, which Spark sums over the
tasks. The driver recombines the sums of digits as big integers, forms ``n * G - S S'`` (n^2
times the covariance centred before multiplying) without any rounding and decomposes it.
A column of ones beside the vectors makes n and S entries of the same product.

Scale: three passes over the vectors (moments, check, result) and one for their length; no
row of them moves. A task sends (d + 1) (d + 2) / 2 rows of digits for vectors of length d,
however many vectors it read; the driver gets as many in all, and the executors the
d * components eigenvectors. A lost executor costs its tasks.

Defined results: rows whose vector is null, empty, of another length than most (see
``vectors.kept``) or not all finite are dropped; repeated rows and null ids count like any
others. Entries beyond 2^52 / 1024 count as that. A component without variance (constant
or linearly dependent entries, a single row) has a null ``whitened`` and takes no part in
``identity_error``, which is null if no component varies, as ``explained`` is then. A
``deviation`` of 2^63 or more is null and stands in ``deviation_exact``. An empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.vectors import kept, scaled

SCALE, SHIFT = 1024, 100_000
MOST = 1 << 52
LIMB, DIGIT = 12, 24
#: Rows whose limb products may be added up before they are carried: 2^29 times 2^24 is 2^53.
EXACT = 1 << 29
#: Digits of a task's entries: two factors of 53 bits and 2^40 rows fit in seven.
DIGITS = 7

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def integers(column: pa.Array, d: int) -> np.ndarray:
    return scaled(column, d, SCALE, MOST) + SHIFT


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """float64 limbs, lowest first; all but the last lie in [0, 2^LIMB), the last has the sign."""
    bits = int(max(x.max(initial=0), -x.min(initial=0) - 1)).bit_length() + 1
    k = -(-bits // LIMB)
    return [(x >> LIMB * i & (1 << LIMB) - 1 if i < k - 1 else x >> LIMB * i).astype(np.float64) for i in range(k)]


class Moments:
    """Exact sums of products of all columns, with a first column of ones."""

    def __init__(self, d: int) -> None:
        self.at = np.triu_indices(d + 1)
        self.digits = np.zeros((DIGITS, len(self.at[0])), np.int64)
        self.products: dict[int, np.ndarray] = defaultdict(lambda: np.zeros((d + 1, d + 1)))
        self.rows = 0

    def add(self, x: np.ndarray) -> None:
        if self.rows + len(x) > EXACT // 8:  # up to eight products of one weight are added
            self.carry()
        self.rows += len(x)
        parts = limbs(np.column_stack((np.ones(len(x), np.int64), x)))
        for p, a in enumerate(parts):
            for q, b in enumerate(parts[p:], p):
                g = a.T @ b
                self.products[p + q] += g if p == q else g + g.T

    def carry(self) -> None:
        """Moves the products into the digits; each digit but the last stays under 2^DIGIT."""
        held, top = 0, len(self.digits) * DIGIT // LIMB
        fine = []
        for i in range(top):
            held = held + (self.products[i][self.at].astype(np.int64) if i in self.products else 0)
            fine.append(held & (1 << LIMB) - 1 if i < top - 1 else held)
            held = held >> LIMB
        for i in range(DIGITS):
            self.digits[i] += fine[2 * i] + (fine[2 * i + 1] << LIMB)
        for i in range(DIGITS - 1):
            self.digits[i + 1] += self.digits[i] >> DIGIT
            self.digits[i] &= (1 << DIGIT) - 1
        self.products.clear()
        self.rows = 0


def _moments(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, any_rows = Moments(d), False
        for b in batches:
            if b.num_rows:
                any_rows = True
                m.add(integers(b.column("v"), d))
        if any_rows:
            m.carry()
            cells = pa.array(np.arange(m.digits.shape[1], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([cells, *(pa.array(x) for x in m.digits)], ["cell", *(f"d{i}" for i in range(DIGITS))])

    return run


class Basis:
    """n, the sums S, and the components of the covariance of the fitted vectors."""

    def __init__(self, cells: dict[int, int], d: int, components: int) -> None:
        full = {}
        for cell, (i, j) in enumerate(zip(*np.triu_indices(d + 1), strict=True)):
            full[int(i), int(j)] = cells[cell]
        self.n = full[0, 0]
        self.sums = [full[0, j + 1] for j in range(d)]
        v = np.empty((d, d))
        for i in range(d):
            for j in range(i, d):
                v[i, j] = v[j, i] = (self.n * full[i + 1, j + 1] - self.sums[i] * self.sums[j]) / self.n**2
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[order], vectors[:, order]
        for c in range(len(order)):  # one of the two signs, the same in every run
            self.vectors[:, c] *= np.sign(self.vectors[np.argmax(np.abs(self.vectors[:, c])), c])
        trace = float(np.trace(v))
        self.varies = self.values > max(values.max(initial=0.0), 0.0) * d * np.finfo(np.float64).eps
        self.explained = [float(x) / trace if trace > 0 else None for x in np.maximum(self.values, 0.0)]
        self.map = self.vectors * np.where(self.varies, 1 / np.sqrt(np.where(self.varies, self.values, 1.0)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: int64 where it fits, else Python integers."""
        most = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if most < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) / self.n @ self.map

    @staticmethod
    def deviation(centred: np.ndarray) -> list[int]:
        """The exact sums of squares."""
        if centred.dtype != object:
            about = (centred.astype(np.float64) ** 2).sum(axis=1)
            if about.max(initial=0) < 2**62:
                return (centred * centred).sum(axis=1).tolist()
        return [sum(e * e for e in row) for row in centred.tolist()]


def _check(basis: Basis, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = 0.0, 0.0
        for b in batches:
            if b.num_rows:
                w = basis.whiten(basis.centred(integers(b.column("v"), d)))
                total, products = total + w.sum(axis=0), products + w.T @ w
        if not isinstance(total, float):
            flat = np.concatenate((total, products.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int64)), pa.array(flat)], ["cell", "x"])

    return run


def _result(basis: Basis, d: int, error: float | None):
    k = len(basis.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            centred = basis.centred(integers(b.column("v"), d))
            exact = basis.deviation(centred)
            each = np.repeat(np.arange(m), k)
            repeat = lambda xs, kind: pa.array(xs, kind).take(pa.array(each))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, basis.n, np.int64)),
                    repeat([x if x < 1 << 63 else None for x in exact], pa.int64()), pa.array(basis.whiten(centred).ravel(), mask=np.tile(~basis.varies, m)),
                    pa.array(basis.explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()), repeat([Decimal(x) for x in exact], pa.decimal128(38, 0)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return run


def fit(rows: DataFrame, d: int, components: int) -> Basis:
    """The basis of the vectors ``v`` of length ``d``; only sums of digits reach the driver."""
    sums = rows.select("v").mapInArrow(_moments(d), "cell long, " + ", ".join(f"d{i} long" for i in range(DIGITS))).groupBy("cell").agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(DIGITS)))
    return Basis({r["cell"]: sum(r[f"d{i}"] << DIGIT * i for i in range(DIGITS)) for r in sums.collect()}, d, components)


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact.

    One row for each vector that counts and each of up to ``components`` components. A
    vector entry c is x = floor(1024 c) + 100000. Components are numbered from 1 by falling
    eigenvalue of the covariance of x; of both signs the one is taken whose largest entry is
    positive. ``identity_error`` is measured on the whitened values of all vectors.
    """
    rows, d = kept(df, vector_col, {"vec_id": id_col})
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long"))
    if not d:
        return df.sparkSession.createDataFrame([], SCHEMA)
    basis = fit(rows, d, components)
    k, error = len(basis.values), None
    if basis.varies.any():
        sums = rows.select("v").mapInArrow(_check(basis, d), "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x"))
        flat = np.array([x for _, x in sorted((r["cell"], r["x"]) for r in sums.collect())]) / basis.n
        covariance = flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k])
        on = basis.varies
        error = float(np.abs(covariance - np.eye(k))[np.ix_(on, on)].max())
    return rows.mapInArrow(_result(basis, d, error), SCHEMA)
