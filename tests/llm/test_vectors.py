"""Whitening and vector codes against plain loops."""

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v string, x long, code string, error long"  # with names that operators use inside
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if c is None else float(c) for c in e], label, "a", 1, "b", 2) for i, e, label in rows], SCHEMA)


def vectors(n, d, seed=1, scale=0.3):
    r = np.random.default_rng(seed)
    base = r.normal(size=(d, d)) * scale / np.arange(1, d + 1)
    return [(i, (r.normal(size=d) @ base).astype(np.float32).tolist(), int(i % 3)) for i in range(n)]


def odd(d):
    """Rows that do not count, and rows that count like any other."""
    good = vectors(3, d, 9)
    drop = [(900, None, 1), (901, [], 1), (902, [None] * d, 1), (903, [0.1] * (d - 1) + [None], 2), (904, [NAN] + [0.0] * (d - 1), 1), (905, [INF] + [0.0] * (d - 1), 1), (906, [-INF] * d, 1), (907, [0.5] * (d + 1), 1)]
    return drop, [(None, good[0][1], None), (3, good[1][1], 1), (3, good[1][1], 1), (4, good[2][1], None), (None, good[0][1], None)]


def floors(e, scale):
    return [int(Fraction(np.float32(c).item()) * scale // 1) for c in e]


# ---------------------------------------------------------------- whitening


def brute_covariance(rows):
    xs = [[c + 100_000 for c in floors(e, 1024)] for _, e, _ in rows]
    n, d = len(xs), len(xs[0])
    s = [sum(x[j] for x in xs) for j in range(d)]
    dev = [sum((n * x[j] - s[j]) ** 2 for j in range(d)) for x in xs]
    v = [[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in xs) / n**3 for j in range(d)] for i in range(d)]
    centred = np.array([[float(Fraction(n * x[j] - s[j], n)) for j in range(d)] for x in xs])
    return n, dev, np.array(v), centred


def test_whitening_against_plain_loops(spark):
    drop, count = odd(12)
    rows = vectors(150, 12) + count
    n, dev, v, centred = brute_covariance(rows)
    got = whitening.whiten(table(spark, rows + drop).repartition(5)).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 9))
    values, vectors_ = np.linalg.eigh(v)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], set()).add(r["whitened"])
        assert int(r["deviation_exact"]) == r["deviation"] and r["explained"] == pytest.approx(values[-r["component"]] / np.trace(v), rel=1e-9)
        assert r["identity_error"] < 1e-9
    signs = {}
    for (i, _, _), exact, c in zip(rows, dev, centred, strict=True):
        held = by[i, exact]
        for k in range(1, 9):
            (w,) = held[k]
            want = c @ vectors_[:, -k] / np.sqrt(values[-k])
            if abs(want) > 1e-6:
                signs.setdefault(k, set()).add(np.sign(want) == np.sign(w))
            assert abs(w) == pytest.approx(abs(want), rel=1e-7, abs=1e-9)
    assert all(len(x) == 1 for x in signs.values())  # one sign for all rows


def test_whitening_of_odd_tables(spark):
    drop, _ = odd(4)
    for rows in ([], drop[:7]):
        got = whitening.whiten(table(spark, rows))
        assert got.count() == 0 and got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0], 0)])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = sorted(whitening.whiten(table(spark, [(1, [0.0, 5.0], 0), (2, [1.0, 5.0], 0)])).collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert [r["whitened"] for r in flat] == [-1.0, None, 1.0, None] and flat[0]["explained"] == 1.0 and flat[0]["identity_error"] < 1e-12
    wide = whitening.whiten(table(spark, [(i, [float(i) * 1e30, 1.0], 0) for i in range(3)])).collect()  # far beyond the bound: held, and too large for a long
    assert {r["deviation"] for r in wide if r["vec_id"] > 0} == {int(r["deviation_exact"]) if r["deviation_exact"] < 2**63 else None for r in wide if r["vec_id"] > 0}


def test_moments_are_exact_whatever_the_size(monkeypatch):
    r = np.random.default_rng(4)
    for top in (9, 20, 52):
        x = r.integers(-(1 << top), 1 << top, (300, 5))
        x[0] = 1 << top
        monkeypatch.setattr(whitening, "EXACT", 8 * 64)  # carried every few batches
        m = whitening.Moments(5)
        for at in range(0, 300, 32):
            m.add(x[at : at + 32])
        m.carry()
        got = [sum(int(m.digits[i, c]) << whitening.DIGIT * i for i in range(whitening.DIGITS)) for c in range(m.digits.shape[1])]
        y = [[1, *map(int, row)] for row in x]
        assert got == [sum(row[i] * row[j] for row in y) for i, j in zip(*np.triu_indices(6), strict=True)]
        parts = whitening.limbs(x)
        assert (sum(p.astype(object) * (1 << whitening.LIMB * i) for i, p in enumerate(parts)) == x).all() and all(np.abs(p).max() <= 1 << whitening.LIMB for p in parts)


# ---------------------------------------------------------------- vector codes


def brute_codes(rows, parts, entries, rounds, bound=1 << 27):
    xs = []
    for i, e, label in rows:
        x = [max(-bound, min(bound, c)) for c in floors(e, 256)]
        x += [0] * (-len(x) % parts)
        w = len(x) // parts
        xs.append((i, e, label, [x[p * w : p * w + w] for p in range(parts)]))
    first = sorted(xs, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[3][p] for r in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    moves = []
    for _ in range(rounds):
        codes = [[nearest(r[3][p], books[p])[1] for p in range(parts)] for r in xs]
        moves.append(codes)
        for p in range(parts):
            for k in range(len(first)):
                mine = [r[3][p] for r, c in zip(xs, codes, strict=True) if c[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out, by_label = [], {}
    for i, _, label, x in xs:
        met = [nearest(x[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in met), sum(d for d, _ in met), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, code, e, by_label[label], sha) for i, code, e, label in out), key=str), moves


@pytest.mark.parametrize(("n", "d", "entries"), [(150, 32, 64), (20, 16, 64), (60, 18, 8)])
def test_codes_against_plain_loops(spark, n, d, entries):
    drop, count = odd(d)
    rows = vectors(n, d) + count
    got = vector_codes.compress(table(spark, rows + drop).repartition(5), entries=entries).collect()
    want, _ = brute_codes(rows, 16, entries, 2)
    assert sorted(map(tuple, got), key=str) == want


def test_only_changed_parts_contribute(spark):
    """Round two moves what changed and nothing else, and the running sums equal full ones."""
    rows = vectors(200, 16)
    df = table(spark, rows).select("vec_id", "label", "embedding").withColumnRenamed("embedding", "v").selectExpr("vec_id", "label", "cast(v as array<double>) v").repartition(3)
    state, books = vector_codes.train(df, 16, 16, 16, 2)
    want, (one, two) = brute_codes(rows, 16, 16, 2)
    codes = {r["vec_id"]: (list(r["was"]), list(r["code"])) for r in state.collect()}
    assert [codes[i][0] for i in range(200)] == one and [codes[i][1] for i in range(200)] == two
    moved = sum(a != b for a, b in zip(one, two, strict=True))
    assert 0 < vector_codes.changed(state).count() == moved < 200
    assert vector_codes.digest(books) == want[0][4]
    batches = state.select("x", "code", "was").toArrow().to_batches()
    (sent,) = vector_codes._deltas(16, 16)(iter(batches))
    assert sum(sent.column("n").to_pylist()) == 0  # what goes to one entry leaves another


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(table(spark, [])).count() == 0
    assert vector_codes.compress(table(spark, odd(16)[0][:7])).count() == 0
    huge = [(i, [1e30 * (-1) ** i] * 15 + [i * 100.0], 1) for i in range(5)]
    assert sorted(map(tuple, vector_codes.compress(table(spark, huge)).collect()), key=str) == brute_codes(huge, 16, 64, 2)[0]
    same = [(7, [0.25] * 16, None)] * 30
    assert sorted(map(tuple, vector_codes.compress(table(spark, same)).collect()), key=str) == brute_codes(same, 16, 64, 2)[0]
    with pytest.raises(ValueError, match="256"):
        vector_codes.compress(table(spark, huge), entries=257)


def test_assignment_is_exact_for_large_integers():
    r = np.random.default_rng(2)
    x, books = r.integers(-(1 << 27), 1 << 27, (40, 2, 4)), r.integers(-(1 << 27), 1 << 27, (2, 9, 4))
    codes, error = vector_codes.assign(x, books)
    for i in range(40):
        for p in range(2):
            assert (int(error[i, p]), int(codes[i, p])) == min((sum((int(a) - int(b)) ** 2 for a, b in zip(x[i, p], e, strict=True)), k) for k, e in enumerate(books[p]))


def test_ties_go_to_the_lower_index():
    x = np.array([[[0]], [[1]]])
    assert vector_codes.assign(x, np.array([[[1], [-1], [1]]]))[0].tolist() == [[0], [0]]
    column = pa.array([[0.5, -0.001]], pa.list_(pa.float64()))
    assert vector_codes.integers(column, 2, 2).tolist() == [[[128], [-1]]]
