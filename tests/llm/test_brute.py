"""Decontamination, ranking, boosting and calibration against plain loops over all rows."""

import math
import random
import zlib

import numpy as np
import pytest

from tests.llm.test_llm import docs
from weftline.llm import boosting, pairwise_quality, template_decontam, toxicity
from weftline.llm.features import quality_features, toxic_features

# ---------------------------------------------------------------- decontamination

UNITS = set(template_decontam.UNITS.split("|"))


def canonical(raw):
    """Word by word: \x01 for a name, \x02 for a number, \x03 for a unit after one."""
    named, i = "", 0
    while i < len(raw):
        if raw[i].isupper() and i > 1 and raw[i - 1] == " " and (raw[i - 2].islower() or raw[i - 2] in ",;"):
            while i < len(raw) and (raw[i].isalpha() or raw[i] in "'’-"):
                i += 1
            named += "\x01"
            continue
        named += raw[i]
        i += 1
    out = []
    for w in named.split(" "):
        done, i = "", 0
        while i < len(w):
            j = i + (w[i] in "+-" and i + 1 < len(w))
            if w[j].isascii() and w[j].isdigit():
                j += 1
                while j < len(w) and (w[j].isdigit() or w[j] in ".,:/"):
                    j += 1
                if 1 <= len(w) - j <= 3 and all(c.isascii() and c.isalpha() or c in "%°€$£" for c in w[j:]):
                    j = len(w)
                done, i = done + "\x02", j
            else:
                done, i = done + w[i], i + 1
        bare = done.rstrip(".,;!?")
        if out and out[-1].endswith("\x02") and (bare.lower() in UNITS or bare in ("%", "°")) and len(done) - len(bare) <= 1:
            done = "\x03" + done[len(bare) :]
        out.append(done)
    return ["".join(c for c in w.lower() if c not in '.,:;!?"()') for w in out]


def folded(raw):
    return ["".join(c for c in w.lower() if c not in '.,:;!?"()') for w in raw.split(" ")]


def bare(w):
    w = w.lower()
    keep = [i for i, c in enumerate(w) if c.isalpha() or c.isdigit()]
    if not keep:
        return "" if "%" not in w else w[w.index("%") :]
    end = max(i for i, c in enumerate(w) if c.isalpha() or c.isdigit() or c == "%")
    return w[keep[0] : end + 1]


def brute_decontaminate(rows, items, width=8, literals=5, coverage=0.5, enough=12):
    prepared = {}
    for item, text in items:
        words = [(r, c, f) for r, c, f in zip(text.split(" "), canonical(text), folded(text), strict=True) if c != ""]
        prepared[item] = (words, [f for f in folded(text) if f])
    out = {}
    for i, text in rows:
        words = [(r, c) for r, c in zip(text.split(" "), canonical(text), strict=True) if c != ""]
        canon, fold = [c for _, c in words], [f for f in folded(text) if f]
        found = []
        for item, (iw, ifold) in prepared.items():
            w = min(width, len(iw))
            if not iw:
                continue
            starts = [p for p in range(len(iw) - w + 1) if sum(c not in ("\x01", "\x02", "\x03") for _, c, _ in iw[p : p + w]) >= min(literals, w)]
            if not starts:
                continue
            ic = [c for _, c, _ in iw]
            runs = {}
            for p in starts:
                mine = {tuple(ic[p : p + w]), tuple(ifold[p : p + w])}
                for exact, theirs in ((False, canon), (True, fold)):
                    for at in range(len(theirs) - w + 1):
                        if tuple(theirs[at : at + w]) in mine:
                            run = runs.setdefault(at - p, (set(), set()))
                            run[0].add(p)
                            if exact:
                                run[1].add(p)
            need = min(enough, math.ceil(len(starts) * coverage))
            for shift, (at, exact) in runs.items():
                if len(at) < need:
                    continue
                pairs = set()
                for k, (r, c, _) in enumerate(iw):
                    if c in ("\x01", "\x02", "\x03") and any(a <= k < a + w for a in at) and 0 <= k + shift < len(words) and words[k + shift][1] == c:
                        pairs.add((bare(r), bare(words[k + shift][0])))
                if len({a for a, _ in pairs}) == len(pairs) or len(exact) >= need:
                    found.append((item, len(at), all(a == b for a, b in pairs)))
        out[i] = (bool(found), sorted({x for x, _, _ in found}), sum(n for _, n, _ in found), any(v for _, _, v in found))
    return out


def test_decontamination_against_loops(spark):
    r = random.Random(12)
    words = ["train", "leaves", "the", "station", "and", "travels", "at", "speed", "before", "it", "meets", "another", "with", "how", "long", "until", "both", "arrive", "costs", "each"]
    names = ["Anna", "Clara", "Boston", "O'Neil", "Lyon", "Petra-Maria"]
    units = ["kg", "miles", "hours", "%", "dollars"]

    def item():
        out = []
        for _ in range(r.randint(4, 26)):
            x = r.random()
            out.append(r.choice(names) if x < 0.15 else f"{r.randint(1, 99)}" if x < 0.25 else f"{r.randint(1, 9)}.5 {r.choice(units)}" if x < 0.32 else f"{r.randint(2, 9)}kg" if x < 0.36 else r.choice(words))
        return " ".join(out) + r.choice((".", "?", ""))

    items = [(k, item()) for k in range(45)] + [(100, "seven"), (101, "12 Anna"), (102, ""), (103, "the train")]
    filler = lambda n: " ".join(r.choice(words) + r.choice(("", "", ",", ".")) for _ in range(n))

    def changed(text):
        swap, out = {}, []
        for w in text.split(" "):
            if w.strip(".,?") in names:
                w = swap.setdefault(w, r.choice(names)) if r.random() < 0.8 else r.choice(names)
            elif w[:1].isdigit():
                w = swap.setdefault(w, str(r.randint(1, 99)) + w.lstrip("0123456789."))
            out.append(w)
        return " ".join(out)

    rows = []
    for n in range(130):
        _, text = r.choice(items[:45])
        kind = n % 5
        body = text if kind == 0 else changed(text) if kind in (1, 2) else text.upper() if kind == 3 else " ".join(text.split(" ")[: r.randint(2, 20)])
        rows.append((n, f"{filler(r.randint(0, 12))} {body} {filler(r.randint(0, 12))}".strip()))
    rows += [(500, ""), (501, "seven"), (502, "A B"), (503, "the train"), (504, "The train leaves."), (505, "13 Clara")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: (x["contaminated"], x["item_ids"], x["n_windows"], x["verbatim"]) for x in template_decontam.decontaminate(docs(spark, rows), bench).collect()}
    want = brute_decontaminate(rows, items)
    wrong = {i: (got[i], want[i]) for i in want if got[i] != want[i]}
    assert not wrong, list(wrong.items())[:3]
    assert 40 < sum(c for c, *_ in want.values()) < 130


def test_a_window_that_all_items_and_documents_share(spark):
    """Two hundred items and documents have their first ten words in common."""
    same = "the quick brown fox jumps over the lazy dog today"
    items = [(k, f"{same} and question {'x' * (k % 7 + 1)}{k // 7} asks for the number of sheep in field {'y' * (k % 5 + 1)} now") for k in range(60)]
    rows = [(i, f"{same} {'only this' if i % 2 else items[i % 60][1][len(same) + 1 :]}") for i in range(120)] + [(900, " ".join([same] * 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: (x["contaminated"], x["item_ids"], x["n_windows"], x["verbatim"]) for x in template_decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert got == brute_decontaminate(rows, items)


# ---------------------------------------------------------------- quality


def labelled(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.6
        text = " ".join(r.choice(["A calm sentence about gardens.", "Rivers run to the sea, slowly.", "We read the report twice."]) for _ in range(r.randint(2, 9))) if good else " ".join(r.choice(["BUY NOW!!!", "click click $$$", "###", "free free free"]) for _ in range(r.randint(2, 20)))
        rows.append((i, text))
        labels.append((i, int(good), int(not good)))
    return [*rows, (9000, None), (9001, ""), (9002, "word " * 400_000)], labels


def test_pairwise_loss_is_least():
    """The weights are the minimum of the loss over the drawn pairs: its slope, by loops, is nothing, and every step away costs."""
    r = np.random.default_rng(3)
    x = np.vstack([r.normal(0.4, 1, (40, 3)), r.normal(-0.4, 1, (30, 3))])
    y = np.array([1] * 40 + [0] * 30)
    m = pairwise_quality.fit_rank(x, y)
    draw = np.random.default_rng(7)
    n = min(pairwise_quality.MAX_PAIRS, 40 * 30)
    pairs = list(zip(draw.choice(np.flatnonzero(y == 1), n), draw.choice(np.flatnonzero(y == 0), n), strict=True))
    z = [[min(6, max(-6, (v - a) / s)) for v, a, s in zip(row, m.mean, m.scale, strict=True)] for row in x]
    z = [[*row, *(v * v / 3 for v in row)] for row in z]

    def loss(w):
        total = sum(math.log1p(math.exp(-sum(k * (p - q) for k, p, q in zip(w, z[a], z[b], strict=True)))) for a, b in pairs)
        return total / n + 1e-3 / 2 * sum(k * k for k in w)

    best = loss(m.weights)
    for j in range(len(m.weights)):
        for step in (-0.05, 0.05):
            assert loss([k + step * (i == j) for i, k in enumerate(m.weights)]) > best
    s = [sum(k * v for k, v in zip(m.weights, row, strict=True)) for row in z]
    balanced = lambda t: sum(v >= t for v in s[:40]) / 40 + sum(v < t for v in s[40:]) / 30
    assert balanced(m.threshold) >= max(balanced(t) for t in s) - 0.06


def test_quality_of_every_document_by_hand(spark):
    rows, labels = labelled(160, 4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = pairwise_quality.train_quality(docs(spark, rows), lab)
    got = {x["doc_id"]: (x["score"], x["predicted"]) for x in pairwise_quality.score_quality(docs(spark, rows), lab).collect()}
    for i, t in rows:
        z = [min(6, max(-6, (v - a) / s)) for v, a, s in zip(quality_features(t), m.mean, m.scale, strict=True)]
        rank = sum(w * v for w, v in zip(m.weights, [*z, *(v * v / 3 for v in z)], strict=True))
        at = min(30, max(-30, m.slope * (rank - m.threshold) + math.log(0.3 / 0.7)))
        assert got[i][0] == pytest.approx(1 / (1 + math.exp(-at)), abs=1e-9) and got[i][1] == int(got[i][0] >= 0.3)


# ---------------------------------------------------------------- toxicity


def test_boosting_chooses_the_best_cut():
    """Each first cut has the greatest gain of all cuts of all features, and leaves hold Newton steps."""
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(60, 3)), 1)
    y = (x[:, 1] + 0.3 * r.normal(size=60) > 0.2).astype(float)
    b = boosting.Boosted(trees=1, depth=1, bins=200, min_rows=4).fit(x, y)
    p = 1 / (1 + math.exp(-b.base))
    g, h = [v - p for v in y], [p * (1 - p)] * 60
    part = lambda rows: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)
    gains = {}
    for j in range(3):
        for c in sorted(set(x[:, j])):
            left, right = [i for i in range(60) if x[i, j] <= c], [i for i in range(60) if x[i, j] > c]
            if len(left) >= 4 and len(right) >= 4:
                gains[j, c] = part(left) + part(right) - part(range(60))
    (feature, cut, leaf) = b.forest[0]
    left, right = [i for i in range(60) if x[i, feature[0]] <= cut[0]], [i for i in range(60) if x[i, feature[0]] > cut[0]]
    assert part(left) + part(right) - part(range(60)) == pytest.approx(max(gains.values()))
    for rows, value in ((left, leaf[0]), (right, leaf[1])):
        assert value == pytest.approx(0.15 * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1))


def walk(model, x):
    """The sum over the trees, a row and a node at a time."""
    total = model.base
    for feature, cut, leaf in model.forest:
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + (x[feature[node]] > cut[node])
        total += leaf[node - len(feature)]
    return total


def test_isotonic_is_the_least_squares_rising_curve():
    r = np.random.default_rng(5)
    s, y = np.sort(r.normal(size=40)), (r.random(40) < np.linspace(0.1, 0.9, 40)).astype(float)
    c = boosting.Isotonic().fit(s, y)
    # min over j >= i of the max over k <= i of the mean of y[k..j]
    want = [min(max(y[k : j + 1].mean() for k in range(i + 1)) for j in range(i, 40)) for i in range(40)]
    blocks = [want[0]] + [b for a, b in zip(want, want[1:], strict=False) if b > a + 1e-12]
    assert np.allclose(c.y, blocks) and (np.diff(c.predict(np.linspace(-3, 3, 200))) >= -1e-12).all()


def test_toxicity_of_every_document_by_hand(spark):
    rows, labels = labelled(200, 6)
    rows = [(i, t if t is None or len(t) < 100_000 else t[:100_000] + "you idiot " * 30_000) for i, t in rows]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.train_toxic(docs(spark, rows), lab)
    got = {x["doc_id"]: (x["score"], x["predicted"], x["held_out"]) for x in toxicity.score_toxicity(docs(spark, rows), lab).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows}
    for i, t in rows:
        f = walk(m.trees, toxic_features(t, m.lexicon, m.stems))
        want = min(1, max(0, float(np.interp(f, m.curve.x, m.curve.y))))
        assert got[i][0] == pytest.approx(want, abs=1e-9) and got[i][1] == int(want >= 0.5) and got[i][2] == out[i]
