"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon (words) and stems (their first letters) are those that the labelled toxic
rows use far more often than the others, counted by a distributed group-by. Features:
densities and numbers of lexicon and stem hits, hits near a second-person pronoun,
capitals, punctuation, obfuscated spellings. The calibration is fitted on predictions for
rows that neither the trees nor the lexicon behind them has seen: each of three folds,
dealt by a hash of the id, has a lexicon and trees of its own.

At most ``MAX_TRAIN`` labelled rows outside the held-out fold are used, a documented bound;
the lexicon grows with them. Every document is scored on its whole text.

Defined results: a null text is scored as the empty one; without labels of both kinds
every score is 0; a score at the threshold is toxic; rows that repeat an id are scored
each by its own text and of those in training one is learnt from; an empty table gives an
empty result; other columns are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.boosting import Boosted, Isotonic
from weftline.llm.common import cut, held_out, labelled_sample
from weftline.llm.features import STEM, plain, toxic_features, toxic_views

MAX_TRAIN = 12_000
FOLDS = 3
DECIDE = 0.5


@dataclass
class ToxicModel:
    lexicon: dict[str, float]
    stems: dict[str, float]
    trees: Boosted | None
    curve: Isotonic | None

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(texts))
        x = np.stack([toxic_features(t, self.lexicon, self.stems) for t in texts])
        return self.curve.predict(self.trees.predict(x))


def _terms(batches):
    for b in batches:
        rows = []
        for t, y, f in zip(b["text"], b["label"], b["fold"], strict=True):
            low = {plain(w) for w in (t or "").split()} - {""}
            rows += [("w", w, f, y) for w in low] + [("s", s, f, y) for s in {w[:STEM] for w in low if len(w) >= STEM}]
        yield pd.DataFrame(rows, columns=["kind", "term", "fold", "y"])


def _lexicons(rows: DataFrame, sizes: dict[tuple[int, int], int]) -> list[tuple[dict[str, float], dict[str, float]]]:
    """(lexicon, stems) of the rows outside each fold, and of all rows last."""
    counts = rows.mapInPandas(_terms, "kind string, term string, fold int, y int").groupBy("kind", "term")
    counts = counts.agg(*(F.count_if((F.col("fold") == f) & (F.col("y") == y)).alias(f"n{f}{y}") for f in range(FOLDS) for y in (0, 1)))
    odds = []
    for out in [*range(FOLDS), None]:
        n, total = {}, {}
        for y in (0, 1):
            folds = [f for f in range(FOLDS) if f != out]
            n[y], total[y] = sum((F.col(f"n{f}{y}") for f in folds), F.lit(0)), sum(sizes.get((f, y), 0) for f in folds)
        value = F.log((n[1] + 0.5) / (total[1] + 1)) - F.log((n[0] + 0.5) / (total[0] + 1))
        # three rows at least say it, and it is over seven times likelier in toxic texts
        odds.append(F.when((n[1] >= 3) & (value > 2.0), value))
    terms = counts.select("kind", "term", *(x.alias(f"o{i}") for i, x in enumerate(odds))).where(" or ".join(f"o{i} is not null" for i in range(len(odds)))).toPandas()
    return [tuple({t: float(o) for k, t, o in zip(terms["kind"], terms["term"], terms[f"o{i}"], strict=True) if k == kind and o == o and o is not None} for kind in "ws") for i in range(len(odds))]


def train_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> ToxicModel:
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    rows = cut(labelled_sample(docs, labels, "toxic", max_rows).withColumn("fold", fold))
    sizes = {(r["fold"], r["label"]): r["n"] for r in rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # six rows
    if not any(y == 1 for _, y in sizes) or not any(y == 0 for _, y in sizes):
        return ToxicModel({}, {}, None, None)
    lexicons = _lexicons(rows, sizes)

    def extract(batches):
        for b in batches:
            views = [toxic_views(t, [lexicons[f], lexicons[-1], *(x for i, x in enumerate(lexicons[:-1]) if i != f)]) for t, f in zip(b["text"], b["fold"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["label"], "fold": b["fold"], "x": [np.concatenate(v) for v in views]})

    got = rows.mapInPandas(extract, "doc_id long, y int, fold int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    y, folds = got["y"].to_numpy().astype(float), got["fold"].to_numpy()
    x = np.array(got["x"].tolist()).reshape(len(got), FOLDS + 1, -1)
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        # a row has the view of its own fold's lexicon first, then that of all, then the other folds' in order
        view = np.where(folds == k, 0, 2 + k - (folds < k))
        mine = x[np.arange(len(x)), view]
        if (folds != k).any() and (folds == k).any():
            unseen[folds == k] = Boosted().fit(mine[folds != k], y[folds != k]).predict(mine[folds == k])
    return ToxicModel(*lexicons[-1], Boosted().fit(x[:, 1], y), Isotonic().fit(unseen, y))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document, no shuffle of texts."""
    model = train_toxic(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(texts)) if len(texts) else [], dtype="float64")

    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= DECIDE).cast("int"))
