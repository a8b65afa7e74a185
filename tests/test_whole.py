"""Results that are whole or none: branches that fail, records that are all learned from."""

import numpy as np
import pytest

from weftline.operators import attention, retrieval, vector_index
from weftline.operators import evaluate as E
from weftline.plans import q_answers

SMALL = "/root/testdata/sf0.001"


def test_a_failed_branch_is_no_answer(spark, monkeypatch):
    def broken(*args, **kwargs):
        raise ValueError("no index")

    monkeypatch.setattr(q_answers.R, "lexical_search", broken)
    with pytest.raises(RuntimeError, match="the branch text failed"):
        q_answers.qa_end_to_end(spark, SMALL)


def test_gather_names_the_branch_that_failed(spark):
    rows = spark.createDataFrame([(1, "c", "s", 0.5, 1)], "query_id int, content string, source string, score double, pos int")
    late = lambda: rows.selectExpr("query_id", "content", "source", "raise_error('late') as score", "pos")
    with pytest.raises(RuntimeError, match="the branch b failed"):
        retrieval.gather({"a": lambda: rows, "b": late}, strict=True)
    assert retrieval.gather({"a": lambda: rows, "b": late})[1] == ["b"]


def test_probes_are_enough_for_vectors_that_no_cell_began_with():
    r = np.random.default_rng(3)
    sample = vector_index._unit(r.normal(size=(6000, 32)))
    centres = vector_index.centroids(sample, 155)
    probes = vector_index.probes_for(sample, centres)
    cell, found, ask = (sample @ centres.T).argmax(axis=1), [], range(2000, 2600)  # neither those that cells began with nor the last
    for i in ask:
        scores = sample @ sample[i]
        scores[i] = -1
        cells = np.argsort(-(centres @ sample[i]))[:probes]
        found.append(np.isin(cell[np.argsort(-scores)[:10]], cells).mean())
    assert np.mean(found) >= 0.94
    assert probes < len(centres) and vector_index.probes_for(sample[:1], centres) == 1


def questions_of(spark, n, odd):
    """Records of ``n`` questions with two candidates; what is right depends on the last ``odd`` questions alone."""
    base = dict.fromkeys(E._NUMERIC, 0.0) | {"first_type": "Fund", "last_type": "Sector"}
    rows = []
    for q in range(n):
        rare = q >= n - odd
        for c in "ab":
            right = c == ("b" if rare else "a")
            rows.append(base | {"query_id": q, "candidate": c, "label": int(right), "matched": float(rare and right), "coverage": 0.1234 if right else 0.0})
    return spark.createDataFrame(rows)


def test_all_records_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(attention, "SAMPLE", 1)  # of no effect
    records = questions_of(spark, 400, 40)
    met = E.pairs_of(records)
    assert met.count() == 2 and met.agg({"n": "sum"}).first()[0] == 400
    w = E.train_on_all(records)
    assert w == E.train_on_all(records.repartition(7, "candidate"))
    assert w["candidate=a"] > w["candidate=b"] and w["matched"] > 0
    scored = E.apply_weights(records, w)
    assert E.rank_metrics(scored).first()["top1"] == 1.0


def test_the_query_learns_from_every_question(spark, monkeypatch):
    from weftline.plans import q_rank

    seen, real = [], E.pairs_of
    monkeypatch.setattr(E, "pairs_of", lambda r: seen.append(r.select("query_id").distinct().count()) or real(r))
    got = q_rank.learned_ranker(spark, SMALL).first()
    asked = q_rank.asked(spark, SMALL).where("query_id % 5 <> 0").count()
    assert seen == [asked] and asked != 250 and got["top1_not_below_rule"] and got["mrr_not_below_rule"]


def test_nothing_to_learn_from(spark):
    records = questions_of(spark, 3, 0)
    assert all(v == 0.0 for v in E.train_on_all(records.where("label = 0")).values())
    assert all(v == 0.0 for v in E.train_on_all(records.limit(0)).values())
