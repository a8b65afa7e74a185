"""What moves, and what a task holds, as tables grow."""

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.operators import chunk, cross, evaluate, louvain, postings, routing
from weftline.operators import graph as G
from weftline.operators import retrieval as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def names(spark, n):
    return spark.range(n).select(F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"))


def test_like_names_are_no_row_a_pair(spark):
    df = names(spark, 120)
    m, n = R.name_arrays(df.withColumnRenamed("name", "mention"), "mention"), R.name_arrays(df, "name")
    blocks = 1  # so few names
    assert cross.name_scores(m, n, 0.5, 3, 768).count() <= 3 * 120 * blocks


def test_names_are_expanded_in_tasks_of_so_many(spark, monkeypatch):
    monkeypatch.setattr(R, "NAMES", 16)
    assert R.name_arrays(names(spark, 120), "name").rdd.getNumPartitions() == 8


def test_questions_are_routed_in_several_tasks(spark):
    q = spark.createDataFrame([(i, "Which sectors and regions?", True, 1, "Fund", "sector_exposure") for i in range(40)], "query_id int, question string, has_entities boolean, n_starts int, start_type string, expected string").coalesce(1)
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert routing.dealt(q).rdd.getNumPartitions() == tasks
    assert f", {tasks}), REPARTITION_BY_NUM" in plan(routing.route(q))
    r = evaluate.training_records(q)
    assert r.count() == 40 * 8 and r.where("selected").groupBy("query_id").count().where("count > 3").count() == 0


def test_neighbours_have_their_types_before_the_search(spark):
    edges = spark.createDataFrame([("a", "r", "hub"), ("b", "r", "hub"), ("hub", "s", "c")], "head string, relation string, tail string")
    kinds = spark.createDataFrame([("a", "A"), ("hub", "H"), ("hub", "I"), ("c", "C")], "name string, type string")
    found = G.neighbors(edges, spark.createDataFrame([("a",)], "start string"), 2, kinds)
    rows = sorted(tuple(x) for x in found.select("hop", "target", "target_type").collect())
    assert rows == [(1, "hub", "H"), (1, "hub", "I"), (2, "a", "A"), (2, "b", ""), (2, "c", "C")]
    assert "target_type" in found.columns and "LeftOuter" not in plan(found)


def test_postings_meet_questions_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "DOCUMENTS", 10)
    index = postings.PostingIndex(spark, str(tmp_path / "p"), 2)
    index.add(spark.createDataFrame([(i % 40, f"common words text{i}") for i in range(60)], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "common words")], "query_id int, question string")
    found = index.search(asked, 5)
    assert "FlatMapCoGroups" in plan(found) and [x["doc_id"] for x in found.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert index._read().count() == 40 * 2 + 60
    assert len(list((tmp_path / "p" / "postings").rglob("*.parquet"))) > 2


def test_chunks_are_given_out_as_they_come(monkeypatch):
    monkeypatch.setattr(chunk, "CHARS", 1000)
    texts = [f"Sentence {i} of a text. " * 30 for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": texts})
    out = list(chunk._chunked(["doc_id"], 64, 1)(iter([batch])))
    assert len(out) > 20 and max(sum(map(len, b["content"].to_pylist())) for b in out) < 2000
    want = [(i, k, c.start, c.end, c.text.strip()) for i, t in enumerate(texts) for k, c in enumerate(chunk.chunk_text(t, 64, 1))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want
    assert list(chunk._chunked(["doc_id"], 64, 1)(iter([]))) == []


def test_rounds_of_communities_broadcast_nothing(spark):
    level = louvain._Level(spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "node string, k long, inner long"), spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "u string, v string, w long"), 2)
    where = level.nodes.select("node", F.col("node").alias("comm"))
    met = level.links.join(louvain._far(where.select(F.col("node").alias("v"), F.col("comm").alias("to"))), "v")
    assert "Broadcast" not in plan(met)
