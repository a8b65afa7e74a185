"""Questions against all rows in blocks, beside the plain join."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import similarity as S
from weftline.operators import cross
from weftline.operators import retrieval as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def odd_vectors(spark):
    r = random.Random(5)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)]) for i in range(150)]  # many equal scores
    rows += [(200, [0.0, 0.0, 0.0]), (201, None), (202, [1.0, None, 2.0]), (203, [float("nan"), 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0]), (205, [1.0, 2.0]), (206, []), (207, [1e-300, 1e-300, 0.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_search_in_blocks_is_the_plain_search(spark, monkeypatch):
    v = odd_vectors(spark)
    q = v.where("vec_id % 3 = 0 or vec_id >= 200").withColumnRenamed("vec_id", "query_id")
    score = F.greatest(F.lit(0.0), S.cosine(F.col("_q"), F.col("embedding")))
    met = q.withColumnRenamed("embedding", "_q").crossJoin(v).select("query_id", "vec_id", score.alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    want = sorted(map(repr, met.withColumn("rank", rank).where("rank <= 7").collect()))
    for size in (1 << 20, 64):
        monkeypatch.setattr(cross, "SCORES", size)
        assert sorted(map(repr, R.vector_search(q, v, 7).collect())) == want


def test_milli_in_blocks_is_the_plain_one(spark):
    v = odd_vectors(spark).where("vec_id not in (203, 204)")
    q = v.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    want = q.withColumnRenamed("embedding", "_q").crossJoin(v).select("query_id", "vec_id", F.floor(S.cosine(F.col("_q"), F.col("embedding")) * 1000 + 0.5).cast("long").alias("milli"))
    assert sorted(map(str, cross.cosine_milli(q, v).collect())) == sorted(map(str, want.collect()))


def test_no_pair_of_ordinary_vectors_is_a_row_of_a_join(spark):
    v = odd_vectors(spark).where("vec_id < 200")
    q = v.where("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    for df in (R.vector_search(q, v, 3), cross.cosine_milli(q, v)):
        assert "NestedLoopJoin" not in plan(df) and "CartesianProduct" not in plan(df)


def test_lexical_search_in_blocks_is_the_plain_one(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(["every", *r.choices(words, k=n)])
    docs = spark.createDataFrame([*((i, text(i % 9)) for i in range(90)), (90, None), (91, ""), (92, "und")], "doc_id long, text string")
    asked = spark.createDataFrame([*((i, text(5)) for i in range(30)), (30, None), (31, "the"), (32, "nowhere")], "query_id long, question string")
    want = R.top_k(R.lexical_scores(asked, docs), ["query_id"], [F.desc("hits"), F.asc("doc_id")], 6)
    got = R.lexical_search(asked, docs, 6)
    columns = ["query_id", "doc_id", "n_tokens", "hits", "rank"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect())) and got.count() > 150
    assert "Generate explode(tokens" not in plan(got)
