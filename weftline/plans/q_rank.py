"""Queries that rank: vectors, lexical matches, fusion, selection, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import vocab
from weftline.functions import similarity as S
from weftline.functions import text as T
from weftline.operators import attention
from weftline.operators import evaluate as E
from weftline.operators import retrieval as R
from weftline.operators import routing
from weftline.operators.cross import cosine_milli
from weftline.plans.book import Book
from weftline.plans.fixtures import ASKED_SQL, QUESTIONS_SQL, all_walked, asked, table
from weftline.plans.q_text import _QTOK, _TOKENS
from weftline.shared import cut

Q = Book()
_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
_SIM = _COS.format(a="q.embedding", b="e.embedding") + " / (sqrt(" + _COS.format(a="q.embedding", b="q.embedding") + ") * sqrt(" + _COS.format(a="e.embedding", b="e.embedding") + "))"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    # the stated queries: every vector whose id is divisible by 50
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label")), e


@Q.add(f"SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY greatest(0, {_SIM}) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE rank <= 5")
def vector_topk(spark, d):
    q, e = _vectors(spark, d)
    return R.vector_search(q, e, 5).select("query_id", "vec_id", "rank")


@Q.add(f"SELECT q.vec_id AS query_id, e.vec_id, CAST(floor({_SIM} * 1000 + 0.5) AS BIGINT) AS milli FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0")
def cosine_all(spark, d):
    q, e = _vectors(spark, d)
    return cosine_milli(q, e)


@Q.add(f"SELECT count(*) AS queries, CAST(sum(hit) AS BIGINT) AS hits FROM (SELECT q.vec_id, max(CAST(q.label = e.label AS INTEGER)) AS hit FROM embeddings q, (SELECT q.vec_id AS qid, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY greatest(0, {_SIM}) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) r, embeddings e WHERE q.vec_id = r.qid AND e.vec_id = r.vec_id AND rank BETWEEN 2 AND 6 GROUP BY q.vec_id)")
def vector_hit_rate(spark, d):
    q, e = _vectors(spark, d)
    top = R.vector_search(q, e, 6).where("rank > 1").join(e.select("vec_id", "label"), "vec_id").join(q.select("query_id", "query_label"), "query_id")
    per = top.groupBy("query_id").agg(F.max((F.col("label") == F.col("query_label")).cast("int")).alias("hit"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.sum("hit").alias("hits"))


_LEX = f"""q AS (SELECT item_id AS query_id, {_QTOK.format(t='text')} AS toks FROM benchmark), w AS (SELECT query_id, len(toks) AS n, unnest(toks) AS tok FROM q),
    c AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format(t='text')})) AS tok FROM documents),
    h AS (SELECT query_id, doc_id, n, count(*) AS hits FROM c JOIN w USING (tok) GROUP BY ALL)"""


def _bench(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@Q.add(f"WITH {_LEX} SELECT query_id, doc_id, CAST(n AS BIGINT) AS n_tokens, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM h) WHERE rank <= 20")
def lexical_topk(spark, d):
    return R.lexical_search(_bench(spark, d), table(spark, d, "documents"), 20).select("query_id", "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "hits", "rank")


_MIX = f"WITH {_LEX}, s AS (SELECT query_id, doc_id, hits * 1.0 / n AS l, (doc_id % 97) / 97.0 AS v, (doc_id % 5) / 5.0 AS m FROM h)"


def _mixed(spark, d):
    h = R.lexical_scores(_bench(spark, d), table(spark, d, "documents"))
    l, v, m = F.col("hits") / F.col("n_tokens"), (F.col("doc_id") % 97) / 97.0, (F.col("doc_id") % 5) / 5.0
    return h.select("query_id", "doc_id", S.hybrid_score(v, l, m).alias("score"))


@Q.add(f"{_MIX} SELECT query_id, doc_id, CAST(floor(least(1, greatest(0.55 * v + 0.35 * l + 0.10 * m, 0.9 * l, 0.25 * m)) * 100000 + 0.25) AS BIGINT) AS score5 FROM s")
def hybrid_score(spark, d):
    return _mixed(spark, d).select("query_id", "doc_id", F.floor(F.col("score") * 100000 + 0.25).cast("long").alias("score5"))


@Q.add(f"""{_MIX}, r AS (SELECT query_id, doc_id % 40 AS key, floor(least(1, greatest(0.55 * v + 0.35 * l + 0.10 * m, 0.9 * l, 0.25 * m)) * 1000) AS score FROM s),
    b AS (SELECT query_id, key, max(score) AS score FROM r GROUP BY ALL) SELECT query_id, key, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM b) WHERE rank <= 5""")
def hybrid_merge(spark, d):
    rows = _mixed(spark, d).select("query_id", (F.col("doc_id") % 40).alias("key"), F.floor(F.col("score") * 1000).cast("long").alias("score"))
    return R.merge_candidates(rows, 5)


# contexts of every user: six branches by event
_CTX = "ctx AS (SELECT user_id AS query_id, CAST(event_id % 6 AS INTEGER) AS branch_ord, event_id AS pos, 'k' || (event_id * 7919 % 23) AS key, value AS score, event_type, event_id FROM events)"


def _contexts(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("query_id"), (F.col("event_id") % 6).cast("int").alias("branch_ord"), F.col("event_id").alias("pos"),
        F.concat(F.lit("k"), F.col("event_id") * 7919 % 23).alias("key"), F.col("value").alias("score"), "event_type",
    )


@Q.add(f"""WITH {_CTX}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY branch_ord, pos) AS rn FROM ctx),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, branch_ord ORDER BY score DESC, pos) AS rank FROM f WHERE rn = 1)
    SELECT query_id, key, branch_ord, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, branch_ord) AS place FROM r""")
def rrf_interleave(spark, d):
    return R.fuse(_contexts(spark, d)).select("query_id", "key", "branch_ord", "rank", "place")


@Q.add(f"""WITH {_CTX}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, branch_ord ORDER BY score DESC, pos) AS rank FROM ctx)
    SELECT query_id, key, CAST(floor(sum(1.0 / (60 + rank)) * 1000000 + 0.25) AS BIGINT) AS rrf6, CAST(count(DISTINCT branch_ord) AS BIGINT) AS branches FROM r GROUP BY ALL""")
def rrf_sum(spark, d):
    f = R.fuse(_contexts(spark, d), dedup_first=False)
    return f.select("query_id", "key", F.floor(F.col("rrf") * 1000000 + 0.25).cast("long").alias("rrf6"), F.size("branches").cast("long").alias("branches"))


@Q.add(f"WITH {_CTX} SELECT query_id, key, pos, branch_ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY branch_ord, pos) AS rn FROM ctx) WHERE rn = 1")
def dedup_first(spark, d):
    return R.first_of_each(_contexts(spark, d)).select("query_id", "key", "pos", "branch_ord")


_KIND = "CASE event_type WHEN 'view' THEN 'vector' WHEN 'click' THEN 'vector' WHEN 'error' THEN 'multimodal' ELSE 'graph' END"


def _kinds(spark, d):
    t = F.col("event_type")
    return _contexts(spark, d).withColumn("kind", F.when(t.isin("view", "click"), "vector").when(t == "error", "multimodal").otherwise("graph"))


@Q.add(f"""WITH {_CTX}, a AS (SELECT *, {_KIND} AS kind FROM ctx), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY pos) = 1 AS first FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, CASE WHEN first THEN CASE kind WHEN 'vector' THEN 0 WHEN 'graph' THEN 1 ELSE 2 END END, pos) AS take FROM b)
    SELECT query_id, pos, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, take) AS place FROM c WHERE take <= 8 OR first) WHERE place <= 8""")
def balanced_contexts(spark, d):
    return R.balanced(_kinds(spark, d), 8).select("query_id", "pos", "place")


@Q.add(f"""WITH {_CTX}, s AS (SELECT query_id, CAST(floor(least(1, max(least(greatest(score / 1000, 0), 1)) * 0.45 + least(count(DISTINCT event_type) / 3.0, 1) * 0.25
    + CASE WHEN bool_or({_KIND} = 'graph') THEN 0.2 ELSE 0 END + CASE WHEN bool_or({_KIND} = 'multimodal') THEN 0.1 ELSE 0 END) * 10000 + 0.25) AS BIGINT) AS quality4 FROM ctx GROUP BY query_id) SELECT * FROM s""")
def retrieval_quality(spark, d):
    c = _kinds(spark, d).withColumn("score", F.col("score") / 1000).withColumn("source", F.col("event_type"))
    return R.retrieval_quality(c).select("query_id", F.floor(F.col("quality") * 10000 + 0.25).cast("long").alias("quality4"))


@Q.add(f"WITH {_CTX} SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY (event_type = 'purchase') DESC, score DESC, pos) AS place FROM ctx")
def policy_first(spark, d):
    content = F.when(F.col("event_type") == "purchase", "The Approval Workflow").otherwise("page")
    c = _contexts(spark, d).withColumns({"content": content, "source": F.col("event_type"), "score": F.col("score") / 100000})
    return R.policy_first(c).select("query_id", "pos", "place")


@Q.add("SELECT s_suppkey, CAST(floor((0.5 * 0.4 + CASE WHEN s_suppkey % 2 = 0 THEN 0.04 ELSE 0 END + least((s_suppkey % 4) / 3.0, 1) * 0.2) * 10000 + 0.25) AS BIGINT) AS sub, CAST(floor((0.7 + 0.3 / greatest(s_suppkey % 5, 1)) * 10000 + 0.25) AS BIGINT) AS path, CAST(floor(((s_suppkey % 3) / 2.0 * 0.7 + 0.15) * 10000 + 0.25) AS BIGINT) AS comm FROM supplier")
def branch_scores(spark, d):
    k = F.col("s_suppkey")
    out = lambda c: F.floor(c * 10000 + 0.25).cast("long")
    return table(spark, d, "supplier").select(
        "s_suppkey", out(S.subgraph_score(F.lit(False), k % 2 == 0, k % 4, F.lit(0.0))).alias("sub"), out(S.path_score(F.lit(1.0), k % 5)).alias("path"), out(S.community_score((k % 3) / 2.0, F.lit(0.5))).alias("comm"),
    )


# ---------------------------------------------------------------- evaluation


def _kw(k: str) -> str:
    return f"(^|[^a-z0-9_]){k}{'' if ' ' in k else 's?'}($|[^a-z0-9_])"


_ROUTE = (
    f"qs AS ({QUESTIONS_SQL}), hit AS ("
    + " UNION ALL ".join(
        f"SELECT query_id, '{m.name}' AS metapath, " + " + ".join(f"CAST(regexp_matches(lower(question), '{_kw(k)}') AS INTEGER)" for k in m.keywords) + " AS score, FALSE AS fallback FROM qs"
        for m in vocab.METAPATHS.values()
    )
    + "), scored AS (SELECT * FROM hit WHERE score > 0 UNION ALL SELECT query_id, m, 1, TRUE FROM qs, (VALUES ('sector_exposure'), ('geographic_risk'), ('compliance_chain')) f(m) WHERE start <> '' AND query_id NOT IN (SELECT query_id FROM hit WHERE score > 0)), "
    "routed AS (SELECT query_id, metapath, score, fallback, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, metapath DESC) AS rank FROM scored) WHERE rank <= 3)"
)


_ROUTE_ALL = _ROUTE.replace(QUESTIONS_SQL, ASKED_SQL)


@Q.add(f"WITH {_ROUTE_ALL} SELECT query_id, metapath, CAST(score AS BIGINT) AS score, fallback, rank FROM routed")
def route_metapaths(spark, d):
    return routing.route(asked(spark, d)).select("query_id", "metapath", F.col("score").cast("long").alias("score"), "fallback", "rank")


_RULES = (
    f"{_ROUTE}, rh AS ("
    + " UNION ALL ".join(f"SELECT query_id, '{r.name}' AS rule, '{r.metapath}' AS metapath, " + " + ".join(f"CAST(contains(lower(question), '{k}') AS INTEGER)" for k in r.keywords) + " AS score FROM qs" for r in vocab.RULES)
    + "), rs AS (SELECT * FROM rh WHERE score > 0 UNION ALL SELECT rh.query_id, rule, rh.metapath, 1 FROM rh JOIN routed USING (query_id, metapath) WHERE query_id NOT IN (SELECT query_id FROM rh WHERE score > 0) AND query_id IN (SELECT query_id FROM qs WHERE start <> '')), "
    "chosen AS (SELECT query_id, rule, metapath, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rule DESC) AS rank FROM rs) WHERE rank <= 4)"
)


@Q.add(f"WITH {_RULES.replace(QUESTIONS_SQL, ASKED_SQL)} SELECT query_id, rule, metapath, CAST(score AS BIGINT) AS score, rank FROM chosen")
def select_rules(spark, d):
    return routing.select_rules(asked(spark, d)).select("query_id", "rule", "metapath", F.col("score").cast("long").alias("score"), "rank")


@Q.add(f"WITH {_ROUTE_ALL} SELECT count(*) AS queries, CAST(sum(CAST(rank IS NOT NULL AS INTEGER)) AS BIGINT) AS hits, CAST(sum(CAST(rank = 1 AS INTEGER)) AS BIGINT) AS top1 FROM qs LEFT JOIN routed ON qs.query_id = routed.query_id AND expected = metapath")
def router_metrics(spark, d):
    q = asked(spark, d)
    r = routing.route(q).select("query_id", F.col("metapath").alias("expected"), "rank")
    return q.join(r, ["query_id", "expected"], "left").agg(F.count(F.lit(1)).alias("queries"), F.count("rank").alias("hits"), F.coalesce(F.sum((F.col("rank") == 1).cast("long")), F.lit(0)).alias("top1"))


_TRAIN = f"WITH {_ROUTE_ALL}, m AS (SELECT * FROM (VALUES {', '.join(repr((m.name, m.steps[0][0], m.steps[-1][3], len(m.keywords))) for m in vocab.METAPATHS.values())}) v(candidate, first_type, last_type, n_keywords)), t AS (SELECT qs.query_id, candidate, CAST(candidate = expected AS INTEGER) AS label, rank, score, first_type = start_type AS type_matches, len(regexp_extract_all(lower(question), '[a-z0-9]+')) AS n_tokens FROM qs CROSS JOIN m LEFT JOIN routed r ON r.query_id = qs.query_id AND r.metapath = candidate)"


@Q.add(f"{_TRAIN} SELECT query_id, candidate, label, CAST(coalesce(rank, 0) AS BIGINT) AS router_rank, CAST(coalesce(score, 0) AS BIGINT) AS router_score, type_matches, CAST(n_tokens AS BIGINT) AS n_tokens FROM t")
def training_records(spark, d):
    r = E.training_records(asked(spark, d))
    return r.select("query_id", "candidate", "label", F.col("router_rank").cast("long").alias("router_rank"), F.col("router_score").cast("long").alias("router_score"), "type_matches", F.col("n_tokens").cast("long").alias("n_tokens"))


@Q.add(f"{_TRAIN} SELECT count(*) AS records, count(DISTINCT query_id) AS queries, CAST(sum(label) AS BIGINT) AS positives, count(rank) AS selected, CAST(sum(CAST(label = 1 AND rank = 1 AS INTEGER)) AS BIGINT) AS top1, CAST(sum(CAST(label = 1 AND type_matches AS INTEGER)) AS BIGINT) AS compatible FROM t")
def training_summary(spark, d):
    r = E.training_records(asked(spark, d))
    return r.agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("query_id").alias("queries"), F.sum("label").alias("positives"), F.count_if("selected").alias("selected"),
        F.count_if((F.col("label") == 1) & (F.col("router_rank") == 1)).alias("top1"), F.count_if((F.col("label") == 1) & F.col("type_matches")).alias("compatible"),
    )


def _split(spark, d):
    """Records of the questions whose id 5 does not divide, to learn from, and of the others."""
    r = cut(E.training_records(asked(spark, d)))  # read three times
    return r.where("query_id % 5 <> 0"), r.where("query_id % 5 = 0")


def _not_below_rule(ranked, held):
    """Held-out questions, and whether a ranker puts the right metapath first as often as the router's own score does, and as high on average."""
    mine, rule = E.rank_metrics(ranked), E.rank_metrics(held.withColumn("score", F.col("router_score").cast("double")))
    both = mine.join(rule.select(F.col("top1").alias("t"), F.col("mrr").alias("m")), F.lit(True))  # one row each
    return both.select("queries", (F.col("top1") >= F.col("t")).alias("top1_not_below_rule"), (F.col("mrr") >= F.col("m") - 1e-12).alias("mrr_not_below_rule"))


_HELD = f"SELECT count(*) AS queries, true AS top1_not_below_rule, true AS mrr_not_below_rule FROM ({ASKED_SQL}) WHERE query_id % 5 = 0"


@Q.add(_HELD)
def learned_ranker(spark, d):
    """The linear ranker, fitted on all records to learn from, on the held-out ones."""
    learn, held = _split(spark, d)
    return _not_below_rule(E.apply_weights(held, E.train_on_all(learn)), held)


@Q.add(_HELD)
def attention_ranker(spark, d):
    """The ranker with attention over path instances, fitted on the records of at most ``attention.SAMPLE`` questions."""
    walks = cut(attention.walk_table(*all_walked(spark, d), vocab.METAPATHS.values()))
    starts = asked(spark, d)
    learn, held = (attention.with_path_instances(r, starts, walks) for r in _split(spark, d))
    return _not_below_rule(attention.apply(held, attention.train(attention.sampled(learn))), held)


@Q.add("SELECT CAST(count(*) AS BIGINT) AS queries, CAST(sum(CAST(r = 1 AS INTEGER)) AS BIGINT) AS top1, CAST(floor(avg(1.0 / r) * 100000 + 0.25) AS BIGINT) AS mrr5 FROM (SELECT user_id, min(r) AS r FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS r FROM events) WHERE event_type = 'purchase' GROUP BY user_id)")
def ranker_mrr(spark, d):
    s = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("candidate"), (F.col("event_type") == "purchase").cast("int").alias("label"), F.col("value").alias("score"))
    m = E.rank_metrics(s)
    return m.select("queries", F.round(F.col("top1") * F.col("queries")).cast("long").alias("top1"), F.floor(F.col("mrr") * 100000 + 0.25).cast("long").alias("mrr5"))


@Q.add("""SELECT event_type, CAST(floor((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) * 100000 + 0.25) AS BIGINT) AS lo, CAST(floor((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) * 100000 + 0.25) AS BIGINT) AS hi
    FROM (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, avg(CAST(value > 50 AS INTEGER)) AS p FROM events GROUP BY event_type)""")
def wilson_ci(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("hits"))
    lo, hi = E.wilson(F.col("hits"), F.col("n"))
    return g.select("event_type", F.floor(lo * 100000 + 0.25).cast("long").alias("lo"), F.floor(hi * 100000 + 0.25).cast("long").alias("hi"))


@Q.add("SELECT coalesce(source, 'all') AS source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (source))")
def eval_summary(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return j.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good")).withColumn("source", F.coalesce("source", F.lit("all")))


@Q.add(f"""WITH {_CTX}, g AS (SELECT w1.v AS wv, w2.v AS wg FROM (VALUES (1), (2), (3), (4)) w1(v), (VALUES (1), (2), (3), (4)) w2(v)),
    s AS (SELECT wv, wg, query_id, event_type, row_number() OVER (PARTITION BY wv, wg, query_id ORDER BY score * CASE WHEN {_KIND} = 'vector' THEN wv ELSE wg END DESC, pos) AS rank FROM ctx, g),
    h AS (SELECT wv, wg, query_id, max(CAST(event_type = 'purchase' AS INTEGER)) AS hit FROM s WHERE rank <= 3 GROUP BY ALL) SELECT wv, wg, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS queries FROM h GROUP BY ALL""")
def weighted_grid(spark, d):
    grid = spark.range(1, 5).select(F.col("id").cast("int").alias("wv")).join(spark.range(1, 5).select(F.col("id").cast("int").alias("wg")), F.lit(True))
    c = _kinds(spark, d).join(F.broadcast(grid), F.lit(True))  # 16 weights
    c = c.withColumn("weighted", F.col("score") * F.when(F.col("kind") == "vector", F.col("wv")).otherwise(F.col("wg")))
    top = R.top_k(c, ["wv", "wg", "query_id"], [F.desc("weighted"), F.asc("pos")], 3)
    h = top.groupBy("wv", "wg", "query_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("hit"))
    return h.groupBy("wv", "wg").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("queries"))


@Q.add(f"""WITH q AS (SELECT item_id, list_sort({_QTOK.format(t='text')})[1:3] AS terms FROM benchmark) SELECT item_id, CAST(sum(CAST(list_has_all(toks, terms) AS INTEGER)) AS BIGINT) AS docs FROM q, (SELECT list_distinct({_TOKENS.format(t='text')}) AS toks FROM documents) GROUP BY item_id""")
def retrieval_hits(spark, d):
    terms = table(spark, d, "benchmark").select("item_id", F.slice(F.array_sort(T.query_tokens(F.col("text"))), 1, 3).alias("terms"))
    want = terms.select("item_id", F.size("terms").alias("need"), F.explode("terms").alias("token"))
    have = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.ascii_tokens(F.col("text")))).alias("token"))
    met = have.join(want, "token").groupBy("item_id", "doc_id", "need").count().where("count = need").groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))
    return terms.select("item_id").join(met, "item_id", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))


@Q.add()
def name_ratio(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("a"))
    return n.join(F.broadcast(n.select(F.col("a").alias("b"))), F.lit(True)).select("a", "b", S.name_ratio(F.col("a"), F.col("b")).alias("ratio"))  # 25 nations


@Q.add("SELECT p_type AS mention, p_type AS name FROM part GROUP BY p_type")
def name_matches(spark, d):
    names = table(spark, d, "part").select(F.col("p_type").alias("name"))
    return R.name_matches(names.select(F.col("name").alias("mention")), names, least=0.999).select("mention", "name")


_NAMES = "SELECT p_type AS name FROM part UNION SELECT p_name FROM part UNION SELECT c_name FROM customer"
_VEC = f"""names AS ({_NAMES}), t AS (SELECT name, {_TOKENS.format(t='name')} AS toks FROM names),
    f AS (SELECT name, unnest(list_concat(toks, list_transform(range(1, greatest(len(array_to_string(toks, '')) - 1, 1)), lambda i: substr(array_to_string(toks, ''), i, 3)))) AS feature FROM t),
    p AS (SELECT name, unnest(list_transform([0, 4, 8, 12], lambda o: [CAST(('0x' || substr(sha256(feature), 2 * o + 1, 8)) AS BIGINT) % 768, CASE WHEN CAST(('0x' || substr(sha256(feature), 2 * (o + 16) + 1, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END])) AS p FROM f),
    v AS (SELECT name, p[1] AS i, CAST(sum(p[2]) AS BIGINT) AS x FROM p GROUP BY ALL), len AS (SELECT name, sum(x * x) AS s FROM v GROUP BY name)"""


@Q.add(f"""WITH {_VEC}, dots AS (SELECT a.name AS mention, b.name, sum(a.x * b.x) AS dot FROM v a JOIN v b ON a.i = b.i WHERE a.name IN (SELECT p_type FROM part UNION SELECT p_name FROM part) GROUP BY ALL),
    s AS (SELECT mention, d.name, CAST(dot AS DOUBLE) / sqrt(CAST(m.s * n.s AS DOUBLE)) AS score FROM dots d JOIN len m ON m.name = mention JOIN len n ON n.name = d.name)
    SELECT mention, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, name) AS rank FROM s WHERE score >= 0.8) WHERE rank <= 3""")
def name_matches_near(spark, d):
    """The names and types of all parts against all names of parts, types and customers."""
    part, customer = table(spark, d, "part"), table(spark, d, "customer")
    asked = part.select(F.col("p_type").alias("name")).unionByName(part.select(F.col("p_name").alias("name"))).distinct()
    names = asked.unionByName(customer.select(F.col("c_name").alias("name"))).distinct()
    return R.name_matches(asked.select(F.col("name").alias("mention")), names).select("mention", "name", "rank")


@Q.add(f"""WITH {_CTX}, c AS (SELECT query_id, pos, score, md5(lower(event_type || ' ' || (event_id % 9))) AS key, CASE WHEN {_KIND} = 'vector' THEN 0 ELSE 1 END AS branch_ord FROM ctx WHERE {_KIND} <> 'multimodal'),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY branch_ord, pos) AS rn FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, branch_ord ORDER BY score DESC, pos) AS rank FROM f WHERE rn = 1)
    SELECT query_id, key, branch_ord, rank FROM r""")
def two_branch(spark, d):
    c = _kinds(spark, d).withColumn("content", F.concat("event_type", F.lit("  "), (F.col("pos") % 9).cast("string")))
    return R.two_branch(c).select("query_id", "key", "branch_ord", "rank")
