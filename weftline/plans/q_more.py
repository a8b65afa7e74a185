"""Queries over graph evidence, ingestion steps, reports and running streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline import vocab
from weftline.operators import evaluate as E
from weftline.operators import graph as G
from weftline.operators import ingest
from weftline.operators import retrieval as R
from weftline.operators import routing
from weftline.plans.book import Book
from weftline.plans.fixtures import CORPORATE, ENTITIES_SQL, QUESTIONS_SQL, SQL, edges_sql, entities, questions, relations, table
from weftline.plans.q_answers import _ALL_WALKS, _paths
from weftline.plans.q_graph import _walk_sql, _walks
from weftline.plans.q_rank import _ROUTE, _SIM, _vectors
from weftline.shared import shared_folder
from weftline.streaming import cdc

Q = Book()

# ---------------------------------------------------------------- evidence and search

_AROUND = f"""e AS MATERIALIZED ({edges_sql("holds", *CORPORATE)}), und AS MATERIALIZED (SELECT head AS source, relation, tail AS target FROM e UNION ALL SELECT tail, relation, head FROM e),
    q AS MATERIALIZED ({QUESTIONS_SQL}), p AS MATERIALIZED (SELECT DISTINCT start FROM q WHERE start <> ''), n AS MATERIALIZED ({ENTITIES_SQL}),
    h1 AS MATERIALIZED (SELECT start, 1 AS hop, source, relation, target FROM p JOIN und ON start = source), f AS MATERIALIZED (SELECT DISTINCT start, target AS node FROM h1 WHERE target <> start),
    h AS MATERIALIZED (SELECT * FROM h1 UNION ALL SELECT start, 2, source, relation, target FROM f JOIN und ON node = source)"""


@Q.add(f"WITH {_AROUND} SELECT query_id, q.start AS entity, hop, source || ' --[' || relation || ']--> ' || target || ' (' || type || '): ' AS content, contains(lower(question), lower(target)) AS asked FROM q JOIN h ON q.start = h.start JOIN n ON target = name")
def subgraph_evidence(spark, d):
    linked = questions(spark).where("start <> ''").select("query_id", "question", F.col("start").alias("entity"))
    got = R.subgraph_evidence(linked, relations(spark, d, "holds", *CORPORATE), entities(spark, d))
    # the fixed parts of the score are 0.4 and 0.2 / 3; a target that is asked for adds 0.04 and the shared words up to 0.2
    target = F.regexp_extract("content", r"--> (.*) \([A-Za-z]+\): $", 1)
    asked = F.contains(F.lower("question"), F.lower(target)) & F.col("score").between(0.4 + 0.2 / 3 + 0.04, 1.0)
    return got.join(linked.select("query_id", "question"), "query_id").select("query_id", "entity", "hop", "content", asked.alias("asked"))


@Q.add(f"SELECT name, type FROM ({ENTITIES_SQL}) WHERE contains(lower(name), 'regi') OR contains(lower(type), 'regi') ORDER BY name LIMIT 20")
def search_entities(spark, d):
    return R.search_entities(entities(spark, d).withColumn("description", F.col("type")), "REGI").select("name", "type")


@Q.add(f"SELECT name FROM ({ENTITIES_SQL}) ORDER BY name LIMIT 1000")
def entity_names(spark, d):
    return R.entity_names(entities(spark, d))


@Q.add(f"""WITH n AS (SELECT s_name, s_nationkey FROM supplier), o AS ({SQL['owns']})
    SELECT a.s_nationkey AS nation, count(*) AS inside FROM o JOIN n a ON head = a.s_name JOIN n b ON tail = b.s_name AND a.s_nationkey = b.s_nationkey GROUP BY 1""")
def useful_communities(spark, d):
    """Suppliers of a nation as a community; those with no ownership inside say nothing."""
    s = table(spark, d, "supplier").select("s_name", F.col("s_nationkey").alias("component"))
    groups = s.groupBy("component").agg(F.array_sort(F.collect_set("s_name")).alias("members"))
    inside = relations(spark, d, "owns").join(s.select(F.col("s_name").alias("head"), "component"), "head").join(s.select(F.col("s_name").alias("tail"), "component"), ["tail", "component"])
    text = F.concat("head", F.lit(" -["), F.upper("relation"), F.lit("]-> "), "tail")
    rels = inside.groupBy("component").agg(F.array_sort(F.collect_set(text)).alias("relations"))
    c = groups.join(rels, "component", "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<string>")))
    c = c.withColumn("summary", G.summary(F.col("members"), F.col("relations")))
    return R.useful_communities(c).select(F.col("component").alias("nation"), F.size("relations").cast("long").alias("inside"))


def _instances_sql(m: vocab.Metapath) -> str:
    hashed = lambda x: f"substr(sha256({x}), 1, 16)"
    (_, r1, _, _), (_, r2, _, _) = m.steps
    one, two = hashed(f"start || '|{r1.upper()}|' || mid"), hashed(f"mid || '|{r2.upper()}|' || \"end\"")
    return f"SELECT '{m.name}' AS metapath, {hashed(f"'{m.name}|' || {one} || '|' || {two}")} AS instance_id, {hashed('start')} AS start_id, start || '>' || mid || '>' || \"end\" AS nodes FROM ({_walk_sql(m)})"


_SECTOR = vocab.METAPATHS["sector_exposure"]


@Q.add(_instances_sql(_SECTOR))
def metapath_instances(spark, d):
    made = G.path_instances(entities(spark, d), relations(spark, d, "holds", "belongs_to"), _SECTOR, limit=None)
    return made.select("metapath", "instance_id", "start_id", F.array_join("nodes", ">").alias("nodes"))


@Q.add(f"SELECT metapath, start_id, nodes FROM ({_instances_sql(vocab.METAPATHS['subsidiary_chain'])}) ORDER BY string_split(nodes, '>') LIMIT 1000")
def metapath_instances_limited(spark, d):
    m = vocab.METAPATHS["subsidiary_chain"]
    return G.path_instances(entities(spark, d), relations(spark, d, "owns"), m).select("metapath", "start_id", F.array_join("nodes", ">").alias("nodes"))


@Q.add(f"SELECT query_id, count(*) AS instances FROM ({QUESTIONS_SQL}) JOIN ({_instances_sql(_SECTOR)}) ON start_id = substr(sha256(start), 1, 16) GROUP BY query_id")
def question_instances(spark, d):
    made = G.path_instances(entities(spark, d), relations(spark, d, "holds", "belongs_to"), _SECTOR, limit=None)
    asked = questions(spark).select("query_id", F.array(F.substring(F.sha2(F.col("start").cast("binary"), 256), 1, 16)).alias("start_ids"))
    return E.question_instances(asked, made).groupBy("query_id").agg(F.count(F.lit(1)).alias("instances"))


@Q.add("""SELECT c_custkey % 50 AS query_id, c_name AS content, kind, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY score DESC, part, c_custkey) AS place FROM (
    SELECT c_custkey, c_name, round(c_acctbal) AS score, 'vector' AS kind, 0 AS part FROM customer UNION ALL SELECT c_custkey, 'table ' || c_name, round(c_acctbal / 2), 'multimodal', 1 FROM customer WHERE c_custkey % 3 = 0)""")
def multimodal_enrichment(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("query_id"), F.col("c_name").alias("content"), F.lit("doc").alias("source"), F.round("c_acctbal").alias("score"), F.lit("vector").alias("kind"), F.col("c_custkey").alias("pos"), "c_acctbal")
    found = c.where("pos % 3 = 0").withColumns({"content": F.concat(F.lit("table "), "content"), "score": F.round(F.col("c_acctbal") / 2)})
    return R.enrich(c.drop("c_acctbal"), found).select("query_id", "content", "kind", "place")


@Q.add(f"SELECT query_id, id, place FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY greatest(0, {_SIM}) DESC, e.vec_id) AS place FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id % 7 <> 0) WHERE place <= 5")
def visible_topk(spark, d):
    q, e = _vectors(spark, d)
    e = e.withColumn("source", F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit("#chunk-0")))
    reg = e.select(F.substring_index("source", "#chunk-", 1).alias("doc_id"), F.when(F.col("vec_id") % 7 == 0, "pending").otherwise("committed").alias("status"))
    return R.visible_vectors(q, e, reg, 5).select("query_id", F.col("vec_id").alias("id"), "place")


# ---------------------------------------------------------------- extraction and merge

_HINT = "(CASE doc_id % 3 WHEN 0 THEN 'Apple filing. ' WHEN 1 THEN 'The LCR of a bank. ' ELSE '' END)"


def _hinted(spark, d):
    k = F.col("doc_id") % 3
    hint = F.when(k == 0, "Apple filing. ").when(k == 1, "The LCR of a bank. ").otherwise("")
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(hint, F.coalesce("text", F.lit(""))).alias("content"), "source")


@Q.add(f"""WITH t AS (SELECT doc_id AS chunk_id, lower(substr({_HINT} || coalesce(text, ''), 1, 200)) AS h FROM documents), k AS (SELECT chunk_id, CASE WHEN contains(h, 'apple') OR contains(h, 'aapl') THEN 0 WHEN contains(h, 'jpmorgan') OR contains(h, 'lcr') THEN 1 ELSE 2 END AS k FROM t),
    v(k, name, type, cents) AS (VALUES (0, 'Apple Inc', 'Company', 92), (0, 'Technology', 'Sector', 88), (0, 'Foxconn', 'Supplier', 85), (1, 'JPMorgan Chase', 'Company', 92), (1, 'Financial Services', 'Sector', 88), (1, 'United States', 'Region', 90), (2, 'Global Income Fund', 'Fund', 88), (2, 'Sample Corp', 'Company', 85), (2, 'Technology', 'Sector', 87))
    SELECT chunk_id, name, type, CAST(cents AS BIGINT) AS cents, 'Synthetic demo entity: ' || name AS description FROM k JOIN v USING (k)""")
def demo_extraction(spark, d):
    e = ingest.demo_extraction(_hinted(spark, d)).select("chunk_id", F.explode("entities").alias("e"))
    return e.select("chunk_id", "e.name", "e.type", F.round(F.col("e.confidence") * 100).cast("long").alias("cents"), "e.description")


@Q.add("SELECT source AS doc_id, count(*) AS chunks, count(*) * 3 AS entities, count(*) * 2 AS relations FROM documents GROUP BY source")
def ingest_counters(spark, d):
    made = ingest.demo_extraction(_hinted(spark, d)).join(_hinted(spark, d).select("chunk_id", "source"), "chunk_id")
    return ingest.ingest_counters(made.withColumn("doc_id", F.col("source"))).select("doc_id", "chunks", "entities", "relations")


@Q.add("""WITH r AS (SELECT l_partkey AS name, l_orderkey * 10000000 + l_linenumber * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS pos, CAST(l_suppkey AS VARCHAR) AS description, l_quantity AS confidence, l_returnflag AS k1, l_linestatus AS k2, l_orderkey AS v FROM lineitem),
    x AS (SELECT *, coalesce(row(length(description), confidence) > max(row(length(description), confidence)) OVER (PARTITION BY name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS wins FROM r),
    p AS (SELECT name, k, coalesce(max_by(v, pos) FILTER (WHERE wins), min_by(v, pos)) AS v FROM (SELECT name, pos, wins, k1 AS k, v FROM x UNION ALL SELECT name, pos, wins, k2, v FROM x) GROUP BY name, k)
    SELECT t.name, description, confidence, properties FROM (SELECT name, max_by(description, pos) AS description, CAST(max_by(confidence, pos) AS BIGINT) AS confidence FROM x WHERE wins GROUP BY name) t
    JOIN (SELECT name, string_agg(k || '=' || v, ',' ORDER BY k) AS properties FROM p GROUP BY name) USING (name)""")
def merge_properties(spark, d):
    pos = (F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("pos")
    v = F.col("l_orderkey").cast("string")
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), pos, F.col("l_suppkey").cast("string").alias("description"), F.col("l_quantity").alias("confidence"), F.map_from_arrays(F.array("l_returnflag", "l_linestatus"), F.array(v, v)).alias("properties"))
    m = ingest.merge_properties(rows)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.select("name", "description", F.col("confidence").cast("long").alias("confidence"), shown.alias("properties"))


@Q.add("SELECT user_id AS name, event_id AS seq, CASE WHEN user_id % 3 = 0 THEN user_id % 5 ELSE 0 END + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events")
def next_versions(spark, d):
    e = table(spark, d, "events")
    stored = e.where("user_id % 3 = 0").select(F.col("user_id").alias("name"), (F.col("user_id") % 5).alias("version")).distinct()
    return ingest.next_versions(stored, e.select(F.col("user_id").alias("name"), F.col("event_id").alias("seq")))


# ---------------------------------------------------------------- steps of ingestion and update


@Q.add("SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'failed' ELSE 'committed' END AS status, doc_id % 4 <> 2 AS shown FROM documents")
def ingest_step(spark, d):
    """Four batches are stored; the graph writer of one breaks after its vectors were written."""
    home = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#chunk-0")).alias("source"))
    for k in range(4):
        vectors = f"{home}/vectors/batch={k}"

        def graph(batch, k=k):
            if k == 2:
                raise RuntimeError("the graph cannot be reached")
            batch.write.mode("overwrite").parquet(f"{home}/graph/batch={k}")

        # an undo leaves the folder of its batch without a row
        undo = lambda batch, v=vectors: batch.limit(0).write.mode("overwrite").parquet(v)
        ingest.store_step(docs.where(F.col("doc_id") % 4 == k), {"vectors": (lambda batch, v=vectors: batch.write.mode("overwrite").parquet(v), undo), "graph": (graph, lambda batch: None)}, f"{home}/log", 10 * k)
    state = ingest.registry_state(spark.read.parquet(f"{home}/log"))
    reg = state.select(F.col("doc_id").cast("string").alias("doc_id"), "status")
    shown = G.visible(spark.read.parquet(f"{home}/vectors"), reg).select("doc_id", F.lit(True).alias("shown"))
    return state.join(shown, "doc_id", "left").select("doc_id", "status", F.coalesce("shown", F.lit(False)).alias("shown"))


@Q.add("SELECT doc_id, doc_id % 5 <> 0 OR doc_id % 10 = 0 AS success, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS tries FROM documents")
def update_retry(spark, d):
    calls = []

    def run(changes):
        calls.append(1)
        ok = F.col("doc_id") % 5 != 0 if len(calls) == 1 else F.col("doc_id") % 10 == 0
        return changes.select("doc_id", ok.alias("success"))

    return ingest.with_retry(table(spark, d, "documents").select("doc_id"), run)


_EVENTS = "SELECT user_id AS doc_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'committed' WHEN 'error' THEN 'failed' END AS status, event_id FROM events WHERE event_type IN ('signup', 'purchase', 'error')"


@Q.add(f"SELECT doc_id, CAST(sum(CAST(status = 'failed' AS INTEGER)) AS BIGINT) + 1 AS retry_count FROM ({_EVENTS}) WHERE doc_id % 2 = 1 AND doc_id % 3 <> 0 GROUP BY doc_id HAVING max_by(status, event_id) = 'failed'")
def dead_letter_retry(spark, d):
    """Dead documents of even ids are cleared, all others tried again; every third succeeds."""
    from weftline.plans.q_changes import _log

    log = _log(spark, d)
    dead = ingest.dead_letters(log)
    log = ingest.clear_letters(log, dead.where("doc_id % 2 = 0"), 10**9)
    log = ingest.retry_letters(log, ingest.dead_letters(log), lambda docs: docs.select("doc_id", (F.col("doc_id") % 3 == 0).alias("success")), 10**9 + 1)
    return ingest.dead_letters(log).select("doc_id", "retry_count")


@Q.add("""SELECT user_id AS event_id, CAST(sum(CASE event_type WHEN 'signup' THEN event_id % 4 WHEN 'error' THEN -(event_id % 4) ELSE 0 END) AS BIGINT) AS chunks_affected,
    CAST(sum(CASE event_type WHEN 'purchase' THEN event_id % 4 WHEN 'click' THEN event_id % 4 ELSE 0 END) AS BIGINT) AS entities_updated FROM events GROUP BY user_id""")
def update_counters(spark, d):
    t = F.col("event_type")
    e = table(spark, d, "events").select(
        F.col("user_id").alias("event_id"), F.when(t.isin("signup", "error"), "chunk").when(t.isin("purchase", "click"), "entity").otherwise("other").alias("kind"),
        F.when(t.isin("signup", "purchase"), "added").when(t == "error", "deleted").otherwise("updated").alias("action"), (F.col("event_id") % 4).alias("n"),
    )
    return ingest.update_counters(e)


@Q.add("SELECT event_id, upper(op) AS operation, 't' || (user_id % 3) AS resource, upper(op) IN ('DELETE', 'D') AS gone FROM (SELECT event_id, user_id, (['insert', 'U', 'delete', 'd'])[event_id % 4 + 1] AS op FROM events)")
def manual_update(spark, d):
    e = table(spark, d, "events")
    op = F.element_at(F.array(*map(F.lit, ["insert", "U", "delete", "d"])), (F.col("event_id") % 4 + 1).cast("int"))
    m = e.select(ingest.manual_event(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")), op, F.col("event_id").cast("string")).alias("value"))
    m = cdc.from_messages(m)
    image = F.coalesce(F.try_element_at("before", F.lit("content")), F.try_element_at("after", F.lit("content")))
    return m.select(image.cast("long").alias("event_id"), "operation", "resource", F.col("before").isNotNull().alias("gone"))


@Q.add("SELECT 'c' || (vec_id % 3) AS name, CAST(sum(CASE WHEN vec_id % 3 = 1 AND label % 2 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n FROM embeddings GROUP BY 1")
def collection_delete(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("embedding_id"), (F.col("vec_id") % 3).alias("collection_id"), F.col("label").alias("doc_id"))
    names = e.select("collection_id", F.concat(F.lit("c"), F.col("collection_id").cast("string")).alias("name")).distinct()
    gone = e.where("doc_id % 2 = 0").select("doc_id").distinct()
    return ingest.count_collection(ingest.delete_collection(e, names, "c1", gone), names)


# ---------------------------------------------------------------- reports


@Q.add(f"""WITH {_ROUTE}, w AS MATERIALIZED (SELECT metapath, start, "end" FROM ({_ALL_WALKS}) WHERE start IN (SELECT start FROM qs)),
    want AS (SELECT qs.query_id, expected, list_distinct(list("end") FILTER (WHERE "end" IS NOT NULL) || CASE WHEN qs.query_id % 2 = 0 THEN ['Nowhere'] ELSE [] END) AS ends FROM qs LEFT JOIN w ON w.start = qs.start AND w.metapath = expected GROUP BY qs.query_id, expected),
    sel AS (SELECT query_id, list(metapath) AS s, min_by(metapath, rank) AS top FROM routed GROUP BY query_id),
    got AS (SELECT qs.query_id, list_distinct(list("end") FILTER (WHERE routed.metapath IS NOT NULL)) AS r, list_distinct(list("end") FILTER (WHERE w.metapath = expected)) AS o FROM qs JOIN w ON w.start = qs.start LEFT JOIN routed ON routed.query_id = qs.query_id AND routed.metapath = w.metapath GROUP BY qs.query_id),
    x AS (SELECT coalesce(list_contains(s, expected), false) AS hit, coalesce(top = expected, false) AS top1, coalesce(len(s), 0) AS n,
        round(coalesce(len(list_intersect(coalesce(ends, []), coalesce(r, []))), 0) / greatest(coalesce(len(ends), 0), 1), 3) AS rr, round(coalesce(len(list_intersect(coalesce(ends, []), coalesce(o, []))), 0) / greatest(coalesce(len(ends), 0), 1), 3) AS oo FROM want LEFT JOIN sel USING (query_id) LEFT JOIN got USING (query_id))
    SELECT count(*) AS total, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS router_hits, CAST(round(avg(CAST(top1 AS INTEGER)) * 1000) AS BIGINT) AS top1, CAST(round(avg(CASE WHEN hit THEN round(1 / n, 3) ELSE 0 END) * 1000) AS BIGINT) AS precision,
        CAST(round(avg(n) * 1000) AS BIGINT) AS selected, CAST(sum(CAST(rr = 1 AS INTEGER)) AS BIGINT) AS routed_path_hits, CAST(sum(CAST(oo = 1 AS INTEGER)) AS BIGINT) AS oracle_path_hits FROM x""")
def router_report(spark, d):
    q = questions(spark)
    routed = routing.route(q).select("query_id", "metapath", "rank")
    own = q.select("query_id", F.col("expected").alias("metapath"))
    walks = G.durable(_paths(spark, d, routed.select("query_id", "metapath").unionByName(own).distinct()).select("query_id", "metapath", "end").distinct())
    ends = own.join(walks, ["query_id", "metapath"], "left").groupBy("query_id", "metapath").agg(F.collect_set("end").alias("ends"))
    extra = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("Nowhere"))).otherwise(F.array().cast("array<string>"))
    r = E.router_report(routed, ends.withColumn("ends", F.concat("ends", extra)), walks)
    mille = lambda c: F.round(F.col(c) * 1000).cast("long")
    return r.select("total", "router_hits", mille("router_top1_hit_rate").alias("top1"), mille("average_router_precision").alias("precision"), mille("average_selected_metapaths").alias("selected"), "routed_path_hits", "oracle_path_hits")


_ITEMS = """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'insufficient' ELSE 'fact' || (turn % 2) END AS answer_type, lower(CASE WHEN conv_id % 5 = 0 THEN 'This is NOT enough.' ELSE coalesce(text, '') END) AS answer, lower(coalesce(role, '')) AS sources FROM conversations"""


@Q.add(f"""WITH i AS ({_ITEMS}), s AS (SELECT answer_type, sources = 'user' AS source_hit, contains(sources, 'e') AS evidence_hit, CASE WHEN answer_type = 'insufficient' THEN contains(answer, 'not enough') ELSE contains(answer, 'the') END AS point_hit, answer_type <> 'insufficient' OR contains(answer, 'not enough') AS sure FROM i)
    SELECT coalesce(answer_type, 'all') AS answer_type, count(*) AS total, CAST(round(1000 * avg(CAST(source_hit AND evidence_hit AND point_hit AND sure AS INTEGER))) AS BIGINT) AS passed, CAST(round(1000 * avg(CAST(source_hit AS INTEGER))) AS BIGINT) AS source_hit,
    CAST(round(1000 * avg(CAST(evidence_hit AS INTEGER))) AS BIGINT) AS evidence_hit, CAST(round(1000 * avg(CAST(point_hit AS INTEGER))) AS BIGINT) AS answer_point_hit FROM s GROUP BY ROLLUP (answer_type)""")
def answer_report(spark, d):
    kind = F.when(F.col("turn") % 4 == 0, "insufficient").otherwise(F.concat(F.lit("fact"), (F.col("turn") % 2).cast("string")))
    none = F.array().cast("array<string>")
    items = table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), kind.alias("answer_type"), F.when(F.col("conv_id") % 5 == 0, "This is NOT enough.").otherwise(F.col("text")).alias("answer"), F.col("role").alias("sources"),
        F.array(F.lit("USER"), F.lit("nobody")).alias("expected_sources"), F.array(F.lit("E")).alias("expected_terms"), F.when(kind == "insufficient", none).otherwise(F.array(F.lit("The"))).alias("expected_points"),
    )
    r = E.answer_report(E.score_answers(items))
    mille = lambda c: F.round(F.col(f"{c}_rate") * 1000).cast("long").alias(c)
    return r.select(F.coalesce("answer_type", F.lit("all")).alias("answer_type"), "total", *map(mille, ("passed", "source_hit", "evidence_hit", "answer_point_hit")))


@Q.add(f"SELECT (SELECT count(*) FROM ({ENTITIES_SQL})) AS entities, (SELECT count(*) FROM ({edges_sql('owns')})) AS relations, (SELECT count(*) FROM ({_walk_sql(vocab.METAPATHS['subsidiary_chain'])})) AS instances, CAST(12 AS BIGINT) AS queries, 'all_metapaths' AS blockers, false AS ready")
def readiness(spark, d):
    e, r = entities(spark, d), relations(spark, d, "owns")
    walks = _walks(spark, d, vocab.METAPATHS["subsidiary_chain"]).select(F.lit("subsidiary_chain").alias("metapath"))
    records = E.training_records(questions(spark)).select("query_id", "candidate", "label")
    return E.readiness(e, r, walks, records).select("entities", "relations", "instances", "queries", F.array_join("blockers", ",").alias("blockers"), "ready")


@Q.add("SELECT feature, cents FROM (SELECT event_type || user_id AS feature, CAST(sum(CAST(round(value * 100) AS BIGINT) - 5000) AS BIGINT) AS cents FROM events GROUP BY 1) ORDER BY abs(cents) DESC, feature LIMIT 10")
def top_weights(spark, d):
    w = table(spark, d, "events").groupBy(F.concat("event_type", F.col("user_id").cast("string")).alias("feature")).agg(F.sum(F.round(F.col("value") * 100).cast("long") - 5000).alias("weight"))
    return E.top_weights(w).select("feature", F.col("weight").alias("cents"))


# ---------------------------------------------------------------- a running stream


@Q.add("SELECT event_type AS path, count(*) AS count, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, max_by(CAST(round(value * 100) AS BIGINT), event_id) AS last FROM events GROUP BY event_type")
def stream_request_metrics(spark, d):
    from weftline.plans.q_changes import _stream

    e = _stream(spark, d).select(F.col("event_type").alias("path"), F.round(F.col("value") * 100).cast("long").alias("duration"), F.col("event_id").alias("seq"))
    return cdc.stream_to_table(spark, cdc.request_metrics(e), "update", ["path"])
