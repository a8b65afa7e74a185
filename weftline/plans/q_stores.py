"""Queries over stores: keyed tables, a watched folder, the vector index, labels kept up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.operators import graph as G
from weftline.operators import ingest
from weftline.operators import retrieval as R
from weftline.operators.postings import PostingIndex
from weftline.operators.vector_index import VectorIndex
from weftline.plans.book import Book
from weftline.plans.fixtures import CORPORATE, SQL, edges_sql, relations, table
from weftline.plans.q_rank import _LEX, _SIM, _bench, _vectors
from weftline.plans.q_text import _QTOK, _TOKENS
from weftline.shared import shared_folder
from weftline.sources import keyed, parse, watch

Q = Book()


def _home(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- keyed tables

_NEW_TEXT = "CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END"


@Q.add(f"SELECT doc_id, 0 AS chunk_index, sha256(coalesce({_NEW_TEXT}, '')) AS hash, source FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 11 <> 0 OR doc_id % 5 = 0)")
def stored_chunks(spark, d):
    """Chunks are stored, some replaced and some added, and some documents deleted; then the store is read."""
    docs = table(spark, d, "documents")
    store = keyed.chunk_store(spark, _home(spark, "chunks"), 16)
    rows = lambda t, df: df.select("doc_id", F.lit(0).alias("chunk_index"), t.alias("content"), "source")
    store.upsert(rows(F.col("text"), docs.where("doc_id % 11 <> 0")))
    store.upsert(rows(F.concat("text", F.lit(".")), docs.where("doc_id % 5 = 0")))
    store.delete(docs.where("doc_id % 7 = 0").select("doc_id"))
    return store.read().select("doc_id", "chunk_index", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("hash"), "source")


_CORP = edges_sql(*CORPORATE)


@Q.add(f"""WITH gone AS (SELECT s_name FROM supplier WHERE s_nationkey = 3), known AS (SELECT s_name AS name FROM supplier UNION SELECT n_name FROM nation UNION SELECT 'Rule ' || r_name FROM region)
    SELECT head, relation, tail, (SELECT count(*) FROM gone) AS deleted FROM (({SQL['located_in']}) UNION ALL ({SQL['subject_to']}) UNION ALL ({SQL['works_at']}))
    WHERE head IN (FROM known) AND tail IN (FROM known) AND head NOT IN (FROM gone) AND tail NOT IN (FROM gone)""")
def stored_graph(spark, d):
    """Entities and relations are stored, relations of unknown ends refused, and one source deleted with its relations."""
    t = lambda n: table(spark, d, n)
    store = keyed.GraphStore(spark, _home(spark, "graph"), 16)
    ent = lambda df, c, kind, source: df.select(F.col(c).alias("name"), F.lit(kind).alias("type"), source.alias("source"))
    base = F.lit("base.csv#chunk-0")
    store.upsert_entities(ent(t("supplier"), "s_name", "Company", F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("#chunk-0"))))
    rules = t("region").select(F.concat(F.lit("Rule "), "r_name").alias("r"))
    store.upsert_entities(ent(t("nation"), "n_name", "Region", base).unionByName(ent(rules, "r", "Regulation", base)))
    store.upsert_relations(relations(spark, d, "located_in", "subject_to", "works_at").withColumn("source", base))
    n = store.delete_by_source(G.source_matches(F.col("source"), "nation3", "-"))
    return store.relations.read().select("head", "relation", "tail", F.lit(n).cast("long").alias("deleted"))


# ---------------------------------------------------------------- a watched folder


@Q.add("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'created' WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE (doc_id % 11 = 0 AND doc_id % 7 <> 0) OR (doc_id % 7 = 0 AND doc_id % 11 <> 0) OR (doc_id % 5 = 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0)")
def watched_documents(spark, d):
    """The documents as files of a watched folder, changed in a second step: what the second look finds."""
    folder, home = _home(spark, "watched"), _home(spark, "watch")
    docs = table(spark, d, "documents")
    name = F.concat((F.col("doc_id") % 10).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name")
    text = F.concat(F.lit("text\n"), F.coalesce("text", F.lit("")))  # an empty file is no file
    new = F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.lit("."))).otherwise(text)
    watch.write_files(docs.where("doc_id % 11 <> 0").select(name, text.alias("content")), folder)
    watch.poll(spark, folder, home)
    watch.write_files(docs.select(name, F.when(F.col("doc_id") % 7 != 0, new).alias("content")), folder)
    found = watch.poll(spark, folder, home)
    return found.select(F.regexp_extract("path", r"(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), "change")


# ---------------------------------------------------------------- files of all kinds

_LINES = "SELECT s_nationkey, 'Name: ' || s_name || ' | Key: ' || s_suppkey AS line, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 20 AS part, s_suppkey FROM supplier"


@Q.add(f"""SELECT 'n' || s_nationkey || '.csv' AS name, 'table' AS doc_type, CAST(part AS INTEGER) AS part, 'Headers: Name | Key' || chr(10) || string_agg(line, chr(10) ORDER BY s_suppkey) AS text, false AS failed FROM ({_LINES}) GROUP BY s_nationkey, part
    UNION ALL SELECT 'd' || item_id || '.md', 'markdown', 0, text, false FROM benchmark WHERE text <> ''
    UNION ALL SELECT 'r' || r_regionkey || '.pdf', 'pdf', 0, '[PDF parsing failed]', true FROM region
    UNION ALL SELECT 'x' || r_regionkey || '.xlsx', 'table', 0, '[Table parsing failed]', true FROM region""")
def parsed_files(spark, d):
    """Tables of suppliers, benchmark texts and files that no reader can read, parsed by type."""
    t = lambda n: table(spark, d, n)
    folder = _home(spark, "files")
    name = lambda mark, key, ext: F.concat(F.lit(mark), F.col(key).cast("string"), F.lit(ext)).alias("name")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.concat(x["s_name"], F.lit(","), x["s_suppkey"].cast("string"))), "\n")
    rows = t("supplier").groupBy("s_nationkey").agg(F.concat(F.lit("Name,Key\n"), lines).alias("content")).select(name("n", "s_nationkey", ".csv"), "content")
    rows = rows.unionByName(t("benchmark").select(name("d", "item_id", ".md"), F.col("text").alias("content")))
    for mark, ext in (("r", ".pdf"), ("x", ".xlsx")):
        rows = rows.unionByName(t("region").select(name(mark, "r_regionkey", ext), F.col("r_name").alias("content")))
    watch.write_files(rows, folder)
    got = parse.parse_files(spark, folder)
    return got.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "doc_type", "part", F.regexp_replace("text", r"(?s)^(\[\w+ parsing failed\]).*", "$1").alias("text"), F.col("error").isNotNull().alias("failed"))


# ---------------------------------------------------------------- vectors and candidates


@Q.add("SELECT count(*) AS queries, true AS found_nine_of_ten, (SELECT count(*) FROM embeddings) AS indexed FROM embeddings WHERE vec_id % 50 = 0")
def index_recall(spark, d):
    """The inverted-file index over all vectors, asked with every vector whose id is divisible by 50, against the exact search."""
    q, e = _vectors(spark, d)
    path = _home(spark, "index")
    index = VectorIndex.build(e, path)
    near, exact = index.search(q, 5), R.vector_search(q, e, 5)
    met = exact.join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    one = met.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("found_nine_of_ten"))
    return one.join(spark.read.parquet(f"{path}/vectors").agg(F.count(F.lit(1)).alias("indexed")), F.lit(True))


@Q.add(f"SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY greatest(0, {_SIM}) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE rank <= 5")
def index_topk_all_cells(spark, d):
    """The index with every cell probed is exact."""
    q, e = _vectors(spark, d)
    index = VectorIndex.build(e, _home(spark, "index"))
    return index.search(q, 5, index.lists).select("query_id", "vec_id", "rank")


@Q.add(f"""WITH q AS (SELECT e.vec_id AS query_id, e.embedding, {_QTOK.format(t='d.text')} AS toks FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 50 = 0),
    near AS (SELECT q.query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.query_id ORDER BY greatest(0, {_SIM}) DESC, e.vec_id) AS rank FROM q, embeddings e WHERE e.vec_id % 7 <> 0),
    w AS (SELECT query_id, unnest(toks) AS tok FROM q), c AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format(t='text')})) AS tok FROM documents WHERE doc_id % 7 <> 0),
    h AS (SELECT query_id, doc_id, count(*) AS hits FROM c JOIN w USING (tok) GROUP BY ALL), lex AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM h)
    SELECT query_id, id, 'vector' AS kind FROM near WHERE rank <= 40 UNION ALL SELECT query_id, doc_id, 'lexical' FROM lex WHERE rank <= 5""")
def visible_candidates(spark, d):
    """Vectors and, beside them, texts of committed documents, for the documents whose id is divisible by 50."""
    q, e = _vectors(spark, d)
    docs = table(spark, d, "documents")
    asked = q.join(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    source = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"), F.lit("#chunk-0"))
    e, texts = e.withColumn("source", source("vec_id")), docs.select("doc_id", "text").withColumn("source", source("doc_id"))
    ids = e.select(F.col("vec_id").alias("i")).unionByName(docs.select(F.col("doc_id").alias("i"))).distinct()
    reg = ids.select(F.concat(F.lit("v"), F.col("i").cast("string")).alias("doc_id"), F.when(F.col("i") % 7 == 0, "pending").otherwise("committed").alias("status"))
    return R.visible_candidates(asked, e, texts, reg, 5).select("query_id", "id", "kind")


# ---------------------------------------------------------------- postings

_TOP = "SELECT query_id, doc_id, CAST(n AS BIGINT) AS n_tokens, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM h) WHERE rank <= 20"
_AFTER = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' benchmark' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"


def _top(df):
    return df.select("query_id", "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "hits", "rank")


@Q.add(f"WITH {_LEX} {_TOP}")
def posting_topk(spark, d):
    """Lexical search in stored postings."""
    index = PostingIndex(spark, _home(spark, "postings"))
    index.add(table(spark, d, "documents").select("doc_id", "text"))
    return _top(index.search(_bench(spark, d), 20))


@Q.add(f"WITH {_LEX.replace('FROM documents', f'FROM {_AFTER}')} {_TOP}")
def posting_topk_changed(spark, d):
    """The same after documents came, changed and went."""
    index = PostingIndex(spark, _home(spark, "postings"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    new = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" benchmark"))).otherwise(F.col("text")))
    old = docs.where("doc_id % 11 <> 0")
    index.add(old)
    hashed = lambda df: df.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    index.apply(ingest.changes(hashed(old), hashed(new)), new)
    return _top(index.search(_bench(spark, d), 20))


# ---------------------------------------------------------------- labels kept up

_OWNED = edges_sql("owns", "works_at")
_CUT = "relation = 'owns' AND right(tail, 1) IN ('1', '4', '7')"
_PLACES = f"SELECT head, tail FROM ({SQL['located_in']}) WHERE right(head, 1) = '3'"


@Q.add(f"""WITH RECURSIVE o AS ({_OWNED}), e AS (SELECT head, tail FROM o WHERE NOT ({_CUT}) UNION ALL {_PLACES}), n AS (SELECT head AS name FROM o UNION SELECT tail FROM o UNION SELECT tail FROM ({_PLACES}) UNION SELECT head FROM ({_PLACES})),
    u AS (SELECT head AS a, tail AS b FROM e UNION SELECT tail, head FROM e), reach(name, other) AS (SELECT name, name FROM n UNION SELECT reach.name, u.b FROM reach JOIN u ON u.a = reach.other)
    SELECT name, min(other) AS component FROM reach GROUP BY name""")
def components_kept_up(spark, d):
    """Components of ownership and work after edges were taken away and locations were added, from the labels before."""
    before = relations(spark, d, "owns", "works_at")
    removed = before.where(_CUT)
    added = relations(spark, d, "located_in").where("right(head, 1) = '3'")
    after = before.where(f"not ({_CUT})").unionByName(added)
    nodes = before.select(F.explode(F.array("head", "tail")).alias("name")).distinct()
    return G.refresh_components(G.connected_components(nodes, before), after, added, removed)
