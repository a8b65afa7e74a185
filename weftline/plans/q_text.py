"""Queries over texts: identifiers, tokens, keys, tables, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import similarity as S
from weftline.functions import text as T
from weftline.operators import chunk, ingest
from weftline.plans.book import Book
from weftline.plans.fixtures import table

Q = Book()
_STOP = "['and','for','the','their','what','which','did']"
_TOKENS = "regexp_extract_all(lower({t}), '[a-z0-9]+')"
_QTOK = f"list_filter(list_distinct(list_filter({_TOKENS}, lambda x: len(x) >= 3)), lambda x: NOT list_contains({_STOP}, x))"
_NORM = r"regexp_replace(trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')), '\s(incorporated|inc|corporation|corp|limited|ltd|llc|plc|ag|sa)$', '')"


@Q.add("SELECT page_id, substr(sha256(url), 1, 16) AS doc_key, sha256(html) AS content_hash FROM pages")
def doc_id_hash(spark, d):
    return table(spark, d, "pages").select("page_id", T.doc_id(F.col("url")).alias("doc_key"), F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"))


_EXTS = [".pdf", ".PNG", ".jpeg", ".csv", ".xlsx", ".md", ".txt", ".bin", ""]


@Q.add(
    f"""SELECT p_partkey, f AS path, CASE regexp_extract(lower(f), '(\\.[^./]+)$', 1) WHEN '.pdf' THEN 'pdf' WHEN '.png' THEN 'image' WHEN '.jpeg' THEN 'image'
        WHEN '.jpg' THEN 'image' WHEN '.csv' THEN 'table' WHEN '.xlsx' THEN 'table' WHEN '.xls' THEN 'table' WHEN '.txt' THEN 'text' WHEN '.md' THEN 'markdown' ELSE 'unknown' END AS doc_type
        FROM (SELECT p_partkey, 'd.1/' || p_name || ({_EXTS})[p_partkey % {len(_EXTS)} + 1] AS f FROM part)"""
)
def ext_classify(spark, d):
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("p_partkey") % len(_EXTS) + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("d.1/"), "p_name", ext).alias("path"))
    return p.withColumn("doc_type", T.doc_type(F.col("path")))


@Q.add(
    """SELECT batch, 'Headers: s_suppkey | s_name | s_nationkey' || chr(10) || string_agg(line, chr(10) ORDER BY rn) AS text FROM (
        SELECT rn, (rn - 1) // 20 AS batch, 's_suppkey: ' || s_suppkey || ' | s_name: ' || s_name || ' | s_nationkey: ' || s_nationkey AS line
        FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier)) GROUP BY batch"""
)
def csv_serialize(spark, d):
    return ingest.serialize_table(table(spark, d, "supplier"), ["s_suppkey", "s_name", "s_nationkey"], ["s_suppkey"]).withColumn("batch", F.col("batch").cast("long"))


@Q.add(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]')) AS BIGINT) AS n FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("n"))


@Q.add(
    r"""SELECT k, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(t, 'â€™', ''''), 'â€œ', '"'), 'â€“', '-'), 'Â·', ' - '), 'Â', ''),
        '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS clean
        FROM (SELECT item_id AS k, 'Itâ€™s â€œ' || replace(text, ' ', '   ') || ' Â· 5 Â€ â€“' || chr(10) || ' ' || chr(10) || chr(10) || ' end ' AS t FROM benchmark)"""
)
def clean_text(spark, d):
    t = F.concat(F.lit("Itâ€™s â€œ"), F.replace("text", F.lit(" "), F.lit("   ")), F.lit(" Â· 5 Â€ â€“\n \n\n end "))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("k"), T.clean_text(t).alias("clean"))


@Q.add(f"SELECT item_id, list_sort({_QTOK.format(t='text')}) AS tokens FROM benchmark")
def lexical_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_sort(T.query_tokens(F.col("text"))).alias("tokens"))


@Q.add(
    f"""SELECT conv_id, turn, CAST(len(list_intersect(q, c)) AS BIGINT) AS hits, CAST(len(q) AS BIGINT) AS n FROM (
        SELECT a.conv_id, a.turn, {_QTOK.format(t='a.text')} AS q, list_distinct({_TOKENS.format(t='b.text')}) AS c
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
)
def lexical_score(spark, d):
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    q, r = T.query_tokens(F.col("text")), F.array_distinct(T.ascii_tokens(F.col("reply")))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_intersect(q, r)).cast("long").alias("hits"), F.size(q).cast("long").alias("n"))


@Q.add(
    f"""SELECT doc_id, CAST(len(list_intersect({_QTOK.format(t="'english source src1 document'")}, list_distinct({_TOKENS.format(t="source || ' ' || doc_id || ' ' || lang")}))) AS BIGINT) AS hits FROM documents"""
)
def metadata_score(spark, d):
    q = T.query_tokens(F.lit("english source src1 document"))
    meta = F.array_distinct(T.ascii_tokens(F.concat_ws(" ", "source", F.col("doc_id").cast("string"), "lang")))
    return table(spark, d, "documents").select("doc_id", F.size(F.array_intersect(q, meta)).cast("long").alias("hits"))


@Q.add(
    f"""WITH q AS (SELECT doc_id, text, {_QTOK.format(t="'Which reports mention thing or hand in the year 2022?'")} AS toks FROM documents),
        f AS (SELECT doc_id, text, list_filter(toks, lambda x: NOT list_contains(['2021','2022','2023','annual','chase','fiscal','jpmorgan','microsoft','report','year'], x)) AS toks FROM q),
        p AS (SELECT doc_id, text, list_min(list_filter(list_transform(toks, lambda x: strpos(lower(text), x)), lambda x: x > 0)) AS first FROM f)
        SELECT doc_id, CASE WHEN length(text) <= 360 THEN text WHEN first IS NULL THEN substr(text, 1, 360)
          ELSE (CASE WHEN first > 81 THEN '...' ELSE '' END) || trim(substr(text, greatest(first - 81, 0) + 1, 360)) || (CASE WHEN greatest(first - 81, 0) + 360 < length(text) THEN '...' ELSE '' END) END AS excerpt FROM p"""
)
def excerpt(spark, d):
    q = F.lit("Which reports mention thing or hand in the year 2022?")
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text"), q).alias("excerpt"))


_NAMES = "SELECT c_custkey, c_name || (['', ' Inc', ', Ltd.', ' Holding SA', ' & Co. Corporation'])[c_custkey % 5 + 1] AS name FROM customer"


def _names(spark, d):
    tail = F.element_at(F.array(*map(F.lit, ["", " Inc", ", Ltd.", " Holding SA", " & Co. Corporation"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.concat("c_name", tail).alias("name"))


@Q.add(f"SELECT c_custkey, {_NORM.format(t='name')} AS norm FROM ({_NAMES})")
def normalize_name(spark, d):
    return _names(spark, d).select("c_custkey", T.normalize_name(F.col("name")).alias("norm"))


@Q.add(
    f"""SELECT c_custkey, list_sort(list_distinct([{_NORM.format(t='name')}, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')),
        lower(array_to_string(list_transform(regexp_extract_all(name, '[A-Za-z0-9]+'), lambda x: x[1]), '')), 'tk.' || c_custkey, 'tk ' || c_custkey])) AS aliases FROM ({_NAMES})"""
)
def aliases(spark, d):
    return _names(spark, d).select("c_custkey", T.aliases(F.col("name"), F.concat(F.lit("TK."), F.col("c_custkey").cast("string"))).alias("aliases"))


@Q.add(
    """SELECT event_id, CASE WHEN u IN ('BELONGS_TO','DEPENDS_ON','DEVELOPED_BY','HOLDS','LOCATED_IN','OWNS','PART_OF','REGULATED_BY','RELATED_TO','SUBJECT_TO','USES','WORKS_AT') THEN u ELSE 'RELATED_TO' END AS rel
        FROM (SELECT event_id, upper(replace((['holds','belongs to','works_at','DROP x','owns','sees'])[event_id % 6 + 1], ' ', '_')) AS u FROM events)"""
)
def sanitize_relation(spark, d):
    r = F.element_at(F.array(*map(F.lit, ["holds", "belongs to", "works_at", "DROP x", "owns", "sees"])), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.relation_type(r).alias("rel"))


@Q.add(r"SELECT doc_id, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{4,}')))[1:30], ' ')) AS key FROM documents")
def dedup_key_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", T.term_key(F.col("text")).alias("key"))


@Q.add(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key FROM documents")
def dedup_key_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.text_key(F.col("text")).alias("key"))


@Q.add("SELECT s_suppkey, 's_name' AS header, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier")
def parse_table(spark, d):
    t = F.concat(F.lit("Headers: s_name | s_nationkey\ns_name: "), "s_name", F.lit(" | s_nationkey: "), F.col("s_nationkey").cast("string"))
    rows = table(spark, d, "supplier").select("s_suppkey", T.parse_table(t).alias("t"))
    cells = rows.select("s_suppkey", "t.headers", F.explode("t.rows").alias("r")).select("s_suppkey", "headers", F.explode("r").alias("c"))
    return cells.where(F.array_contains("headers", F.col("c.key"))).select("s_suppkey", F.col("c.key").alias("header"), F.col("c.value").alias("value"))


@Q.add(
    f"""WITH t AS (SELECT item_id, {_TOKENS.format(t='text')} AS toks FROM benchmark),
        f AS (SELECT item_id, unnest(list_concat(toks, list_transform(range(1, greatest(len(array_to_string(toks, '')) - 1, 1)), lambda i: substr(array_to_string(toks, ''), i, 3)))) AS feature FROM t),
        h AS (SELECT item_id, sha256(feature) AS h FROM f),
        p AS (SELECT item_id, unnest(list_transform([0, 4, 8, 12], lambda o: [CAST(('0x' || substr(h, 2 * o + 1, 8)) AS BIGINT) % 64, CASE WHEN CAST(('0x' || substr(h, 2 * (o + 16) + 1, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END])) AS p FROM h),
        s AS (SELECT item_id, p[1] AS index, sum(p[2]) AS quarters FROM p GROUP BY ALL)
        SELECT item_id, CAST(index AS INTEGER) AS index, CAST(quarters AS BIGINT) AS quarters FROM s WHERE quarters <> 0"""
)
def hash_embedding(spark, d):
    # whole quarters before the norm, so that both engines compare exactly
    e = S.hash_embedding(table(spark, d, "benchmark"), "item_id", F.col("text"), 64, unit=False)
    return e.select("item_id", "index", (F.col("value") * 4).cast("long").alias("quarters"))


@Q.add("SELECT count(*) AS n, count(DISTINCT source) AS sources, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def corpus_stats(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.sum(F.length("text")).alias("chars"))


@Q.add()
def chunk_documents(spark, d):
    return chunk.chunk_documents(table(spark, d, "documents"))


@Q.add("SELECT conv_id AS doc_id, turn AS page, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS chunk_index FROM conversations WHERE turn % 5 <> 1 AND trim(text) <> ''")
def chunk_pages(spark, d):
    """Turns as pages of a conversation, some of them blank; at this budget a page is one chunk."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.when(F.col("turn") % 5 == 1, " ").otherwise(F.col("text")).alias("text"))
    return chunk.chunk_pages(c, budget=1 << 20).select("doc_id", "page", "chunk_index")


@Q.add(
    r"""SELECT conv_id, turn, list_filter(list_transform(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: lower(regexp_replace(w, '^[.,:;!?()]+|[.,:;!?()]+$', '', 'g'))),
        lambda w: regexp_matches(w, '^\p{L}{4,}$'))[1:8] AS keywords FROM conversations"""
)
def keywords(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.keywords(F.col("text")).alias("keywords"))


@Q.add(
    """SELECT p_partkey, CASE WHEN k = 0 THEN 'type not allowed' WHEN k = 1 THEN 'empty' WHEN k = 2 THEN 'content does not match type' WHEN k = 3 THEN 'too large' END AS reason
        FROM (SELECT p_partkey, p_partkey % 5 AS k FROM part)"""
)
def upload_validation(spark, d):
    k = F.col("p_partkey") % 5
    path = F.when(k == 0, "a.exe").when(k == 2, "a.pdf").otherwise("a.txt")
    content = F.when(k == 1, "").when(k == 3, F.repeat(F.lit("x"), 200)).otherwise("plain text").cast("binary")
    return table(spark, d, "part").select("p_partkey", ingest.valid_upload(path, content, 100).alias("reason"))


@Q.add("SELECT s_suppkey, s_name AS name, 'Company' AS type, CAST(0.9 AS DOUBLE) AS confidence FROM supplier WHERE s_suppkey % 3 <> 0")
def parse_reply(spark, d):
    body = F.concat(
        F.lit('```json\n{"entities": [{"name": "'), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")), F.lit('", "type": "Company", "confidence": 0.9}], "relations": []}\n```')
    )
    r = table(spark, d, "supplier").select("s_suppkey", ingest.parse_extraction(body).alias("r"))
    return r.select("s_suppkey", F.explode("r.entities").alias("e")).select("s_suppkey", "e.name", "e.type", "e.confidence")
