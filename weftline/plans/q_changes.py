"""Queries over changes: registry, snapshots, change events, limits, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import ingest
from weftline.plans.book import Book
from weftline.plans.fixtures import table
from weftline.streaming import cdc, stateful

Q = Book()


def _log(spark, d):
    t = F.col("event_type")
    event = F.when(t == "signup", "begin").when(t == "purchase", "commit").when(t == "error", "fail")
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), event.alias("event"), F.col("event_id").alias("seq"))


_STATUS = "SELECT user_id AS doc_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'committed' WHEN 'error' THEN 'failed' END AS status, event_id FROM events WHERE event_type IN ('signup', 'purchase', 'error')"


@Q.add(f"SELECT doc_id, max_by(status, event_id) AS status, CAST(sum(CAST(status = 'failed' AS INTEGER)) AS BIGINT) AS retry_count, max(event_id) AS updated_at FROM ({_STATUS}) GROUP BY doc_id")
def registry_fold(spark, d):
    return ingest.registry_state(_log(spark, d)).select("doc_id", "status", "retry_count", "updated_at")


@Q.add(f"SELECT doc_id, retry_count, failed_at, row_number() OVER (ORDER BY failed_at DESC) AS place FROM (SELECT doc_id, max_by(status, event_id) AS status, CAST(sum(CAST(status = 'failed' AS INTEGER)) AS BIGINT) AS retry_count, max(event_id) FILTER (WHERE status = 'failed') AS failed_at FROM ({_STATUS}) GROUP BY doc_id) WHERE status = 'failed'")
def dead_letters(spark, d):
    dead = ingest.registry_state(_log(spark, d)).where("status = 'failed'").withColumn("neg", -F.col("failed_at"))
    return ingest.number(dead.select("doc_id", "retry_count", "failed_at", "neg"), ["neg"], "place").select("doc_id", "retry_count", "failed_at", F.col("place").cast("long").alias("place"))


@Q.add(f"SELECT doc_id FROM (SELECT doc_id, max_by(status, event_id) AS status FROM ({_STATUS}) GROUP BY doc_id) WHERE status = 'committed'")
def committed_ids(spark, d):
    return ingest.registry_state(_log(spark, d)).where("status = 'committed'").select("doc_id")


@Q.add("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src1')")
def new_content(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    reg = docs.where("source = 'src1'").select("content_hash", F.lit("committed").alias("status"))
    return ingest.new_content(docs, reg).select("doc_id")


@Q.add("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'created' WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE (doc_id % 11 = 0 AND doc_id % 7 <> 0) OR (doc_id % 7 = 0 AND doc_id % 11 <> 0) OR (doc_id % 5 = 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0)")
def change_detection(spark, d):
    return ingest.changes(*_snapshots(spark, d))


def _snapshots(spark, d):
    docs = table(spark, d, "documents")
    h = lambda t: F.sha2(t.cast("binary"), 256).alias("hash")
    old = docs.where("doc_id % 11 <> 0").select("doc_id", h(F.col("text")))
    new = docs.where("doc_id % 7 <> 0").select("doc_id", h(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))))
    return old, new


@Q.add("SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0")
def apply_changes(spark, d):
    old, new = _snapshots(spark, d)
    return ingest.apply_changes(old, new, ingest.changes(old, new))


@Q.add("SELECT CASE WHEN event_id % 4 = 0 THEN 'none' ELSE CAST(event_id AS VARCHAR) END AS event_id, upper(event_type) AS operation, 't' || (user_id % 3) AS resource, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 10 <> 0 AS parsed FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT 'none', 'UPDATE', 'unknown', NULL, FALSE FROM events WHERE event_id % 10 = 0")
def cdc_normalize(spark, d):
    e = table(spark, d, "events")
    good = F.to_json(F.struct(
        F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("op"), F.struct(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("table")).alias("source"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("after"), F.lit(1700000000000).alias("ts_ms"),
    ))
    m = cdc.from_messages(e.select(F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(good).alias("value"), "event_id"))
    own = F.when(F.col("event_id").rlike("^[0-9]+$") & (F.length("event_id") < 16), F.col("event_id")).otherwise("none")
    return m.select(own.alias("event_id"), "operation", "resource", F.try_element_at("after", F.lit("k")).cast("long").alias("k"), "parsed")


@Q.add("SELECT event_type, CASE WHEN u IN ('INSERT','CREATE','C','R') THEN 'created' WHEN u IN ('UPDATE','MODIFY','U') THEN 'modified' WHEN u IN ('DELETE','D') THEN 'deleted' END AS change, count(*) AS n FROM (SELECT event_type, upper((['insert','u','D','Create','truncate'])[event_id % 5 + 1]) AS u FROM events) GROUP BY ALL")
def cdc_operations(spark, d):
    op = F.element_at(F.array(*map(F.lit, ["insert", "u", "D", "Create", "truncate"])), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_type", cdc.change_type(op).alias("change")).groupBy("event_type", "change").agg(F.count(F.lit(1)).alias("n"))


@Q.add("SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN CAST(sum(CAST(event_type <> 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) END AS version FROM events")
def cdc_versions(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("resource"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("success"))
    return cdc.versions(e).select(F.col("seq").alias("event_id"), F.col("resource").alias("user_id"), "version")


@Q.add("""SELECT message_id, CASE WHEN NOT parsed THEN 'unparseable' WHEN ok <= 4 THEN 'committed' WHEN n > 3 THEN 'dropped' ELSE 'retrying' END AS outcome, CASE WHEN NOT parsed THEN 1 ELSE least(coalesce(ok, n), 4) END AS attempts
    FROM (SELECT user_id AS message_id, min(CASE WHEN event_type = 'purchase' THEN a END) AS ok, count(*) AS n, bool_and(user_id % 10 <> 3) AS parsed FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events) GROUP BY user_id)""")
def message_disposition(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "events").withColumn("attempt", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    return cdc.dispositions(e.select(F.col("user_id").alias("message_id"), "attempt", (F.col("event_type") == "purchase").alias("ok"), (F.col("user_id") % 10 != 3).alias("parsed")))


@Q.add("SELECT coalesce(event_type, 'all') AS path, count(*) AS n, CAST(round(sum(round(value * 100))) AS BIGINT) AS total_cents, CAST(round(max_by(value, event_id) * 100) AS BIGINT) AS last_cents FROM events GROUP BY ROLLUP (event_type)")
def request_metrics(spark, d):
    e = table(spark, d, "events")
    out = e.rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100)).alias("c"), F.max_by("value", "event_id").alias("last"))
    return out.select(F.coalesce("event_type", F.lit("all")).alias("path"), "n", F.round("c").cast("long").alias("total_cents"), F.round(F.col("last") * 100).cast("long").alias("last_cents"))


@Q.add("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place <= 50")
def event_history(spark, d):
    from weftline.operators.retrieval import top_k

    return top_k(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], [F.desc("event_id")], 50, "place")


@Q.add("SELECT user_id AS resource, count(*) AS events, CAST(sum(CAST(event_type <> 'error' AS INTEGER)) AS BIGINT) AS succeeded FROM events GROUP BY user_id")
def cdc_stats(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("resource")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") != "error").alias("succeeded"))


_LIMITED = """WITH RECURSIVE x AS (SELECT user_id, event_id AS seq, CAST(floor(epoch(ts)) AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS rn FROM events),
    r(user_id, seq, t, rn, held, allowed) AS (SELECT user_id, seq, t, rn, [t], true FROM x WHERE rn = 1
        UNION ALL SELECT user_id, seq, t, rn, CASE WHEN len(k) < 5 THEN list_append(k, t) ELSE k END, len(k) < 5
        FROM (SELECT x.user_id, x.seq, x.t, x.rn, list_filter(r.held, lambda z: z >= x.t - 21600) AS k FROM r JOIN x ON x.user_id = r.user_id AND x.rn = r.rn + 1))"""


@Q.add(f"{_LIMITED} SELECT CAST(user_id AS VARCHAR) AS client, seq, t AS ts, allowed FROM r")
def rate_limit(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    return cdc.rate_limit(e, 5, 6 * 3600)


@Q.add(f"{_LIMITED} SELECT CAST(user_id AS VARCHAR) AS client, seq, allowed FROM r")
def stream_rate_limit(spark, d):
    """The same limit as a stream with state and timers."""
    s = _stream(spark, d).select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    return cdc.stream_to_table(spark, stateful.limited(s, 5, 6 * 3600)).select("client", "seq", "allowed")


@Q.add("""SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN CAST(sum(CAST(event_type <> 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) END AS version,
        CASE WHEN event_type = 'view' THEN event_id % 2 END AS added, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 1 THEN 0.5 ELSE 0.0 END END AS change_ratio FROM events""")
def stream_versions(spark, d):
    """Event steps as a stream: a version counter for each resource, and the diff of updates."""
    image = lambda x: F.create_map(F.lit("content"), F.concat(F.lit("same\n"), x))
    e = _stream(spark, d).select(
        F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_type") == "view", "UPDATE").otherwise("INSERT").alias("operation"), F.col("user_id").cast("string").alias("resource"),
        F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("success"), image(F.lit("0")).alias("before"), image((F.col("event_id") % 2).cast("string")).alias("after"),
    )
    out = cdc.stream_to_table(spark, stateful.versioned(e))
    return out.select(F.col("event_id").cast("long").alias("event_id"), F.col("resource").cast("long").alias("user_id"), "version", F.col("diff.added_count").cast("long").alias("added"), "diff.change_ratio")


@Q.add()
def line_diff(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.split("text", "\n")
    after = F.concat_ws("\n", F.lit("First line."), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))
    e = docs.select("doc_id", F.lit("UPDATE").alias("operation"), F.create_map(F.lit("content"), "text").alias("before"), F.create_map(F.lit("content"), after).alias("after"))
    return cdc.with_diff(e).select("doc_id", "diff.added_count", "diff.removed_count", "diff.change_ratio", "diff.major")


@Q.add("SELECT chunk_id, name FROM (SELECT event_id // 10 AS chunk_id, 'u' || user_id AS name, value / 100 AS confidence FROM events) WHERE confidence >= 0.7")
def extraction_gate(spark, d):
    ents, rels = _extracted(spark, d)
    return ingest.gate(ents, rels)[0].select("chunk_id", "name")


def _extracted(spark, d):
    e = table(spark, d, "events")
    chunk = F.floor(F.col("event_id") / 10).cast("long").alias("chunk_id")
    ents = e.select(chunk, F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), (F.col("value") / 100).alias("confidence"), F.col("event_type").alias("type"), F.col("event_id").alias("pos"), chunk.alias("chunk_index"))
    rels = e.select(chunk, F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("head"), F.col("event_type").alias("relation"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tail"), ((F.col("event_id") % 10) / 10).alias("confidence"))
    return ents, rels


@Q.add("WITH k AS (SELECT DISTINCT event_id // 10 AS chunk_id, user_id FROM events WHERE value / 100 >= 0.7) SELECT event_id // 10 AS chunk_id, 'u' || events.user_id AS head, event_type AS relation FROM events JOIN k ON event_id // 10 = chunk_id AND events.user_id = k.user_id WHERE event_id % 10 >= 7")
def extraction_relations(spark, d):
    ents, rels = _extracted(spark, d)
    return ingest.gate(ents, rels)[1].select("chunk_id", "head", "relation")


@Q.add("SELECT 'u' || user_id AS name, event_type AS type, min(event_id) AS pos FROM events GROUP BY ALL")
def extraction_dedup(spark, d):
    ents, _ = _extracted(spark, d)
    return ingest.first_extraction(ents, ["name", "type"]).select("name", "type", "pos")


@Q.add("SELECT p_type AS name, max(length(p_name)) AS len FROM part GROUP BY p_type")
def entity_merge_richest(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_name").alias("description"), F.col("p_retailprice").alias("confidence"))
    return ingest.richest(p).select("name", F.length("description").cast("long").alias("len"))


# ---------------------------------------------------------------- streams over the event table


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@Q.add("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    out = cdc.stream_to_table(spark, cdc.tumbling(_stream(spark, d)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@Q.add("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(round(sum(round(value * 100))) AS BIGINT) AS cents FROM events GROUP BY ALL")
def batch_tumbling(spark, d):
    return cdc.tumbling(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round(F.col("total") * 100).cast("long").alias("cents"))


@Q.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    out = cdc.stream_to_table(spark, cdc.sessions(_stream(spark, d)), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@Q.add("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    s = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 days").select("user_id", "event_type", "ts").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return cdc.stream_to_table(spark, s.select("user_id", "event_type"))


