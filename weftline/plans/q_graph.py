"""Queries over the typed graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import vocab
from weftline.operators import graph as G
from weftline.operators import routing
from weftline.operators.louvain import louvain, modularity
from weftline.plans.book import Book
from weftline.plans.fixtures import CORPORATE, ENTITIES_SQL, QUESTIONS_SQL, SQL, all_walked, edges_sql, entities, questions, relations, table
from weftline.shared import cut

Q = Book()


def _walk_sql(m: vocab.Metapath, unique: bool = False) -> str:
    (_, r1, w1, _), (_, r2, w2, _) = m.steps
    side = lambda r, w, i: f"(SELECT {'head' if w == 'out' else 'tail'} AS a, {'tail' if w == 'out' else 'head'} AS b, relation FROM ({SQL[r]})) e{i}"
    apart = " WHERE NOT (e1.a = e2.b AND e1.b = e2.a)" if unique and r1 == r2 else ""
    return f"SELECT e1.a AS start, e2.b AS \"end\", e1.a || ' -[' || upper(e1.relation) || ']-> ' || e1.b || '; ' || e2.a || ' -[' || upper(e2.relation) || ']-> ' || e2.b AS evidence, e1.b AS mid FROM {side(r1, w1, 1)} JOIN {side(r2, w2, 2)} ON e1.b = e2.a{apart}"


def _walks(spark, d, m: vocab.Metapath, unique: bool = False):
    names = dict.fromkeys(s[1] for s in m.steps)
    return G.traverse(entities(spark, d), relations(spark, d, *names), m, unique_edges=unique)


def _counts(spark, d, m: vocab.Metapath):
    names = dict.fromkeys(s[1] for s in m.steps)
    return G.walk_counts(entities(spark, d), relations(spark, d, *names), m)


def _metapath(m: vocab.Metapath) -> None:
    def run(spark, d):
        w = _walks(spark, d, m)
        return w.select("start", "end", G.evidence(F.col("path")).alias("evidence"), G.intermediates(F.col("path"))[0].alias("mid"))

    Q.add(_walk_sql(m), f"metapath_{m.name}")(run)


for _m in vocab.METAPATHS.values():
    _metapath(_m)


@Q.add(_walk_sql(vocab.METAPATHS["shared_sector"], unique=True))
def metapath_unique_edges(spark, d):
    w = _walks(spark, d, vocab.METAPATHS["shared_sector"], unique=True)
    # an edge used in reverse keeps its own direction in a path of unique edges
    mid = F.col("path")[0]["tail"]
    shown = F.concat("start", F.lit(" -[BELONGS_TO]-> "), mid, F.lit("; "), mid, F.lit(" -[BELONGS_TO]-> "), "end")
    return w.select("start", "end", shown.alias("evidence"), mid.alias("mid"))


@Q.add(f"""SELECT start, "end" AS sector, count(*) AS holdings FROM ({_walk_sql(vocab.METAPATHS['sector_exposure'])}) GROUP BY ALL""")
def sector_exposure(spark, d):
    return _counts(spark, d, vocab.METAPATHS["sector_exposure"]).select("start", F.col("end").alias("sector"), F.col("walks").alias("holdings"))


@Q.add(f"""SELECT metapath, count(*) AS instances, count(DISTINCT "end") AS ends, count(DISTINCT start) AS starts FROM ({" UNION ALL ".join(f"SELECT '{m.name}' AS metapath, start, \"end\" FROM ({_walk_sql(m)})" for m in vocab.METAPATHS.values())}) GROUP BY metapath""")
def path_instances(spark, d):
    return G.walk_totals(*all_walked(spark, d), vocab.METAPATHS.values()).where("instances > 0")


_CORP = edges_sql(*CORPORATE)
_UND = "und AS (SELECT head AS source, relation, tail AS target FROM e UNION ALL SELECT tail, relation, head FROM e)"
_PEOPLE = "p AS (SELECT DISTINCT 'Person#' || (s_suppkey % 20) AS start FROM supplier)"


def _people(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("Person#"), F.col("s_suppkey") % 20).alias("start")).distinct()


_ASKED = "p AS (SELECT s_name AS start FROM supplier WHERE s_suppkey % 50 = 0)"


@Q.add(
    f"""WITH e AS ({_CORP}), {_UND}, {_ASKED}, n AS ({ENTITIES_SQL}), h1 AS (SELECT start, 1 AS hop, source, relation, target FROM p JOIN und ON start = source),
        f AS (SELECT DISTINCT start, target AS node FROM h1 WHERE target <> start), h2 AS (SELECT start, 2 AS hop, source, relation, target FROM f JOIN und ON node = source)
        SELECT start, hop, source, relation, target, type AS target_type FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) JOIN n ON target = name"""
)
def khop_neighbors(spark, d):
    asked = table(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.col("s_name").alias("start"))
    return G.neighbors(relations(spark, d, *CORPORATE), asked, 2, entities(spark, d))


@Q.add(
    f"""WITH e0 AS ({_CORP}), e AS (SELECT *, row_number() OVER () AS id FROM e0), u AS (SELECT id, head AS source, relation, tail AS next FROM e UNION ALL SELECT id, tail, relation, head FROM e), {_PEOPLE}
        SELECT start, u.next AS target, u.relation AS relations FROM p JOIN u ON start = source
        UNION ALL SELECT start, b.next, a.relation || ',' || b.relation FROM p JOIN u a ON start = a.source JOIN u b ON a.next = b.source AND a.id <> b.id"""
)
def khop_trails(spark, d):
    return G.trails(relations(spark, d, *CORPORATE), _people(spark, d), 2).withColumn("relations", F.array_join("relations", ","))


@Q.add(
    f"""WITH RECURSIVE e AS MATERIALIZED ({_CORP}), und AS (SELECT DISTINCT head AS source, tail AS target FROM e UNION SELECT tail, head FROM e), {_PEOPLE},
        r(start, node, k) AS (SELECT start, start, 0 FROM p UNION SELECT start, target, k + 1 FROM r JOIN und ON node = source WHERE k < 5)
        SELECT start, node AS goal, min(k) AS length FROM r WHERE node LIKE 'Rule %' OR node LIKE 'NATION%' GROUP BY ALL"""
)
def shortest_path_len(spark, d):
    ends = entities(spark, d).where("name like 'Rule %' or name like 'NATION%'").select(F.col("name").alias("goal"))
    pairs = _people(spark, d).join(F.broadcast(ends), F.lit(True))  # 20 people and the regions and rules
    return G.shortest_paths(relations(spark, d, *CORPORATE), pairs).select("start", "goal", "length")


def _levels_sql(most: int = 5) -> str:
    """Breadth-first levels, the least path to each node of a level, one after the other."""
    out = ["l0 AS (SELECT start, start AS node, [start] AS nodes, CAST([] AS VARCHAR[]) AS rels FROM p)"]
    for k in range(1, most + 1):
        seen = " UNION ALL ".join(f"SELECT start, node FROM l{i}" for i in range(k))
        out.append(
            f"l{k} AS MATERIALIZED (SELECT start, node, min(nodes) AS nodes, arg_min(rels, nodes) AS rels FROM (SELECT l.start, u.target AS node, list_append(l.nodes, u.target) AS nodes, list_append(l.rels, u.relation) AS rels "
            f"FROM l{k - 1} l JOIN u ON u.source = l.node) s WHERE NOT EXISTS (SELECT 1 FROM ({seen}) x WHERE x.start = s.start AND x.node = s.node) GROUP BY start, node)"
        )
    return ", ".join(out) + ", found AS (" + " UNION ALL ".join(f"SELECT *, {k} AS length FROM l{k}" for k in range(most + 1)) + ")"


@Q.add(
    f"""WITH e AS MATERIALIZED ({_CORP}), {_UND}, u AS MATERIALIZED (SELECT source, target, min(upper(relation)) AS relation FROM und GROUP BY ALL), {_PEOPLE}, {_levels_sql()}
        SELECT start, node AS goal, length, 'Reasoning path: ' || start || array_to_string(list_transform(list_zip(rels, nodes[2:]), lambda z: ' --[' || z[1] || ']--> ' || z[2]), '') AS content
        FROM found WHERE node LIKE 'Rule %'"""
)
def shortest_path_text(spark, d):
    ends = table(spark, d, "region").select(F.concat(F.lit("Rule "), "r_name").alias("goal"))
    pairs = _people(spark, d).join(F.broadcast(ends), F.lit(True))  # 20 people and the rules
    p = G.shortest_paths(relations(spark, d, *CORPORATE), pairs)
    return p.select("start", "goal", "length", G.reasoning_path(F.col("nodes"), F.col("relations")).alias("content"))


_OWN = f"({SQL['owns']}) UNION ALL ({SQL['works_at']})"


def _groups(spark, d):
    """People and suppliers by works_at alone: one component a person."""
    edges = relations(spark, d, "works_at")
    nodes = edges.select(F.col("head").alias("name")).unionByName(edges.select(F.col("tail").alias("name"))).distinct()
    return nodes, edges


@Q.add(
    f"""WITH e AS ({SQL['works_at']}), c AS (SELECT head AS component, unnest([head, tail]) AS name FROM e)
        SELECT DISTINCT name, component FROM c"""
)
def connected_components(spark, d):
    return G.connected_components(*_groups(spark, d))


_MEMBERS = f"""WITH e AS ({SQL['works_at']}), m AS (SELECT head AS c, list_sort(list_distinct(list_concat(list(DISTINCT head), list(tail)))) AS members, list_sort(list(head || ' -[WORKS_AT]-> ' || tail)) AS rels FROM e GROUP BY head)"""


@Q.add(
    f"""{_MEMBERS} SELECT substr(sha256(array_to_string(members, '|')), 1, 12) AS community_id, members, CAST(len(rels) AS BIGINT) AS n_relations,
        'Graph community summary: ' || array_to_string(members[1:8], ', ') || '. Main relationship themes: works at. Representative evidence: ' || array_to_string(rels[1:8], '; ') || '.' AS summary FROM m"""
)
def community_build(spark, d):
    nodes, edges = _groups(spark, d)
    c = G.communities(G.connected_components(nodes, edges), edges)
    return c.select("community_id", "members", F.size("relations").cast("long").alias("n_relations"), "summary")


@Q.add(f"""{_MEMBERS}, q AS ({QUESTIONS_SQL}) SELECT query_id, substr(sha256(array_to_string(members, '|')), 1, 12) AS community_id FROM q JOIN m ON list_contains(members, start)""")
def community_lookup(spark, d):
    nodes, edges = _groups(spark, d)
    c = G.communities(G.connected_components(nodes, edges), edges).select("community_id", F.explode("members").alias("start"))
    return questions(spark).join(c, "start").select("query_id", "community_id").distinct()


_CLIENTS = "SELECT c_name AS head, 'Rule ' || r_name AS tail FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_RULE_RING = f"""r AS (SELECT 'Rule ' || r_name AS name, row_number() OVER (ORDER BY r_regionkey) - 1 AS i, count(*) OVER () AS n FROM region),
    ring AS (SELECT a.name AS head, b.name AS tail FROM r a JOIN r b ON b.i = (a.i + 1) % a.n), e AS (SELECT head, tail FROM ({_CLIENTS}) UNION ALL SELECT head, tail FROM ring)"""


def _ruled(spark, d):
    """Customers with the rule of their region, and the rules in a ring: each rule with its customers is the best community."""
    n = table(spark, d, "region").count()
    rules = lambda c: table(spark, d, "region").select(F.concat(F.lit("Rule "), "r_name").alias(c), F.col("r_regionkey").alias(f"_{c}"))
    ring = rules("head").join(rules("tail"), F.col("_tail") == (F.col("_head") + 1) % n)
    t = lambda name: table(spark, d, name)
    clients = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = clients.select(F.col("c_name").alias("head"), F.concat(F.lit("Rule "), "r_name").alias("tail")).unionByName(ring.select("head", "tail"))
    return edges.select(F.explode(F.array("head", "tail")).alias("name")).distinct(), edges


@Q.add(
    f"""WITH {_RULE_RING}, c AS (SELECT head AS name, tail AS rule FROM ({_CLIENTS}) UNION ALL SELECT name, name FROM r)
        SELECT name, min(name) OVER (PARTITION BY rule) AS community FROM c"""
)
def label_communities(spark, d):
    return louvain(*_ruled(spark, d))


def _corporate(spark, d):
    edges = relations(spark, d, *CORPORATE)
    return edges.select(F.explode(F.array("head", "tail")).alias("name")).distinct(), edges


_REACH = f"""e AS (SELECT DISTINCT head, tail FROM ({_CORP})), u AS (SELECT head AS a, tail AS b FROM e UNION SELECT tail, head FROM e),
    n AS (SELECT DISTINCT a AS name FROM u), reach(name, other) AS (SELECT name, name FROM n UNION SELECT reach.name, u.b FROM reach JOIN u ON u.a = reach.other),
    comp AS (SELECT name, min(other) AS component FROM reach GROUP BY name)"""


@Q.add(f"WITH RECURSIVE {_REACH} SELECT name, component FROM comp")
def corporate_components(spark, d):
    return G.connected_components(*_corporate(spark, d))


@Q.add(f"""WITH RECURSIVE {_REACH}, p AS (SELECT DISTINCT greatest(a, b) AS x, least(a, b) AS y FROM u), d AS (SELECT unnest([x, y]) AS name FROM p)
        SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM p) AS links, 0 AS split, true AS connected, true AS not_below_components""")
def louvain_corporate(spark, d):
    """Louvain over all corporate relations: every node once, no community across components, modularity of components or more."""
    # read by each step below: made once, a relation at a time, and no side goes through the driver
    edges = reduce(DataFrame.unionByName, (cut(relations(spark, d, n)) for n in CORPORATE))
    nodes = cut(edges.select(F.explode(F.array("head", "tail")).alias("name")).distinct())
    labels = louvain(nodes, edges)
    comps = G.connected_components(nodes, edges)
    spread = labels.join(comps.hint("merge"), "name").groupBy("community").agg(F.count_distinct("component").alias("n"))
    inside = edges.join(labels.select(F.col("name").alias("head"), "community").hint("merge"), "head").join(labels.select(F.col("name").alias("tail"), F.col("community").alias("c2")).hint("merge"), "tail").where("community = c2")
    within = G.connected_components(nodes, inside).join(labels.hint("merge"), "name").groupBy("community").agg(F.count_distinct("component").alias("n"))
    q, base = modularity(labels, edges), modularity(comps.withColumnRenamed("component", "community"), edges)
    one = labels.agg(F.count(F.lit(1)).alias("nodes")).join(q.select("links", F.col("modularity").alias("q")), F.lit(True)).join(base.select(F.col("modularity").alias("base")), F.lit(True))
    one = one.join(spread.agg(F.count_if(F.col("n") > 1).alias("split")), F.lit(True)).join(within.agg(F.bool_and(F.col("n") == 1).alias("connected")), F.lit(True))  # sums of one row each
    return one.select("nodes", "links", "split", "connected", (F.col("q") >= F.col("base") - 1e-9).alias("not_below_components"))


# Documents behind the edges: suppliers' documents are pending or failed by key.
_REG = "reg AS (SELECT s_name || '.pdf' AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN 'committed' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' END AS status FROM supplier WHERE s_suppkey % 4 <> 3)"
_ENT = f"ent AS (SELECT name, type, CASE WHEN type = 'Company' THEN name || '.pdf#chunk-0' ELSE 'base.csv#chunk-1' END AS source FROM ({ENTITIES_SQL}))"


def _stored(spark, d):
    k = F.col("s_suppkey") % 4
    reg = table(spark, d, "supplier").where(k != 3).select(F.concat("s_name", F.lit(".pdf")).alias("doc_id"), F.when(k == 0, "committed").when(k == 1, "pending").otherwise("failed").alias("status"))
    ent = entities(spark, d).withColumn("source", F.when(F.col("type") == "Company", F.concat("name", F.lit(".pdf#chunk-0"))).otherwise("base.csv#chunk-1"))
    rel = relations(spark, d, *CORPORATE).withColumn("source", F.lit("base.csv#chunk-2"))
    return reg, ent, rel


@Q.add(f"WITH {_REG}, {_ENT} SELECT name, type FROM ent WHERE NOT EXISTS (SELECT 1 FROM reg WHERE status <> 'committed' AND doc_id = regexp_replace(source, '#chunk-.*', ''))")
def visible_entities(spark, d):
    reg, ent, _ = _stored(spark, d)
    return G.visible(ent, reg).select("name", "type")


@Q.add(
    f"""WITH {_REG}, {_ENT}, v AS (SELECT name FROM ent WHERE NOT EXISTS (SELECT 1 FROM reg WHERE status <> 'committed' AND doc_id = regexp_replace(source, '#chunk-.*', '')))
        SELECT head, relation, tail FROM ({_CORP}) WHERE head IN (SELECT name FROM v) AND tail IN (SELECT name FROM v)"""
)
def visible_subgraph(spark, d):
    reg, ent, rel = _stored(spark, d)
    return G.visible_subgraph(ent, rel, reg)[1].select("head", "relation", "tail")


@Q.add(f"SELECT query_id, name, type FROM ({QUESTIONS_SQL}) JOIN ({ENTITIES_SQL}) ON name = start")
def entity_lookup(spark, d):
    return questions(spark).join(entities(spark, d), F.col("start") == F.col("name")).select("query_id", "name", "type")


@Q.add(f"SELECT key, name FROM (VALUES ('brand#1'), ('econ'), ('rule'), ('0000000')) k(key) JOIN ({ENTITIES_SQL}) ON contains(lower(name), key)")
def entity_contains(spark, d):
    keys = spark.createDataFrame([("brand#1",), ("econ",), ("rule",), ("0000000",)], "key string")
    return entities(spark, d).join(F.broadcast(keys), F.contains(F.lower("name"), F.col("key"))).select("key", "name")


@Q.add(f"SELECT type, count(*) AS n FROM ({ENTITIES_SQL}) GROUP BY type UNION ALL SELECT relation, count(*) FROM ({_CORP} UNION ALL ({SQL['holds']})) GROUP BY relation")
def graph_stats(spark, d):
    e = entities(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return e.unionByName(relations(spark, d, *CORPORATE, "holds").groupBy(F.col("relation").alias("type")).agg(F.count(F.lit(1)).alias("n")))


@Q.add(f"SELECT name, type, row_number() OVER (ORDER BY name) - 1 AS id FROM ({ENTITIES_SQL})")
def entity_ids(spark, d):
    from weftline.operators.ingest import number

    return number(entities(spark, d), ["name"], "id").select("name", "type", (F.col("id") - 1).alias("id"))


@Q.add(
    """SELECT name, how FROM (VALUES ('Supplier#000000001', 'exact'), ('Supplier#000000002', 'alias'), ('Supplier#000000003', 'contains'), ('Supplier#000000004', 'similar')) v(name, how)"""
)
def entity_resolution(spark, d):
    mentions = spark.createDataFrame([("Supplier#000000001",), ("supplier 000000002",), ("upplier#000000003",), ("Suplier#000000004 ",), ("the",)], "mention string")
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"))
    return routing.resolve(mentions, s).select("name", "how")


@Q.add()
def entity_resolution_typos(spark, d):
    from weftline.operators.ingest import number

    types = table(spark, d, "part").select(F.col("p_type").alias("name")).distinct()
    mentions = types.select(F.concat(F.lit("x"), F.substring("name", 2, 1000)).alias("mention"))
    return routing.resolve(mentions, number(types, ["name"], "seq").select("name", "seq"))


@Q.add(f"WITH gone AS (SELECT s_name FROM supplier WHERE s_nationkey = 3) SELECT head, relation, tail FROM ({_CORP}) WHERE head NOT IN (SELECT * FROM gone) AND tail NOT IN (SELECT * FROM gone)")
def delete_by_source(spark, d):
    ent = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("#chunk-0")).alias("source"))
    rel = relations(spark, d, *CORPORATE).withColumn("source", F.lit("base#chunk-0"))
    hit = lambda: G.source_matches(F.col("source"), "nation3", "-")
    return G.delete_by_source(ent, rel, hit(), hit())[1].select("head", "relation", "tail")


@Q.add("SELECT user_id AS name, max_by(event_type, event_id) AS type, max_by(value, event_id) AS confidence, max(event_id) AS seq FROM events GROUP BY user_id")
def entity_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("name"), F.col("event_type").alias("type"), F.col("value").alias("confidence"), F.col("event_id").alias("seq"))
    return G.latest(e.withColumn("_s", F.col("seq")), ["name"], "seq").drop("_s")


@Q.add("SELECT user_id AS name, min(event_type) AS type, count(*) AS version FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type = 'click' UNION ALL SELECT DISTINCT user_id, event_type FROM events WHERE event_type = 'view') GROUP BY user_id")
def entity_merge(spark, d):
    ev = table(spark, d, "events")
    side = lambda t: ev.where(F.col("event_type") == t).select(F.col("user_id").alias("name"), F.col("event_type").alias("type"), F.lit("").alias("description"), F.lit(0.9).alias("confidence")).distinct()
    stored = side("click").withColumn("version", F.lit(1))
    return G.merge_entities(stored, side("view")).select("name", "type", F.col("version").cast("long").alias("version"))


@Q.add("SELECT DISTINCT user_id AS head, event_type AS relation FROM events")
def relation_upsert(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("head"), F.col("event_type").alias("relation")).dropDuplicates(["head", "relation"])


@Q.add(f"""SELECT metapath, start, count(*) AS instances, count(DISTINCT "end") AS ends, CAST(floor(ln(1 + count(*)) * 100000 + 0.25) AS BIGINT) AS log5 FROM ({" UNION ALL ".join(f"SELECT '{m.name}' AS metapath, start, \"end\" FROM ({_walk_sql(m)})" for m in vocab.METAPATHS.values())}) GROUP BY ALL""")
def path_features(spark, d):
    out = G.walk_features(*all_walked(spark, d), vocab.METAPATHS.values())
    return out.select("metapath", "start", F.col("walks").alias("instances"), "ends", F.floor(F.log1p("walks") * 100000 + 0.25).cast("long").alias("log5"))


@Q.add(f"""WITH ids AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM ({ENTITIES_SQL})) SELECT query_id, start, id AS start_id, expected FROM ({QUESTIONS_SQL}) LEFT JOIN ids ON name = start""")
def query_labels(spark, d):
    ids = entity_ids(spark, d).select(F.col("name").alias("start"), F.col("id").alias("start_id"))
    return questions(spark).join(ids, "start", "left").select("query_id", "start", "start_id", "expected")
