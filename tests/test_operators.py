import pytest
from pyspark.sql import functions as F

from weftline import vocab
from weftline.functions import similarity as S
from weftline.functions import text as T
from weftline.operators import chunk, evaluate, ingest, retrieval, routing
from weftline.operators import graph as G
from weftline.sources import files
from weftline.streaming import cdc


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def small(spark):
    ents = spark.createDataFrame([("Global Income Fund", "Fund"), ("Microsoft", "Company"), ("Apple Inc.", "Company"), ("Technology", "Sector")], "name string, type string")
    rels = spark.createDataFrame([("Global Income Fund", "holds", "Microsoft"), ("Microsoft", "belongs_to", "Technology"), ("Apple Inc.", "belongs_to", "Technology")], "head string, relation string, tail string")
    return ents, rels


def test_metapaths(spark, small):
    ents, rels = small
    w = G.traverse(ents, rels, vocab.METAPATHS["sector_exposure"]).collect()
    assert [(r["start"], r["end"]) for r in w] == [("Global Income Fund", "Technology")]
    start = spark.createDataFrame([("Microsoft",)], "start string")
    ends = lambda **k: {r["end"] for r in G.traverse(ents, rels, vocab.METAPATHS["shared_sector"], start, **k).collect()}
    assert ends() == {"Microsoft", "Apple Inc."}
    assert ends(unique_edges=True) == {"Apple Inc."}


def test_metapath_evidence_and_facts(spark, small):
    ents, rels = small
    q = spark.createDataFrame([(1, "Infer sector exposure for Global Income Fund", True)], "query_id int, question string, has_entities boolean")
    chosen = routing.select_rules(q)
    walks = G.traverse(ents, rels, vocab.METAPATHS["sector_exposure"]).select(F.lit(1).alias("query_id"), F.lit("sector_exposure").alias("metapath"), "start", "end", "path")
    fact = routing.infer(chosen, walks).first()
    assert fact["rule"] == "fund_sector_exposure" and abs(fact["confidence"] - 0.85) < 1e-9
    assert fact["conclusion"] == "Global Income Fund has inferred sector exposure to Technology."
    assert "Global Income Fund -[HOLDS]-> Microsoft" in fact["evidence"]


def test_bad_metapath():
    with pytest.raises(ValueError):
        G.check_metapath(vocab.Metapath("x", "", (), (("Fund", "holds", "up", "Company"),)))
    for m in vocab.METAPATHS.values():
        G.check_metapath(m)


def test_routing(spark):
    q = spark.createDataFrame([(1, "Which sectors is Global Income Fund exposed to?", True), (2, "Tell me more", True), (3, "Tell me more", False)], "query_id int, question string, has_entities boolean")
    r = routing.route(q).orderBy("query_id", "rank").collect()
    assert [x["metapath"] for x in r if x["query_id"] == 1] == ["sector_exposure"]
    assert [x["metapath"] for x in r if x["query_id"] == 2] == ["sector_exposure", "geographic_risk", "compliance_chain"]
    assert not [x for x in r if x["query_id"] == 3]


def test_neighbors_on_a_line(spark):
    rels = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c")], "head string, relation string, tail string")
    start = spark.createDataFrame([("a",)], "start string")
    got = sorted((r["hop"], r["source"], r["target"]) for r in G.neighbors(rels, start, 2).collect())
    assert got == [(1, "a", "b"), (2, "b", "a"), (2, "b", "c")]


def test_shortest_path(spark):
    rels = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("a", "r", "d")], "head string, relation string, tail string")
    pairs = spark.createDataFrame([("a", "c"), ("b", "d"), ("a", "zz")], "start string, goal string")
    got = {(r["start"], r["goal"]): (r["length"], r["nodes"]) for r in G.shortest_paths(rels, pairs).collect()}
    assert got == {("a", "c"): (2, ["a", "b", "c"]), ("b", "d"): (2, ["b", "a", "d"])}


def test_resolve_meets_every_similar_name(spark):
    import difflib
    import random

    from weftline.operators import routing

    r = random.Random(8)
    names = ["".join(r.choice("abcde") for _ in range(r.randint(2, 9))) for _ in range(60)] + ["microsoft", "north river timber mills trading company of the old eastern coast"]
    names = list(dict.fromkeys(names))
    typo = lambda n: "x" + n[1:] if r.random() < 0.5 else "y" + n
    turned = "trading company of the old eastern coast north river timber mills"
    mentions = sorted({typo(n) for n in names} | {"xicrosoft", turned})
    ents = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, seq long")
    got = {x["mention"]: x for x in routing.resolve(spark.createDataFrame([(m,) for m in mentions], "mention string"), ents).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert got["xicrosoft"]["name"] == "microsoft" and (got[turned]["name"], got[turned]["how"]) == (names[-1], "embedding")
    for m in mentions:
        best = max(ratio(m, n) for n in names)
        if m not in got or got[m]["how"] in ("similar", "embedding"):
            assert (m in got and got[m]["how"] == "similar") == (best >= 0.82), m
            assert best < 0.82 or ratio(m, got[m]["name"]) == best, m


def test_components_of_a_long_path(spark):
    import random

    names = [f"n{i:04}" for i in range(400)]
    random.Random(3).shuffle(names)
    edges = spark.createDataFrame([(a, "r", b) for a, b in zip(names, names[1:], strict=False)], "head string, relation string, tail string")
    nodes = spark.createDataFrame([(n,) for n in [*names, "alone"]], "name string")
    got = {r["name"]: r["component"] for r in G.connected_components(nodes, edges).collect()}
    assert got == dict.fromkeys(names, "n0000") | {"alone": "alone"}


def test_components_and_communities(spark):
    rels = spark.createDataFrame([("fund", "related_to", "duration risk"), ("x", "owns", "y"), ("y", "owns", "z")], "head string, relation string, tail string")
    nodes = spark.createDataFrame([(n,) for n in ("fund", "duration risk", "x", "y", "z", "alone")], "name string")
    labels = G.connected_components(nodes, rels)
    assert {r["name"]: r["component"] for r in labels.collect()} == {"fund": "duration risk", "duration risk": "duration risk", "x": "x", "y": "x", "z": "x", "alone": "alone"}
    c = {len(r["members"]): r for r in G.communities(labels, rels).collect()}
    assert set(c) == {2, 3} and c[2]["relations"] == ["fund -[RELATED_TO]-> duration risk"]
    assert "Main relationship themes: related to." in c[2]["summary"]


def test_visibility(spark):
    reg = spark.createDataFrame([("p", "pending"), ("c", "committed")], "doc_id string, status string")
    ents = spark.createDataFrame([("A", "Fund", "p#chunk-0"), ("B", "Company", "c#chunk-1"), ("C", "Company", "unknown")], "name string, type string, source string")
    rels = spark.createDataFrame([("A", "holds", "B", "c#chunk-0"), ("C", "owns", "B", "c#chunk-0")], "head string, relation string, tail string, source string")
    e, r = G.visible_subgraph(ents, rels, reg)
    assert sorted(x["name"] for x in e.collect()) == ["B", "C"]
    assert [x["head"] for x in r.collect()] == ["C"]


def test_names(spark):
    n = lambda x: one(spark, T.normalize_name(F.lit(x)))
    assert n("Apple, Inc.") == "apple" and n("JPMorgan Chase & Co. Corporation") == "jpmorgan chase co" and n("Sample Corp Ltd") == "sample corp"
    assert one(spark, T.aliases(F.lit("Apple Inc"), F.lit("AAPL.O"))) == sorted({"apple", "appleinc", "ai", "aapl o", "aapl.o"})
    assert one(spark, T.relation_type(F.lit("belongs to"))) == "BELONGS_TO"
    assert one(spark, T.relation_type(F.lit("drop table"))) == "RELATED_TO"


def test_clean_text(spark):
    assert one(spark, T.clean_text(F.lit("﻿Bankâs â€œcapitalâ€\u009d  ratio \n\n\n\n Itâ€™s fine "))) == "Bank's \"capital\" ratio\n\nIt's fine"


def test_term_key(spark):
    k = lambda x: one(spark, T.term_key(F.lit(x)))
    assert k("alpha beta gamma") == k("gamma, Alpha beta!") != k("alpha beta delta")


def test_chunker_sentences():
    text = "First sentence stays whole. Second one also stays. Third sentence ends here."
    out = chunk.chunk_text(text, 6, 1)
    assert out[0].text.endswith(".")
    assert out[1].text.startswith(("First sentence stays whole.", "Second one"))
    assert all(len(c.text.split()) <= 12 for c in out)


def test_chunker_paragraph_offsets():
    text = "First paragraph has several words here.\n\nSecond paragraph also has words.\n\nThird paragraph closes the text."
    out = chunk.chunk_text(text, 18, 1)
    assert len(out) >= 2
    assert all(c.text == text[c.start : c.end].strip() for c in out)


def test_chunker_words_and_blank(spark):
    long = " ".join(f"w{i}" for i in range(50))
    assert all(c.tokens <= 10 for c in chunk.chunk_text(long, 10, 1))
    assert chunk.chunk_text("   ") == []
    d = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two.")], "doc_id long, text string")
    assert [(r["doc_id"], r["content"]) for r in chunk.chunk_documents(d).collect()] == [(3, "One. Two.")]


def test_chunks_run_on_over_pages(spark):
    rows = [(1, 2, "Three."), (1, 0, "One.\n\n" + " ".join(["w"] * 12)), (1, 1, None), (2, 0, " "), (2, 5, "Two."), (None, 0, "No id.")]
    d = spark.createDataFrame(rows, "doc_id long, page long, text string")
    got = [(r["doc_id"], r["page"], r["chunk_index"]) for r in chunk.chunk_pages(d, 10, 0).collect()]
    ones = sorted(x for x in got if x[0] == 1)
    assert [x[2] for x in ones] == list(range(len(ones))) and ones[0][1] == 0 and ones[-1][1] == 2 and len(ones) >= 3
    assert (2, 5, 0) in got and (None, 0, 0) in got and len(got) == len(ones) + 2


def test_intent_decides_what_is_asked_and_chosen(spark):
    rows = [(1, "Compare Alpha and Beta"), (2, "How do I file a claim"), (3, "Name the fund"), (4, "difference of both")]
    q = spark.createDataFrame(rows, "query_id int, question string")
    got = {(r["query_id"], r["ask"]): (r["question"], r["k"], r["most"]) for r in routing.asks(q).collect()}
    assert {k for k in got if k[0] != 1} == {(2, 0), (3, 0), (4, 0)} and got[3, 0] == ("Name the fund", 6, 5) and got[4, 0][1] == 12
    assert len([k for k in got if k[0] == 1]) >= 2 and all(v[1] == 3 for k, v in got.items() if k[0] == 1)

    def search(asked):
        texts = spark.createDataFrame([(i, f"text {i}" + (" policy" if i == 5 else "")) for i in range(9)], "pos int, content string")
        return asked.where("question not like 'Alpha%'").join(texts, F.col("pos") >= 0).select("query_id", "content", F.lit("s").alias("source"), (1 - F.col("pos") / 10).alias("score"), F.lit("vector").alias("kind"), "pos")

    out = {}
    for r in retrieval.retrieve_for_intent(q, search).orderBy("query_id", "place").collect():
        out.setdefault(r["query_id"], []).append(r["content"])
    assert out[1] == ["text 0", "text 1", "text 2"]  # found for each name, each text once
    assert "text 5 policy" in out[2] and len(out[2]) == 8
    assert len(out[3]) == 5 and len(out[4]) == 9


def test_comparison_without_a_hit_asks_again(spark):
    q = spark.createDataFrame([(1, "Compare Alpha and Beta")], "query_id int, question string")
    search = lambda a: a.where("k = 12").select("query_id", F.lit("x").alias("content"), F.lit("s").alias("source"), F.lit(0.5).alias("score"), F.lit("graph").alias("kind"), F.lit(0).alias("pos"))
    assert [r["content"] for r in retrieval.retrieve_for_intent(q, search).collect()] == ["x"]


def test_plain_search_answers_when_the_other_fails(spark):
    q = spark.createDataFrame([(1, "a")], "query_id int, question string")
    broken = lambda a: a.select("query_id", F.raise_error(F.lit("no graph")).cast("string").alias("content"))
    plain = lambda a: a.select("query_id", F.lit("plain").alias("content"))
    assert retrieval.with_fallback(broken, plain)(q).first()["content"] == "plain"
    assert retrieval.with_fallback(plain, broken)(q).first()["content"] == "plain"


def test_fusion_interleaves(spark):
    rows = [(1, 0, 1, "a", 0.1), (1, 1, 2, "b", 0.99), (1, 1, 3, "c", 0.98), (1, 1, 4, "a", 0.5)]
    c = spark.createDataFrame(rows, "query_id int, branch_ord int, pos int, key string, score double")
    out = retrieval.fuse(c).orderBy("place").collect()
    assert [r["key"] for r in out] == ["a", "b", "c"] and abs(out[0]["rrf"] - 1 / 61) < 1e-12
    both = retrieval.fuse(c, dedup_first=False).orderBy("place").first()
    assert both["key"] == "a" and both["rrf"] > 1 / 61


def test_balanced(spark):
    rows = [(1, 0, "vector", 0.4), (1, 1, "graph", 0.95), (1, 2, "vector", 0.9)]
    out = retrieval.balanced(spark.createDataFrame(rows, "query_id int, pos int, kind string, score double"), 2).collect()
    assert sorted(r["kind"] for r in out) == ["graph", "vector"]


def test_hybrid_and_scores(spark):
    exact, related = one(spark, S.hybrid_score(F.lit(0.2), F.lit(1.0), F.lit(0.0))), one(spark, S.hybrid_score(F.lit(0.6), F.lit(0.3), F.lit(0.0)))
    assert exact > related
    assert one(spark, S.path_score(F.lit(1.0), F.lit(1))) == 1.0 and abs(one(spark, S.path_score(F.lit(1.0), F.lit(3))) - 0.8) < 1e-9
    a, z = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert abs(one(spark, S.cosine(a, a)) - 1) < 1e-12 and one(spark, S.cosine(a, z)) == 0 and one(spark, S.cosine(a, F.array(F.lit(1.0)))) == 0


def test_table_evidence(spark):
    c = spark.createDataFrame([(1, "Headers: Fund | Sector | Exposure\nFund: Global Income Fund | Sector: Technology | Exposure: 42%", "What technology exposure does Global Income Fund have?", 0.3)], "query_id int, content string, question string, score double")
    r = retrieval.table_evidence(c).first()
    assert "42%" in r["content"] and r["score"] > 0.5


def test_intent_and_rewrite(spark):
    q = spark.createDataFrame([("Compare A versus B",), ("Why did it fall?",), ("How do I file?",), ("How much is it?",)], "q string")
    assert [r["i"] for r in q.select(routing.intent(F.col("q")).alias("i")).collect()] == ["comparative", "analytical", "procedural", "factoid"]
    r = one(spark, routing.rewrite(F.lit("Which sectors does Global Income Fund hold, please?")))
    assert r["entities"] == ["Which", "Global Income Fund"] and r["keywords"] == ["which", "sectors", "does", "global", "income", "fund", "hold", "please"]


def test_line_diff(spark):
    r = spark.createDataFrame([("a\nb\nb\nc", "a\nb\nb\nd\nc"), ("a\nb\nc", "a\nb\nc\nd\ne\nf")], "b string, a string").select(cdc.line_diff("b", "a").alias("d")).collect()
    assert (r[0]["d"]["added"], r[0]["d"]["removed"]) == (["d"], [])
    assert r[1]["d"]["major"] and r[1]["d"]["change_ratio"] == 0.3333


def test_messages_and_dispositions(spark):
    m = spark.createDataFrame([('{"id":"1","op":"u","source":{"table":"t"},"ts_ms":1000}',), ("not-json",), ('{"op":"x"}',)], "value string")
    got = cdc.from_messages(m).withColumn("change", cdc.change_type(F.col("operation"))).collect()
    assert (got[0]["event_id"], got[0]["resource"], got[0]["change"], got[0]["parsed"]) == ("1", "t", "modified", True)
    assert not got[1]["parsed"] and got[2]["change"] is None and got[2]["resource"] == "unknown"
    a = spark.createDataFrame([("ok", 1, True, True)] + [("bad", i, False, True) for i in range(1, 5)] + [("junk", 1, False, False), ("new", 1, False, True)], "message_id string, attempt int, ok boolean, parsed boolean")
    assert {r["message_id"]: r["outcome"] for r in cdc.dispositions(a).collect()} == {"ok": "committed", "bad": "dropped", "junk": "unparseable", "new": "retrying"}


def test_rate_limit_refusals_do_not_count(spark):
    r = spark.createDataFrame([("a", i, float(t)) for i, t in enumerate([0, 1, 2, 59, 61, 62])] + [("b", 9, 0.0)], "client string, seq int, ts double")
    got = {(x["client"], x["seq"]): x["allowed"] for x in cdc.rate_limit(r, 2, 60).collect()}
    assert got == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("a", 3): False, ("a", 4): True, ("a", 5): True, ("b", 9): True}


def test_stream_cdc(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text('{"id":"1","op":"INSERT","source":{"table":"t"},"ts_ms":1}\nbroken\n')
    seen = []
    q = cdc.start_cdc(spark.readStream.text(str(src)), lambda df: seen.extend(r["event_id"] for r in df.collect()), str(tmp_path / "ck"), str(tmp_path / "dead"), once=True)
    q.awaitTermination()
    assert seen == ["1"] and spark.read.parquet(str(tmp_path / "dead")).count() == 1


def test_changes_and_registry(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id int, hash string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "doc_id int, hash string")
    ch = ingest.changes(old, new)
    assert {r["doc_id"]: r["change"] for r in ch.collect()} == {2: "modified", 3: "deleted", 4: "created"}
    assert sorted(map(tuple, ingest.apply_changes(old, new, ch).collect())) == [(1, "a"), (2, "x"), (4, "d")]
    log = spark.createDataFrame([("d", "begin", 1), ("d", "fail", 2), ("e", "begin", 1), ("e", "commit", 5)], "doc_id string, event string, seq int")
    assert {r["doc_id"]: (r["status"], r["retry_count"]) for r in ingest.registry_state(log).collect()} == {"d": ("failed", 1), "e": ("committed", 0)}


def test_number_is_global(spark):
    df = ingest.number(spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")), ["k"])
    assert [(r["k"], r["n"]) for r in df.orderBy("k").collect()] == [(i, i + 1) for i in range(1000)]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title")
    (tmp_path / "b.pdf").write_bytes(b"not a pdf")
    (tmp_path / "t.csv").write_text("h,v\n" + "\n".join(f"r{i},{i}" for i in range(25)))
    docs = {r["path"].rsplit("/", 1)[1]: r["doc_type"] for r in files.documents(spark, str(tmp_path)).collect()}
    assert docs == {"a.md": "markdown", "b.pdf": "pdf", "t.csv": "table"}
    good, bad = files.uploads(files.documents(spark, str(tmp_path)))
    assert good.count() == 2 and bad.first()["reason"] == "content does not match type"
    t = files.table_texts(spark, str(tmp_path / "t.csv")).orderBy("batch").collect()
    assert len(t) == 2 and t[0]["text"].startswith("Headers: h | v\nh: r0 | v: 0\n")
    assert files.within("/data", "x/../y.txt") == "/data/y.txt"
    with pytest.raises(ValueError):
        files.within("/data", "../etc/passwd")


def test_wilson_and_ranker(spark):
    lo, hi = evaluate.wilson(F.lit(12), F.lit(12))
    assert abs(one(spark, lo) - 0.757) < 0.01 and one(spark, hi) == 1.0
    rows = [{"query_id": q, "candidate": c, "label": int(c == w), "first_type": "Fund", "last_type": c, **dict.fromkeys(evaluate._NUMERIC, 0), "matched": int(c == w)} for q, w in ((1, "a"), (2, "b")) for c in "abc"]
    w = evaluate.train_pairwise(rows)
    assert w["matched"] > 0


WRITES = """DROP TABLE x; DROP VIEW x; CREATE TABLE t (a int); CREATE TABLE t AS SELECT 1 AS a; CREATE OR REPLACE TABLE t AS SELECT 1 AS a; REPLACE TABLE t AS SELECT 1 AS a; CREATE VIEW v AS SELECT 1 AS a;
CREATE OR REPLACE TEMPORARY VIEW v AS SELECT 1 AS a; CREATE DATABASE d; CREATE FUNCTION f AS 'x.Y'; DROP FUNCTION f; INSERT INTO t VALUES (1); INSERT OVERWRITE t SELECT 1; INSERT INTO t REPLACE WHERE a = 1 SELECT 1;
INSERT OVERWRITE DIRECTORY '/tmp/never-written' USING parquet SELECT 1 AS a; INSERT OVERWRITE LOCAL DIRECTORY '/tmp/never-written' USING json SELECT 1 AS a; WITH q AS (SELECT 1 AS a) INSERT INTO t SELECT * FROM q;
FROM s INSERT INTO t SELECT a INSERT INTO u SELECT a; TRUNCATE TABLE t; ALTER TABLE t ADD COLUMNS (b int); ALTER TABLE t RENAME TO u; ALTER TABLE t SET TBLPROPERTIES ('a' = 'b'); ALTER TABLE t DROP PARTITION (a = 1);
ALTER VIEW v AS SELECT 2 AS a; DELETE FROM t WHERE a = 1; UPDATE t SET a = 2; MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DELETE; LOAD DATA INPATH '/tmp/x' INTO TABLE t; MSCK REPAIR TABLE t; CACHE TABLE t;
CACHE TABLE t AS SELECT 1 AS a; UNCACHE TABLE t; CLEAR CACHE; REFRESH TABLE t; ANALYZE TABLE t COMPUTE STATISTICS; SET spark.sql.ansi.enabled = false; RESET; USE d; ADD JAR '/tmp/x.jar'; COMMENT ON TABLE t IS 'x';
SHOW TABLES; DESCRIBE TABLE t; EXPLAIN SELECT 1; DECLARE VARIABLE z INT; SET VAR z = 1; EXECUTE IMMEDIATE 'SELECT 1'; SELECT reflect('java.lang.System', 'getenv', 'HOME');
SELECT 1 WHERE EXISTS (SELECT java_method('java.lang.System', 'lineSeparator')); SELECT * FROM (SELECT try_reflect('java.lang.System', 'lineSeparator') AS a) WHERE a IN (SELECT b FROM u)"""
QUERIES = """SELECT 1 AS a; SELECT a, count(*) AS n FROM VALUES (1), (2) AS t(a) GROUP BY a HAVING count(*) > 0 ORDER BY a LIMIT 5; WITH q AS (SELECT 1 AS a), r AS (SELECT * FROM q) SELECT * FROM q JOIN r USING (a);
SELECT * FROM range(3) WHERE id IN (SELECT id FROM range(2)) AND EXISTS (SELECT 1) AND id < (SELECT max(id) FROM range(9)); SELECT 1 AS a UNION SELECT 2 INTERSECT SELECT 2 EXCEPT SELECT 3; VALUES (1, 'insert into t');
SELECT sum(a) OVER w AS s FROM VALUES (1) AS t(a) WINDOW w AS (ORDER BY a); SELECT x FROM VALUES (array(1, 2)) AS t(xs) LATERAL VIEW explode(xs) AS x; SELECT a, b FROM VALUES (1, 2) AS t(a, b) GROUP BY GROUPING SETS ((a, b), (a));
SELECT * FROM VALUES (1, 'x', 2) AS t(a, k, v) PIVOT (sum(v) FOR k IN ('x')); SELECT * FROM VALUES (1), (2) AS t(a), LATERAL (SELECT t.a + 1 AS b); SELECT /*+ BROADCAST(t) */ * FROM range(3) AS t; SELECT DISTINCT id FROM (SELECT * FROM range(5)) TABLESAMPLE (100 PERCENT)"""


@pytest.mark.parametrize("bad", [s.strip() for s in WRITES.split(";")])
def test_no_write_passes_the_guard(spark, bad):
    from weftline.operators.guard import read_only_sql

    with pytest.raises(PermissionError):
        read_only_sql(spark, bad)


@pytest.mark.parametrize("good", [s.strip() for s in QUERIES.split(";")])
def test_queries_pass_the_guard(spark, good):
    from weftline.operators.guard import read_only_sql

    assert read_only_sql(spark, good).count() == spark.sql(good).count()


def test_a_string_is_no_statement(spark):
    from weftline.operators.guard import read_only_sql

    assert read_only_sql(spark, "select 'drop table x' as a").first()["a"] == "drop table x"


def test_a_failed_branch_is_left_out(spark):
    rows = spark.createDataFrame([(1, f"c{i}", "s", i / 10, i) for i in range(5)], "query_id int, content string, source string, score double, pos long")

    def broken():
        return rows.withColumn("score", F.raise_error(F.lit("no such store")).cast("double"))

    def missing():
        raise OSError("not there")

    got, failed = retrieval.gather({"a": lambda: rows, "b": broken, "c": missing, "d": lambda: rows.limit(0)}, most=2)
    assert failed == ["b", "c"] and sorted((r["branch"], r["content"]) for r in got.collect()) == [("a", "c3"), ("a", "c4")]
    with pytest.raises(OSError, match="not there"):
        retrieval.gather({"c": missing})


def test_paths_and_communities_of_a_question(spark, small):
    _, rels = small
    linked = spark.createDataFrame([(1, "Global Income Fund", 5), (1, "Technology", 9), (2, "Apple Inc.", 0)], "query_id int, entity string, ord int")
    (p,) = retrieval.reasoning_branch(linked.withColumn("ord", F.when(F.col("ord") == 5, 0).when(F.col("ord") == 9, 1).otherwise(0)), rels).collect()
    assert p["content"] == "Reasoning path: Global Income Fund --[HOLDS]--> Microsoft --[BELONGS_TO]--> Technology" and p["query_id"] == 1
    nodes = rels.select(F.explode(F.array("head", "tail")).alias("name")).distinct()
    c = G.communities(G.connected_components(nodes, rels), rels)
    q = spark.createDataFrame([(1, "technology of the fund"), (2, "x")], "query_id int, question string")
    got = retrieval.community_branch(linked, q, c).collect()
    assert {r["query_id"] for r in got} == {1, 2} and all(r["score"] >= 0.7 for r in got)


def test_second_try(spark):
    q = spark.createDataFrame([(1, "good"), (2, "poor"), (3, "hopeless")], "query_id int, question string")
    score = F.when(F.col("question").startswith("good"), 0.9).when(F.col("question").contains("poor Focus"), 0.5).otherwise(0.1)
    got = {r["query_id"]: r["outcome"] for r in retrieval.with_second_try(q, lambda df: df.select("query_id", F.col("question").alias("answer"), score.alias("quality"))).collect()}
    assert got == {1: "answered", 2: "retried", 3: "clarify"}


def test_numbers_over_a_distinct_and_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        df = spark.range(20_000).select(((F.col("id") * 7919) % 5003).alias("x")).distinct()
        got = sorted((r["x"], r["n"]) for r in ingest.number(df, ["x"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == [(x, x + 1) for x in range(5003)]


def test_merge_properties_like_a_fold(spark):
    import random

    r, rows, want = random.Random(3), [], {}
    for pos in range(300):
        name, desc, conf, props = r.choice("abcd"), "x" * r.randint(0, 4), r.randint(0, 3) / 4, {r.choice("klmn"): f"{pos}" for _ in range(r.randint(0, 2))}
        rows.append((name, pos, desc, conf, props))
        if name not in want:
            want[name] = (desc, conf, props)
        elif (len(desc), conf) > (len(want[name][0]), want[name][1]):
            want[name] = (desc, conf, {**want[name][2], **props})
        else:
            want[name] = (*want[name][:2], {**props, **want[name][2]})
    df = spark.createDataFrame(rows, "name string, pos long, description string, confidence double, properties map<string,string>")
    got = {x["name"]: (x["description"], x["confidence"], x["properties"]) for x in ingest.merge_properties(df).collect()}
    assert got == want


def test_model_hooks(spark):
    from weftline.functions import hooks

    def build():
        calls = []

        def model(texts):
            calls.append(len(texts))
            assert len(texts) <= 5
            return [f"{t}:{len(calls) > 0}" for t in texts]

        return model

    d = spark.createDataFrame([(i, f"t{i}" if i % 7 else None) for i in range(50)], "chunk_id int, content string")
    got = {r["chunk_id"]: r["reply"] for r in hooks.extract(d, build).collect()}
    assert got == {i: f"t{i}:True" if i % 7 else ":True" for i in range(50)}
    v = hooks.embed(d, "chunk_id", F.col("content"), lambda: lambda ts: [[float(len(t))] for t in ts]).collect()
    assert {r["chunk_id"]: r["embedding"] for r in v} == {i: [float(len(f"t{i}")) if i % 7 else 0.0] for i in range(50)}
    c = spark.createDataFrame([("c", ["a", "b"], ["a -[X]-> b"], "old")], "community_id string, members array<string>, relations array<string>, summary string")
    assert hooks.summarise(c, lambda: lambda ts: [t.upper() for t in ts]).first()["summary"] == "MEMBERS: A, B\nRELATIONS: A -[X]-> B"
    assert hooks.summarise(c).first()["summary"] == "old"


def test_change_stream_tries_again_and_drops(spark, tmp_path):
    src, dead, tries = tmp_path / "in", tmp_path / "dead", []
    src.mkdir()
    (src / "a.txt").write_text('{"id": "1", "op": "c"}\n{broken\n{"id": "2", "op": "truncate"}\n')

    def apply(df):
        tries.append(df.count())
        if len(tries) < 3:
            raise RuntimeError("not yet")

    cdc.start_cdc(spark.readStream.text(str(src)), apply, str(tmp_path / "ck"), str(dead), once=True).awaitTermination()
    assert tries == [1, 1, 1]
    assert sorted(r["reason"] for r in spark.read.parquet(str(dead)).collect()) == ["unparseable", "unsupported"]

    def never(df):
        raise RuntimeError("no")

    cdc.start_cdc(spark.readStream.text(str(src)), never, str(tmp_path / "ck2"), str(tmp_path / "dead2"), once=True, retries=1).awaitTermination()
    assert sorted(r["reason"] for r in spark.read.parquet(str(tmp_path / "dead2")).collect()) == ["dropped", "unparseable", "unsupported"]


def test_seed_and_snapshot(spark, tmp_path):
    from weftline.sources import files

    (tmp_path / "g.json").write_text('{"entities": [{"name": "Acme Corp", "type": "Company"}], "relations": [{"head": "F", "relation": "HOLDS", "tail": "Acme Corp"}], "questions": [{"q": "x"}]}')
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "e.csv").write_text("a,b\n")
    home = str(tmp_path / "store")
    got = {r["part"]: r["n"] for r in files.seed(spark, str(tmp_path / "g.json"), [str(tmp_path / "t.csv"), str(tmp_path / "e.csv")], home).collect()}
    assert got == {"entities": 1, "relations": 1, "chunks": 2}
    chunks = {r["text"] for r in spark.read.parquet(f"{home}/chunks").collect()}
    assert chunks == {"Headers: a | b\na: 1 | b: 2\na: 3 | b: 4", "[Empty CSV]"}
    entities, relations, aliases = files.graph_snapshot(spark, home)
    assert entities.count() == relations.count() == 1 and "acme" in {r["alias"] for r in aliases.collect()}


def test_split_records(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "dataset string, x int")
    train, held = evaluate.split_records(df, ["a"], ["b"])
    assert [r["x"] for r in train.collect()] == [1] and [r["x"] for r in held.collect()] == [2]
    with pytest.raises(ValueError):
        evaluate.split_records(df, ["a"], ["c"])


def test_question_batches_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_SIDE", 10)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    got = retrieval.vector_search(v.withColumnRenamed("vec_id", "query_id"), v, 1).collect()
    assert len(got) == 40 and len(retrieval.blocks(v.select(F.col("vec_id").alias("query_id")))) == 8


# ---------------------------------------------------------------- components


def brute_roots(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def path_hub_cycle():
    import random

    r = random.Random(3)
    names = r.sample(range(10_000), 900)
    links = [*zip(names[:400], names[1:400], strict=False), *((names[500], x) for x in names[501:700]), *((names[700 + i], names[700 + (i + 1) % 50]) for i in range(50))]
    return [*links, (5, 5), (None, 7), (20_000, 20_001), (20_001, 20_000)]


@pytest.mark.parametrize("block", [100, 1 << 17])
def test_components(spark, monkeypatch, block):
    """A shuffled path, a hub, a cycle and loose links, in one task and in many, and with names as ids."""
    from weftline.operators import components as C

    monkeypatch.setattr(C, "BLOCK", block)  # how many tasks there are; each contracts what it gets
    links = path_hub_cycle()
    df = spark.createDataFrame(links, "a long, b long")
    assert {x["id"]: x["component"] for x in C.components(df).collect()} == brute_roots(links)
    text = df.select(F.concat(F.lit("n"), "a").alias("x"), F.concat(F.lit("n"), "b").alias("y"))
    out = C.components(text, "x", "y").collect()
    assert {x["id"]: x["component"] for x in out} == brute_roots([(a and f"n{a}", b and f"n{b}") for a, b in links]) and len(out) == len({x["id"] for x in out})
    assert C.components(df.where("a < 0")).count() == 0


@pytest.mark.parametrize("block", [4, 64, 1 << 20])
def test_contraction_in_blocks(monkeypatch, block):
    import pyarrow as pa

    from weftline.operators import components as C

    monkeypatch.setattr(C, "BLOCK", block)
    links = [(max(e), min(e)) for e in path_hub_cycle() if None not in e and e[0] != e[1]]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links[i : i + 16], strict=True)], ["u", "v"]) for i in range(0, len(links), 16)]
    out = [(u, v) for b in C._forest(iter(batches)) for u, v in zip(*(b.column(c).to_pylist() for c in ("u", "v")), strict=True)]
    assert all(u > v for u, v in out) and len(out) <= len(links) and brute_roots(out) == brute_roots(links)


# ---------------------------------------------------------------- louvain


def brute_modularity(labels, edges):
    pairs = {(max(e), min(e)) for e in edges if None not in e and e[0] in labels and e[1] in labels}
    m, degree, inside = len(pairs), {}, {}
    for a, b in pairs:
        for x in (a, b):
            degree[labels[x]] = degree.get(labels[x], 0) + 1
        if labels[a] == labels[b]:
            inside[labels[a]] = inside.get(labels[a], 0) + 1
    return sum(inside.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in degree.items()) if m else None


def best_modularity(names, edges):
    """The greatest modularity of all partitions of a small node set."""

    def partitions(xs):
        if not xs:
            yield {}, 0
            return
        for p, n in partitions(xs[1:]):
            for c in range(n + 1):
                yield {**p, xs[0]: c}, max(n, c + 1)

    return max(brute_modularity(p, edges) for p, _ in partitions(names))


def communities_of(spark, names, edges):
    from weftline.operators.louvain import louvain, modularity

    nodes, links = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(edges, "head string, tail string")
    out = louvain(nodes, links)
    got = {r["name"]: r["community"] for r in out.collect()}
    assert set(got) == {n for n in names if n is not None} and out.count() == len(got)
    for c in set(got.values()):
        assert c == min(n for n in got if got[n] == c)
    q = modularity(out, links).first()
    assert q["modularity"] == pytest.approx(brute_modularity(got, edges)) if q["links"] else q["modularity"] is None
    return got, q["modularity"]


def test_louvain_on_small_graphs(spark):
    path = [("a", "b"), ("b", "c"), ("c", "d")]
    got, q = communities_of(spark, list("abcd"), path)
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"} and q == pytest.approx(best_modularity(list("abcd"), path))
    odd = [*path, ("b", "a"), ("a", "b"), ("d", "d"), (None, "a"), ("a", "nobody")]
    assert communities_of(spark, [*"abcde", None, "a"], odd)[0]["e"] == "e"
    two = [(x, y) for g in ("abcd", "efgh") for x in g for y in g if x < y] + [("d", "e")]
    got, q = communities_of(spark, list("abcdefgh"), two)
    assert {got[x] for x in "abcd"} == {"a"} and {got[x] for x in "efgh"} == {"e"} and q == pytest.approx(best_modularity(list("abcdefgh"), two))
    assert communities_of(spark, list("abc"), []) == ({"a": "a", "b": "b", "c": "c"}, None)
    assert communities_of(spark, [], [])[0] == {}


def test_louvain_finds_planted_groups(spark):
    """Twelve dense groups of 20 with few links between; one of them hangs on a hub."""
    import random

    r = random.Random(6)
    groups = [[f"n{g:02d}{i:02d}" for i in range(20)] for g in range(12)]
    edges = [(a, b) for g in groups[:11] for a in g for b in g if a < b and r.random() < 0.6] + [(groups[11][0], x) for x in groups[11][1:]]
    names = [x for g in groups for x in g]
    edges += [tuple(r.sample(names, 2)) for _ in range(60)]
    got, q = communities_of(spark, names, edges)
    planted = {x: g[0] for g in groups for x in g}
    assert q >= brute_modularity(planted, edges) - 1e-9
    agree = sum(got[a] == got[b] for g in groups[:11] for a, b in zip(g, g[1:], strict=False))
    assert agree >= 0.97 * 11 * 19
    nodes, links = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(edges, "head string, tail string")
    from weftline.operators.louvain import louvain

    assert {x["name"]: x["community"] for x in louvain(nodes.repartition(9), links.repartition(11)).collect()} == got  # whatever the partitions

    def failing(*_):
        raise RuntimeError("no detector")

    labels, how = G.detect_communities(nodes, links, failing)
    assert how == "connected_components" and {x["community"] for x in labels.collect()} == {min(names)}
