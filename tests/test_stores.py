"""Keyed tables, the vector index, labels kept up and meeting searches against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import graph as G
from weftline.operators import retrieval as R
from weftline.operators.vector_index import VectorIndex
from weftline.sources import keyed

CHUNK = "doc_id string, chunk_index int, content string, embedding array<float>"


def chunks(spark, rows):
    return spark.createDataFrame([(d, i, c, [1.0, 2.0]) for d, i, c in rows], CHUNK)


def held(store):
    return {(r["doc_id"], r["chunk_index"]): r["content"] for r in store.read().collect()}


def test_keyed_table(spark, tmp_path):
    store = keyed.chunk_store(spark, str(tmp_path / "t"), 8)
    with pytest.raises(FileNotFoundError):
        store.read()
    rows = {(f"d{d}", i): f"text {d} {i}" for d in range(30) for i in range(3)} | {(None, 0): "of no document"}
    assert store.upsert(chunks(spark, [(d, i, c) for (d, i), c in rows.items()])) == 1 and held(store) == rows
    before = store._manifest(1)["folders"]

    assert store.upsert(chunks(spark, [("d3", 1, "new"), ("d3", 7, "more"), (None, 0, "again")])) == 2
    rows |= {("d3", 1): "new", ("d3", 7): "more", (None, 0): "again"}
    assert held(store) == rows
    after = store._manifest(2)["folders"]
    touched = store._touched(spark.createDataFrame([("d3",), (None,)], "doc_id string"))
    assert 0 < len(touched) <= 2 and {b for b in before if after.get(b) != before[b]} == touched  # other buckets keep their files

    assert store.delete(spark.createDataFrame([("d5",), ("nobody",)], "doc_id string")) == 3
    assert store.delete(spark.createDataFrame([("d6", 2), (None, 0)], "doc_id string, chunk_index int")) == 4
    rows = {k: v for k, v in rows.items() if k[0] != "d5" and k not in (("d6", 2), (None, 0))}
    assert held(store) == rows
    assert {(r["doc_id"], r["chunk_index"]) for r in store.lookup(spark.createDataFrame([("d3",), ("d5",)], "doc_id string")).collect()} == {("d3", 0), ("d3", 1), ("d3", 2), ("d3", 7)}
    with pytest.raises(ValueError, match="must name"):
        store.delete(spark.createDataFrame([(1,)], "chunk_index int"))

    ordered = spark.createDataFrame([("d9", 0, "late", None, 5), ("d9", 0, "early", None, 1)], f"{CHUNK}, seq int")
    store.upsert(ordered.select("doc_id", "chunk_index", "content", "embedding", "seq").repartition(2), "seq")
    assert held(store)["d9", 0] == "late" and "seq" not in store.read().columns
    assert len({(r["doc_id"], r["chunk_index"]) for r in store.read(1).collect()}) == 91  # old versions are there until they are swept
    assert store.vacuum() > 0 and store.vacuum() == 0 and held(store)["d9", 0] == "late"
    with pytest.raises(Exception, match="v-000000000001"):
        store.read(1)


def test_a_broken_write_changes_nothing(spark, tmp_path, monkeypatch):
    store = keyed.chunk_store(spark, str(tmp_path / "t"), 4)
    store.upsert(chunks(spark, [("a", 0, "one"), ("b", 0, "two")]))

    def breaks(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_publish", breaks)
        with pytest.raises(RuntimeError):
            store.upsert(chunks(spark, [("a", 0, "half")]))
    assert store.version() == 1 and held(store) == {("a", 0): "one", ("b", 0): "two"}
    assert store.vacuum() == 1  # what the broken write left
    assert store.upsert(chunks(spark, [("a", 0, "whole")])) == 2 and held(store)["a", 0] == "whole"

    other = keyed.chunk_store(spark, str(tmp_path / "t"), 4)
    monkeypatch.setattr(other, "version", lambda: 1)  # a writer that began before
    with pytest.raises(keyed.Conflict):
        other.upsert(chunks(spark, [("b", 0, "lost")]))
    assert held(store) == {("a", 0): "whole", ("b", 0): "two"}
    store.delete(spark.createDataFrame([("a",), ("b",)], "doc_id string"))
    assert held(store) == {}


def test_graph_store(spark, tmp_path):
    store = keyed.GraphStore(spark, str(tmp_path / "g"), 4)
    store.upsert_entities(spark.createDataFrame([("Fund", "Fund", "a.pdf#chunk-0"), ("Co", "Company", "a.pdf#chunk-1"), ("Tech", "Sector", "b.csv#chunk-0"), ("", "x", "y"), (None, "x", "y")], "name string, type string, source string"))
    rel = [("Fund", "holds", "Co", "a.pdf#chunk-0"), ("Co", "belongs_to", "Tech", "b.csv#chunk-0"), ("Tech", "related_to", "Tech", "a.pdf#chunk-0"), ("Co", "owns", "Nobody", "b.csv#chunk-0")]
    refused = store.upsert_relations(spark.createDataFrame(rel, "head string, relation string, tail string, source string"))
    assert [r["tail"] for r in refused.collect()] == ["Nobody"]
    store.upsert_entities(spark.createDataFrame([("Tech", "Technology", "b.csv#chunk-9")], "name string, type string, source string"))
    assert {r["name"]: r["type"] for r in store.entities.read().collect()} == {"Fund": "Fund", "Co": "Company", "Tech": "Technology"}
    assert store.delete_by_source(G.source_matches(F.col("source"), "a.pdf", "-")) == 2
    assert [r["name"] for r in store.entities.read().collect()] == ["Tech"] and store.relations.read().count() == 0


# ---------------------------------------------------------------- vectors


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + 0.6 * r.normal(size=24)).astype(np.float32).tolist(), f"s{i % 5}") for i in range(3000)]
    rows += [(5000, None, "x"), (5001, [None] * 24, "x"), (5002, [float("nan")] * 24, "x"), (5003, [1.0], "x"), (5004, [0.0] * 24, "zero"), (5005, rows[0][1], "copy"), (5006, rows[0][1], "copy")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, source string").repartition(6)
    path = str(tmp_path_factory.mktemp("index"))
    return VectorIndex.build(vectors, path), vectors.where("vec_id < 5000 or vec_id > 5003")


def pairs(df):
    return {(r["query_id"], r["vec_id"]) for r in df.collect()}


def test_index_recall(spark, index):
    built, good = index
    asked = good.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = pairs(R.vector_search(asked, good, 10))
    assert spark.read.parquet(f"{built.path}/vectors").count() == good.count() and built.lists > 50
    near = pairs(built.search(asked, 10))
    assert len(near & exact) >= 0.9 * len(exact)
    assert 1 <= built.probes < built.lists  # as many cells as the sample needed
    few = pairs(built.search(asked, 10, 1))
    assert len(few & exact) < len(near & exact)
    assert pairs(built.search(asked, 10, built.lists)) == exact
    ranks = built.search(asked, 3, built.lists).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in ranks] == [0, 5005, 5006] and ranks[0]["score"] == pytest.approx(1.0)


def test_index_reads_probed_cells_only(spark, index):
    built, good = index
    asked = good.where("vec_id = 50").select(F.col("vec_id").alias("query_id"), "embedding")
    plan = built.search(asked, 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list#", "list#")[:100_000] or "list#" in plan.split("PartitionFilters: [")[1][:60]


def test_index_grows_and_is_loaded(spark, index, tmp_path):
    built, good = index
    small = VectorIndex.build(good.where("vec_id < 200"), str(tmp_path / "i"), lists=7)
    small.add(good.where("vec_id >= 200 and vec_id < 400"))
    again = VectorIndex.load(spark, str(tmp_path / "i"))
    asked = good.where("vec_id in (300, 13)").select(F.col("vec_id").alias("query_id"), "embedding")
    assert again.lists == 7 and pairs(again.search(asked, 4, 7)) == pairs(R.vector_search(asked, good.where("vec_id < 400"), 4))
    odd = spark.createDataFrame([(1, None), (2, [1.0, 2.0]), (3, [0.0] * 24)], "query_id int, embedding array<float>")
    assert {r["query_id"] for r in again.search(odd, 2, 7).collect()} == {3}
    empty = VectorIndex.build(good.limit(0), str(tmp_path / "e"))
    assert empty.search(asked, 3).count() == 0


def test_index_search_gives_k_hits_a_task_and_question(spark, index, monkeypatch):
    from weftline.operators import vector_index

    built, good = index
    rows = good.where("vec_id < 3000").orderBy("vec_id").collect()
    q = vector_index._unit(np.array([r["embedding"] for r in rows[:40]], np.float64))
    cell = np.arange(len(rows), dtype=np.int32) % 9
    batches = [pa.RecordBatch.from_pydict({"list": cell[at : at + 500], "vec_id": [r["vec_id"] for r in rows[at : at + 500]], "embedding": [r["embedding"] for r in rows[at : at + 500]]}) for at in range(0, 3000, 500)]
    monkeypatch.setattr(vector_index, "HITS", 100)
    got = list(vector_index._scan(q, np.full(40, -np.inf), built.centres, 5)(iter(batches)))
    assert sum(b.num_rows for b in got) == 40 * 5  # and not five of each of 9 cells and 6 batches
    x = vector_index._unit(np.array([r["embedding"] for r in rows], np.float64))
    best = np.argsort(-np.maximum(q @ x.T, 0.0), axis=1, kind="stable")[:, :5]
    assert {(a, b) for g in got for a, b in zip(g["q"].to_pylist(), g["vec_id"].to_pylist(), strict=True)} == {(i, rows[j]["vec_id"]) for i in range(40) for j in best[i]}


# ---------------------------------------------------------------- labels and paths


def plain_components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_after_edits(spark):
    r = random.Random(4)
    names = [f"n{i:03d}" for i in range(120)]
    edges = {tuple(r.sample(names[:90], 2)) for _ in range(70)}
    nodes = set(names[:90])
    df = lambda e: spark.createDataFrame(sorted(e), "head string, tail string")
    labels = spark.createDataFrame(sorted(plain_components(nodes, edges).items()), "name string, component string")
    for step in range(3):
        removed = set(r.sample(sorted(edges), 12 if step != 1 else 0))
        added = {tuple(r.sample(names, 2)) for _ in range(9 if step != 2 else 0)} - edges
        edges = edges - removed | added
        nodes |= {x for e in added for x in e}
        labels = G.refresh_components(labels, df(edges), df(added), df(removed))
        assert {x["name"]: x["component"] for x in labels.collect()} == plain_components(nodes, edges)


def test_untouched_components_are_not_searched(spark, monkeypatch):
    old = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")], "name string, component string")
    seen = []
    search = G.connected_components
    monkeypatch.setattr(G, "connected_components", lambda nodes, edges: seen.append({x["name"] for x in nodes.collect()}) or search(nodes, edges))
    e = lambda rows: spark.createDataFrame(rows, "head string, tail string")
    new = G.refresh_components(old, e([("a", "b"), ("d", "e")]), e([]), e([("c", "d")]), spark.createDataFrame([("z",)], "name string"))
    assert {x["name"]: x["component"] for x in new.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "z": "z"}
    assert seen == [{"c", "d", "e"}]


def plain_paths(edges, start, goal, most=5):
    """The least of the shortest paths as (nodes, relations)."""
    near, relation = defaultdict(set), {}
    for a, rel, b in edges:
        for x, y in ((a, b), (b, a)):
            near[x].add(y)
            relation[x, y] = min(relation.get((x, y), rel.upper()), rel.upper())
    level = [[start]]
    for _ in range(most + 1):
        found = sorted(p for p in level if p[-1] == goal)
        if found:
            return found[0], [relation[a, b] for a, b in zip(found[0], found[0][1:], strict=False)]
        level = [[*p, n] for p in level for n in near[p[-1]] if n not in p]
    return None


def test_paths_that_meet_in_the_middle(spark):
    r = random.Random(9)
    names = [f"v{i}" for i in range(26)]
    edges = [(*r.sample(names, 1), r.choice(("owns", "holds", "uses")), *r.sample(names, 1)) for _ in range(34)]
    asked = [(a, b) for a in names[:9] for b in names[4:20]] + [("v1", "nobody"), (None, "v2"), ("v3", "v3")]
    got = G.shortest_paths(spark.createDataFrame(edges, "head string, relation string, tail string"), spark.createDataFrame(asked, "start string, goal string"))
    have = {(x["start"], x["goal"]): (x["nodes"], x["relations"]) for x in got.collect()}
    want = {(a, b): p for a, b in asked if a is not None and (p := plain_paths(edges, a, b))}
    assert have == want and {len(n) for n, _ in want.values()} >= {1, 2, 3, 4, 5}
    text = got.where("start = 'v0' and length = 2").select(G.reasoning_path(F.col("nodes"), F.col("relations")).alias("t"), "nodes", "relations").first()
    (a, b, c), (p, q) = text["nodes"], text["relations"]
    assert text["t"] == f"Reasoning path: {a} --[{p}]--> {b} --[{q}]--> {c}"


# ---------------------------------------------------------------- names and words


def test_name_matches_meet_few_candidates(spark):
    """Exactly the pairs of a full comparison, out of under half of all pairs: hashed places are dense, so the bound prunes no more."""
    from weftline.functions import similarity as S

    r = random.Random(7)
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(70)]
    names = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(160)} | {"", "é", "ab", "Global Income Fund", "global income funds", f"{words[0]} {words[1]} {words[2]}", f"{words[0]} {words[1]} {words[2]}s"})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    mentions = df.withColumnRenamed("name", "mention")
    v = defaultdict(dict)
    for x in S.hash_embedding(df, "name", F.col("name"), 768).collect():
        v[x["name"]][x["index"]] = x["value"]
    dot = lambda a, b: sum(x * v[b].get(i, 0.0) for i, x in v[a].items())
    want = {(a, b) for a in names for b in names if v[a] and dot(a, b) >= 0.8}
    got = {(x["mention"], x["name"]): x["score"] for x in R.name_matches(mentions, df, k=1000).collect()}
    assert set(got) == want and len(want) > len(v) and all(s == pytest.approx(dot(a, b)) for (a, b), s in got.items())
    met = R.name_candidates(R.name_vectors(mentions, "mention"), R.name_vectors(df, "name"), 0.8).count()
    assert len(want) <= met < 0.5 * len(v) ** 2
    assert R.name_matches(mentions.limit(0), df).count() == 0


def test_postings_follow_changes(spark, tmp_path):
    from weftline.operators.postings import PostingIndex

    index = PostingIndex(spark, str(tmp_path / "p"), 8)
    texts = {i: f"word{i % 5} common text{i}" for i in range(40)}
    docs = lambda t: spark.createDataFrame(sorted(t.items()), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common word3 nothing"), (2, "text7 word1"), (3, "the and"), (4, None)], "query_id int, question string")
    rows = lambda df: sorted(tuple(x) for x in df.select("query_id", "doc_id", "hits", "n_tokens", "rank").collect())
    index.add(docs(texts))
    assert rows(index.search(asked, 5)) == rows(R.lexical_search(asked, docs(texts), 5))
    index.add(docs({3: "word3 word3 other", 50: "text7", 51: None, 52: ""}))
    index.remove(spark.createDataFrame([(13,), (999,)], "doc_id long"))
    texts |= {3: "word3 word3 other", 50: "text7", 51: None, 52: ""}
    del texts[13]
    live = docs(texts)
    want = rows(R.lexical_search(asked, live, 50))
    assert rows(index.search(asked, 50)) == want
    counts = {x["token"]: x["documents"] for x in index.frequencies().collect()}
    assert counts["common"] == 38 and counts["other"] == 1 and counts["text7"] == 2 and "text13" not in counts and "text3" not in counts
    before = index._read().count()
    index.compact()
    assert rows(index.search(asked, 50)) == want and index._read().count() == sum(counts.values()) < before
