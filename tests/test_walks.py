"""Walks through hubs, and communities of one piece."""

from collections import Counter, defaultdict

from weftline import vocab
from weftline.operators import graph as G
from weftline.operators.louvain import connected_parts, modularity

HOLDING = [m for m in vocab.METAPATHS.values() if m.steps[0][1] == "holds"]
PEERS = vocab.METAPATHS["shared_sector"]


def peers(spark):
    edges = [(f"c{i}", "belongs_to", f"s{i % 3}") for i in range(60)] + [("c0", "belongs_to", "s1"), ("c1", "belongs_to", "s1"), ("c9", "belongs_to", "none")]
    names = [(f"c{i}", "Company") for i in range(60)] + [(f"s{i}", "Sector") for i in range(3)]
    members = defaultdict(list)
    for c, _, s in edges:
        members[s].append(c)
    walks = Counter((c, other) for c, _, s in edges if s != "none" for other in members[s])
    return spark.createDataFrame(names, "name string, type string"), spark.createDataFrame(edges, "head string, relation string, tail string"), walks


def test_sums_of_walks_without_their_pairs(spark):
    ent, edges, walks = peers(spark)
    got = {r["start"]: (r["walks"], r["ends"]) for r in G.walk_sums(ent, edges, PEERS).collect()}
    assert got == {s: (sum(n for (a, _), n in walks.items() if a == s), sum(a == s for a, _ in walks)) for s in {a for a, _ in walks}}
    # the ends of a hub are there once, and again only for the company of two sectors
    _, ends = G.walk_reach(ent, edges, PEERS)
    assert ends.count() < 140 < len(walks)


def test_walks_through_a_hub_are_dealt(spark, monkeypatch):
    ent, edges, walks = peers(spark)
    monkeypatch.setattr(G, "HUB", 4)
    got = G.traverse(ent, edges, PEERS)
    assert Counter((r["start"], r["end"]) for r in got.collect()) == walks
    assert "_part" in got._jdf.queryExecution().executedPlan().toString()


def test_a_community_in_two_pieces_is_two(spark):
    labels = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x"), ("e", "x"), ("f", "y")], "name string, comm string")
    edges = spark.createDataFrame([("b", "a"), ("c", "d"), ("b", "f"), ("f", "c"), ("e", "e"), (None, "a")], "head string, tail string")
    got = {tuple(r) for r in connected_parts(labels, edges).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e"), ("f", "f")}


def holdings(spark):
    """Funds, companies and what is behind them, with edges of wrong types, repeated edges, and companies that lead nowhere."""
    names = [(f"f{i}", "Fund") for i in range(30)] + [(f"c{i}", "Company") for i in range(12)] + [(f"{t[0].lower()}{t[1]}{i}", t) for t in ("Sector", "Region", "Supplier", "Technology", "Regulation") for i in range(4)]
    edges = [(f"f{i}", "holds", f"c{(i * k) % 13}") for i in range(30) for k in (1, 2, 3, 5)] + [("c1", "holds", "c2"), ("x", "holds", "c3"), ("f1", "holds", "f2"), (None, "holds", "c1"), ("f1", "holds", None)]
    for relation, t, n in (("belongs_to", "se", 1), ("located_in", "re", 1), ("depends_on", "su", 3), ("uses", "te", 2), ("subject_to", "re", 1)):
        edges += [(f"c{i}", relation, f"{t}{(i + j) % 4}") for i in range(10) for j in range(n)]
    edges += [("c1", "uses", "te0"), ("c1", "uses", "te0"), ("c2", "uses", "f3"), ("f1", "uses", "te1")]
    return spark.createDataFrame(names, "name string, type string"), spark.createDataFrame(edges, "head string, relation string, tail string")


def test_metapaths_of_one_first_step_are_summed_at_once(spark, monkeypatch):
    ent, edges = holdings(spark)
    asked, far = [*HOLDING, PEERS], []
    real = G.walk_sums
    want = {(m.name, *r) for m in asked for r in real(ent, edges, m).select("start", "walks", "ends").collect()}
    assert len({w[0] for w in want}) == len(asked) and any(w[2] != w[3] for w in want)
    monkeypatch.setattr(G, "walk_sums", lambda e, x, m: far.append(m.name) or real(e, x, m))
    for few in (16, 2, 0):
        far.clear()
        monkeypatch.setattr(G, "FEW", few)
        assert {tuple(r) for r in G.walk_features(ent, edges, asked).select("metapath", "start", "walks", "ends").collect()} == want
        assert len(far) == {16: 0, 2: 3, 0: 6}[few]


def test_totals_of_walks_without_their_pairs(spark):
    ent, edges = holdings(spark)
    asked = [*HOLDING, PEERS, vocab.METAPATHS["subsidiary_chain"]]
    got = {r["metapath"]: (r["instances"], r["ends"], r["starts"]) for r in G.walk_totals(ent, edges, asked).collect()}
    for m in asked:
        walks = G.traverse(ent, edges, m).select("start", "end").collect()
        assert got[m.name] == (len(walks), len({w["end"] for w in walks}), len({w["start"] for w in walks}))


def test_modularity_broadcasts_nothing(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "head string, tail string")
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")], "name string, community string")
    got = modularity(labels, edges)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and got.first()["links"] == 3
