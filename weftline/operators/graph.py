"""The typed property graph: tables (name, type) and (head, relation, tail), traversal and maintenance."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import vocab
from weftline.operators.components import components
from weftline.operators.louvain import louvain
from weftline.shared import cut, discard, shared_folder

log = logging.getLogger(__name__)

#: Edges onward from a node beyond which the walks into it are dealt to several tasks.
HUB = 1000
#: Nodes onward from a node up to which they go along with each edge into it.
FEW = 16
#: Edges of a task that sums walks by their start.
EDGES = 1 << 18
EDGE = "struct<head:string,relation:string,tail:string>"


def durable(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so an iteration does not grow its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


# ---------------------------------------------------------------- visibility


def owner(source: Column) -> Column:
    """The document of a chunk's source."""
    return F.substring_index(source, "#chunk-", 1)


def visible(df: DataFrame, registry: DataFrame, source_col: str = "source") -> DataFrame:
    """Rows of unknown or committed documents."""
    hidden = registry.where("status <> 'committed'").select(F.col("doc_id").alias("_owner"))
    return df.withColumn("_owner", owner(F.col(source_col))).join(hidden, "_owner", "left_anti").drop("_owner")


def visible_subgraph(entities: DataFrame, relations: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    ents = visible(entities, registry)
    names = ents.select("name").distinct()
    rels = visible(relations, registry)
    rels = rels.join(names.withColumnRenamed("name", "head"), "head", "left_semi").join(names.withColumnRenamed("name", "tail"), "tail", "left_semi")
    return ents, rels


# ---------------------------------------------------------------- traversal


def undirected(edges: DataFrame) -> DataFrame:
    """(source, relation, target): each edge once from either end."""
    out = edges.select(F.col("head").alias("source"), "relation", F.col("tail").alias("target"))
    return out.unionByName(edges.select(F.col("tail").alias("source"), "relation", F.col("head").alias("target")))


def neighbors(edges: DataFrame, starts: DataFrame, hops: int = 2, entities: DataFrame | None = None) -> DataFrame:
    """(start, hop, source, relation, target[, target_type]): every edge met by a breadth-first search.

    ``starts`` has the column ``start``. An edge is met again from its other end, as the
    search goes over frontier nodes; nodes are expanded once per start.
    """
    und = undirected(edges)
    if entities is not None:
        # an edge has its target's type before the search, so what is met is not joined again
        types = entities.select(F.col("name").alias("target"), F.col("type").alias("target_type"))
        und = und.join(types, "target", "left").withColumn("target_type", F.coalesce("target_type", F.lit("")))
    und = cut(und) if hops > 1 else und  # read once a hop, made once
    shown = ["start", "hop", "source", "relation", "target"] if entities is None else ["target", "start", "hop", "source", "relation", "target_type"]
    seen = starts.select("start", F.col("start").alias("node")).distinct()
    frontier, found = seen, []
    for hop in range(1, hops + 1):
        met = frontier.join(und, frontier["node"] == und["source"]).withColumn("hop", F.lit(hop)).select(*shown)
        found.append(met)
        if hop == hops:
            break
        fresh = met.select("start", F.col("target").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        frontier = durable(fresh) if hop % 2 == 0 else fresh
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, found)


def trails(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """(start, target, relations): undirected walks of one to ``hops`` edges that use no edge twice."""
    numbered = edges.select("head", "relation", "tail", F.xxhash64("head", "relation", "tail").alias("edge"))
    und = numbered.select("edge", "relation", F.col("head").alias("source"), F.col("tail").alias("next"))
    und = und.unionByName(numbered.where("head <> tail").select("edge", "relation", F.col("tail").alias("source"), F.col("head").alias("next")))
    cur = starts.select("start", F.col("start").alias("target"), F.array().cast("array<string>").alias("relations"), F.array().cast("array<bigint>").alias("used"))
    found = []
    for _ in range(hops):
        cur = cur.join(und, cur["target"] == und["source"]).where(~F.array_contains("used", F.col("edge"))).select(
            "start", F.col("next").alias("target"), F.concat("relations", F.array("relation")).alias("relations"), F.concat("used", F.array("edge")).alias("used")
        )
        found.append(cur.select("start", "target", "relations"))
    return reduce(DataFrame.unionByName, found)


def check_metapath(m: vocab.Metapath) -> None:
    """Raises ValueError for a path that names unknown types, relations or directions or that does not connect."""
    if not m.name or not m.steps:
        raise ValueError("a metapath needs a name and steps")
    for a, relation, way, b in m.steps:
        if a not in vocab.ENTITY_TYPES or b not in vocab.ENTITY_TYPES or relation.upper() not in vocab.RELATION_TYPES or way not in ("out", "in"):
            raise ValueError(f"{m.name}: bad step {(a, relation, way, b)}")
    for (_, _, _, b), (a, _, _, _) in zip(m.steps, m.steps[1:], strict=False):
        if a != b:
            raise ValueError(f"{m.name}: {b} does not meet {a}")


def _through_hubs(cur: DataFrame, step: DataFrame) -> DataFrame:
    """``cur`` joined with ``step`` on end = _a; walks into a node of many edges are dealt to several tasks, each with its edges."""
    onward = step.groupBy("_a").agg(F.count(F.lit(1)).alias("_n"))
    if (onward.agg(F.max("_n")).first()[0] or 0) <= HUB:
        return cur.join(step, cur["end"] == step["_a"])
    hubs = cut(onward.where(F.col("_n") > HUB).select(F.col("_a").alias("_h"), F.least(F.ceil(F.col("_n") / HUB), F.lit(64)).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = cur.join(hubs, cur["end"] == hubs["_h"], "left").withColumn("_part", F.pmod(F.xxhash64("start", F.size("path"), F.to_json("path")), parts).cast("int")).drop("_h", "_parts")
    right = step.join(hubs, step["_a"] == hubs["_h"], "left").withColumn("_at", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_h", "_parts")
    tasks = 25 * cur.sparkSession.sparkContext.defaultParallelism  # a number of its own, as few rows are many walks
    left, right = left.repartition(tasks, "end", "_part"), right.repartition(tasks, "_a", "_at")
    return left.hint("shuffle_hash").join(right.hint("shuffle_hash"), (left["end"] == right["_a"]) & (left["_part"] == right["_at"]))


def traverse(entities: DataFrame, edges: DataFrame, m: vocab.Metapath, starts: DataFrame | None = None, unique_edges: bool = False) -> DataFrame:
    """(start, end, path): the walks along a metapath.

    The path compiles to a chain of equi-joins; edges are filtered by relation and nodes
    by type before each join. ``unique_edges`` forbids using an edge twice, which keeps
    a walk from returning along its own step.
    """
    check_metapath(m)
    typed = lambda t: entities.where(F.col("type") == t).select(F.col("name").alias("_n")).distinct()
    cur = typed(m.steps[0][0]).select(F.col("_n").alias("start"))
    if starts is not None:
        cur = cur.join(starts.select("start").distinct(), "start", "left_semi")
    cur = cur.select("start", F.col("start").alias("end"), F.array().cast(f"array<{EDGE}>").alias("path"))
    for i, (_, relation, way, to) in enumerate(m.steps):
        e = edges.where(F.lower("relation") == relation)
        step = e.select(F.col("head").alias("_a"), F.col("tail").alias("_b"), F.struct(F.col("head"), F.upper("relation").alias("relation"), F.col("tail")).alias("_e"))
        if way == "in":
            step = step.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "_e")
        step = step.join(typed(to), F.col("_b") == F.col("_n"), "left_semi")
        cur = cur.join(step, cur["end"] == step["_a"]) if i == 0 else _through_hubs(cur, cut(step))
        if unique_edges:
            cur = cur.where(~F.array_contains("path", F.col("_e")))
        shown = F.struct(F.col("_a").alias("head"), F.col("_e.relation").alias("relation"), F.col("_b").alias("tail")) if not unique_edges else F.col("_e")
        cur = cur.select("start", F.col("_b").alias("end"), F.concat("path", F.array(shown)).alias("path"))
    return cur


def walk_counts(entities: DataFrame, edges: DataFrame, m: vocab.Metapath) -> DataFrame:
    """(start, end, walks): how many walks along a metapath join two nodes, without building a path.

    From the last step to the first, and summed at each, so a hub of the middle steps
    meets one row for each end and not one for each walk.
    """
    check_metapath(m)
    typed = lambda t, c: entities.where(F.col("type") == t).select(F.col("name").alias(c)).distinct()
    out = None
    for a, relation, way, b in reversed(m.steps):
        ends = ("head", "tail") if way == "out" else ("tail", "head")
        step = edges.where(F.lower("relation") == relation).select(F.col(ends[0]).alias("start"), F.col(ends[1]).alias("mid"))
        step = step.join(typed(a, "start"), "start", "left_semi")
        if out is None:
            out = step.join(typed(b, "mid"), "mid", "left_semi").groupBy("start", F.col("mid").alias("end")).agg(F.count(F.lit(1)).alias("walks"))
        else:
            out = step.join(out.withColumnRenamed("start", "mid"), "mid").groupBy("start", "end").agg(F.sum("walks").alias("walks"))
    return out


def walk_reach(entities: DataFrame, edges: DataFrame, m: vocab.Metapath) -> tuple[DataFrame, DataFrame]:
    """((start, reach, walks), (reach, end)): how many walks start at each node, and the distinct ends they reach.

    Nodes that go on to the same set share its key ``reach``, so all that lead to one hub
    have the hub's ends once and not once each; only a node with several sets ahead gets one of its own.
    """
    check_metapath(m)
    typed = lambda t, c: entities.where(F.col("type") == t).select(F.col("name").alias(c)).distinct()
    known = ends = None
    for i, (a, relation, way, b) in enumerate(reversed(m.steps)):
        at = ("head", "tail") if way == "out" else ("tail", "head")
        step = edges.where(F.lower("relation") == relation).select(F.col(at[0]).alias("start"), F.col(at[1]).alias("mid"))
        step = step.join(typed(a, "start"), "start", "left_semi")
        own = F.concat(F.lit(f"{i}:"), "start")
        if known is None:
            step = cut(step.join(typed(b, "mid"), "mid", "left_semi"))
            known = step.groupBy("start").agg(F.count(F.lit(1)).alias("walks")).select("start", own.alias("reach"), "walks")
            ends = step.select(own.alias("reach"), F.col("mid").alias("end")).distinct()
            continue
        met = cut(step.join(known.withColumnRenamed("start", "mid"), "mid").select("start", "reach", "walks"))
        per = met.groupBy("start").agg(F.sum("walks").alias("walks"), F.min("reach").alias("low"), F.max("reach").alias("high"))
        many = met.select("start", "reach").distinct().join(per.where("low <> high").select("start"), "start", "left_semi")
        ends = ends.unionByName(many.join(ends, "reach").select(own.alias("reach"), "end").distinct())
        known = per.select("start", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(own).alias("reach"), "walks")
    return known, ends


def walk_sums(entities: DataFrame, edges: DataFrame, m: vocab.Metapath) -> DataFrame:
    """(start, walks, ends): how many walks start at each node, and how many distinct ends they reach."""
    known, ends = walk_reach(entities, edges, m)
    return known.join(ends.groupBy("reach").agg(F.count(F.lit(1)).alias("ends")), "reach").select("start", "walks", "ends")


def _first_steps(metapaths) -> dict[tuple, list[vocab.Metapath]]:
    """Metapaths by their first step, which those of a group have in common."""
    out: dict[tuple, list[vocab.Metapath]] = {}
    for m in metapaths:
        check_metapath(m)
        out.setdefault(m.steps[0], []).append(m)
    return out


def _onward(entities: DataFrame, edges: DataFrame, m: vocab.Metapath) -> DataFrame:
    """(mid, end, walks) of the steps behind the first."""
    return walk_counts(entities, edges, replace(m, steps=m.steps[1:])).withColumnRenamed("start", "mid")


def _step(edges: DataFrame, step: tuple) -> DataFrame:
    """(start, mid): the edges of a step, of nodes of any type."""
    at = ("head", "tail") if step[2] == "out" else ("tail", "head")
    return edges.where(F.lower("relation") == step[1]).select(F.col(at[0]).alias("start"), F.col(at[1]).alias("mid"))


def walk_features(entities: DataFrame, edges: DataFrame, metapaths) -> DataFrame:
    """(metapath, start, walks, ends) of all metapaths: how many walks start at a node, and how many distinct ends they reach.

    Metapaths with the same first step walk it once: an edge meets what lies ahead of its
    node on all of them, as numbers, and goes to its start, where all is summed without a
    further shuffle. A metapath with more than ``FEW`` ends ahead of a node, or of another
    length than two, shares sets of ends instead (``walk_sums``).
    """
    out = []
    for first, ms in _first_steps(metapaths).items():
        near = {}
        for m in ms:
            onward = cut(_onward(entities, edges, m)) if len(m.steps) == 2 else None
            if onward is not None and (onward.groupBy("mid").count().agg(F.max("count")).first()[0] or 0) <= FEW:
                near[m.name] = onward
            else:
                discard(onward)
                out.append(walk_sums(entities, edges, m).select(F.lit(m.name).alias("metapath"), "start", "walks", "ends"))
        if not near:
            continue
        ahead = []
        for i, onward in enumerate(near.values()):
            # numbers that are written keep; those of a metapath have its place as rest
            ends = cut(onward.select("end").distinct().select("end", (F.monotonically_increasing_id() * len(near) + i).alias("e")))
            ahead.append(onward.join(ends, "end").select("mid", F.struct("e", "walks").alias("x")))
        mids = reduce(DataFrame.unionByName, ahead).groupBy("mid").agg(F.collect_list("x").alias("x")).select("mid", "x.e", "x.walks")  # FEW of each metapath at most
        step = _step(edges, first)
        tasks = max(1, -(-step.count() // EDGES))
        rows = step.join(mids, "mid").select("start", "e", "walks").repartition(tasks, "start")
        rows = rows.select("start", "walks", F.posexplode("e").alias("at", "e")).select("start", "e", F.get("walks", F.col("at")).alias("walks"))
        per = rows.groupBy("start", "e").agg(F.sum("walks").alias("walks")).groupBy("start", F.pmod("e", F.lit(len(near))).alias("i")).agg(F.sum("walks").alias("walks"), F.count(F.lit(1)).alias("ends"))
        per = per.join(entities.where(F.col("type") == first[0]).select(F.col("name").alias("start")).distinct(), "start", "left_semi")
        out.append(per.select(F.get(F.array(*map(F.lit, near)), F.col("i").cast("int")).alias("metapath"), "start", "walks", "ends"))
    return reduce(DataFrame.unionByName, out)


def walk_totals(entities: DataFrame, edges: DataFrame, metapaths) -> DataFrame:
    """(metapath, instances, ends, starts), a row each: all walks of a metapath, and the distinct nodes at which they end and start.

    Counted from how many edges of the first step enter a node and how many walks go on from
    it, so no start meets an end. Starts are looked for only where some nodes lead nowhere.
    """
    out = []
    for first, ms in _first_steps(metapaths).items():
        known = entities.where(F.col("type") == first[0]).select(F.col("name").alias("start")).distinct()
        step = cut(_step(edges, first).join(known, "start", "left_semi"))  # lies by start
        into = cut(step.groupBy("mid").agg(F.count(F.lit(1)).alias("n")))
        starts = step.agg(F.count_distinct("start").alias("starts"))
        for m in ms:
            if len(m.steps) == 1:
                rest = entities.where(F.col("type") == first[3]).select(F.col("name").alias("mid")).distinct().select("mid", F.col("mid").alias("end"), F.lit(1).alias("walks"))
            else:
                rest = _onward(entities, edges, m)
            met = cut(into.join(rest, "mid").select("mid", "end", (F.col("n") * F.col("walks")).alias("walks")))
            alive = met.select("mid").distinct()
            if into.join(alive, "mid", "left_anti").limit(1).count():
                begun = step.join(alive, "mid", "left_semi").agg(F.count_distinct("start").alias("starts"))
            else:
                begun = starts
            sums = met.agg(F.coalesce(F.sum("walks"), F.lit(0)).alias("instances"), F.count_distinct("end").alias("ends"))
            out.append(sums.join(begun, F.lit(True)).select(F.lit(m.name).alias("metapath"), "instances", "ends", "starts"))  # a row each
    return reduce(DataFrame.unionByName, out)


def path_instances(entities: DataFrame, edges: DataFrame, m: vocab.Metapath, limit: int | None = 1000) -> DataFrame:
    """(metapath, instance_id, start_id, nodes, edge_ids) of the walks from every node of the first type.

    Ordered by start and then by nodes; of each metapath the first ``limit`` (none: all).
    Ids are hashes of what they name, so they need no numbering.
    """
    node_id = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 16)
    walks = traverse(entities, edges, m)
    nodes = F.concat(F.array("start"), F.transform("path", lambda e: e["tail"]))
    ids = F.transform("path", lambda e: node_id(F.concat_ws("|", e["head"], e["relation"], e["tail"])))
    out = walks.select(F.lit(m.name).alias("metapath"), "start", nodes.alias("nodes"), ids.alias("edge_ids"))
    if limit is not None:
        out = out.orderBy("start", "nodes").limit(limit)
    return out.select("metapath", node_id(F.concat_ws("|", F.col("metapath"), F.array_join("edge_ids", "|"))).alias("instance_id"), node_id(F.col("start")).alias("start_id"), "nodes", "edge_ids")


def evidence(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda e: F.concat(e["head"], F.lit(" -["), e["relation"], F.lit("]-> "), e["tail"])), "; ")


def metapath_text(name: Column, path: Column) -> Column:
    """A walk as evidence, with what its metapath stands for. The wording is a fixed value."""
    known = F.create_map(*[F.lit(x) for m in vocab.METAPATHS.values() for x in (m.name, m.description)])
    return F.concat(F.lit("Metapath "), name, F.lit(": "), evidence(path), F.lit(". This supports "), F.try_element_at(known, name))


def intermediates(path: Column) -> Column:
    return F.transform(F.slice(path, 1, F.size(path) - 1), lambda e: e["tail"])


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """(start, goal, length, nodes, relations): one shortest undirected path for each pair within ``most`` hops.

    Two searches meet in the middle: level by level, by turns from the starts and from the
    goals, and after each level the pairs whose fronts touch are answered and dropped, with
    the fronts that no open pair needs. Of equal paths the one with the least nodes in order
    is taken, and of relations between two nodes the least, in capitals, so ties fall alike
    in every run.
    """
    # of relations between two nodes the least is taken when paths are compared
    und = cut(undirected(edges).where("source is not null and target is not null").select("source", "target", F.upper("relation").alias("relation")))
    open_ = cut(pairs.select("start", "goal").where("start is not null and goal is not null").distinct())
    side = lambda c: open_.select(F.col(c).alias("root")).distinct().select("root", F.col("root").alias("node"), F.array("root").alias("nodes"), F.array().cast("array<string>").alias("rels"))
    fronts, seen, answered = {c: cut(side(c)) for c in ("start", "goal")}, {}, []
    seen = {c: [fronts[c].select("root", "node")] for c in fronts}
    for k in range(most + 1):
        if k:
            c = "start" if k % 2 else "goal"
            need = open_.select(F.col(c).alias("root")).distinct()
            met = fronts[c].join(need, "root", "left_semi").join(und, F.col("node") == F.col("source"))
            grown = (F.concat("nodes", F.array("target")), F.concat("rels", F.array("relation"))) if c == "start" else (F.concat(F.array("target"), "nodes"), F.concat(F.array("relation"), "rels"))
            best = met.select("root", F.col("target").alias("node"), F.struct(grown[0].alias("nodes"), grown[1].alias("rels")).alias("p")).groupBy("root", "node").agg(F.min("p").alias("p"))
            known = reduce(DataFrame.unionByName, seen[c])
            fronts[c] = cut(best.join(known, ["root", "node"], "left_anti").select("root", "node", "p.nodes", "p.rels"))
            seen[c].append(fronts[c].select("root", "node"))
        mine = fronts["start"].select(F.col("root").alias("start"), "node", "nodes", "rels").join(open_, "start")
        theirs = fronts["goal"].select(F.col("root").alias("goal"), "node", F.col("nodes").alias("onward"), F.col("rels").alias("rest"))
        joined = mine.join(theirs, ["goal", "node"]).groupBy("start", "goal").agg(F.min(F.struct(F.concat("nodes", F.slice("onward", F.lit(2), F.size("onward"))).alias("nodes"), F.concat("rels", "rest").alias("relations"))).alias("p"))
        found = cut(joined.select("start", "goal", F.lit(k).alias("length"), "p.nodes", "p.relations"))
        answered.append(found)
        last, open_ = open_, cut(open_.join(found, ["start", "goal"], "left_anti"))
        discard(last)
        if not open_.limit(1).count():
            break
    discard(und, open_)
    return pairs.join(reduce(DataFrame.unionByName, answered), ["start", "goal"])


def reasoning_path(nodes: Column, relations: Column) -> Column:
    """A path as evidence. The wording is a fixed value."""
    steps = F.transform(relations, lambda r, i: F.concat(F.lit(" --["), r, F.lit("]--> "), F.get(nodes, i + 1)))
    return F.concat(F.lit("Reasoning path: "), nodes[0], F.array_join(steps, ""))


# ---------------------------------------------------------------- components and communities


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, component): the smallest name that each node reaches, over edges between nodes of the table."""
    names = nodes.select("name").distinct()
    inside = edges.join(names.select(F.col("name").alias("head")), "head", "left_semi").join(names.select(F.col("name").alias("tail")), "tail", "left_semi")
    found = components(inside, "head", "tail")
    return names.join(found, names["name"] == found["id"], "left").select("name", F.coalesce("component", "name").alias("component"))


def refresh_components(old: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame, new_nodes: DataFrame | None = None) -> DataFrame:
    """(name, component) after a change, from the labels before it; equal to labels made anew.

    ``edges`` has the edges after the change, ``added`` and ``removed`` (head, tail) what
    changed. Only components that lost an edge are searched again, over their own edges;
    added edges then join labels, each component being one node. Rows of other components
    keep their labels without a search. A node that lost all edges stays, as its own
    component; nodes that come (``new_nodes``: name, or the ends of added edges) are new.
    """
    ends = lambda df: df.select(F.explode(F.array("head", "tail")).alias("name")).where("name is not null").distinct()
    hit = old.join(ends(removed), "name", "left_semi").select("component").distinct()
    again = cut(old.join(hit, "component", "left_semi").select("name"))
    inside = edges.join(again.select(F.col("name").alias("head")), "head", "left_semi").join(again.select(F.col("name").alias("tail")), "tail", "left_semi")
    fresh = ends(added) if new_nodes is None else ends(added).unionByName(new_nodes.select("name")).distinct()
    fresh = fresh.join(old.select("name"), "name", "left_anti").select("name", F.col("name").alias("component"))
    kept = old.join(hit, "component", "left_anti").select("name", "component")
    labels = cut(kept.unionByName(connected_components(again, inside)).unionByName(fresh))
    label = lambda c: labels.select(F.col("name").alias(c), F.col("component").alias(f"{c}_label"))
    joins = components(added.select("head", "tail").join(label("head"), "head").join(label("tail"), "tail"), "head_label", "tail_label")
    return labels.join(joins, labels["component"] == joins["id"], "left").select("name", F.coalesce(joins["component"], labels["component"]).alias("component"))


def communities(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(community_id, members, relations, summary) of components with two members or more."""
    groups = labels.groupBy("component").agg(F.array_sort(F.collect_set("name")).alias("members")).where(F.size("members") > 1)
    text = F.concat("head", F.lit(" -["), F.upper("relation"), F.lit("]-> "), "tail")
    inside = edges.join(labels.select(F.col("name").alias("head"), "component"), "head").groupBy("component").agg(F.array_sort(F.collect_set(text)).alias("relations"))
    out = groups.join(inside, "component", "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<string>")))
    return out.select(F.substring(F.sha2(F.array_join("members", "|").cast("binary"), 256), 1, 12).alias("community_id"), "members", "relations", summary(F.col("members"), F.col("relations")).alias("summary"))


def summary(members: Column, relations: Column) -> Column:
    """The structured summary: first eight members, up to five themes, first eight relations. The wording is a fixed value."""
    shown = F.array_join(F.slice(members, 1, 8), ", ")
    themes = F.array_sort(F.array_distinct(F.transform(relations, lambda r: F.lower(F.replace(F.regexp_extract(r, r"-\[([A-Z_]+)\]->", 1), F.lit("_"), F.lit(" "))))))
    themes = F.array_join(F.slice(F.filter(themes, lambda x: x != ""), 1, 5), ", ")
    return F.when(F.size(relations) == 0, F.concat(F.lit("Graph community summary: "), shown, F.lit(". No direct intra-community relationships were captured."))).otherwise(
        F.concat(F.lit("Graph community summary: "), shown, F.lit(". Main relationship themes: "), F.when(themes == "", "captured relationships").otherwise(themes), F.lit(". Representative evidence: "), F.array_join(F.slice(relations, 1, 8), "; "), F.lit("."))
    )


def detect_communities(nodes: DataFrame, edges: DataFrame, detect: Callable[[DataFrame, DataFrame], DataFrame] = louvain) -> tuple[DataFrame, str]:
    """((name, community), algorithm): Louvain communities, or connected components where that fails."""
    try:
        return detect(nodes, edges), "louvain"
    except Exception:
        log.warning("community detection failed, using connected components", exc_info=True)
        return connected_components(nodes, edges).withColumnRenamed("component", "community"), "connected_components"


# ---------------------------------------------------------------- maintenance


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that was written last."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_entities(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Merge mode: stored type and confidence stay, a description is replaced if not empty, versions count up."""
    n = new.select("name", *[F.col(c).alias(f"_{c}") for c in ("type", "description", "confidence")])
    both = stored.join(n, "name", "full_outer")
    return both.select(
        "name", F.coalesce("type", "_type").alias("type"), F.coalesce(F.nullif("_description", F.lit("")), "description", "_description").alias("description"),
        F.coalesce("confidence", "_confidence").alias("confidence"), (F.coalesce("version", F.lit(0)) + F.when(F.col("_type").isNotNull(), 1).otherwise(0)).alias("version"),
    )


def source_matches(source: Column, path: str, hashed: str) -> Column:
    return (source == path) | source.startswith(f"{path}#chunk-") | source.startswith(f"{hashed}#chunk-")


def delete_by_source(entities: DataFrame, relations: DataFrame, gone: Column, gone_relation: Column) -> tuple[DataFrame, DataFrame]:
    """Entities of a source go, and with them their relations and the source's own."""
    names = entities.where(gone).select("name").distinct()
    left = relations.where(~gone_relation).join(names.withColumnRenamed("name", "head"), "head", "left_anti").join(names.withColumnRenamed("name", "tail"), "tail", "left_anti")
    return entities.where(~gone), left
