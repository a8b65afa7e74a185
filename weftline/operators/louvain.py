"""Louvain communities: rounds of local moves as joins and aggregates, then contraction of the graph.

A level starts with every node as a community of its own. A round finds, for each node, the
neighbouring community that raises modularity most; moves towards greater communities and
towards lesser ones take turns, so two nodes never just swap. Simultaneous moves can spoil
each other, so what a round gives is measured while the next one is computed, and a round
that does not raise modularity is undone and tried again with a quarter of the moves, and
then with moves of which no two touch the same community: their gains are exact and add up.
So modularity rises with every round that stays, and a level ends where no single move
raises it any more, or two rounds on end raise it by less than ``least``. The communities
then become the nodes of a smaller graph; the last level is one in which nothing moves.

A round is three jobs of equi-joins on (node), (node, community) and (community), whose sums
are partial before they move; nothing but a few sums reaches the driver. Tables lie in the
shared folder, the ones before are deleted. Weights are integers and modularity is compared
as an integer, so results do not depend on partitioning or order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.operators.components import components
from weftline.shared import cut, discard

BIG = "decimal(38,0)"
#: (towards greater communities, share of the moves as a power of 4); None: moves that touch no community in common.
TRIES = ((True, 0), (False, 0), (True, 1), (False, 1), None)


def _far(df: DataFrame) -> DataFrame:
    """A side that is not to be broadcast: each round would send its tables through the driver once more."""
    return df.hint("merge")


@dataclass
class _Level:
    """nodes (node, k, inner): weighted degree and twice the weight inside; links (u, v, w) both ways between different nodes; twice all weight."""

    nodes: DataFrame
    links: DataFrame
    twice: int


def _first_level(nodes: DataFrame, edges: DataFrame) -> _Level:
    names = nodes.select(F.col("name").alias("node")).where("node is not null").distinct()
    pairs = edges.where("head is not null and tail is not null").select(F.greatest("head", "tail").alias("u"), F.least("head", "tail").alias("v")).distinct()
    known = lambda c: names.select(F.col("node").alias(c))
    pairs = cut(pairs.join(_far(known("u")), "u", "left_semi").join(_far(known("v")), "v", "left_semi").select("u", "v"))
    apart = pairs.where("u <> v")
    links = cut(apart.select("u", "v", F.lit(1).cast("long").alias("w")).unionByName(apart.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(1).cast("long").alias("w"))))
    weight = links.select(F.col("u").alias("node"), "w", F.lit(0).cast("long").alias("inner")).unionByName(pairs.where("u = v").select(F.col("u").alias("node"), F.lit(2).cast("long").alias("w"), F.lit(2).cast("long").alias("inner")))
    weight = weight.unionByName(names.select("node", F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("inner")))
    own = cut(weight.groupBy("node").agg(F.sum("w").alias("k"), F.sum("inner").alias("inner")))
    discard(pairs)
    return _Level(own, links, int(own.agg(F.sum("k")).first()[0] or 0))


def _contracted(level: _Level, where: DataFrame) -> _Level:
    """Communities (``where``: node, comm) as nodes."""
    a, b = where.select(F.col("node").alias("u"), F.col("comm").alias("cu")), where.select(F.col("node").alias("v"), F.col("comm").alias("cv"))
    met = cut(level.links.join(_far(a), "u").join(_far(b), "v").groupBy("cu", "cv").agg(F.sum("w").alias("w")))
    links = cut(met.where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"), "w"))
    inside = met.where("cu = cv").select(F.col("cu").alias("node"), F.lit(0).cast("long").alias("k"), F.col("w").alias("inner"))
    held = level.nodes.join(_far(where), "node").select(F.col("comm").alias("node"), "k", "inner")
    nodes = cut(held.unionByName(inside).groupBy("node").agg(F.sum("k").alias("k"), F.sum("inner").alias("inner")))
    discard(met)
    return _Level(nodes, links, level.twice)


@dataclass
class _State:
    """where: (node, comm); rows: (node, comm, k, total, to, to_total, gain) with the best other community of each node; 4 m^2 times the modularity; nodes that gain by a move."""

    where: DataFrame
    rows: DataFrame
    value: int
    eager: int

    def drop(self) -> None:
        discard(self.where, self.rows)


def _scored(level: _Level, where: DataFrame) -> _State:
    squares, inner = Observation(), Observation()
    sized = where.join(_far(level.nodes.select("node", "k", "inner")), "node")
    total = cut(sized.groupBy("comm").agg(F.sum("k").alias("total")).observe(squares, F.sum(F.col("total").cast("decimal(19,0)") * F.col("total")).alias("x")))
    met = level.links.join(_far(where.select(F.col("node").alias("v"), F.col("comm").alias("to"))), "v").select(F.col("u").alias("node"), "to", "w", *(F.lit(0).cast("long").alias(c) for c in ("k", "inner", "own")))
    own = sized.select("node", F.col("comm").alias("to"), F.lit(0).cast("long").alias("w"), "k", "inner", F.lit(1).cast("long").alias("own"))
    per = met.unionByName(own).groupBy("node", "to").agg(*(F.sum(c).alias(c) for c in ("w", "k", "inner", "own")))
    per = per.join(_far(total.withColumnRenamed("comm", "to")), "to")
    row = F.struct("to", "w", "total", "k", "inner")
    # a community's worth to a node needs the node's degree, which its own community's row has
    own = per.where("own > 0").select("node", row.alias("mine"))
    others = per.where("own = 0").select("node", "to", "w", "total")
    both = own.join(_far(others), "node", "left")
    worth = F.col("w").cast(BIG) * F.lit(level.twice) - F.col("mine.k").cast(BIG) * F.col("total")
    stay = F.col("mine.w").cast(BIG) * F.lit(level.twice) - F.col("mine.k").cast(BIG) * (F.col("mine.total") - F.col("mine.k"))
    # of equal gains the smallest community: max_by over the negated order is not to be had for text, so min over (-gain, to)
    best = both.groupBy("node", "mine").agg(F.min(F.when(F.col("to").isNotNull(), F.struct((stay - worth).cast(BIG).alias("loss"), "to", "total"))).alias("best"))
    rows = best.select("node", F.col("mine.to").alias("comm"), F.col("mine.k").alias("k"), F.col("mine.total").alias("total"), F.col("best.to").alias("to"), F.col("best.total").alias("to_total"), (-F.col("best.loss")).alias("gain"), (F.col("mine.w") + F.col("mine.inner")).alias("inside"))
    rows = cut(rows.observe(inner, F.sum("inside").alias("x"), F.count_if(F.col("gain") > 0).alias("eager")))
    discard(total)
    return _State(where, rows, level.twice * int(inner.get["x"] or 0) - int(squares.get["x"] or 0), inner.get["eager"])


def _moves(rows: DataFrame, attempt: tuple[bool, int] | None, salt: int) -> DataFrame:
    """(node, was, comm) before and after the moves of one try."""
    wanted = (F.col("to").isNotNull()) & (F.col("gain") > 0)
    if attempt is not None:
        up, share = attempt
        mine, theirs = F.struct("total", "comm"), F.struct(F.col("to_total").alias("total"), F.col("to").alias("comm"))
        go = wanted & ((theirs > mine) if up else (theirs < mine)) & (F.pmod(F.xxhash64(F.lit(salt), "node"), F.lit(4**share)) == 0)
        return rows.select("node", F.col("comm").alias("was"), F.when(go, F.col("to")).otherwise(F.col("comm")).alias("comm"))
    moves = rows.where(wanted).select("node", "comm", "to", F.struct((-F.col("gain")).alias("loss"), "node").alias("key"))
    first = moves.select("key", F.explode(F.array("comm", "to")).alias("c")).groupBy("c").agg(F.min("key").alias("key"))
    won = moves.join(first.toDF("comm", "k1").hint("rebalance"), "comm").where("key = k1").join(first.toDF("to", "k2").hint("rebalance"), "to").where("key = k2").select("node", F.col("to").alias("new"))
    return rows.select("node", F.col("comm").alias("was")).join(_far(won), "node", "left").select("node", "was", F.coalesce("new", "was").alias("comm"))


def _local_moves(level: _Level, least: float) -> tuple[DataFrame, bool]:
    """(node, comm) where no move is left, and whether any node moved."""
    now = _scored(level, cut(level.nodes.select("node", F.col("node").alias("comm"))))
    enough, moved, at, salt, weak = least * level.twice**2, False, 0, 0, 0
    while now.eager and at < len(TRIES) and weak < 2:
        salt += 1
        changes = Observation()
        new = _moves(now.rows, TRIES[at], salt).withColumn("moves", F.col("comm") != F.col("was"))
        new = cut(new.observe(changes, F.count_if("moves").alias("n")).select("node", "comm"))
        if not changes.get["n"]:  # nobody wants to go that way
            discard(new)
            at += 1
            continue
        then = _scored(level, new)
        if then.value > now.value:
            weak = 0 if then.value - now.value >= enough else weak + 1
            now.drop()
            now, moved = then, True
            at = 1 - at if at < 2 else 0  # the other direction next
        else:
            then.drop()
            at += 1
    discard(now.rows)
    return now.where, moved


def connected_parts(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, community) of labels (name, comm): each connected part of a community with its smallest name.

    A node that held its community together may have left it. Parts without a link between
    them have more modularity apart than as one.
    """
    end = lambda c, k: labels.select(F.col("name").alias(c), F.col("comm").alias(k))
    inside = edges.select("head", "tail").join(_far(end("head", "c1")), "head").join(_far(end("tail", "c2")), "tail").where("c1 = c2 and head <> tail")
    found = components(inside.select("head", "tail"), "head", "tail").select(F.col("id").alias("name"), "component")
    return labels.join(_far(found), "name", "left").select("name", F.coalesce("component", "name").alias("community"))


def louvain(nodes: DataFrame, edges: DataFrame, least: float = 1e-3) -> DataFrame:
    """(name, community): every node with the smallest name of its community.

    ``nodes`` has name, ``edges`` has head and tail. Edges are taken without direction, each
    pair once, as in a simple graph; edges of unknown nodes or null ends are left out, a
    loop counts for its node. ``least`` is the modularity that a round should gain.
    A node without edges is a community of its own, and so is every node if there is no
    edge; an empty table gives an empty result.
    """
    level = _first_level(nodes, edges)
    names = cut(level.nodes.select(F.col("node").alias("name"), F.col("node").alias("comm")))
    while level.twice:
        where, moved = _local_moves(level, least)
        if moved:
            joined = cut(names.join(_far(where.select(F.col("node").alias("comm"), F.col("comm").alias("next"))), "comm").select("name", F.col("next").alias("comm")))
            below = _contracted(level, where)
            discard(names, level.nodes, level.links)
            names, level = joined, below
        discard(where)
        if not moved:
            break
    discard(level.nodes, level.links)
    out = cut(connected_parts(names, edges))
    discard(names)
    return out


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: links, modularity of the labels (name, community), edges read as ``louvain`` reads them."""
    pairs = edges.where("head is not null and tail is not null").select(F.greatest("head", "tail").alias("u"), F.least("head", "tail").alias("v")).distinct()
    a, b = labels.select(F.col("name").alias("u"), F.col("community").alias("cu")), labels.select(F.col("name").alias("v"), F.col("community").alias("cv"))
    met = pairs.join(_far(a), "u").join(_far(b), "v")
    ends = met.select(F.explode(F.array("cu", "cv")).alias("c"), (F.col("cu") == F.col("cv")).cast("long").alias("half"))
    per = ends.groupBy("c").agg(F.count(F.lit(1)).alias("degree"), F.sum("half").alias("inside"))
    sums = per.agg(F.sum("degree").alias("twice"), F.sum("inside").alias("inside"), F.sum(F.col("degree").cast("decimal(19,0)") * F.col("degree")).alias("squares"))
    sums = sums.select(F.coalesce("twice", F.lit(0)).alias("twice"), "inside", "squares")
    return sums.select((F.col("twice") / 2).cast("long").alias("links"), F.when(F.col("twice") > 0, F.col("inside") / F.col("twice") - F.col("squares").cast("double") / (F.col("twice").cast("double") * F.col("twice"))).alias("modularity"))
