"""Ranked retrieval, fusion and selection over batches of questions."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline import vocab
from weftline.functions import similarity as S
from weftline.functions import text as T
from weftline.operators import graph as G
from weftline.operators import routing
from weftline.operators.cross import cosine_candidates, lexical_candidates, name_scores
from weftline.shared import cut

log = logging.getLogger(__name__)

#: Names that a task makes vectors of.
NAMES = 4096
QUERY_SIDE = 10_000  # questions that a batch may broadcast; a larger batch is dealt out instead


def top_k(df: DataFrame, by: list[str], order: list[Column], k: Column | int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the plan cuts each partition to k before it shuffles."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def blocks(queries: DataFrame) -> list[DataFrame]:
    """A question batch (query_id, ...) as broadcast sides of at most about ``QUERY_SIDE`` rows each."""
    n = queries.count()
    if n <= QUERY_SIDE:
        return [F.broadcast(queries)]
    parts = -(-2 * n // QUERY_SIDE)  # half full on average, so that chance does not overfill one
    mine = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    return [F.broadcast(queries.where(mine == i)) for i in range(parts)]


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score, rank) by cosine, clamped at 0; exact."""
    return top_k(cosine_candidates(queries, vectors, k), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


def lexical_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, n_tokens, hits): how many of a question's tokens each document has, unranked.

    Tokens meet by an equi-join, so only documents that share a token are scored.
    """
    q = queries.select("query_id", T.query_tokens(F.col("question")).alias("tokens"))
    wanted = q.select("query_id", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))
    vocabulary = wanted.select("token").distinct()
    have = docs.select("doc_id", F.explode(F.array_distinct(T.ascii_tokens(F.col("text")))).alias("token")).join(vocabulary, "token", "left_semi")
    return have.join(wanted, "token").groupBy("query_id", "doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("hits"))


def lexical_search(queries: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, doc_id, hits, n_tokens, rank): documents by the share of the question's tokens they have.

    Counted block by block from postings, so a token that all have is no row a pair.
    """
    none = F.array().cast("array<string>")
    q = queries.select("query_id", F.coalesce(T.query_tokens(F.col("question")), none).alias("tokens"))
    d = docs.select("doc_id", F.coalesce(F.array_distinct(T.ascii_tokens(F.col("text"))), none).alias("tokens"))
    return top_k(lexical_candidates(q, d, k), ["query_id"], [F.desc("hits"), F.asc("doc_id")], k)


def merge_candidates(rows: DataFrame, k: int) -> DataFrame:
    """The best row of each (query_id, key), then the best k of each query."""
    best = rows.groupBy("query_id", "key").agg(F.max("score").alias("score"))
    return top_k(best, ["query_id"], [F.desc("score"), F.asc("key")], k)


def first_of_each(contexts: DataFrame, key: str = "key") -> DataFrame:
    """The first context of each key in (branch_ord, pos) order."""
    rest = [c for c in contexts.columns if c not in ("query_id", key)]
    first = contexts.groupBy("query_id", key).agg(F.min_by(F.struct(*rest), F.struct("branch_ord", "pos")).alias("_r"))
    return first.select("query_id", key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def fuse(contexts: DataFrame, dedup_first: bool = True, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, branch_ord, pos, key, score).

    ``dedup_first`` removes repeated keys before ranking, so branches interleave by rank;
    otherwise a key sums what each of its branches gives.
    """
    rows = first_of_each(contexts) if dedup_first else contexts
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "branch_ord").orderBy(F.desc("score"), F.asc("pos"))))
    fused = ranked.groupBy("query_id", "key").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.min("branch_ord").alias("branch_ord"), F.min("rank").alias("rank"), F.array_sort(F.collect_set("branch_ord")).alias("branches")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("rrf"), F.asc("branch_ord"), F.asc("rank"), F.asc("key"))
    return fused.withColumn("place", F.row_number().over(order))


def balanced(contexts: DataFrame, limit: Column | int) -> DataFrame:
    """The first context of each kind (vector, graph, multimodal), then others in order up to ``limit``; by score."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    kinds = {"vector": 0, "graph": 1, "multimodal": 2}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("kind")]
    rows = contexts.withColumn("_first", F.row_number().over(W.partitionBy("query_id", "kind").orderBy("pos")) == 1)
    rows = rows.withColumn("_take", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("_first"), F.when(F.col("_first"), kind), "pos")))
    kept = rows.where((F.col("_take") <= limit) | F.col("_first"))
    out = kept.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "_take")))
    return out.where(F.col("place") <= limit).drop("_first", "_take")


def policy_first(contexts: DataFrame) -> DataFrame:
    """Contexts that speak of policies gain 0.15 (at most 1) and come first."""
    hay = F.lower(F.concat_ws(" ", "content", "source"))
    hit = hay.rlike("|".join(vocab.POLICY_TERMS))
    rows = contexts.withColumn("policy", hit).withColumn("score", F.when(hit, F.least(F.col("score") + 0.15, F.lit(1.0))).otherwise(F.col("score")))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("policy"), F.desc("score"), "pos")))


def retrieval_quality(contexts: DataFrame) -> DataFrame:
    """(query_id, quality) from best score, number of sources, graph and multimodal support."""
    best = F.max(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)))
    sources = F.count_distinct(F.nullif("source", F.lit("")))
    return contexts.groupBy("query_id").agg(
        F.least(
            F.lit(1.0),
            best * 0.45 + F.least(sources / 3, F.lit(1.0)) * 0.25 + F.when(F.bool_or(F.col("kind") == "graph"), 0.2).otherwise(0.0) + F.when(F.bool_or(F.col("kind") == "multimodal"), 0.1).otherwise(0.0),
        ).alias("quality")
    )


def table_evidence(contexts: DataFrame) -> DataFrame:
    """(query_id, content, matched headers and rows, facts, score) of serialised tables against their question."""
    tokens = lambda t: F.filter(F.array_distinct(T.ascii_tokens(t)), lambda x: F.length(x) >= 3)
    rows = contexts.withColumn("t", T.parse_table(F.col("content"))).withColumn("q", tokens(F.col("question")))
    rows = rows.where((F.size("t.headers") > 0) & (F.size("t.rows") > 0))
    heads = F.filter("t.headers", lambda h: F.arrays_overlap(tokens(h), F.col("q")))
    hit = F.slice(F.filter("t.rows", lambda r: F.arrays_overlap(tokens(F.array_join(F.transform(r, lambda c: c["value"]), " ")), F.col("q"))), 1, 5)
    rows = rows.withColumns({"matched_headers": heads, "matched_rows": hit})
    named = F.when(F.size("matched_headers") > 0, F.col("matched_headers")).otherwise(F.col("t.headers"))
    rows = rows.withColumn("named", named)
    fact = lambda r: F.transform(
        F.filter(r, lambda c: F.array_contains(F.col("named"), c["key"]) & c["value"].rlike("[0-9]")),
        lambda c: F.trim(F.concat(F.coalesce(F.get(F.transform(F.filter(r, lambda x: ~F.array_contains(F.col("named"), x["key"]) & (x["value"] != "")), lambda x: x["value"]), F.lit(0)), F.lit("")), F.lit(" "), c["key"], F.lit("="), c["value"])),
    )
    rows = rows.withColumn("facts", F.flatten(F.transform(F.slice("t.rows", 1, 10), fact)))
    rows = rows.where((F.size("matched_headers") > 0) | (F.size("matched_rows") > 0) | (F.size("facts") > 0))
    structural = 0.5 + F.least(F.size("matched_headers") * 0.1, F.lit(0.2)) + F.least(F.size("matched_rows") * 0.05, F.lit(0.2)) + F.when(F.size("facts") > 0, 0.1).otherwise(0.0)
    preview = F.array_join(F.transform(F.slice("matched_rows", 1, 3), lambda r: F.array_join(F.transform(F.filter(r, lambda c: c["value"] != ""), lambda c: F.concat(c["key"], F.lit("="), c["value"])), ", ")), "; ")
    text = F.concat_ws(
        " ", F.lit("Table reasoning evidence:"), F.concat(F.lit("headers="), F.array_join("t.headers", ", ")),
        F.when(F.size("matched_headers") > 0, F.concat(F.lit("matched_columns="), F.array_join("matched_headers", ", "))),
        F.when(preview != "", F.concat(F.lit("matched_rows="), preview)), F.when(F.size("facts") > 0, F.concat(F.lit("numeric_values="), F.array_join(F.slice("facts", 1, 8), "; "))),
    )
    return rows.select("query_id", text.alias("content"), "matched_headers", F.size("matched_rows").alias("n_rows"), "facts", F.least(F.lit(1.0), F.greatest("score", structural)).alias("score"))


def image_evidence(score: Column, question: Column, content: Column) -> Column:
    tokens = lambda t: F.filter(F.array_distinct(T.ascii_tokens(t)), lambda x: F.length(x) >= 3)
    return F.least(F.lit(1.0), F.greatest(score, 0.45 + 0.05 * F.size(F.array_intersect(tokens(question), tokens(content)))))


def answer(contexts: DataFrame) -> DataFrame:
    """(query_id, answer): the first line of the best context, up to 240 characters."""
    best = contexts.groupBy("query_id").agg(F.min_by("content", "place").alias("content"))
    lines = F.filter(F.transform(F.split("content", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    return best.select(
        "query_id",
        F.when(first.isNull(), "The retrieved context is insufficient to answer this question. [Source: retrieved context]").otherwise(
            F.concat(F.lit("Offline demo excerpt: "), F.substring(first, 1, 240), F.lit(". [Source: retrieved context]"))
        ).alias("answer"),
    )


def two_branch(contexts: DataFrame) -> DataFrame:
    """Fusion of vector and graph contexts only, deduplicated by text; other kinds take no part."""
    rows = contexts.where(F.col("kind").isin("vector", "graph")).withColumn("key", T.text_key(F.col("content"))).withColumn("branch_ord", F.when(F.col("kind") == "vector", 0).otherwise(1))
    return fuse(rows.select("query_id", "branch_ord", "pos", "key", "score"))


def with_fallback(search: Callable[[DataFrame], DataFrame], plain: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A search that lets ``plain`` answer a batch on which ``search`` fails; its rows are written once to know."""

    def run(asked: DataFrame) -> DataFrame:
        try:
            return G.durable(search(asked))
        except Exception:  # whatever a search of the user's raises
            log.warning("the search failed; the plain one answers", exc_info=True)
            return plain(asked)

    return run


BRANCH = ("query_id", "content", "source", "score", "pos")


def gather(branches: dict[str, Callable[[], DataFrame]], most: int | None = None, strict: bool = False) -> tuple[DataFrame, list[str]]:
    """(query_id, branch, branch_ord, pos, content, source, score) of all branches that work, and the names of those that failed.

    A branch gives (query_id, content, source, score, pos) and is cut to its ``most`` best of
    each question. Its rows are written once, so a failure shows here: it is logged and the
    other branches answer. If all fail, the last error is raised. With ``strict`` the first
    failure is raised: for callers that do not hand on the names of the failed branches, as
    what the others found would pass for the whole.
    """
    found, failed, error = [], [], None
    for i, (name, make) in enumerate(branches.items()):
        try:
            rows = make().select(*BRANCH)
            rows = rows if most is None else top_k(rows, ["query_id"], [F.desc("score"), F.asc("pos")], most).select(*BRANCH)
            found.append(G.durable(rows.select("query_id", F.lit(name).alias("branch"), F.lit(i).alias("branch_ord"), F.col("pos").cast("long").alias("pos"), "content", "source", F.col("score").cast("double").alias("score"))))
        except Exception as e:  # whatever a branch of the user's raises
            if strict:
                raise RuntimeError(f"the branch {name} failed") from e
            log.warning("the branch %s failed and is left out", name, exc_info=True)
            failed.append(name)
            error = e
    if not found:
        raise error or ValueError("no branch was given")
    return reduce(DataFrame.unionByName, found), failed


def reasoning_branch(linked: DataFrame, edges: DataFrame) -> DataFrame:
    """Reasoning paths between the linked entities of a question, each with the two after it: (query_id, entity, ord)."""
    a, b = linked.select("query_id", F.col("entity").alias("start"), F.col("ord").alias("i")), linked.select("query_id", F.col("entity").alias("goal"), F.col("ord").alias("j"))
    pairs = a.join(b, "query_id").where("j > i and j <= i + 2 and start <> goal")
    p = G.shortest_paths(edges, pairs.select("start", "goal").distinct())
    text = G.reasoning_path(F.col("nodes"), F.col("relations"))
    return pairs.join(p, ["start", "goal"]).select("query_id", text.alias("content"), F.lit("path").alias("source"), S.path_score(F.lit(1.0), F.col("length")).alias("score"), (F.col("i") * 1000 + F.col("j")).alias("pos"))


def community_branch(linked: DataFrame, questions: DataFrame, communities: DataFrame, limit: int = 3) -> DataFrame:
    """The summaries of up to ``limit`` communities that hold a question's entities, those that say something."""
    n = linked.groupBy("query_id").agg(F.count_distinct("entity").alias("n"))
    member = useful_communities(communities).select("community_id", "summary", F.explode("members").alias("entity"))
    met = linked.select("query_id", "entity").distinct().join(member, "entity").groupBy("query_id", "community_id", "summary").agg(F.count(F.lit(1)).alias("hits"))
    met = met.join(n, "query_id").join(questions.select("query_id", "question"), "query_id")
    score = S.community_score(F.col("hits") / F.col("n"), S.graph_lexical(F.col("question"), F.col("summary")))
    rows = met.select("query_id", F.col("summary").alias("content"), F.concat(F.lit("community:"), "community_id").alias("source"), score.alias("score"), F.xxhash64("community_id").alias("pos"))
    return top_k(rows, ["query_id"], [F.desc("score"), F.asc("source")], limit).drop("rank")


def retrieve_for_intent(questions: DataFrame, search: Callable[[DataFrame], DataFrame], per_entity: int = 3) -> DataFrame:
    """(query_id, content, source, score, kind, place): contexts found and chosen as each question's intent asks.

    ``search`` takes (query_id, question, k) and gives (query_id, content, source, score,
    kind, pos). What a comparison finds for each of its entities is fused by reciprocal
    rank; one that finds nothing asks again as a whole. Procedures prefer policies.
    """

    def run(asked: DataFrame) -> DataFrame:
        asked = asked.withColumn("query_id", F.struct("query_id", "ask"))
        got = search(asked.select("query_id", "question", "k")).select("query_id", "content", "source", "score", "kind", "pos")
        got = top_k(got.join(asked.select("query_id", "intent", "most", "k"), "query_id"), ["query_id"], [F.desc("score"), F.asc("pos")], F.col("k"))
        return got.select("query_id.query_id", "query_id.ask", "intent", "most", "content", "source", "score", "kind", F.col("rank").alias("pos"))

    found = G.durable(run(routing.asks(questions, per_entity)))
    bare = questions.where(routing.intent(F.col("question")) == "comparative").join(found.select("query_id").distinct(), "query_id", "left_anti")
    found = found.unionByName(run(routing.asks(bare, None)))
    out = ["query_id", "intent", "most", "content", "source", "score", "kind", "pos"]

    both = found.where((F.col("intent") == "comparative") & F.col("kind").isin("vector", "graph")).withColumn("key", T.text_key(F.col("content")))
    both = both.withColumns({"branch_ord": F.when(F.col("kind") == "vector", 0).otherwise(1), "pos": F.struct("ask", "pos")})
    rest = ["intent", "most", "content", "source", "score", "kind", "branch_ord", "pos"]
    first = both.groupBy("query_id", "key").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select("query_id", "key", "r.*")
    fused = fuse(first.select("query_id", "branch_ord", "pos", "key", "score"), dedup_first=False).select("query_id", "key", "rrf", "place")
    fused = fused.withColumn("score", F.round(F.col("rrf") / F.max("rrf").over(W.partitionBy("query_id")), 4))
    compared = first.drop("score", "pos").join(fused.withColumnRenamed("place", "pos"), ["query_id", "key"])

    steps = policy_first(found.where("intent = 'procedural'")).withColumn("pos", F.col("place"))
    other = found.where(~F.col("intent").isin("comparative", "procedural"))
    rows = reduce(DataFrame.unionByName, (x.select(*out) for x in (compared, steps, other)))
    return balanced(rows, F.col("most")).select("query_id", "content", "source", "score", "kind", "place")


def with_second_try(questions: DataFrame, run, least: float = 0.25, suffix: str = " Focus on evidence.") -> DataFrame:
    """(query_id, answer, quality, outcome): questions of low quality are asked once more, then clarified.

    ``run(questions)`` gives (query_id, answer, quality); only the low ones run again.
    """
    first = run(questions)
    low = questions.join(first.where(F.col("quality") < least).select("query_id"), "query_id", "left_semi")
    second = run(low.withColumn("question", F.concat("question", F.lit(suffix))))
    clear = F.lit("Please give more detail: the documents hold too little evidence for this question.")
    good = F.col("quality") >= least
    again = second.select("query_id", F.when(good, F.col("answer")).otherwise(clear).alias("answer"), "quality", F.when(good, "retried").otherwise("clarify").alias("outcome"))
    return first.where(good).select("query_id", "answer", "quality", F.lit("answered").alias("outcome")).unionByName(again)


def name_vectors(df: DataFrame, key: str, dims: int = 768) -> DataFrame:
    """(key, index, value, square): hash embeddings in whole quarters, and the squared length of each."""
    v = S.hash_embedding(df.select(key).distinct(), key, F.col(key), dims, unit=False).withColumn("value", (F.col("value") * 4).cast("long"))
    return v.join(v.groupBy(key).agg(F.sum(F.col("value") * F.col("value")).alias("square")), key)


def name_arrays(df: DataFrame, key: str, dims: int = 768) -> DataFrame:
    """(key, places, values, square) of ``name_vectors``, a row for each name that has a place.

    A name is some seventy rows on the way, so tasks are as many as the names need: left to
    sizes in bytes, all names would be expanded in one.
    """
    names = cut(df.select(key).where(F.col(key).isNotNull()).distinct())
    names = names.repartition(max(1, -(-names.count() // NAMES)), key)
    v = S.hash_embedding(names, key, F.col(key), dims, unit=False).select(key, F.struct("index", (F.col("value") * 4).cast("int").alias("value")).alias("v"))
    v = v.groupBy(key).agg(F.collect_list("v").alias("v"), F.sum(F.col("v.value").cast("long") * F.col("v.value")).alias("square"))
    return v.select(key, F.col("v.index").alias("places"), F.col("v.value").alias("values"), "square")


def name_candidates(m: DataFrame, n: DataFrame, least: float) -> DataFrame:
    """The distinct (mention, name) that a cosine of ``least`` is possible for, of two tables of ``name_vectors``.

    Places are put in one order, rare ones first. What a vector has behind the first places
    that hold more than 1 - least^2 of its square is shorter than ``least`` of its length, so
    two vectors that share none of their first places cannot reach it: only first places
    are joined, and common places seldom are among them.
    """
    order = n.groupBy("index").agg(F.count(F.lit(1)).alias("n"))  # a row a place at most
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "index")

    def first(v: DataFrame, key: str) -> DataFrame:
        w = W.partitionBy(key).orderBy(rank).rowsBetween(W.unboundedPreceding, -1)
        held = v.join(order, "index", "left").withColumn("before", F.coalesce(F.sum(F.col("value") * F.col("value")).over(w), F.lit(0)))
        # a little more than needed, so that rounding loses nothing
        return held.where(F.col("before") <= F.col("square") * (1 - least * least + 1e-9)).select(key, "index")

    return first(m, "mention").join(first(n, "name"), "index").select("mention", "name").distinct()


def name_matches(mentions: DataFrame, names: DataFrame, least: float = 0.8, k: int = 3, dims: int = 768) -> DataFrame:
    """(mention, name, score, rank): hash-embedding neighbours of each mention by cosine.

    Exact: every mention meets every name in blocks, as products of whole numbers; a score is a
    quotient of integers and a root, so equal scores are equal in every run and ties go to the name.
    """
    m, n = name_arrays(mentions, "mention", dims), name_arrays(names, "name", dims)
    return top_k(name_scores(m, n, least, k, dims), ["mention"], [F.desc("score"), F.asc("name")], k)


# ---------------------------------------------------------------- evidence of the graph, search, enrichment


def subgraph_evidence(linked: DataFrame, edges: DataFrame, entities: DataFrame, hops: int = 2) -> DataFrame:
    """(query_id, entity, hop, content, score): every edge met from a question's linked entities.

    ``linked`` has (query_id, question, entity); ``entities`` has name, type and may have a
    description. The wording is a fixed value.
    """
    met = G.neighbors(edges, linked.select(F.col("entity").alias("start")).distinct(), hops)
    desc = F.col("description") if "description" in entities.columns else F.lit("")
    about = entities.select(F.col("name").alias("target"), F.col("type").alias("target_type"), desc.alias("target_desc"))
    met = met.join(about, "target", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    met = met.withColumn("content", F.concat("source", F.lit(" --["), "relation", F.lit("]--> "), "target", F.lit(" ("), blank("target_type"), F.lit("): "), blank("target_desc")))
    named = linked.groupBy("query_id").agg(F.collect_set(F.lower("entity")).alias("named"))  # a question's entities
    rows = linked.join(named, "query_id").join(met, F.col("entity") == F.col("start"))
    score = S.subgraph_score(
        F.array_contains("named", F.lower("entity")), F.contains(F.lower("question"), F.lower("target")) & (F.col("target") != ""), F.lit(1.0), S.graph_lexical(F.col("question"), F.col("content"))
    )
    return rows.select("query_id", "entity", "hop", "content", score.alias("score"))


def useful_communities(communities: DataFrame) -> DataFrame:
    """Communities whose summary says something."""
    return communities.where((F.coalesce("summary", F.lit("")) != "") & ~F.contains(F.col("summary"), F.lit(vocab.NO_RELATIONS)))


def search_entities(entities: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """At most ``limit`` entities whose name or description contains the keyword, case aside, by name."""
    low = F.lit(keyword.lower())
    return entities.where(F.contains(F.lower("name"), low) | F.contains(F.lower(F.coalesce("description", F.lit(""))), low)).orderBy("name").limit(limit)


def entity_names(entities: DataFrame, limit: int = 1000) -> DataFrame:
    return entities.select("name").orderBy("name").limit(limit)


def enrich(contexts: DataFrame, results: DataFrame) -> DataFrame:
    """Contexts (query_id, content, source, score, kind) with the multimodal results appended, numbered by falling score.

    Equal scores keep the order of appending.
    """
    every = contexts.select("query_id", "content", "source", "score", "kind", F.lit(0).alias("part"), "pos").unionByName(
        results.select("query_id", "content", "source", "score", F.lit("multimodal").alias("kind"), F.lit(1).alias("part"), "pos")
    )
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "part", "pos")
    return every.withColumn("place", F.row_number().over(w)).drop("part", "pos")


def visible_vectors(queries: DataFrame, vectors: DataFrame, registry: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score, place): the nearest ``k`` of the vectors of committed or unknown documents (column ``source``)."""
    return vector_search(queries, G.visible(vectors, registry), k).withColumnRenamed("rank", "place")


def visible_candidates(queries: DataFrame, vectors: DataFrame, texts: DataFrame, registry: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, kind): max(8k, k) visible vectors and, beside them, the lexical candidates of visible texts."""
    near = visible_vectors(queries, vectors, registry, max(8 * k, k)).select("query_id", F.col("vec_id").alias("id"), "score", F.lit("vector").alias("kind"))
    lex = lexical_search(queries, G.visible(texts, registry), k)
    return near.unionByName(lex.select("query_id", F.col("doc_id").alias("id"), (F.col("hits") / F.col("n_tokens")).alias("score"), F.lit("lexical").alias("kind")))
