"""Questions: intent, rewriting, routing to metapaths and rules, inference."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline import vocab
from weftline.functions import text as T
from weftline.operators.graph import durable
from weftline.operators import graph as G


def intent(question: Column) -> Column:
    q = F.lower(question)
    has = lambda *words: q.rlike("|".join(words))
    return (
        F.when(has("compare", "versus", "difference"), "comparative").when(has("why", "impact", "analyze", "explain"), "analytical")
        .when(~q.contains("how much") & has("how", "steps", "process"), "procedural").otherwise("factoid")
    )


def rewrite(question: Column) -> Column:
    """struct(queries, entities, keywords)."""
    ents, keys = T.entity_spans(question), T.keywords(question)
    focus = F.trim(F.array_join(F.concat(ents, keys), " "))
    return F.struct(F.array(question, F.when(focus == "", question).otherwise(focus)).alias("queries"), ents.alias("entities"), keys.alias("keywords"))


def asks(questions: DataFrame, per_entity: int | None = 3) -> DataFrame:
    """(query_id, ask, intent, question, k, most): what each question asks of a search, by its intent.

    A comparison asks once for each of its entities, led by the entity's name, for
    ``per_entity`` contexts (None: it is not split); any other question asks as it is for
    ``k``. ``most`` contexts are chosen in the end.
    """
    size = F.create_map(*[x for name, (k, most) in vocab.INTENT_SIZES.items() for x in (F.lit(name), F.struct(F.lit(k).alias("k"), F.lit(most).alias("most")))])
    q = questions.select("query_id", "question", intent(F.col("question")).alias("intent"), rewrite(F.col("question"))["entities"].alias("entities"))
    split = F.lit(per_entity is not None) & (F.col("intent") == "comparative") & (F.size("entities") > 0)
    q = q.withColumns({"split": split, "size": size[F.col("intent")]})
    out = q.select("query_id", "intent", "question", "split", "size", F.posexplode(F.when(F.col("split"), F.col("entities")).otherwise(F.array(F.lit("")))).alias("ask", "entity"))
    asked = F.when(F.col("split"), F.concat("entity", F.lit(" "), "question")).otherwise(F.col("question"))
    return out.select("query_id", "ask", "intent", asked.alias("question"), F.when(F.col("split"), F.lit(per_entity)).otherwise(F.col("size.k")).alias("k"), F.col("size.most").alias("most"))


def dealt(questions: DataFrame) -> DataFrame:
    """Questions in several tasks for each core: a table of millions may be one small file."""
    return questions.repartition(4 * questions.sparkSession.sparkContext.defaultParallelism, "query_id")


def _keyword_pattern(keyword: str) -> str:
    return rf"(?U)(?<!\w){re.escape(keyword)}{'' if ' ' in keyword else 's?'}(?!\w)"


def route(questions: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, metapath, score, matched, fallback, rank) of (query_id, question, has_entities).

    The vocabulary is a fixed, small set of expressions, so routing is one projection.
    """
    q = F.col("low")
    # the pattern is tried on questions that contain the keyword only
    hits = F.array(*[F.struct(F.lit(m.name).alias("metapath"), F.array_compact(F.array(*[F.when(q.contains(k) & q.rlike(_keyword_pattern(k)), k) for k in m.keywords])).alias("matched")) for m in vocab.METAPATHS.values()])
    scored = F.transform(F.filter(hits, lambda h: F.size(h["matched"]) > 0), lambda h: F.struct(F.size(h["matched"]).alias("score"), h["metapath"].alias("metapath"), h["matched"].alias("matched"), F.lit(False).alias("fallback")))
    spare = F.array(*[F.struct(F.lit(1).alias("score"), F.lit(m).alias("metapath"), F.array().cast("array<string>").alias("matched"), F.lit(True).alias("fallback")) for m in vocab.FALLBACK_METAPATHS])
    chosen = F.when(F.size("scored") > 0, F.col("scored")).when(F.col("has_entities"), spare)
    # one projection after the other, so that none is evaluated twice
    low = dealt(questions.select("query_id", "question", "has_entities")).select("query_id", "has_entities", F.lower("question").alias("low"))
    out = low.select("query_id", "has_entities", scored.alias("scored")).select("query_id", F.explode(chosen).alias("s")).select("query_id", "s.*")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("metapath")))).where(F.col("rank") <= limit)


def select_rules(questions: DataFrame, limit: int = 4) -> DataFrame:
    """(query_id, rule, metapath, score, rank): rules by the keywords that the question contains."""
    q = F.lower("question")
    hits = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.metapath).alias("metapath"), sum((q.contains(k).cast("int") for k in r.keywords), F.lit(0)).alias("score")) for r in vocab.RULES])
    scored = questions.select("query_id", "question", "has_entities", F.filter(hits, lambda h: h["score"] > 0).alias("hits"))
    direct = scored.where(F.size("hits") > 0).select("query_id", F.explode("hits").alias("s")).select("query_id", "s.*")
    rest = scored.where((F.size("hits") == 0) & F.col("has_entities"))
    by_path = rules_table(questions.sparkSession).select("rule", "metapath")
    routed = route(rest, limit).join(F.broadcast(by_path), "metapath").select("query_id", "rule", "metapath", F.lit(1).alias("score"))
    out = direct.unionByName(routed)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("rule")))).where(F.col("rank") <= limit)


def rules_table(spark: SparkSession) -> DataFrame:
    rows = [(r.name, r.metapath, r.description, r.conclusion) for r in vocab.RULES]
    return spark.createDataFrame(rows, "rule string, metapath string, description string, template string")


def infer(selected: DataFrame, paths: DataFrame, per_query: int | None = 10) -> DataFrame:
    """(query_id, rule, start, end, conclusion, evidence, confidence) from selected rules and traversed paths.

    ``paths`` has (query_id, metapath, start, end, path).
    """
    rules = F.broadcast(rules_table(selected.sparkSession).select("rule", "description", "template"))
    met = selected.join(rules, "rule").join(paths, ["query_id", "metapath"])
    conclusion = F.replace(F.replace("template", F.lit("{start}"), F.col("start")), F.lit("{end}"), F.col("end"))
    text = F.concat(F.lit("Inference rule "), "rule", F.lit(": "), "description", F.lit(" Evidence path: "), G.evidence(F.col("path")), F.lit(". Therefore: "), F.col("conclusion"))
    out = met.withColumn("conclusion", conclusion).withColumn("evidence", text).withColumn("confidence", F.least(F.lit(1.0), 0.55 + 0.15 * F.size("path")))
    if per_query is not None:
        order = W.partitionBy("query_id").orderBy("rank", "start", "end", "evidence")
        out = out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_query)
    return out.select("query_id", "rule", "start", "end", "conclusion", "evidence", "confidence")


def resolve(mentions: DataFrame, entities: DataFrame, alias_table: DataFrame | None = None, fuzzy: float = 0.82, least: float = 0.8) -> DataFrame:
    """(mention, name, how): given alias, exact, alias, normalised, contained, similar name, then embedding; first hit wins.

    ``entities`` has (name, seq). Each stage runs only on what the ones before left. The
    similar-name stage meets every name that can reach ``fuzzy``, see ``_shared_keys``.
    """
    ents = durable(entities.select("name", "seq").withColumn("_norm", T.normalize_name(F.col("name"))))  # every stage reads it
    todo = mentions.select("mention").distinct().where(~F.lower("mention").isin(*vocab.ENTITY_STOPWORDS)).withColumn("norm", T.normalize_name(F.col("mention")))
    if alias_table is not None:
        todo = todo.join(alias_table.select(F.lower("alias").alias("_a"), "target"), F.lower("mention") == F.col("_a"), "left").withColumn("key", F.coalesce("target", "mention")).drop("_a", "target")
    else:
        todo = todo.withColumn("key", F.col("mention"))
    todo = todo.withColumn("norm", T.normalize_name(F.col("key")))
    pick = lambda df: df.groupBy("mention").agg(F.min_by("name", "seq").alias("name"))
    exact = pick(todo.join(ents, F.col("key") == F.col("name")).select("mention", "name", "seq")).withColumn("how", F.lit("exact"))
    al = ents.select("name", "seq", F.explode(T.aliases(F.col("name"))).alias("alias"))
    rest = todo.join(exact, "mention", "left_anti")
    by_alias = rest.join(al, F.col("norm") == F.col("alias")).groupBy("mention").agg(F.max_by("name", "seq").alias("name")).withColumn("how", F.lit("alias"))
    rest = rest.join(by_alias, "mention", "left_anti")
    inside = _containing(rest.where(F.length("key") >= 3), ents.drop("_norm"))
    contained = durable(pick(inside.select("mention", "name", "seq")).withColumn("how", F.lit("contains")))
    rest = durable(rest.join(contained, "mention", "left_anti"))
    from weftline.functions.similarity import name_ratio

    keyed = rest.select("mention", "norm", F.explode(_shared_keys(F.col("norm"), fuzzy)).alias("_key"))
    named = ents.select("name", "seq", "_norm", F.explode(_shared_keys(F.col("_norm"), fuzzy)).alias("_key"))
    # the ratio is at most 2 * the shorter length over both; a little slack for the rounding of that bound
    lengths = 2 * F.least(F.length("norm"), F.length("_norm")) >= (F.length("norm") + F.length("_norm")) * (fuzzy - 1e-9)
    near = keyed.join(named, "_key").where(lengths).select("mention", "norm", "name", "seq", "_norm").distinct().withColumn("r", name_ratio(F.col("norm"), F.col("_norm"))).where(F.col("r") >= fuzzy)
    similar = near.groupBy("mention").agg(F.max_by("name", F.struct("r", -F.col("seq"))).alias("name")).withColumn("how", F.lit("similar"))
    rest = rest.join(similar, "mention", "left_anti")
    from weftline.operators.retrieval import name_matches

    embedded = name_matches(rest.select("mention"), ents.select("name"), least=least, k=1).select("mention", "name", F.lit("embedding").alias("how"))
    return exact.unionByName(by_alias).unionByName(contained).unionByName(similar).unionByName(embedded)


def _containing(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """(mention, name, seq) of the names that contain a mention's ``key``, case aside.

    A name with the key has all its runs of three characters; they meet by the one of the
    key that the fewest names have, so a run that most names share brings no pair.
    """
    threes = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(F.lower(c), i, F.lit(3))))
    have = names.select("name", "seq", F.explode(threes(F.col("name"))).alias("three"))
    held = have.groupBy("three").agg(F.count(F.lit(1)).alias("n"))
    own = mentions.select("mention", "key", F.explode(threes(F.col("key"))).alias("three")).join(held, "three", "left")
    rarest = own.groupBy("mention", "key").agg(F.min_by("three", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "three")).alias("three"))
    return rarest.join(have, "three").where(F.contains(F.lower("name"), F.lower("key"))).select("mention", "name", "seq")


def _shared_keys(name: Column, fuzzy: float) -> Column:
    """Bigrams, for short names characters too: names with a ratio of ``fuzzy`` share one.

    Of two names of s characters in all, fuzzy * s / 2 match; without a common bigram each
    match is a block of its own, and at most (1 - fuzzy) * s characters lie between
    blocks, so s <= 1 / (1.5 * fuzzy - 1).
    """
    short = F.length(name) <= int(1 / (1.5 * fuzzy - 1)) if 1.5 * fuzzy > 1 else F.lit(True)
    at = lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.substr(name, i, F.lit(n))), lambda x: F.length(x) == n)
    keys = F.when(short, F.concat(at(2), at(1))).otherwise(at(2))
    return F.when(F.length(name) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(keys))
