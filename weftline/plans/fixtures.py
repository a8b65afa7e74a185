"""The typed graph and the question sets that the queries run over, derived from the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline import vocab
from weftline.shared import cut


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def entities(spark: SparkSession, d: str) -> DataFrame:
    """(name, type)."""
    t = lambda n: table(spark, d, n)
    parts = (
        (t("customer"), F.col("c_name"), "Fund"), (t("supplier"), F.col("s_name"), "Company"), (t("part"), F.col("p_brand"), "Sector"), (t("part"), F.col("p_type"), "Technology"),
        (t("part"), F.concat(F.lit("Part#"), "p_partkey"), "Supplier"), (t("nation"), F.col("n_name"), "Region"), (t("region"), F.concat(F.lit("Rule "), "r_name"), "Regulation"),
        (t("supplier"), F.concat(F.lit("Person#"), F.col("s_suppkey") % 20), "Person"),
    )
    return reduce(DataFrame.unionByName, [df.select(name.alias("name"), F.lit(kind).alias("type")) for df, name, kind in parts]).distinct()


def _top(lines: DataFrame, what: str, measure, k: int) -> DataFrame:
    sums = lines.groupBy("l_suppkey", what).agg(F.sum(measure).alias("m"))
    w = W.partitionBy("l_suppkey").orderBy(F.desc("m"), F.asc(what))
    return sums.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def relations(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """(head, relation, tail) of the relations asked for; only their tables are read."""
    t = lambda n: table(spark, d, n)
    supplier = lambda: t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    out = []
    for n in names:
        if n == "holds":
            pairs = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()
            e = pairs.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(supplier(), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("c_name").alias("head"), F.col("s_name").alias("tail"))
        elif n in ("belongs_to", "uses", "depends_on"):
            lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
            cents = F.round(F.col("l_extendedprice") * 100).cast("long")
            amount = F.col("l_quantity").cast("long")
            top = {"belongs_to": lambda: _top(lines, "p_brand", cents, 1), "uses": lambda: _top(lines, "p_type", amount, 2), "depends_on": lambda: _top(lines, "p_partkey", amount, 3)}[n]()
            tail = {"belongs_to": F.col("p_brand"), "uses": F.col("p_type"), "depends_on": F.concat(F.lit("Part#"), "p_partkey") if n == "depends_on" else None}[n]
            e = top.join(supplier(), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("head"), tail.alias("tail"))
        elif n == "located_in":
            e = supplier().join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("head"), F.col("n_name").alias("tail"))
        elif n == "subject_to":
            e = supplier().join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            e = e.select(F.col("s_name").alias("head"), F.concat(F.lit("Rule "), "r_name").alias("tail"))
        elif n == "works_at":
            e = supplier().select(F.concat(F.lit("Person#"), F.col("s_suppkey") % 20).alias("head"), F.col("s_name").alias("tail"))
        elif n == "owns":
            child = supplier().where("s_suppkey >= 1").select(F.expr("(s_suppkey - 1) div 2").alias("up"), F.col("s_name").alias("tail"))
            e = child.join(supplier(), F.col("up") == F.col("s_suppkey")).select(F.col("s_name").alias("head"), "tail")
        else:
            raise ValueError(n)
        out.append(e.select("head", F.lit(n).alias("relation"), "tail"))
    return reduce(DataFrame.unionByName, out)


CORPORATE = ("belongs_to", "uses", "depends_on", "located_in", "subject_to", "works_at", "owns")

#: The same graph for the oracle: relation -> SQL of (head, relation, tail).
_LINES = "lineitem JOIN part ON l_partkey = p_partkey"


def _top_sql(n: str, what: str, measure: str, k: int, tail: str) -> str:
    return (
        f"SELECT s_name AS head, '{n}' AS relation, {tail} AS tail FROM (SELECT l_suppkey, {what}, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum({measure}) DESC, {what}) AS r "
        f"FROM {_LINES} GROUP BY l_suppkey, {what}) JOIN supplier ON l_suppkey = s_suppkey WHERE r <= {k}"
    )


SQL = {
    "holds": "SELECT DISTINCT c_name AS head, 'holds' AS relation, s_name AS tail FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey",
    "belongs_to": _top_sql("belongs_to", "p_brand", "CAST(round(l_extendedprice * 100) AS BIGINT)", 1, "p_brand"),
    "uses": _top_sql("uses", "p_type", "CAST(l_quantity AS BIGINT)", 2, "p_type"),
    "depends_on": _top_sql("depends_on", "p_partkey", "CAST(l_quantity AS BIGINT)", 3, "'Part#' || p_partkey"),
    "located_in": "SELECT s_name AS head, 'located_in' AS relation, n_name AS tail FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "subject_to": "SELECT s_name AS head, 'subject_to' AS relation, 'Rule ' || r_name AS tail FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "works_at": "SELECT 'Person#' || (s_suppkey % 20) AS head, 'works_at' AS relation, s_name AS tail FROM supplier",
    "owns": "SELECT p.s_name AS head, 'owns' AS relation, c.s_name AS tail FROM supplier c JOIN supplier p ON (c.s_suppkey - 1) // 2 = p.s_suppkey WHERE c.s_suppkey >= 1",
}
ENTITIES_SQL = """SELECT c_name AS name, 'Fund' AS type FROM customer UNION SELECT s_name, 'Company' FROM supplier UNION SELECT p_brand, 'Sector' FROM part
    UNION SELECT p_type, 'Technology' FROM part UNION SELECT 'Part#' || p_partkey, 'Supplier' FROM part UNION SELECT n_name, 'Region' FROM nation
    UNION SELECT 'Rule ' || r_name, 'Regulation' FROM region UNION SELECT 'Person#' || (s_suppkey % 20), 'Person' FROM supplier"""


def edges_sql(*names: str) -> str:
    return " UNION ALL ".join(f"({SQL[n]})" for n in names)


def all_walked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities and the edges of all metapaths, made once, a table for each relation so that others are not read with it."""
    names = dict.fromkeys(s[1] for m in vocab.METAPATHS.values() for s in m.steps)
    made = (cut(relations(spark, d, n).select("head", "tail")).select("head", F.lit(n).alias("relation"), "tail") for n in names)
    return cut(entities(spark, d)), reduce(DataFrame.unionByName, made)


#: (query_id, question, first linked entity or "", its type, expected metapath)
QUESTIONS = (
    (1, "Which sectors is Customer#000000001 exposed to?", "Customer#000000001", "Fund", "sector_exposure"),
    (2, "Infer sector exposure for Customer#000000002", "Customer#000000002", "Fund", "sector_exposure"),
    (3, "Which regions and countries are represented by the holdings of Customer#000000003?", "Customer#000000003", "Fund", "geographic_risk"),
    (4, "What supplier dependencies does Customer#000000004 have through its vendors?", "Customer#000000004", "Fund", "supply_chain_risk"),
    (5, "Explain the cloud and software infrastructure risk of Customer#000000005", "Customer#000000005", "Fund", "technology_risk"),
    (6, "Compare peers in the same sector as Supplier#000000001", "Supplier#000000001", "Company", "shared_sector"),
    (7, "Which companies share board directors with Supplier#000000002?", "Supplier#000000002", "Company", "management_overlap"),
    (8, "What regulation and compliance rules is Customer#000000006 subject to?", "Customer#000000006", "Fund", "compliance_chain"),
    (9, "Who owns the parent of Supplier#000000003, and which subsidiary follows?", "Supplier#000000003", "Company", "subsidiary_chain"),
    (10, "Tell me about Customer#000000007", "Customer#000000007", "Fund", "sector_exposure"),
    (11, "How do I file a report?", "", "", "compliance_chain"),
    (12, "How much technology exposure does Customer#000000008 have versus Customer#000000009?", "Customer#000000008", "Fund", "technology_risk"),
)


def questions(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(list(QUESTIONS), "query_id int, question string, start string, start_type string, expected string")
    return df.withColumn("has_entities", F.col("start") != "").withColumn("n_starts", F.when(F.col("start") != "", 1).otherwise(0))


def _literal(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


QUESTIONS_SQL = "SELECT CAST(query_id AS INTEGER) AS query_id, question, start, start_type, expected FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, q)) + ")" for q in QUESTIONS) + ") v(query_id, question, start, start_type, expected)"

#: Questions of whole tables: every customer and supplier asks one of these of itself. (of, form, question, expected metapath)
FORMS = (
    ("Fund", 0, "Which sectors is {} exposed to?", "sector_exposure"),
    ("Fund", 1, "Infer sector exposure for {}", "sector_exposure"),
    ("Fund", 2, "Which regions and countries are represented by the holdings of {}?", "geographic_risk"),
    ("Fund", 3, "What supplier dependencies does {} have through its vendors?", "supply_chain_risk"),
    ("Fund", 4, "Explain the cloud and software infrastructure risk of {}", "technology_risk"),
    ("Fund", 5, "What regulation and compliance rules is {} subject to?", "compliance_chain"),
    ("Fund", 6, "Tell me about {}", "sector_exposure"),
    ("Fund", 7, "How much technology exposure does {} have?", "technology_risk"),
    ("Company", 0, "Compare peers in the same sector as {}", "shared_sector"),
    ("Company", 1, "Which companies share board directors with {}?", "management_overlap"),
    ("Company", 2, "Who owns the parent of {}, and which subsidiary follows?", "subsidiary_chain"),
)


def asked(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, question, start, start_type, expected, has_entities, n_starts): a question of every customer and supplier."""
    forms = spark.createDataFrame(list(FORMS), "start_type string, form int, text string, expected string")
    own = lambda name, key, start, kind, even, n: table(spark, d, name).select((F.col(key) * 2 + even).alias("query_id"), F.col(start).alias("start"), F.lit(kind).alias("start_type"), (F.col(key) % n).cast("int").alias("form"))
    rows = own("customer", "c_custkey", "c_name", "Fund", 0, 8).unionByName(own("supplier", "s_suppkey", "s_name", "Company", 1, 3))
    met = rows.join(F.broadcast(forms), ["start_type", "form"])  # eleven forms
    return met.select("query_id", F.replace("text", F.lit("{}"), "start").alias("question"), "start", "start_type", "expected", F.lit(True).alias("has_entities"), F.lit(1).alias("n_starts"))


ASKED_SQL = (
    "SELECT query_id, replace(text, '{}', start) AS question, start, start_type, expected FROM (SELECT c_custkey * 2 AS query_id, c_name AS start, 'Fund' AS start_type, c_custkey % 8 AS form FROM customer "
    "UNION ALL SELECT s_suppkey * 2 + 1, s_name, 'Company', s_suppkey % 3 FROM supplier) JOIN (VALUES " + ", ".join("(" + ", ".join(map(_literal, f)) + ")" for f in FORMS) + ") f(start_type, form, text, expected) USING (start_type, form)"
)
