"""File sources and sinks."""

from __future__ import annotations

import posixpath
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import ingest
from weftline.operators.graph import durable


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_id, doc_type, content hash and content of every file under ``path``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", T.doc_id(F.col("path")).alias("doc_id"), T.doc_type(F.col("path")).alias("doc_type"), F.sha2("content", 256).alias("content_hash"), "length", "content")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of text and markdown files, a file a row."""
    f = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return f


def uploads(files: DataFrame, most: int = 10 << 20) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with the reason)."""
    judged = files.withColumn("reason", ingest.valid_upload(F.col("path"), F.col("content"), most))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("path", "length", "reason")


def within(root: str, name: str) -> str:
    """The path of ``name`` under ``root``; ValueError if it leaves it."""
    full = posixpath.normpath(posixpath.join(root, name))
    if full != root.rstrip("/") and not full.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{name} is outside {root}")
    return full


def table_texts(spark: SparkSession, path: str, batch: int = 20) -> DataFrame:
    """(batch, text) of a CSV file with a header, serialised for retrieval; one text says so if it has no rows.

    The numbered rows are written once, so that their order is the same wherever it is read.
    """
    df = spark.read.csv(path, header=True)
    order = "_weft_order"
    rows = durable(df.withColumn(order, F.monotonically_increasing_id()))
    empty = spark.range(1).select(F.lit(0).cast("long").alias("batch"), F.lit("[Empty CSV]").alias("text")).join(rows.limit(1), F.lit(True), "left_anti")
    return ingest.serialize_table(rows, df.columns, [order], batch).unionByName(empty)


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, questions) of a JSON graph file."""
    j = spark.read.json(path, multiLine=True)
    return tuple(j.select(F.explode(c).alias("x")).select("x.*") for c in ("entities", "relations", "questions"))


def holdings_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of (manager, company, sector, region) rows."""
    ent = lambda c, t: rows.select(F.col(c).alias("name"), F.lit(t).alias("type"))
    rel = lambda a, r, b: rows.select(F.col(a).alias("head"), F.lit(r).alias("relation"), F.col(b).alias("tail"))
    entities = ent("manager", "Fund").unionByName(ent("company", "Company")).unionByName(ent("sector", "Sector")).unionByName(ent("region", "Region")).distinct()
    relations = rel("manager", "holds", "company").unionByName(rel("company", "belongs_to", "sector")).unionByName(rel("company", "located_in", "region")).distinct()
    return entities, relations


def write_chunks(chunks: DataFrame, path: str, parts: int = 64) -> None:
    """Chunks dealt to folders by a hash of their document's id, so a later delete rewrites its documents' folders only."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    chunks.withColumn("bucket", bucket).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def graph_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, alias index) of a stored graph; the index has a row for each alias of a name."""
    entities, relations = spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations")
    return entities, relations, alias_index(entities)


def alias_index(entities: DataFrame) -> DataFrame:
    """(alias, name)."""
    return entities.select(F.explode(T.aliases(F.col("name"))).alias("alias"), "name").where("alias <> ''").distinct()


def write_graph_snapshot(entities: DataFrame, relations: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    relations.write.mode("overwrite").parquet(f"{path}/relations")


def seed(spark: SparkSession, graph: str, tables: list[str], path: str) -> DataFrame:
    """Stores a JSON graph and CSV tables as the first content under ``path``; returns the number of rows of each part."""
    entities, relations, _ = graph_json(spark, graph)
    write_graph_snapshot(entities, relations, path)
    texts = [table_texts(spark, t).select(F.lit(t).alias("doc_id"), "batch", "text") for t in tables]
    if texts:
        write_chunks(reduce(DataFrame.unionByName, texts), f"{path}/chunks")
    counts = [spark.read.parquet(f"{path}/{p}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n") for p in ("entities", "relations", *(["chunks"] if texts else []))]
    return reduce(DataFrame.unionByName, counts)


def write_artifact(values: DataFrame, path: str) -> None:
    """A report or model as one small JSON file: ``values`` has a handful of rows."""
    values.coalesce(1).write.mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_graph_artifacts(entities: DataFrame, relations: DataFrame, instances: DataFrame, path: str) -> None:
    """Entities, relations and path instances, the last by metapath."""
    entities.write.mode("overwrite").json(f"{path}/entities")
    relations.write.mode("overwrite").json(f"{path}/relations")
    instances.write.mode("overwrite").partitionBy("metapath").json(f"{path}/adjacency_by_metapath")
