"""Ingestion: extraction gates, registry state, change detection, stored chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline import vocab
from weftline.operators.graph import durable


def serialize_table(df: DataFrame, columns: list[str], order: list[str], batch: int = 20) -> DataFrame:
    """(batch, text): rows as ``h: v | h: v`` under a ``Headers:`` line, ``batch`` rows a text.

    Rows are numbered within range partitions and their offsets, so no single task holds the table.
    """
    line = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    numbered = number(df.select(*order, line.alias("line")), order).withColumn("batch", F.floor((F.col("n") - 1) / batch))
    texts = numbered.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return texts.select("batch", F.concat(F.lit("Headers: " + " | ".join(columns) + "\n"), "body").alias("text"))


def number(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Global row numbers from 1 in the given order: range partitions, then each partition's offset.

    The dealt rows are written once: bounds are sampled anew in every run of a range
    partitioning, so sizes and rows must come from the same one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, row, off = "_weft_part", "_weft_row", "_weft_off"
    dealt = df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id())
    within = durable(dealt.withColumn(row, F.row_number().over(W.partitionBy(part).orderBy(*order))))
    sizes = within.groupBy(part).agg(F.max(row).alias("c"))  # one row a partition
    offsets = sizes.select(part, F.coalesce(F.sum("c").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(off))
    return within.join(F.broadcast(offsets), part).withColumn(name, F.col(row) + F.col(off)).drop(part, row, off)


def gate(entities: DataFrame, relations: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Confident entities, and confident relations whose ends were kept in the same chunk."""
    kept = entities.where(F.col("confidence") >= least)
    ends = kept.select("chunk_id", "name").distinct()
    rels = relations.where(F.col("confidence") >= least)
    for end in ("head", "tail"):
        rels = rels.join(ends.withColumnRenamed("name", end), ["chunk_id", end], "left_semi")
    return kept, rels


def first_extraction(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key in (chunk_index, pos) order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("chunk_index", "pos")).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def richest(df: DataFrame, key: str = "name") -> DataFrame:
    """Of several records of an entity the one with the longest description, then the highest confidence."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.length("description"), "confidence")).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def registry_state(log: DataFrame) -> DataFrame:
    """(doc_id, status, retry_count, failed_at, updated_at) folded from (doc_id, event, seq)."""
    status = F.when(F.col("event") == "begin", "pending").when(F.col("event") == "commit", "committed").when(F.col("event") == "fail", "failed")
    rows = log.withColumn("status", status).where("status is not null")
    return rows.groupBy("doc_id").agg(
        F.max_by("status", "seq").alias("status"), F.count_if(F.col("status") == "failed").alias("retry_count"),
        F.max(F.when(F.col("status") == "failed", F.col("seq"))).alias("failed_at"), F.max("seq").alias("updated_at"),
    )


def new_content(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Incoming documents whose content hash no committed document has."""
    return incoming.join(registry.where("status = 'committed'").select("content_hash").distinct(), "content_hash", "left_anti")


def changes(old: DataFrame, new: DataFrame, key: str = "doc_id", content: str = "hash") -> DataFrame:
    """(key, change): created, modified or deleted between two snapshots."""
    o, n = old.select(key, F.col(content).alias("_o"), F.lit(True).alias("_in_old")), new.select(key, F.col(content).alias("_n"), F.lit(True).alias("_in_new"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("_in_old").isNull(), "created").when(F.col("_in_new").isNull(), "deleted").when(~F.col("_o").eqNullSafe(F.col("_n")), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def apply_changes(stored: DataFrame, new_rows: DataFrame, change: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stored rows without those of changed documents, and the new rows of created and modified ones."""
    touched = change.select(key).distinct()
    live = change.where("change <> 'deleted'").select(key).distinct()
    return stored.join(touched, key, "left_anti").unionByName(new_rows.join(live, key, "left_semi"))


def valid_upload(path: Column, content: Column, most: int = 10 << 20) -> Column:
    """null for a good upload, otherwise why it is rejected."""
    ext = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    head = F.hex(F.substring(content, 1, 8))
    starts = {".pdf": "25504446", ".png": "89504E470D0A1A0A", ".jpg": "FFD8FF", ".jpeg": "FFD8FF", ".xlsx": "504B0304", ".xls": "D0CF11E0A1B11AE1"}
    wrong = F.lit(False)
    for e, magic in starts.items():
        wrong = wrong | ((ext == e) & ~head.startswith(magic))
    return (
        F.when(~ext.isin(*starts, ".csv", ".txt", ".md"), "type not allowed").when(F.length(content) == 0, "empty").when(F.length(content) > most, "too large")
        .when(wrong, "content does not match type").when(ext.isin(".csv", ".txt", ".md") & ~F.is_valid_utf8(content.cast("string")), "not UTF-8")
    )


def parse_extraction(reply: Column) -> Column:
    """struct(entities, relations) of a JSON reply, fenced or not; rows without a name or an end are dropped."""
    body = F.regexp_replace(F.trim(reply), r"(?s)^```(?:json)?\s*|\s*```$", "")
    parsed = F.from_json(body, "entities array<struct<name:string,type:string,description:string,confidence:double>>, relations array<struct<head:string,relation:string,tail:string,confidence:double>>")
    ents = F.transform(F.filter(parsed["entities"], lambda e: F.coalesce(e["name"], F.lit("")) != ""), lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["type"], F.lit("Entity")).alias("type"), F.coalesce(e["description"], F.lit("")).alias("description"), F.coalesce(e["confidence"], F.lit(1.0)).alias("confidence")))
    rels = F.transform(F.filter(parsed["relations"], lambda r: (F.coalesce(r["head"], F.lit("")) != "") & (F.coalesce(r["tail"], F.lit("")) != "")), lambda r: F.struct(r["head"].alias("head"), F.coalesce(r["relation"], F.lit("RELATED_TO")).alias("relation"), r["tail"].alias("tail"), F.coalesce(r["confidence"], F.lit(1.0)).alias("confidence")))
    return F.struct(F.coalesce(ents, F.array().cast("array<struct<name:string,type:string,description:string,confidence:double>>")).alias("entities"), F.coalesce(rels, F.array().cast("array<struct<head:string,relation:string,tail:string,confidence:double>>")).alias("relations"))


# ---------------------------------------------------------------- merge, versions, demo extraction


def merge_properties(df: DataFrame, key: str = "name") -> DataFrame:
    """(key, description, confidence, properties) folded in ``pos`` order.

    A record with a longer description, or an equally long one and more confidence, wins;
    the properties of both are merged and the winner's take precedence. The winner so far
    is the greatest (length, confidence) up to there, the first of equals, so precedence
    is an order by (winner of its step, position) and no record is visited twice.
    """
    w = W.partitionBy(key).orderBy("pos")
    rank = F.struct(F.length("description").alias("size"), F.col("confidence").alias("confidence"))
    before = F.max(rank).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = df.withColumn("_weft_wins", F.coalesce(rank > before, F.lit(True)))
    # a winner puts its properties over all before; a loser's go under all before
    place = F.when(F.col("_weft_wins"), F.col("pos")).otherwise(-F.col("pos"))
    one = rows.select(key, "pos", "description", "confidence", "_weft_wins", place.alias("_weft_place"), F.explode_outer("properties").alias("k", "v"))
    best = one.where("k is not null").groupBy(key, "k").agg(F.max_by("v", "_weft_place").alias("v")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("properties"))
    top = rows.where("_weft_wins").groupBy(key).agg(F.max_by(F.struct("description", "confidence"), "pos").alias("r"))
    out = top.join(best, key, "left").select(key, "r.description", "r.confidence", "properties")
    return out.withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def next_versions(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """(name, seq, version) of each update: one more than the greater of the stored version and the updates before it."""
    n = F.row_number().over(W.partitionBy("name").orderBy("seq"))
    return updates.join(stored.select("name", F.col("version").alias("_weft_v")), "name", "left").select("name", "seq", (F.coalesce("_weft_v", F.lit(0)).cast("long") + n).alias("version"))


def demo_extraction(chunks: DataFrame) -> DataFrame:
    """(chunk_id, entities, relations): the offline extractor, keyed on a text's first 200 characters."""
    hint = F.lower(F.substring("content", 1, 200))
    entity = lambda e: F.struct(*(F.lit(x).alias(c) for c, x in zip(("name", "type", "confidence", "description"), (*e, f"Synthetic demo entity: {e[0]}"), strict=True)))
    relation = lambda r: F.struct(*(F.lit(x).alias(c) for c, x in zip(("head", "relation", "tail", "confidence"), r, strict=True)))
    ents = rels = None
    for words, e, r in vocab.DEMO_EXTRACTIONS:
        hit = F.lit(True)
        if words:
            hit = hint.contains(words[0]) | hint.contains(words[1])
        made = F.array(*map(entity, e)), F.array(*map(relation, r))
        ents, rels = (F.when(hit, made[0]), F.when(hit, made[1])) if ents is None else (ents.when(hit, made[0]), rels.when(hit, made[1]))
    return chunks.select("chunk_id", ents.alias("entities"), rels.alias("relations"))


# ---------------------------------------------------------------- steps of ingestion and update


def store_step(documents: DataFrame, writers: dict, registry: str, seq: int = 0) -> str:
    """One ingestion of a batch: begin, every writer, then commit; on an error fail and roll all writers back.

    ``writers`` maps a name to (write, undo), both of which get ``documents``. ``registry``
    is the folder of the (doc_id, event, seq) log; readers show rows of committed documents
    only, so a batch is published by its last append. Returns the last event.
    """
    def log(event: str, at: int) -> None:
        documents.select("doc_id", F.lit(event).alias("event"), F.lit(seq + at).cast("long").alias("seq")).distinct().write.mode("append").parquet(registry)

    log("begin", 0)
    begun = []
    try:
        for name, (write, _) in writers.items():
            begun.append(name)
            write(documents)
    except Exception:
        for name in reversed(begun):
            writers[name][1](documents)
        log("fail", 1)
        return "fail"
    log("commit", 1)
    return "commit"


def with_retry(changes: DataFrame, run) -> DataFrame:
    """``run(changes)`` gives (key..., success); the changes that failed are run once more."""
    first = durable(run(changes))
    keys = [c for c in changes.columns if c in first.columns]
    again = run(changes.join(first.where("not success").select(*keys), keys, "left_semi"))
    return first.where("success").withColumn("tries", F.lit(1)).unionByName(again.withColumn("tries", F.lit(2)))


def dead_letters(log: DataFrame) -> DataFrame:
    """(doc_id, retry_count, failed_at) of the documents whose last state is failed and that nobody cleared since."""
    cleared = log.where("event = 'clear'").groupBy("doc_id").agg(F.max("seq").alias("cleared_at"))
    dead = registry_state(log).where("status = 'failed'").join(cleared, "doc_id", "left")
    return dead.where("cleared_at is null or cleared_at < failed_at").select("doc_id", "retry_count", "failed_at")


def clear_letters(log: DataFrame, chosen: DataFrame, seq: int) -> DataFrame:
    """The log with tombstones for the chosen documents."""
    return log.unionByName(chosen.select("doc_id", F.lit("clear").alias("event"), F.lit(seq).cast("long").alias("seq")))


def retry_letters(log: DataFrame, chosen: DataFrame, run, seq: int) -> DataFrame:
    """The log after a new try of the chosen dead documents: ``run(documents)`` gives (doc_id, success)."""
    tried = run(dead_letters(log).join(chosen.select("doc_id"), "doc_id", "left_semi").select("doc_id"))
    event = F.when(F.col("success"), "commit").otherwise("fail").alias("event")
    return log.unionByName(tried.select("doc_id", event, F.lit(seq).cast("long").alias("seq")))


def ingest_counters(extracted: DataFrame) -> DataFrame:
    """(doc_id, chunks, entities, relations) of (doc_id, entities, relations) rows, one a chunk."""
    return extracted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("entities")).alias("entities"), F.sum(F.size("relations")).alias("relations"))


def update_counters(parts: DataFrame) -> DataFrame:
    """(event_id, chunks_affected, entities_updated) of (event_id, kind, action, n): added less deleted chunks; added and updated entities."""
    n = lambda kind, action: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("action") == action), F.col("n"))), F.lit(0))
    return parts.groupBy("event_id").agg((n("chunk", "added") - n("chunk", "deleted")).alias("chunks_affected"), (n("entity", "added") + n("entity", "updated")).alias("entities_updated"))


def manual_event(resource: Column, operation: Column, content: Column) -> Column:
    """The change message of a manual update, as the change stream has it."""
    image = F.create_map(F.lit("content"), content)
    gone = F.upper(operation).isin("DELETE", "D")
    return F.to_json(F.struct(operation.alias("op"), F.struct(resource.alias("table")).alias("source"), F.when(gone, image).alias("before"), F.when(~gone, image).alias("after")))


def delete_collection(embeddings: DataFrame, collections: DataFrame, collection: str, gone: DataFrame) -> DataFrame:
    """Embedding rows without those of the ``gone`` documents (doc_id) in the named collection."""
    ids = collections.where(F.col("name") == collection).select("collection_id")
    inside = embeddings.join(ids, "collection_id", "left_semi").join(gone.select("doc_id"), "doc_id", "left_semi").select("embedding_id")
    return embeddings.join(inside, "embedding_id", "left_anti")


def count_collection(embeddings: DataFrame, collections: DataFrame) -> DataFrame:
    """(name, n): rows of each collection."""
    return collections.join(embeddings, "collection_id", "left").groupBy("name").agg(F.count("embedding_id").alias("n"))
