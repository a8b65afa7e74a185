"""Change events: normalisation, diffs, versions, dispositions, limits; batch and streaming."""

from __future__ import annotations

import difflib
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline import vocab
from weftline.shared import cut, discard, shared_folder

MESSAGE = "id string, op string, source struct<table:string>, before map<string,string>, after map<string,string>, ts_ms bigint"


def change_type(operation: Column) -> Column:
    """created, modified or deleted; null for an operation that is not supported."""
    m = F.create_map(*[F.lit(x) for kv in vocab.CDC_OPERATIONS.items() for x in kv])
    return F.try_element_at(m, F.upper(operation))


def from_file_event(kind: Column) -> Column:
    return F.when(kind == "created", "INSERT").when(kind == "deleted", "DELETE").otherwise("UPDATE")


def from_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """event_id, operation, resource, ts, before, after, parsed, empty of JSON messages.

    Unparseable ones have parsed false, those without a value are empty and not parsed.
    """
    text = F.col(value).cast("string")
    m = df.withColumn("_m", F.from_json(text, MESSAGE, {"mode": "PERMISSIVE"})).withColumn("parsed", F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False)))
    return m.select(
        F.coalesce("_m.id", F.substring(F.sha2(text.cast("binary"), 256), 1, 16)).alias("event_id"), F.upper(F.coalesce("_m.op", F.lit("UPDATE"))).alias("operation"),
        F.coalesce("_m.source.table", F.lit("unknown")).alias("resource"), F.timestamp_millis("_m.ts_ms").alias("ts"), F.col("_m.before").alias("before"), F.col("_m.after").alias("after"), "parsed", text.isNull().alias("empty"),
    )


_DIFF = T.StructType([
    T.StructField("added", T.ArrayType(T.StringType())), T.StructField("removed", T.ArrayType(T.StringType())), T.StructField("added_count", T.IntegerType()),
    T.StructField("removed_count", T.IntegerType()), T.StructField("change_ratio", T.DoubleType()), T.StructField("major", T.BooleanType()),
])


@F.pandas_udf(_DIFF)
def line_diff(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Lines added and removed by the longest-matching-blocks comparison."""
    rows = []
    for b, a in zip(before, after, strict=True):
        old, new = (b or "").splitlines(), (a or "").splitlines()
        codes = [c for c in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if c[0] != "equal"]
        gone = [x for _, i, j, _, _ in codes for x in old[i:j]]
        come = [x for _, _, _, i, j in codes for x in new[i:j]]
        ratio = (len(gone) + len(come)) / max(len(old) + len(new), 1)
        rows.append((come, gone, len(come), len(gone), round(ratio, 4), ratio > 0.3))
    return pd.DataFrame(rows, columns=["added", "removed", "added_count", "removed_count", "change_ratio", "major"])


def with_diff(events: DataFrame) -> DataFrame:
    """Adds ``diff`` where the operation is UPDATE and both images have content."""
    both = (F.col("operation") == "UPDATE") & F.col("before").isNotNull() & F.col("after").isNotNull()
    get = lambda m: F.coalesce(F.try_element_at(F.col(m), F.lit("content")), F.lit(""))
    return events.withColumn("_both", both).withColumn("_d", line_diff(get("before"), get("after"))).withColumn("diff", F.when(F.col("_both"), F.col("_d"))).drop("_both", "_d")


def versions(events: DataFrame) -> DataFrame:
    """Each event's version of its resource: the number of successes up to it; null for a failure."""
    n = F.sum(F.col("success").cast("long")).over(W.partitionBy("resource").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("version", F.when(F.col("success"), n))


def dispositions(attempts: DataFrame, retries: int = 3) -> DataFrame:
    """(message_id, outcome, attempts): committed at the first success, dropped after ``retries`` more failures, else open.

    A message without a value (column ``empty``, if there is one) is empty, whatever else is said of it.
    """
    empty = F.bool_or("empty") if "empty" in attempts.columns else F.lit(False)
    rows = attempts.groupBy("message_id").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("first_ok"), F.count(F.lit(1)).alias("n"), F.bool_and("parsed").alias("parsed"), empty.alias("empty"))
    rows = rows.withColumn("parsed", F.col("parsed") & ~F.col("empty"))
    return rows.select(
        "message_id",
        F.when(F.col("empty"), "empty").when(~F.col("parsed"), "unparseable").when(F.col("first_ok") <= retries + 1, "committed").when(F.col("n") > retries, "dropped").otherwise("retrying").alias("outcome"),
        F.when(~F.col("parsed"), F.lit(1).cast("long")).otherwise(F.least(F.coalesce(F.col("first_ok").cast("long"), F.col("n")), F.lit(retries + 1).cast("long"))).alias("attempts"),
    )


def backoff(attempt: Column) -> Column:
    return F.least(0.5 * attempt, F.lit(2.0))


def rate_limit(requests: DataFrame, limit: int = 60, window_s: int = 60) -> DataFrame:
    """(client, seq, ts, allowed): a sliding window in which refused requests do not count.

    The feedback makes this a fold over each client's requests in time order. Rows are
    dealt by client, sorted in the partition and streamed, so a client of any size needs
    only its window in memory.
    """
    schema = "client string, seq long, ts double, allowed boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, kept = None, deque()
        for b in batches:
            ok = []
            for c, t in zip(b["client"], b["ts"], strict=True):
                if c != client:
                    client, kept = c, deque()
                while kept and kept[0] < t - window_s:
                    kept.popleft()
                ok.append(len(kept) < limit)
                if ok[-1]:
                    kept.append(t)
            yield b.assign(allowed=ok)

    rows = requests.select(F.col("client").cast("string").alias("client"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("double").alias("ts"))
    return rows.repartition("client").sortWithinPartitions("client", "ts", "seq").mapInPandas(run, schema)


# ---------------------------------------------------------------- streams


def kafka_source(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """Messages of the change topics from the latest offsets; offsets live in the query's checkpoint."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", "latest").load()


def file_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def settle(events: DataFrame, apply: Callable[[DataFrame], None], retries: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame | None:
    """Applies a written table of events (column ``row``, a number of its own); returns those that cannot be applied, None if all were.

    The whole is tried ``retries`` times more, with growing pauses, as an outage needs time.
    What still fails is halved by a hash of its row until the rows that fail are alone: one
    bad event among n costs some 2 log n calls, and every event that can be applied is.
    ``apply`` must leave nothing behind when it raises. A single row has then failed
    ``retries`` + 1 times at least, if only with others or alone.
    """
    for attempt in range(1, retries + 2):
        try:
            apply(events)
            return None
        except Exception:
            if attempt <= retries:
                pause(min(0.5 * attempt, 2.0))
    dropped, todo = [], [(events, 0)]
    while todo:
        part, depth = todo.pop()
        if part.limit(2).count() < 2:
            dropped.append(part)
            continue
        side = F.pmod(F.xxhash64(F.lit(depth), "row"), F.lit(2))
        for i in (0, 1):
            half = part.where(side == i)
            if half.limit(1).count():
                try:
                    apply(half)
                except Exception:
                    todo.append((half, depth + 1))
    return reduce(DataFrame.unionByName, dropped)


def start_cdc(messages: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, dead_letters: str, once: bool = False, retries: int = 3):
    """Applies each micro-batch of messages, parsed once; what cannot be applied goes to ``dead_letters`` with its reason.

    ``apply(events)`` gets the normalised events. If it raises, the batch is tried again and
    then halved until only events that fail alone are left (see ``settle``): these are
    dropped, all others are applied. A message without a value is empty, other reasons are
    unparseable and unsupported. Offsets are committed after that. A replayed batch writes
    the same folder of dead letters again, named by its number, so nothing is there twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        parsed = from_messages(df).withColumn("change", change_type(F.col("operation"))).withColumn("row", F.monotonically_increasing_id())
        events = cut(parsed)
        try:
            good = F.col("parsed") & F.col("change").isNotNull()
            reason = F.when(F.col("empty"), "empty").when(~F.col("parsed"), "unparseable").otherwise("unsupported")
            dead = events.where(~good).withColumn("reason", reason)
            dropped = settle(events.where(good), apply, retries)
            if dropped is not None:
                dead = dead.unionByName(dropped.withColumn("reason", F.lit("dropped")))
            dead.select("event_id", "operation", "resource", "ts", "reason").write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
        finally:
            discard(events)

    w = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def request_metrics(requests: DataFrame) -> DataFrame:
    """(path, count, total, last): upserted sums of a stream in update mode, or of a table."""
    return requests.groupBy("path").agg(F.count(F.lit(1)).alias("count"), F.sum("duration").alias("total"), F.max_by("duration", "seq").alias("last"))


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; the same expression over a table and over a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def stream_to_table(spark: SparkSession, stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a bounded stream to its end into files of the shared folder and returns what they hold.

    Every batch writes the folder of its number, so a replay leaves nothing twice. In
    append mode the result is all batches; in complete mode the last one; in update mode
    the last row of each of ``keys``.
    """
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    try:
        rows = spark.read.schema(schema).parquet(f"{home}/rows")
    except AnalysisException:  # no batch was written
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch", "left_semi")
    elif mode == "update":
        rest = [c for c in rows.columns if c not in [*keys, "batch"]]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
    return rows.drop("batch")
