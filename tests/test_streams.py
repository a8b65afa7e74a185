"""Stateful streams and the watched folder against plain folds."""

import json
from collections import defaultdict

from pyspark.sql import functions as F

from weftline.sources import watch
from weftline.streaming import cdc, stateful

EVENTS = "event_id string, operation string, resource string, seq long, success boolean, before map<string,string>, after map<string,string>"


def events(n, start=0):
    for i in range(start, start + n):
        op = ("UPDATE", "INSERT", "DELETE")[i % 3]
        yield (f"e{i}", op, None if i % 11 == 0 else f"r{i % 4}", i, None if i % 13 == 0 else i % 5 != 0, {"content": f"a\nb{i}"}, {"content": f"a\nc{i}\nd"})


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(("event_id", "operation", "resource", "seq", "success", "before", "after"), r, strict=True))) + "\n" for r in rows))


def test_versions_go_on_after_a_restart(spark, tmp_path):
    src, want, counts = tmp_path / "in", {}, defaultdict(int)
    for eid, op, resource, seq, ok, *_ in [*events(60), *events(40, 60)]:
        counts[resource] += bool(ok)
        want[eid] = (op, resource, seq, bool(ok), counts[resource] if ok else None)
    got = {}
    for part in ([*events(60)], [*events(40, 60)]):  # the second run starts anew from the checkpoint
        write(src, f"{part[0][0]}.json", part)
        stream = stateful.versioned(spark.readStream.schema(EVENTS).json(str(src)))
        out = str(tmp_path / "out")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        got = {r["event_id"]: r for r in spark.read.parquet(out).collect()}
    assert {k: (r["operation"], r["resource"], r["seq"], r["success"], r["version"]) for k, r in got.items()} == want
    assert all((r["diff"] is not None) == (r["operation"] == "UPDATE") for r in got.values())
    assert got["e3"]["diff"]["added"] == ["c3", "d"] and got["e3"]["diff"]["removed"] == ["b3"] and got["e3"]["diff"]["change_ratio"] == 0.6


def test_versions_of_a_table(spark):
    batch = stateful.versioned(spark.createDataFrame([*events(50)], EVENTS).repartition(3))
    rows = spark.createDataFrame([*events(50)], EVENTS).withColumn("success", F.coalesce("success", F.lit(False)))
    want = {r["event_id"]: r["version"] for r in cdc.versions(rows).collect()}
    assert {r["event_id"]: r["version"] for r in batch.collect()} == want
    assert stateful.versioned(spark.createDataFrame([], EVENTS)).count() == 0


def brute_limit(rows, limit, window):
    kept, out = defaultdict(list), {}
    for client, seq, t in rows:
        kept[client] = [x for x in kept[client] if x >= t - window]
        out[seq] = len(kept[client]) < limit
        if out[seq]:
            kept[client].append(t)
    return out


def test_rate_limit_stream_with_timers(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    rows = [(f"c{i % 3}", i, 1_700_000_000 + i * 7 + (0 if i % 5 else 300 * (i // 40))) for i in range(120)]
    rows.sort(key=lambda r: (r[2], r[1]))
    for n, part in enumerate((rows[:50], rows[50:51], rows[51:])):
        (src / f"{n}.json").write_text("".join(json.dumps({"client": c, "seq": s, "t": t}) + "\n" for c, s, t in part))
        stream = spark.readStream.schema("client string, seq long, t long").json(str(src)).select("client", "seq", F.timestamp_seconds("t").alias("ts"))
        stateful.limited(stream, 4, 60).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert {r["seq"]: r["allowed"] for r in spark.read.parquet(out).collect()} == brute_limit(rows, 4, 60)


def test_bad_events_are_dropped_alone(spark, tmp_path):
    """Of forty events the two that cannot be applied are dropped; an empty message is no unparseable one."""
    src = tmp_path / "in"
    src.mkdir()
    lines = [json.dumps({"value": json.dumps({"id": f"m{i}", "op": "u", "source": {"table": "t"}})}) for i in range(40)]
    (src / "a.json").write_text("\n".join([*lines, json.dumps({"value": None, "x": 1}), json.dumps({"value": "{broken"})]))
    applied, calls = set(), []

    def apply(df):
        ids = {r["event_id"] for r in df.collect()}
        calls.append(len(ids))
        if ids & {"m7", "m23"}:
            raise RuntimeError("cannot be applied")
        applied.update(ids)

    cdc.start_cdc(spark.readStream.schema("value string, x int").json(str(src)), apply, str(tmp_path / "ck"), str(tmp_path / "dead"), once=True, retries=1).awaitTermination()
    assert applied == {f"m{i}" for i in range(40)} - {"m7", "m23"}
    dead = sorted((r["reason"], r["event_id"] if r["reason"] == "dropped" else "") for r in spark.read.parquet(str(tmp_path / "dead")).collect())
    assert dead == [("dropped", "m23"), ("dropped", "m7"), ("empty", ""), ("unparseable", "")]
    assert calls[0] == calls[1] == 40 and len(calls) < 40


def test_disposition_of_an_empty_message(spark):
    rows = spark.createDataFrame([(1, 1, True, True, False), (2, 1, False, False, True), (3, 1, False, False, False)], "message_id int, attempt int, ok boolean, parsed boolean, empty boolean")
    assert {r["message_id"]: (r["outcome"], r["attempts"]) for r in cdc.dispositions(rows).collect()} == {1: ("committed", 1), 2: ("empty", 1), 3: ("unparseable", 1)}


# ---------------------------------------------------------------- the watched folder


def put(spark, folder, files):
    rows = spark.createDataFrame([(k, None if v is None else v.encode()) for k, v in files.items()], "name string, content binary")
    return watch.write_files(rows, str(folder))


def look(spark, folder, home):
    rows = watch.poll(spark, str(folder), str(home)).collect()
    return {r["path"].split("/docs/")[1]: (r["change"], r["old_hash"] is not None, r["new_hash"] is not None) for r in rows}


def test_watched_folder(spark, tmp_path):
    folder, home = tmp_path / "docs", tmp_path / "home"
    assert look(spark, folder, home) == {}  # the folder is not there yet
    assert put(spark, folder, {"a.txt": "one", "sub/deep/b.txt": "two", "c.txt": "", "d.txt": "four"}) == 4
    assert look(spark, folder, home) == {k: ("created", False, True) for k in ("a.txt", "sub/deep/b.txt", "d.txt")}
    assert look(spark, folder, home) == {}
    put(spark, folder, {"a.txt": "one more", "sub/deep/b.txt": None, "sub/e.txt": "five", "d.txt": "four"})  # d is written again as it was
    assert look(spark, folder, home) == {"a.txt": ("modified", True, True), "sub/deep/b.txt": ("deleted", True, False), "sub/e.txt": ("created", False, True)}
    assert watch.stored_events(spark, str(home)).count() == 6 and watch.last_version(spark, str(home)) == 4
    # a look that broke off before its mark is made again
    put(spark, folder, {"a.txt": "three"})
    assert look(spark, folder, home) == {"a.txt": ("modified", True, True)}
    (home / "state" / "v=5" / "_SUCCESS").unlink()
    assert watch.last_version(spark, str(home)) == 4
    assert look(spark, folder, home) == {"a.txt": ("modified", True, True)} and watch.stored_events(spark, str(home)).where("v = 5").count() == 1
    # an old file moved in is read although it is older than all others
    import os

    (folder / "old.txt").write_text("old")
    os.utime(folder / "old.txt", (1_000_000_000, 1_000_000_000))
    assert look(spark, folder, home) == {"old.txt": ("created", False, True)}


def test_watch_as_a_stream(spark, tmp_path):
    import time

    folder, home, seen = tmp_path / "docs", str(tmp_path / "home"), []
    put(spark, folder, {"a.txt": "one"})
    q = watch.watch(spark, str(folder), home, lambda df: seen.extend(r["change"] for r in df.collect()), every="1 second")
    try:
        for _ in range(60):
            if seen == ["created"]:
                put(spark, folder, {"a.txt": "two"})
            if len(seen) > 1:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert seen[:2] == ["created", "modified"]


def test_a_look_lists_files_in_tasks(spark, tmp_path):
    from weftline.sources import watch

    names = [f"{i % 3}/deep {i % 2}/f%20 {i}.txt" for i in range(40)]
    watch.write_files(spark.createDataFrame([*((n, n) for n in names), (".hidden", "x"), ("_temporary/x", "x"), ("empty", "")], "name string, content string"), str(tmp_path / "in"))
    got = watch.listed(spark, str(tmp_path / "in"))
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "in"))
    want = want.select("path", F.col("modificationTime").alias("modified"), "length")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 40
    found = watch.poll(spark, str(tmp_path / "in"), str(tmp_path / "home"))
    assert {r["path"].split("/in/")[1]: r["change"] for r in found.collect()} == dict.fromkeys(names, "created")
