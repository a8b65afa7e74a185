"""A watched folder: what was created, modified and deleted since the last look, at any depth, over restarts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import ingest
from weftline.shared import cut, delete, discard

FILE = "path string, modified timestamp, length long, hash string"
EVENT = "path string, change string, old_hash string, new_hash string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def last_version(spark: SparkSession, home: str) -> int:
    """The number of the last complete look; 0 before the first."""
    fs, p = _fs(spark, f"{home}/state")
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max((int(n[2:]) for n in names if n.startswith("v=") and _exists(spark, f"{home}/state/{n}/_SUCCESS")), default=0)


def _files(spark: SparkSession, folder: str) -> DataFrame | None:
    """Path, time, length and content of the files below ``folder``; None if there is none. Content is read only where it is used."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(folder)
    except AnalysisException:
        return None


LISTED = "path string, modified timestamp, length long, folder boolean"


def _reach(path: str):
    """The file system of a path and its name there, in a task."""
    from pyarrow import fs

    path = path.removeprefix("file:") if path.startswith("file:/") else path
    return fs.FileSystem.from_uri(path if "://" in path else "file:///" + quote(path.lstrip("/")))


def _look(batches):
    """What lies directly in the folders; names that Spark's readers hide and empty files are left out."""
    import pyarrow as pa
    from pyarrow import fs

    for b in batches:
        for folder in b.column("path").to_pylist():
            home, root = _reach(folder)
            rows = []
            for f in home.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                name, deep = f.base_name, f.type == fs.FileType.Directory
                hidden = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))
                if not hidden and (deep or f.size):
                    rows.append((f"{folder.rstrip('/')}/{name}", (f.mtime_ns or 0) // 1_000_000 * 1000, f.size or 0, deep))
            path, modified, length, deep = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [pa.array(path, pa.string()), pa.array(modified, pa.timestamp("us", "UTC")), pa.array(length, pa.int64()), pa.array(deep, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "modified", "length", "folder"])


def _hash(batches):
    """path, hash of the files that still are there, read a piece at a time."""
    import pyarrow as pa

    for b in batches:
        rows = []
        for path in b.column("path").to_pylist():
            home, name = _reach(path)
            digest = hashlib.sha256()
            try:
                with home.open_input_stream(name) as f:
                    while piece := f.read(1 << 20):
                        digest.update(piece)
            except FileNotFoundError:
                continue
            rows.append((path, digest.hexdigest()))
        path, hashed = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(hashed, pa.string())], ["path", "hash"])


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified, length of the files below ``folder``, listed by tasks, a depth at a time; a task holds the names of one folder."""
    fs, p = _fs(spark, folder)
    level, tables = spark.createDataFrame([(fs.makeQualified(p).toString(),)], "path string"), []
    while True:
        seen = cut(level.mapInArrow(_look, LISTED))
        tables.append(seen)
        level = seen.where("folder").select("path")
        n = level.count()
        if not n:
            break
        level = level.repartition(min(n, 8 * spark.sparkContext.defaultParallelism))
    out = cut(reduce(DataFrame.unionByName, tables).where("not folder").select("path", "modified", "length"))
    discard(*tables)
    return out


def _state(spark: SparkSession, home: str, version: int) -> DataFrame:
    return spark.read.schema(FILE).parquet(f"{home}/state/v={version}") if version else spark.createDataFrame([], FILE)


def poll(spark: SparkSession, folder: str, home: str) -> DataFrame:
    """path, change, old_hash, new_hash of one look at ``folder``; ``home`` keeps what was seen.

    A file counts as modified if its content has another hash, not if it was only touched.
    Files whose time and length are as before are not read again: the listing tells them.
    Tasks list and read the files, so the driver knows none of their names. Events and state of a look are folders of its number; the state's success mark
    publishes both, so a look that broke off is made anew and its events are written over.
    The state before the last one is deleted. Defined results: an empty or missing folder
    says that all known files were deleted; an empty file is not there, as Spark's readers do
    not see it, so a file that loses its content is deleted; a file renamed is one deleted
    and one created.
    """
    version = last_version(spark, home)
    old = _state(spark, home, version)
    light = listed(spark, folder)
    same = light.join(old, ["path", "modified", "length"]).select("path", "modified", "length", "hash")
    fresh = light.join(old.select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")
    # a number of partitions of its own, as a short row is a whole file to read
    hashed = fresh.select("path").repartition(8 * spark.sparkContext.defaultParallelism, "path").mapInArrow(_hash, "path string, hash string")
    new = same.unionByName(fresh.join(hashed, "path").select("path", "modified", "length", "hash"))
    next_state = f"{home}/state/v={version + 1}"
    delete(spark, next_state)
    new.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").mode("overwrite").parquet(next_state)
    discard(light)
    new = spark.read.schema(FILE).parquet(next_state)
    key = lambda df: df.select(F.col("path").alias("doc_id"), "hash")
    found = ingest.changes(key(old), key(new)).withColumnRenamed("doc_id", "path")
    hashes = old.select("path", F.col("hash").alias("old_hash")).join(new.select("path", F.col("hash").alias("new_hash")), "path", "full_outer")
    events = f"{home}/events/v={version + 1}"
    found.join(hashes, "path").select("path", "change", "old_hash", "new_hash").write.mode("overwrite").parquet(events)
    fs, mark = _fs(spark, f"{next_state}/_SUCCESS")
    fs.create(mark, True).close()
    if version > 1:
        delete(spark, f"{home}/state/v={version - 1}")
    return spark.read.schema(EVENT).parquet(events)


def watch(spark: SparkSession, folder: str, home: str, handle: Callable[[DataFrame], None] | None = None, every: str = "10 seconds"):
    """A streaming query that looks at ``folder`` again and again and hands each look's events to ``handle``.

    A look whose handler raised is not made again by number: the query stops with the error,
    and its events stay under ``home``/events for a second try.
    """

    def batch(_: DataFrame, number: int) -> None:
        events = poll(spark, folder, home)
        if handle is not None:
            handle(events)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", f"{home}/ticks").trigger(processingTime=every).start()


def stored_events(spark: SparkSession, home: str) -> DataFrame:
    """All events so far with the number of their look (``v``), of complete looks only."""
    version = last_version(spark, home)
    if not version:
        return spark.createDataFrame([], f"{EVENT}, v int")
    return spark.read.schema(f"{EVENT}, v int").parquet(f"{home}/events").where(F.col("v") <= version)


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes each row (name, content) to the file ``folder``/``name``, from the tasks; returns the number of files.

    A row without content deletes its file. Names may hold folders; the folder must be one
    that every executor reaches.
    """

    def run(batches):
        from pyarrow import fs

        path = folder.removeprefix("file:") if folder.startswith("file:/") else folder
        home, root = fs.FileSystem.from_uri(path if "://" in path else "file:///" + path.lstrip("/"))
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                path = f"{root}/{name}"
                if content is None:
                    if home.get_file_info(path).is_file:
                        home.delete_file(path)
                    continue
                home.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with home.open_output_stream(path) as out:
                    out.write(content)
            yield b.select(["name"])

    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string").count()
