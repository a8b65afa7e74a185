"""Stored tables with keyed upserts and deletes: hash buckets, copied on write, published by a manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.shared import delete


class Conflict(RuntimeError):
    """Another writer published the version that this one made."""


@dataclass
class KeyedTable:
    """A table under ``path`` whose rows are dealt to ``buckets`` folders by a hash of ``bucket_by``.

    A version is a manifest that names the folder of each bucket that has rows. A change
    writes new folders for the buckets that it touches and then publishes a manifest that
    names them beside the untouched ones, which stay as they are. A reader takes the last
    manifest and never sees half a change; a writer that breaks off leaves folders that
    nothing names, for ``vacuum``. Of two writers at once one gets a ``Conflict`` and has
    changed nothing. Buckets are some hundreds at most, so manifests are small; a bucket that
    one key fills is many files, as its rows are split by size.

    Null keys are equal to each other. Columns are those of the first rows stored.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    bucket_by: tuple[str, ...]
    buckets: int = 64

    def __post_init__(self) -> None:
        if not set(self.bucket_by) <= set(self.keys):
            raise ValueError("rows are dealt by columns of the key")

    # ---------------------------------------------------------------- files and manifests

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def version(self) -> int:
        """The last published version; 0 before the first."""
        return max((int(n[2:-5]) for n in self._names("manifest") if n.startswith("v-") and n.endswith(".json")), default=0)

    def _manifest(self, version: int) -> dict:
        fs, p = self._fs(f"{self.path}/manifest/v-{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, schema: str, folders: dict[str, str]) -> None:
        jvm = self.spark._jvm
        fs, tmp = self._fs(f"{self.path}/manifest/tmp-{uuid.uuid4().hex}")
        _, final = self._fs(f"{self.path}/manifest/v-{version:012d}.json")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "folders": folders}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(tmp, final, none)  # refuses a name that is there
        except Py4JJavaError as e:
            fs.delete(tmp, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} of {self.path} is there already") from None
            raise

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Bucket -> folder of the rows, which are in no version yet."""
        name = uuid.uuid4().hex
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        return {n.split("=")[1]: f"data/{name}/{n}" for n in self._names(f"data/{name}") if n.startswith("_bucket=")}

    def _rows(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        found = [f"{self.path}/{f}" for b, f in sorted(manifest["folders"].items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    # ---------------------------------------------------------------- reading and writing

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default."""
        v = self.version() if version is None else version
        if not v:
            raise FileNotFoundError(f"{self.path} holds no version")
        return self._rows(self._manifest(v))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose ``bucket_by`` columns are among ``keys``; only their buckets are read."""
        manifest = self._manifest(self.version())
        wanted = keys.select(*self.bucket_by).distinct()
        return self._matched(self._rows(manifest, self._touched(wanted)), wanted, self.bucket_by, "left_semi")

    def _touched(self, rows: DataFrame) -> set[str]:
        return {str(r["b"]) for r in rows.select(self._bucket().alias("b")).distinct().collect()}

    @staticmethod
    def _matched(rows: DataFrame, others: DataFrame, columns, how: str) -> DataFrame:
        other = others.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(columns))).distinct()
        return rows.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(columns)]), how)

    def _change(self, base: int, fresh: DataFrame | None, gone: DataFrame, columns) -> int:
        """Publishes ``base`` without the rows whose ``columns`` are in ``gone``, and with ``fresh``."""
        manifest = self._manifest(base)
        touched = self._touched(gone)
        rows = self._matched(self._rows(manifest, touched), gone, columns, "left_anti")
        if fresh is not None:
            rows = rows.unionByName(fresh.select(*rows.columns))
        folders = {b: f for b, f in manifest["folders"].items() if b not in touched} | (self._write(rows) if touched else {})
        self._publish(base + 1, manifest["schema"], folders)
        return base + 1

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Stores rows in place of those with their keys; returns the version.

        Of rows that repeat a key the one with the greatest ``order`` is stored, any of them
        if there is none; ``order`` itself is stored if it is a column of the table.
        """
        base = self.version()
        rest = [c for c in rows.columns if c not in self.keys]
        packed = F.struct(*rest) if rest else F.lit(None)
        one = rows.groupBy(*self.keys).agg((F.max_by(packed, order) if order else F.first(packed)).alias("_r")).select(*self.keys, *(F.col(f"_r.{c}").alias(c) for c in rest))
        if not base:
            stored = one.select(*[c for c in rows.columns])
            self._publish(1, stored.schema.json(), self._write(stored))
            return 1
        return self._change(base, one, one, self.keys)

    def delete(self, keys: DataFrame) -> int:
        """Deletes the rows whose values are among ``keys``, which has all of ``bucket_by`` and any more of the key columns."""
        columns = [c for c in self.keys if c in keys.columns]
        if not set(self.bucket_by) <= set(columns):
            raise ValueError(f"a delete must name {self.bucket_by}")
        return self._change(self.version(), None, keys.select(*columns).distinct(), columns)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests but the last ``keep`` and the folders that none of these names; returns how many folders went.

        Not while others write: the folders of a change under way are in no manifest yet.
        """
        last = self.version()
        live = {f for v in range(max(1, last - keep + 1), last + 1) for f in self._manifest(v)["folders"].values()}
        gone = 0
        for name in self._names("data"):
            for bucket in [n for n in self._names(f"data/{name}") if n.startswith("_bucket=")]:
                if f"data/{name}/{bucket}" not in live:
                    delete(self.spark, f"{self.path}/data/{name}/{bucket}")
                    gone += 1
            if not any(n.startswith("_bucket=") for n in self._names(f"data/{name}")):
                delete(self.spark, f"{self.path}/data/{name}")
        for n in self._names("manifest"):
            if n.startswith("tmp-") or n.startswith("v-") and int(n[2:-5]) <= last - keep:
                delete(self.spark, f"{self.path}/manifest/{n}")
        return gone


def chunk_store(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """Chunks (doc_id, chunk_index, content, embedding, metadata, ...); a delete by doc_id rewrites its bucket only."""
    return KeyedTable(spark, path, ("doc_id", "chunk_index"), ("doc_id",), buckets)


class GraphStore:
    """Entities by name and relations by (head, relation, tail), each a keyed table under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.entities = KeyedTable(spark, f"{path}/entities", ("name",), ("name",), buckets)
        self.relations = KeyedTable(spark, f"{path}/relations", ("head", "relation", "tail"), ("head",), buckets)

    def upsert_entities(self, rows: DataFrame, order: str | None = None) -> int:
        return self.entities.upsert(rows.where(F.coalesce("name", F.lit("")) != ""), order)

    def upsert_relations(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """Stores the relations whose ends are both stored; returns the others."""
        names = self.entities.read().select("name")
        inside = rows.join(names.select(F.col("name").alias("head")), "head", "left_semi").join(names.select(F.col("name").alias("tail")), "tail", "left_semi")
        self.relations.upsert(inside.select(*rows.columns), order)
        known = lambda c: names.select(F.col("name").alias(c), F.lit(True).alias(f"_{c}"))
        marked = rows.join(known("head"), "head", "left").join(known("tail"), "tail", "left")
        return marked.where("_head is null or _tail is null").select(*rows.columns)

    def delete_by_source(self, gone) -> int:
        """Deletes the entities whose ``source`` fulfils the condition, with every relation that meets them or fulfils it; returns the number of entities."""
        names = self.entities.read().where(gone).select("name")
        n = names.count()
        rel = self.relations.read()
        met = rel.where(gone).select("head", "relation", "tail")
        for end in ("head", "tail"):
            met = met.unionByName(rel.join(names.select(F.col("name").alias(end)), end, "left_semi").select("head", "relation", "tail"))
        self.relations.delete(met.distinct())
        self.entities.delete(names)
        return n
