"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a fresh local one only where that is unset and the master is local."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="weftline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _home(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/weftline-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table of its own in the shared folder and go on from the files."""
    path = f"{_home(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more."""
    for df in tables:
        path = None if df is None else getattr(df, "_weftline_path", None)
        if path:
            delete(df.sparkSession, path)


def purge(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote in this application; results that still read one must be stored before."""
    delete(spark, _home(spark))


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
