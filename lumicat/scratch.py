"""Scratch tables in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a local one of our own only where it is unset, as in tests.

    A cluster's executors don't share the driver's folders, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="lumicat-scratch-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        root = _own[app]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/lumicat-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the scratch folder and read it back.

    Cuts the lineage; a lost executor costs no recomputation of what is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these tables, once nothing will read them again."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            delete_path(t.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
