"""A versioned catalog of Parquet snapshots.

``<root>/_catalog.json`` names the schema version and each table's current snapshot folder; a
commit writes new folders and then replaces that file, so readers see the old state or the new
one. One writer at a time holds ``<root>/_lock``. Only this small metadata is on the driver; it
goes through Spark's file systems, so a catalog can be wherever its tables can.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from lumicat import schema


class CatalogError(RuntimeError):
    pass


class Catalog:
    def __init__(self, spark: SparkSession, root: str, lock_timeout: float = 30.0, lock_stale: float = 3600.0):
        self.spark, self.root = spark, root.rstrip("/")
        self._locked = False
        jvm = spark.sparkContext._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path())
        self._lock(lock_timeout, lock_stale)
        try:
            self.meta = self._read_meta()
            if self.meta is None:
                if self._fs.listStatus(self._path()).__len__() > 1:
                    raise CatalogError(f"{root} holds other files and no catalog")
                self.meta = {"magic": "lumicat", "version": schema.VERSION, "tables": {}}
                self._write_meta()
            elif self.meta["version"] > schema.VERSION:
                raise CatalogError(f"catalog version {self.meta['version']} is newer than {schema.VERSION}")
            elif self.meta["version"] < schema.VERSION:  # later versions only add tables
                self.meta["version"] = schema.VERSION
                self._write_meta()
        except BaseException:
            self.close()
            raise

    def _lock(self, timeout: float, stale: float) -> None:
        """Waits for the lock; one that its owner has not renewed for ``stale`` seconds (commits do) was left by a crash."""
        end = time.monotonic() + timeout
        while not self._fs.createNewFile(self._path("_lock")):
            try:
                age = time.time() - self._fs.getFileStatus(self._path("_lock")).getModificationTime() / 1000
            except Exception:  # it has just gone
                continue
            if age > stale:
                self._fs.delete(self._path("_lock"), False)
                continue
            if time.monotonic() > end:
                raise CatalogError(f"{self.root} is locked by another writer")
            time.sleep(0.05)
        self._locked = True

    def close(self) -> None:
        if self._locked:
            self._fs.delete(self._path("_lock"), False)
            self._locked = False

    def __enter__(self) -> Catalog:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def _read_meta(self) -> dict | None:
        if not self._fs.exists(self._path("_catalog.json")):
            return None
        stream = self._fs.open(self._path("_catalog.json"))
        try:
            meta = json.loads(bytes(stream.readAllBytes()))
        except ValueError:
            meta = {}
        finally:
            stream.close()
        if meta.get("magic") != "lumicat":
            raise CatalogError(f"{self.root} is not a catalog")
        return meta

    def _write_meta(self) -> None:
        part = self._path(f"_catalog.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(part)
        out.write(bytearray(json.dumps(self.meta).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        context.rename(part, self._path("_catalog.json"), options)

    def read(self, table: str) -> DataFrame:
        wanted = schema.tables(self.meta["version"])[table]
        folder = self.meta["tables"].get(table)
        return self.spark.read.schema(wanted).parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], wanted)

    def commit(self, changes: dict[str, DataFrame]) -> None:
        """Write the tables as new snapshots, then make them current together."""
        if not self._locked:
            raise CatalogError("the catalog is closed")
        self._fs.setTimes(self._path("_lock"), int(time.time() * 1000), -1)
        folders = {}
        for table, df in changes.items():
            names = schema.tables(self.meta["version"])[table].names
            folders[table] = f"{table}/v={uuid.uuid4().hex}"
            df.select(*names).write.parquet(f"{self.root}/{folders[table]}")
        self.meta["tables"] = {**self.meta["tables"], **folders}
        self._write_meta()

    def vacuum(self) -> None:
        """Delete snapshots that aren't current."""
        current = set(self.meta["tables"].values())
        for table in schema.tables(self.meta["version"]):
            if self._fs.exists(self._path(table)):
                for status in self._fs.listStatus(self._path(table)):
                    if f"{table}/{status.getPath().getName()}" not in current:
                        self._fs.delete(status.getPath(), True)


def purge(spark: SparkSession, root: str, really: bool = False) -> str:
    """Delete a catalog; only says so unless ``really``. Refuses folders that aren't catalogs."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_catalog.json")):
        raise CatalogError(f"{root} is not a catalog")
    if not really:
        return f"would delete {root}"
    fs.delete(path, True)
    return f"deleted {root}"
