"""Snapshots of the graph: Parquet tables of one version in a folder, and a pointer that a rename moves to the next version.

A commit writes whole tables beside the old ones and then replaces the pointer file, so that a reader sees one version or
the other, and a run that ends halfway leaves the old one. The version before the current one is kept for readers under way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "files": "path string, language string, size long, mtime double, content_hash string, parse_status string, doc_summary string",
    "symbols": "file_path string, ordinal int, kind string, name string, exported boolean, is_default boolean, line int, signature_hash string",
    "imports": "file_path string, ordinal int, specifier string, names array<string>",
    "conventions": "id string, module string, pattern string, value string, statement string, matched long, sample_size long, evidence array<string>, status string, active boolean",
    "meta": "key string, value string",
}
POINTER = "CURRENT"
#: Version of the tables above; a folder of a newer one isn't touched.
VERSION = 2


class StoreError(RuntimeError):
    pass


class Store:
    """A folder of snapshots, or with path None a store that has nothing and keeps nothing."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path.rstrip("/") if path else None
        meta = self.meta()
        if int(meta.get("schema", VERSION)) > VERSION:
            raise StoreError(f"{path} was written by a newer version (schema {meta['schema']}); upgrade, or delete it: the next full scan makes it again.")

    def _hadoop(self, place: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """The name of the current version."""
        if self.path is None:
            return None
        where, fs = self._hadoop(f"{self.path}/{POINTER}")
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip() or None
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        version = self.current()
        if version is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{version}/{table}")

    def meta(self) -> dict[str, str]:
        """All keys; a handful."""
        return {r.key: r.value for r in self.read("meta").collect()}

    def commit(self, tables: dict[str, DataFrame], meta: dict[str, str]) -> None:
        """Make tables the current version; those not given are carried over, meta is added to what there is. All or nothing."""
        if self.path is None:
            return
        old = self.current()
        number = int(old.split("-")[0]) + 1 if old else 1
        version = f"{number:08d}-{uuid.uuid4().hex[:8]}"
        rows = {**self.meta(), **meta, "schema": str(VERSION)}
        every = {name: tables.get(name, self.read(name)) for name in TABLES if name != "meta"} | {"meta": self.spark.createDataFrame(list(rows.items()), TABLES["meta"])}
        for name, frame in every.items():
            names = self.spark.createDataFrame([], TABLES[name]).columns
            frame.select(*names).write.parquet(f"{self.path}/{version}/{name}")
        if self.current() != old:
            raise StoreError(f"{self.path} was changed by another run; nothing was committed.")
        self._point(version)
        self._clean({version, old})

    def _point(self, version: str) -> None:
        fresh, fs = self._hadoop(f"{self.path}/.{POINTER}-{uuid.uuid4().hex}")
        stream = fs.create(fresh)
        stream.write(bytearray(version.encode()))
        stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        place, _ = self._hadoop(f"{self.path}/{POINTER}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(fresh), fs.makeQualified(place), options)

    def _clean(self, kept: set[str | None]) -> None:
        where, fs = self._hadoop(self.path)
        for status in fs.listStatus(where):
            if status.isDirectory() and status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)
