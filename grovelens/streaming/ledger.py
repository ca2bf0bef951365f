"""A change feed of a tree as a stream: batches of changed rows are merged into the ledger of files as they come.

Rows are (path, language, size, mtime, content_hash, parse_status, doc_summary, seen); a null content_hash says that the file is gone.
A batch may hold several rows of a path: the last seen counts. Merging a batch twice gives the same ledger, so a batch that is
run again after a fault does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from grovelens.sources.store import TABLES, Store

CHANGE_SCHEMA = f"{TABLES['files']}, seen timestamp"


def latest(batch: DataFrame) -> DataFrame:
    """The last row of each path, ties to the greater content hash."""
    row = F.struct("seen", "content_hash", *[c for c in batch.columns if c not in ("seen", "content_hash", "path")])
    return batch.groupBy("path").agg(F.max(row).alias("r")).select("path", "r.*")


def merge_batch(store: Store, batch: DataFrame) -> None:
    """Commit the ledger with a batch's changes; symbols and imports of changed files go until they are parsed again."""
    last = latest(batch).persist()
    files = store.read("files")
    kept = files.join(last.select("path"), "path", "left_anti")
    alive = last.filter("content_hash is not null").select(*files.columns)
    children = {name: store.read(name).join(last.select(F.col("path").alias("file_path")), "file_path", "left_anti") for name in ("symbols", "imports")}
    store.commit({"files": kept.unionByName(alive), **children}, {})
    last.unpersist()


def follow(changes: DataFrame, store: Store, checkpoint: str) -> DataStreamWriter:
    """A writer that merges each micro-batch of the stream `changes` (CHANGE_SCHEMA); start() it with a trigger of your choice."""
    return changes.writeStream.foreachBatch(lambda batch, _: merge_batch(store, batch)).option("checkpointLocation", checkpoint)
