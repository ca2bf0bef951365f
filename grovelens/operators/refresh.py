"""Bring the graph's tables in line with a source tree: read what may have changed, parse what did, replace those rows.

A file whose metadata prove it unchanged isn't read; one whose content hash is the old one isn't parsed. The tables of
everything else are taken over by anti-joins on the changed paths.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelens.functions.text import first_sentence, looks_generated
from grovelens.operators import state
from grovelens.sources import extract, worktree
from grovelens.sources.languages import is_parsed
from grovelens.sources.scratch import Scratch
from grovelens.sources.store import Store

#: Changed whenever what the extractors give changes: another one in the store means that everything is parsed again.
PARSER_VERSION = "2"
MAX_PARSE_BYTES = 512 * 1024


@dataclass
class Refresh:
    """The new tables, the changes (path, change: added, modified, deleted, unchanged), and what the run did."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    changes: DataFrame
    full: bool
    parsed: int
    warnings: list[str]
    meta: dict[str, str]

    def tables(self) -> dict[str, DataFrame]:
        return {"files": self.files, "symbols": self.symbols, "imports": self.imports}

    def counts(self) -> dict[str, int]:
        return {"added": 0, "modified": 0, "deleted": 0, "unchanged": 0} | dict(self.changes.groupBy("change").count().collect())


def read_changed(current: DataFrame, known: DataFrame, root: str, full: bool, last_scan: float) -> DataFrame:
    """current (path, language, size, mtime) that metadata don't prove unchanged, with content_hash (null: unreadable), change and content."""
    old = known.select("path", *[F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "content_hash")])
    same = F.coalesce(state.unchanged_by_metadata(F.col("size"), F.col("mtime"), F.col("old_size"), F.col("old_mtime"), F.lit(last_scan)), F.lit(False))
    asked = current.join(old, "path", "left")
    asked = (asked if full else asked.filter(~same)).select("path", "language", "size", "mtime", "old_content_hash")
    # neighbours are often alike in size: spread by path, so that a folder of large files doesn't end up in one task
    read = worktree.contents(asked.repartition("path"), root).withColumn("content_hash", F.sha1("content"))
    return read.withColumn("change", F.when(F.col("content").isNotNull(), state.change_of(F.col("old_content_hash"), F.col("content_hash"))))


def parse(read: DataFrame) -> DataFrame:
    """read (path, language, size, mtime, content_hash, change, content) with parse_status, doc_summary, symbols and imports.

    Generated files are neither parsed nor described, files over MAX_PARSE_BYTES aren't parsed, nor are other languages.
    """
    text = F.coalesce(F.expr("try_validate_utf8(cast(content as string))"), F.expr("make_valid_utf8(cast(content as string))"))
    given = read.withColumn("text", text)
    status = F.when(looks_generated(F.col("text")), "generated").when(~is_parsed(F.col("language")), "file-only").when(F.col("size") > MAX_PARSE_BYTES, "too-large").otherwise("parsed")
    rows = given.select("path", "language", "size", "mtime", "content_hash", "change", "text", status.alias("status"))
    return extract.annotate(rows).select(
        "path",
        "language",
        "size",
        "mtime",
        "content_hash",
        "change",
        F.when(F.col("failed"), "error").otherwise(F.col("status")).alias("parse_status"),
        first_sentence(F.col("doc")).alias("doc_summary"),
        "symbols",
        "imports",
    )


def refresh(spark: SparkSession, root: str, store: Store, scratch: Scratch, full: bool = False, ignore: tuple[str, ...] = (), now_ms: float | None = None) -> Refresh:
    """The tables as they should be; nothing is written. Rows of unreadable files stay as they were, with a warning.

    Everything is parsed on the first run, when asked, and after a change of PARSER_VERSION. unchanged counts files whose content is the
    old one, even if they are parsed again. The new tables are in the scratch.
    """
    now = time.time() * 1000 if now_ms is None else now_ms
    meta, known = store.meta(), store.read("files")
    empty = known.limit(1).count() == 0
    upgraded = not empty and meta.get("parser_version") != PARSER_VERSION
    full = full or empty or upgraded
    current, warnings = worktree.list_sources(spark, root, ignore)
    current = scratch.keep(current)
    if upgraded:
        warnings = ["the parser changed since the last scan; every file is parsed again once", *warnings]

    read = read_changed(current, known, root, full, float(meta.get("last_scan_ms", 0)))
    wanted = F.col("content").isNotNull() if full else F.col("content").isNotNull() & (F.col("change") != "unchanged")
    # one pass reads, hashes and parses: rows that needn't be parsed come out with their metadata only
    fresh = scratch.keep(parse(read.withColumn("content", F.when(wanted, F.col("content")))))
    unreadable = [r.path for r in fresh.filter("change is null").select("path").orderBy("path").limit(20).collect()]
    pending = fresh.filter("change is not null") if full else fresh.filter("change in ('added', 'modified')")
    touched = fresh.filter("change = 'unchanged'") if not full else fresh.limit(0)

    gone = known.join(current.select("path"), "path", "left_anti").select("path")
    replaced = pending.select("path").unionByName(gone)
    kept = known.join(replaced, "path", "left_anti")
    files = scratch.keep(state.touch(kept, touched).unionByName(pending.select(*known.columns)))
    children = {}
    for name, columns in (("symbols", ("kind", "name", "exported", "is_default", "line", "signature_hash")), ("imports", ("specifier", "names"))):
        rows = pending.select(F.col("path").alias("file_path"), F.posexplode(name).alias("ordinal", "x")).select("file_path", "ordinal", *[f"x.{c}" for c in columns])
        children[name] = scratch.keep(store.read(name).join(replaced.withColumnRenamed("path", "file_path"), "file_path", "left_anti").unionByName(rows))
    same = current.select("path").join(fresh.filter("change in ('added', 'modified')"), "path", "left_anti").select("path", F.lit("unchanged").alias("change"))
    changes = scratch.keep(same.unionByName(pending.filter("change <> 'unchanged'").select("path", "change")).unionByName(gone.withColumn("change", F.lit("deleted"))))
    failed = [r.path for r in pending.filter("parse_status = 'error'").select("path").orderBy("path").limit(20).collect()]
    warnings = [*warnings, *(f"could not read {p}" for p in unreadable), *(f"could not parse {p}" for p in failed)]
    parsed = pending.filter("parse_status = 'parsed'").count()
    return Refresh(files, children["symbols"], children["imports"], changes, full, parsed, warnings, {"parser_version": PARSER_VERSION, "last_scan_ms": repr(now)})
