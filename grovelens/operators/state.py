"""Change detection, snapshot merges and the life cycle of conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that a convention's id names between its module and its value; values may hold colons themselves (fixed value).
ID = r"^(.*?):(export-style|file-naming|test-location|test-naming):(.*)\z"


def change_of(old: Column, new: Column) -> Column:
    """added, modified, deleted or unchanged, by the content hash of either side (null: not there)."""
    return F.when(old.isNull(), "added").when(new.isNull(), "deleted").when(old == new, "unchanged").otherwise("modified")


def changeset(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change) of two snapshots."""
    a = old.select(F.col(key), F.col(content).alias("__old"))
    b = new.select(F.col(key), F.col(content).alias("__new"))
    return a.join(b, key, "full_outer").select(key, change_of(F.col("__old"), F.col("__new")).alias("change"))


def apply_changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """The next snapshot in one full outer join: new rows of added and modified keys, old rows of unchanged ones, no deleted ones."""
    a = old.select(F.col(key), F.struct(*old.columns).alias("__old"))
    b = new.select(F.col(key), F.struct(*old.columns).alias("__new"))
    row = F.when(F.col("__old")[content] == F.col("__new")[content], F.col("__old")).otherwise(F.col("__new"))
    return a.join(b, key, "full_outer").filter("__new is not null").select(row.alias("r")).select("r.*")


def merge(old: DataFrame, new: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The next snapshot of a table that follows the changes (key, change) of another: rows of changed and deleted keys go, rows of `new` come.

    Several rows may have one key (symbols of a file), and `new` holds rows of changed keys only.
    """
    gone = changes.filter(F.col("change") != "unchanged").select(key)
    return old.join(gone, key, "left_anti").unionByName(new)


def touch(files: DataFrame, seen: DataFrame) -> DataFrame:
    """files with the modification times of `seen` (path, mtime) where it has one."""
    new = seen.select("path", F.col("mtime").alias("__mtime"))
    return files.join(new, "path", "left").withColumn("mtime", F.coalesce("__mtime", "mtime")).drop("__mtime").select(*files.columns)


def sync_conventions(old: DataFrame, detected: DataFrame) -> DataFrame:
    """Upsert by id: everything but the status comes from `detected`; rows no longer detected become inactive and stay as they were."""
    carried = [c for c in detected.columns if c != "id" and c in old.columns]
    d = detected.select("id", *[F.col(c).alias(f"__{c}") for c in carried], F.lit(True).alias("__there"))
    joined = old.join(d, "id", "full_outer")
    there = F.col("__there").isNotNull()
    return joined.select(
        "id",
        *[F.when(there, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in carried],
        F.coalesce("status", F.lit("pending")).alias("status"),
        there.alias("active"),
    )


def placeholder(found: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of unknown decided ids get the module, pattern and value that the id spells, and the id as their statement."""
    part = lambda n, other: F.when(F.col("id").rlike(ID), F.regexp_extract("id", ID, n)).otherwise(other)
    made = {"module": part(1, F.lit(".")), "pattern": part(2, F.lit("unknown")), "value": part(3, F.col("id")), "statement": F.col("id"), "matched": F.lit(0), "sample_size": F.lit(0)}
    return found.select(*[F.coalesce(c, made[c].cast(t)).alias(c) if c in made else F.col(c) for c, t in columns.items()])


def apply_decisions(conventions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reset every status to pending, then apply decisions (id, status); rejected wins; unknown ids become inactive rows."""
    one = decisions.groupBy("id").agg(F.max("status").alias("__status"))
    joined = conventions.drop("status").join(one, "id", "full_outer")
    decided = joined.withColumns({"status": F.coalesce("__status", F.lit("pending")), "active": F.coalesce("active", F.lit(False))})
    return placeholder(decided, dict(conventions.dtypes))


def set_status(conventions: DataFrame, convention: str, status: str) -> DataFrame:
    return conventions.withColumn("status", F.when(F.col("id") == convention, status).otherwise(F.col("status")))


def answer_status(answer: str) -> str | None:
    """confirmed, rejected, or None for anything else: it stays pending."""
    return {"y": "confirmed", "yes": "confirmed", "n": "rejected", "no": "rejected"}.get(answer.strip().lower())


def pending_ranked(conventions: DataFrame, n: int = 10) -> DataFrame:
    """The n pending, active conventions of the highest agreement, then sample, then id."""
    share = F.col("matched").cast("double") / F.greatest("sample_size", F.lit(1))
    return conventions.filter("status = 'pending' and active").orderBy(share.desc(), F.desc("sample_size"), "id").limit(n)


def pending_count(conventions: DataFrame) -> int:
    return conventions.filter("status = 'pending' and active").count()


def emittable(conventions: DataFrame) -> DataFrame:
    """Confirmed and still detected."""
    return conventions.filter("status = 'confirmed' and active").orderBy("module", "pattern", "id")


def lapsed(conventions: DataFrame) -> DataFrame:
    """Confirmed but no longer detected."""
    return conventions.filter("status = 'confirmed' and not active").orderBy("id")


def decided(conventions: DataFrame) -> DataFrame:
    """(id, status) of what a human decided."""
    return conventions.filter("status <> 'pending'").select("id", "status").orderBy("id")


def unchanged_by_metadata(size: Column, mtime: Column, old_size: Column, old_mtime: Column, last_scan: Column, window_ms: int = 2000) -> Column:
    """True if a file's metadata prove that it needn't be read: equal, and older than the last scan by more than the window."""
    return (size == old_size) & (mtime == old_mtime) & (mtime < last_scan - window_ms)


def legacy_value(pattern: Column, statement: Column) -> Column:
    """The value that a statement of the first format has only as prose; null where it has none."""
    exports = F.when(statement.contains("a mix of default and named"), "mixed").when(statement.contains("named exports"), "named").when(statement.contains("default exports"), "default")
    naming = F.nullif(F.regexp_extract(statement, r"use (\S+) naming", 1), F.lit(""))
    return F.when(pattern == "export-style", exports).when(pattern == "file-naming", naming)


def migrate_decisions(conventions: DataFrame, modules: DataFrame) -> DataFrame:
    """(id, module, pattern, value, statement, status) of decided conventions (id, module_id, statement, status) of the first format.

    modules: (id, path_glob), which says what path a module's bare name stood for. Of rows that get one id, one stays.
    """
    globs = modules.select(F.col("id").alias("module_id"), "path_glob")
    rows = conventions.filter("status <> 'pending'").join(globs, "module_id", "left")
    pattern = F.element_at(F.split("id", ":"), -1)
    folder = F.regexp_replace(F.coalesce("path_glob", F.concat("module_id", F.lit("/**"))), r"/\*\*?\z", "")
    named = rows.select(F.when(folder.isin("*", ""), ".").otherwise(folder).alias("module"), pattern.alias("pattern"), legacy_value(pattern, F.col("statement")).alias("value"), "statement", "status")
    keyed = named.filter("value is not null").withColumn("id", F.concat_ws(":", "module", "pattern", "value"))
    return keyed.groupBy("id").agg(F.min(F.struct("module", "pattern", "value", "statement", "status")).alias("r")).select("id", "r.*")
