"""Files of a source tree: listing, ignore rules, contents, and the state at the last commit.

A tree lies on storage that driver and executors share. git, where there is one, lists on the driver (it is one process on
one index); otherwise folders below the top are walked by the executors. Contents are read where they are needed only.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelens.functions import globs
from grovelens.sources.languages import language_of

STAT_SCHEMA = "path string, size long, mtime double"
REFUSED = "dubious ownership"


def _git(root: str, *args: str, given: str | None = None) -> subprocess.CompletedProcess:
    return subprocess.run(["git", *args], cwd=root, input=given, capture_output=True, text=True, encoding="utf-8", errors="surrogateescape", check=False)


def list_by_git(root: str) -> tuple[list[str] | None, str | None]:
    """Tracked and new files as git sees them, or None with a warning if git refused the tree (None without one if there is no git)."""
    try:
        said = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    except OSError:
        return None, None
    if said.returncode == 0:
        return [p for p in said.stdout.split("\0") if p], None
    return None, refusal(root) if REFUSED in said.stderr else None


def refusal(root: str) -> str:
    return (
        "git refused to read this repository (it belongs to another user), so the file system was walked instead and only the root "
        f'.gitignore was honoured. To fix: git config --global --add safe.directory "{os.path.abspath(root)}"'
    )


def root_rules(root: str) -> list[tuple[str, bool]]:
    place = os.path.join(root, ".gitignore")
    if not os.path.isfile(place):
        return []
    with open(place, encoding="utf-8", errors="replace") as f:
        return globs.compiled(f.read().split("\n"))


def list_by_walk(spark: SparkSession, root: str, rules: list[tuple[str, bool]]) -> DataFrame:
    """(path) of files that neither rules nor the root .gitignore ignore; ignored folders aren't entered. A task walks one folder of the top."""
    own = root_rules(root)

    def open_(path: str) -> bool:
        return not globs.ignores(path, rules) and not globs.ignores(path, own)

    def walk(folder: str) -> Iterator[str]:
        for entry in os.scandir(os.path.join(root, folder)):
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_dir(follow_symlinks=False):
                if open_(f"{path}/"):
                    yield from walk(path)
            elif entry.is_file() and not globs.ignores(path, own):
                yield path

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder in frame["folder"]:
                yield pd.DataFrame({"path": list(walk(folder))}, dtype="object")

    top = list(os.scandir(root))
    files = [(e.name,) for e in top if e.is_file() and not globs.ignores(e.name, own)]
    folders = [(e.name,) for e in top if e.is_dir(follow_symlinks=False) and open_(f"{e.name}/")]
    found = spark.createDataFrame(files, "path string")
    if folders:
        below = spark.createDataFrame(folders, "folder string").repartition(len(folders)).mapInPandas(run, "path string")
        found = found.unionByName(below)
    return found


def list_files(spark: SparkSession, root: str, ignore: Iterable[str] = (), include: Column | None = None) -> tuple[DataFrame, list[str]]:
    """(path, size, mtime in milliseconds) of every file of the tree that isn't ignored, and warnings.

    include: a condition on path, tested before any file is looked at. Files that git lists but the tree lacks are left out.
    """
    rules = globs.compiled([*globs.DEFAULT_IGNORES, *ignore])
    listed, warning = list_by_git(root)
    found = list_by_walk(spark, root, rules) if listed is None else spark.createDataFrame([(p,) for p in listed], "path string")
    kept = found.filter(~globs.ignored(F.col("path"), rules))
    kept = kept if include is None else kept.filter(include)
    return stat(kept.distinct(), root), [warning] if warning else []


def list_sources(spark: SparkSession, root: str, ignore: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """list_files() of known languages, with `language`."""
    files, warnings = list_files(spark, root, ignore, language_of(F.col("path")).isNotNull())
    return files.withColumn("language", language_of(F.col("path"))), warnings


def stat(files: DataFrame, root: str) -> DataFrame:
    """STAT_SCHEMA of files (path) that are there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path in frame["path"]:
                try:
                    s = os.stat(os.path.join(root, path))
                except OSError:
                    continue
                if os.path.isfile(os.path.join(root, path)):
                    rows.append((path, s.st_size, s.st_mtime_ns / 1e6))
            yield pd.DataFrame(rows, columns=["path", "size", "mtime"])

    return files.select("path").mapInPandas(run, STAT_SCHEMA)


def contents(files: DataFrame, root: str) -> DataFrame:
    """files with `content` (binary; null where a file can't be read). Batches bound what a worker holds."""
    names = files.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):
                part = frame.iloc[at : at + 64].copy()
                part["content"] = [_read(os.path.join(root, p)) for p in part["path"]]
                yield part

    return files.select(*names).mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema)}, content binary")


def _read(place: str) -> bytes | None:
    try:
        with open(place, "rb") as f:
            return f.read()
    except OSError:
        return None


def texts(files: DataFrame, root: str) -> DataFrame:
    """(path, text) of files that can be read, UTF-8 with replacements."""
    return contents(files.select("path"), root).filter("content is not null").select("path", F.expr("try_validate_utf8(cast(content as string))").alias("t"), "content").select("path", F.coalesce("t", F.expr("make_valid_utf8(cast(content as string))")).alias("text"))


def has_head(root: str) -> bool:
    try:
        return _git(root, "rev-parse", "--verify", "--quiet", "HEAD").returncode == 0
    except OSError:
        return False


def text_at_head(root: str, path: str) -> str | None:
    """A file's text at the last commit, null if it wasn't there; the path is relative to root, which may lie below the repository's top."""
    try:
        said = subprocess.run(["git", "show", f"HEAD:./{path}"], cwd=root, capture_output=True, check=False)
    except OSError:
        return None
    return said.stdout.decode("utf-8", "replace") if said.returncode == 0 else None


def files_at_head(root: str) -> list[str]:
    try:
        said = _git(root, "ls-tree", "-r", "-z", "--name-only", "HEAD", ".")
    except OSError:
        return []
    return [p for p in said.stdout.split("\0") if p] if said.returncode == 0 else []


def head_texts(spark: SparkSession, root: str, paths: Iterable[str]) -> DataFrame:
    """(path, text) at the last commit; null texts for files that it lacks. The paths are a plan's artifacts, a handful."""
    return spark.createDataFrame([(p, text_at_head(root, p)) for p in paths], "path string, text string")


def ignored_by_git(root: str, paths: list[str]) -> set[str] | None:
    """Those of paths that git ignores; None if git can't tell."""
    try:
        said = _git(root, "check-ignore", "-z", "--no-index", "--stdin", given="\0".join(paths))
    except OSError:
        return None
    return {p for p in said.stdout.split("\0") if p} if said.returncode in (0, 1) else None
