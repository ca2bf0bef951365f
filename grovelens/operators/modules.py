"""Modules from the folder tree: membership, labels, and the folders that inference should look through.

A module's id is its folder. Membership is an expression over the path; what the tree's shape adds to it (pass-through and
dominant folders) is found by aggregates over the files, round by round, of which only folders that qualify reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovelens.functions import globs
from grovelens.operators.resolve import is_test, module_of

ROOT = "."
# Share of a project's source files that makes a folder dominant, the least files to look at, rounds.
DOMINANT_SHARE = 0.5
DOMINANT_FILES = 8
ROUNDS = 12


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def module_id(path: Column, overrides: Sequence[str] = (), roots: Sequence[str] = (), containers: Sequence[str] = ()) -> Column:
    """module_of(), unless an override glob covers the file: the first that does decides."""
    inferred = module_of(path, roots, containers)
    return F.coalesce(*[globs.matched_folder(folders(path), g) for g in overrides], inferred) if overrides else inferred


def label(module: Column) -> Column:
    return F.when(module == ROOT, "(root)").otherwise(F.concat(module, F.lit("/")))


def slug(module: Column) -> Column:
    """A module's name as part of a file name."""
    return F.when(module == ROOT, "root").otherwise(F.regexp_replace(module, r"[\\/]+", "-"))


def mermaid_id(module: Column) -> Column:
    return F.concat(F.lit("m_"), F.regexp_replace(module, "[^A-Za-z0-9]", "_"))


def _project(path: Column, roots: Sequence[str]) -> Column:
    found = F.lit("")
    for root in sorted(roots, key=len):
        found = F.when(path.startswith(f"{root}/"), root).otherwise(found)
    return found


def folder_statistics(files: DataFrame, overrides: Sequence[str], roots: Sequence[str], containers: Sequence[str]) -> DataFrame:
    """module, files, source_files, own_files, subfolders (distinct) of files (path)."""
    path = F.col("path")
    placed = files.select("path", module_id(path, overrides, roots, containers).alias("module"), is_test(path).alias("test"))
    depth = F.size(F.split("module", "/"))
    parts = F.split("path", "/")
    below = F.when(F.size(parts) > depth + 1, F.get(parts, depth))
    by_folder = placed.groupBy("module", below.alias("sub"), (F.size(parts) == depth + 1).alias("own")).agg(F.count("*").alias("files"), F.count_if(~F.col("test")).alias("sources"))
    return by_folder.groupBy("module").agg(
        F.sum("files").alias("files"),
        F.sum("sources").alias("source_files"),
        F.sum(F.when(F.col("own"), F.col("files")).otherwise(0)).alias("own_files"),
        F.count_distinct("sub").alias("subfolders"),
    )


def dominant_folders(files: DataFrame, overrides: Sequence[str] = (), roots: Sequence[str] = ()) -> list[str]:
    """Folders that hold nothing but one other folder, or most of a project's source in two or more: modules begin below them.

    Small folders, tests and overrides stay as they are, and a folder that a dominant one was split into isn't split again.
    """
    files = files.select("path").distinct()
    per_project = dict(files.filter(~is_test(F.col("path"))).groupBy(_project(F.col("path"), roots).alias("p")).agg(F.count("*")).collect())
    defined = F.coalesce(*[globs.matched_folder(F.split("module", "/"), g) for g in overrides], F.lit("")) == F.col("module") if overrides else F.lit(False)
    containers: list[str] = []
    split: set[str] = set()
    for _ in range(ROUNDS):
        stats = folder_statistics(files, overrides, roots, containers).filter((F.col("module") != ROOT) & (F.col("source_files") >= DOMINANT_FILES) & (F.col("subfolders") >= 1) & ~defined)
        found = []
        for row in stats.select("*", _project(F.concat("module", F.lit("/x")), roots).alias("project")).orderBy("module").collect():
            if row.module in roots or row.module in containers:
                continue
            if row.subfolders == 1:
                if row.own_files <= max(1, row.files * 0.1):
                    found.append(row.module)
                continue
            parent = row.module.rpartition("/")[0]
            if row.source_files / (per_project.get(row.project) or row.source_files) >= DOMINANT_SHARE and row.module not in split and parent not in split:
                found.append(row.module)
                split |= {f"{row.module}/{s.sub}" for s in _subfolders(files, row.module)}
        if not found:
            break
        containers += found
    return containers


def _subfolders(files: DataFrame, folder: str) -> list:
    parts = F.split("path", "/")
    depth = folder.count("/") + 1
    return files.filter(F.col("path").startswith(f"{folder}/") & (F.size(parts) > depth + 1)).select(F.get(parts, F.lit(depth)).alias("sub")).distinct().collect()
