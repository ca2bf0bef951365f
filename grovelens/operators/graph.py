"""Edges, counts and ranks of an import graph. Frames and column names are parameters, so any graph will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def file_edges(refs: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct (from_path, to_path) pairs without self-edges; duplicates are merged before the shuffle."""
    return refs.select(F.col(source).alias("from_path"), F.col(target).alias("to_path")).filter("from_path is not null and to_path is not null").distinct()


def module_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(from_module, to_module, weight): distinct file pairs by module pair.

    sources, targets: (path, module, is_test). Edges from or to test files and within a module are dropped.
    """
    s = sources.filter(~F.col("is_test")).select(F.col("path").alias("from_path"), F.col("module").alias("from_module"))
    t = targets.filter(~F.col("is_test")).select(F.col("path").alias("to_path"), F.col("module").alias("to_module"))
    joined = edges.join(s, "from_path").join(t, "to_path").filter("from_module <> to_module")
    return joined.groupBy("from_module", "to_module").agg(F.count("*").alias("weight"))


def imported_by(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(to_path, imported_by): distinct importers that are no tests."""
    s = sources.filter(~F.col("is_test")).select(F.col("path").alias("from_path"))
    return edges.join(s, "from_path", "left_semi").groupBy("to_path").agg(F.count("*").alias("imported_by"))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows by a total order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int, rank: str = "rank", total: str = "total") -> DataFrame:
    """The first n rows of each group with rank and the group's size.

    The limit on row_number lets Spark keep n rows of each group before it shuffles; sizes are counted apart, with partial sums.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(rank) <= n)
    return ranked.join(df.groupBy(group).agg(F.count("*").alias(total)), group)


def dominant_value(df: DataFrame, scope: str, value: str, min_sample: int = 3, min_agreement: float = 0.8) -> DataFrame:
    """(scope, value, matched, sample_size) for scopes of which one value holds a share of at least min_agreement; ties go to the smaller value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(scope, value).agg(F.count("*").alias("matched"))
    by_scope = Window.partitionBy(scope)
    ranked = counts.select(scope, value, "matched", F.sum("matched").over(by_scope).alias("sample_size"), F.row_number().over(by_scope.orderBy(F.desc("matched"), value)).alias("rank"))
    return ranked.filter((F.col("rank") == 1) & (F.col("sample_size") >= min_sample) & (F.col("matched") >= F.col("sample_size") * min_agreement)).drop("rank")


def first_existing(candidates: DataFrame, key: str, prio: str, candidate: str, existing: DataFrame, name: str) -> DataFrame:
    """For each key the candidate of the lowest prio that `existing` has; keys without one are left out."""
    found = candidates.join(existing.select(F.col(name).alias(candidate)).distinct(), candidate, "left_semi")
    return found.groupBy(key).agg(F.min(F.struct(prio, candidate)).alias("best")).select(key, F.col(f"best.{candidate}").alias(candidate), F.col(f"best.{prio}").alias(prio))


def first_root_wins(candidates: DataFrame, key: str, root: str, candidate: str, existing: DataFrame, name: str) -> DataFrame:
    """All existing candidates of each key under its lowest root that has any."""
    found = candidates.join(existing.select(F.col(name).alias(candidate)).distinct(), candidate, "left_semi")
    least = F.min(root).over(Window.partitionBy(key))
    return found.withColumn("__least", least).filter(F.col(root) == F.col("__least")).drop("__least").distinct()


def deepest(ancestors: DataFrame, key: str, directory: str, depth: str, roots: DataFrame, root: str) -> DataFrame:
    """For each key the deepest of its ancestor directories that is a root: a longest-prefix join by equality."""
    found = ancestors.join(roots.select(F.col(root).alias(directory)).distinct(), directory, "left_semi")
    return found.groupBy(key).agg(F.max(F.struct(depth, directory)).alias("best")).select(key, F.col(f"best.{directory}").alias(directory), F.col(f"best.{depth}").alias(depth))
