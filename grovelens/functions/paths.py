"""Posix path expressions: normalisation, ancestors, suffixes; all without user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Fold `.`, empty and `..` segments; a leading `..` that has nothing to cancel stays in a relative path. Empty becomes `.`."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, p: Column) -> Column:
        n = F.size(acc)
        up = (p == "..") & (n > 0) & (F.coalesce(F.get(acc, n - 1), F.lit("")) != "..")
        return F.when(up, F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0)))).when((p == "..") & absolute, acc).otherwise(F.concat(acc, F.array(p)))

    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), folded)).when(folded == "", F.lit(".")).otherwise(folded)


def dirname(path: Column) -> Column:
    """The directory of a path; `.` for a bare name."""
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ancestors(path: Column) -> Column:
    """(dir, depth) of every directory above a path, `.` with depth 0 first."""
    parts = F.split(path, "/")
    each = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("dir"), n.alias("depth")))
    return each


def suffixes(path: Column) -> Column:
    """Every suffix of a path that begins at a segment, the whole path included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def collated(value: Column) -> Column:
    """A sort key in the order of the root Unicode collation."""
    return F.collate(value, "UNICODE")
