"""The nearest name by edit distance, without comparing every name with every other.

A name within distance d of an option keeps at least one of d + 1 parts of the option unchanged, shifted by d places at most.
Options are keyed by their parts, names by every place where such a part may be, and the two meet in an equi-join; what
meets is measured. Prefixes, which count as a little over one edit, meet by equality of the shorter name with a prefix of the longer.
Where a scope has few options, a name is measured with each of them. No join is a broadcast: sizes are estimated before keys are made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovelens.functions.text import closeness

#: Options of a scope that a name is measured with one by one; their parts and places are more rows than that.
FEW_OPTIONS = 32


def _span(length: Column, part: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of one of `parts` almost equal parts; the last ones are longer by one where it doesn't come out even."""
    short, longer = F.floor(length / parts), length % parts
    before = F.greatest(F.lit(0), part - (parts - longer))
    return (part * short + before + 1).cast("int"), (short + (part >= parts - longer).cast("int")).cast("int")


def part_keys(name: Column, d: int) -> Column:
    """(length, part, text) of the d + 1 parts of an option."""
    length = F.length(name)

    def key(k: Column) -> Column:
        start, size = _span(length, k, d + 1)
        return F.struct(length.alias("length"), k.alias("part"), F.substr(name, start, size).alias("piece"))

    return F.transform(F.sequence(F.lit(0), F.lit(d)), key)


def place_keys(name: Column, d: int) -> Column:
    """The keys that an option within distance d of name must have one of."""
    length = F.length(name)
    shapes = F.flatten(F.transform(F.sequence(F.greatest(length - d, F.lit(0)), length + d), lambda n: F.transform(F.sequence(F.lit(0), F.lit(d)), lambda k: F.struct(n.alias("n"), k.alias("k")))))

    def keys(shape: Column) -> Column:
        start, size = _span(shape["n"], shape["k"], d + 1)
        # the k parts to the left can have taken k edits and the parts to the right what is left of d: a part that is
        # shifted further from either end than that isn't the only one that the two have in common
        k, shift = shape["k"], length - shape["n"]
        first = F.greatest(F.lit(1), start - k, start + shift - (d - k))
        last = F.least(length - size + 1, start + k, start + shift + (d - k))
        places = F.when(first <= last, F.sequence(first.cast("int"), F.greatest(first, last).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda at: F.struct(shape["n"].alias("length"), shape["k"].alias("part"), F.substr(name, at, size).alias("piece")))

    return F.array_distinct(F.flatten(F.transform(shapes, keys)))


def prefixes(name: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: F.substr(name, F.lit(1), n))


def nearest(asked: DataFrame, options: DataFrame, scope: Sequence[str], key: Sequence[str], name: str, option: str, max_distance: int) -> DataFrame:
    """key, option, distance: the closest option of each asked row's scope within max_distance, ties to the smaller option; rows without one are left out."""
    found = with_nearest(asked.select(*dict.fromkeys([*key, *scope, name])), options, scope, name, option, max_distance)
    return found.filter(F.col("distance").isNotNull()).select(*key, option, "distance")


def with_nearest(asked: DataFrame, options: DataFrame, scope: Sequence[str], name: str, option: str, max_distance: int) -> DataFrame:
    """asked with option and distance: the closest option of its scope within max_distance, ties to the smaller option; null without one.

    Scopes of few options, counted before, are lists that a row's name is measured with; in others rows that share scope and name are measured once.
    """
    o = options.select(*scope, F.col(option).alias("__option")).filter("__option is not null").distinct()
    if not scope:
        return _by_parts(asked, o, scope, name, option, max_distance)
    counts = o.groupBy(*scope).agg(F.count("*").alias("__n"))
    least, most = counts.agg(F.min("__n"), F.max("__n")).first()
    if least is None or most <= FEW_OPTIONS:
        return _by_lists(asked, o, scope, name, option, max_distance)
    if least > FEW_OPTIONS:
        return _by_parts(asked, o, scope, name, option, max_distance)
    many = counts.filter(F.col("__n") > FEW_OPTIONS).select(*scope)
    kept = [join(frame, many) for frame in (asked, o) for join in (lambda f, m: f.join(m.hint("merge"), [*scope], "left_semi"), lambda f, m: f.join(m.hint("merge"), [*scope], "left_anti"))]
    return _by_parts(kept[0], kept[2], scope, name, option, max_distance).unionByName(_by_lists(kept[1], kept[3], scope, name, option, max_distance))


def _by_lists(asked: DataFrame, o: DataFrame, scope: Sequence[str], name: str, option: str, max_distance: int) -> DataFrame:
    lists = o.groupBy(*scope).agg(F.collect_list("__option").alias("__options"))
    each = F.transform("__options", lambda x: F.struct(closeness(F.col(name), x).alias("distance"), x.alias("option")))
    best = F.array_min(F.filter(each, lambda x: x["distance"] <= max_distance))
    # without a plan of their own, the two fields would measure twice
    found = asked.join(lists.hint("merge"), [*scope], "left").select(*asked.columns, F.explode_outer(F.array(best)).alias("__best"))
    return found.select(*asked.columns, F.col("__best.option").alias(option), F.col("__best.distance").alias("distance"))


def _by_parts(asked: DataFrame, o: DataFrame, scope: Sequence[str], name: str, option: str, max_distance: int) -> DataFrame:
    a = asked.select(*scope, F.col(name).alias("__name")).filter("__name is not null").distinct()
    names, opts = F.col("__name"), F.col("__option")
    by_part = a.select(*scope, "__name", F.explode(place_keys(names, max_distance)).alias("__key")).join(o.select(*scope, "__option", F.explode(part_keys(opts, max_distance)).alias("__key")).hint("merge"), [*scope, "__key"])
    met = by_part.select(*scope, "__name", "__option")
    if max_distance >= 1:
        shorter = a.select(*scope, "__name", F.explode(prefixes(names)).alias("__option")).join(o.hint("merge"), [*scope, "__option"])
        longer = o.select(*scope, "__option", F.explode(prefixes(opts)).alias("__name")).join(a.hint("merge"), [*scope, "__name"])
        met = met.unionByName(shorter.select(*met.columns)).unionByName(longer.select(*met.columns))
    near = met.distinct().withColumn("__distance", closeness(names, opts)).filter(F.col("__distance") <= max_distance)
    best = near.groupBy(*scope, "__name").agg(F.min(F.struct("__distance", "__option")).alias("__best"))
    joined = asked.withColumn("__name", F.col(name)).join(best.hint("merge"), [*scope, "__name"], "left")
    return joined.select(*asked.columns, F.col("__best.__option").alias(option), F.col("__best.__distance").alias("distance"))
