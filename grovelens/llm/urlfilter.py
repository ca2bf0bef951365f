"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

The expressions of a URL are every pair of a suffix of its host (whole labels) and a prefix of its path. Only pairs
whose shape (number of labels, prefix length) occurs in the rule table can match, so only those are built; the set of
shapes is read from the rule table's own aggregate, which is as small as its longest host times its longest path.

Precedence: the longest rule wins (host and path together, then host, then block before allow).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelens.llm.common import ascii_lower, free_name, skew_join

#: Rules (verdict, host, path).
CONTRACT_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Bytes of a digest that the equi-join compares before the whole digest is.
PREFIX_BYTES = 4
#: A rule table is broadcast up to this many rows (about 150 bytes each); beyond it, the join shuffles both sides.
BROADCAST_RULES = 200_000


def url_host(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a frame."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("\n", host, path), 256))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict added.

    A URL that no rule fits gets rule null and the verdict `otherwise`. Null, empty and malformed URLs have an empty host
    and path, fit no rule and are kept. Repeated rows are each returned; columns of urls named like an added one are
    replaced. An empty rule table judges everything `otherwise`, an empty URL table gives an empty result. Of rules that fit
    equally long, the longer host wins, then block, then the greater rule. A URL is taken whole, however long; expressions are built only in the rules' lengths.
    """
    given = urls.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    known = rules.select(F.lower("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict").filter("r_host is not null").distinct()
    known = known.select(
        F.substring(_digest(F.col("r_host"), F.col("r_path")), 1, PREFIX_BYTES).alias("short"),
        _digest(F.col("r_host"), F.col("r_path")).alias("digest"),
        F.struct(
            (F.length("r_host") + F.length("r_path")).alias("size"),
            F.length("r_host").alias("host_size"),
            F.when(F.col("verdict") == "block", 1).otherwise(0).alias("strict"),
            F.concat("r_host", "r_path").alias("rule"),
            F.col("verdict"),
        ).alias("found"),
        F.size(F.split("r_host", r"\.")).alias("labels"),
        F.length("r_path").alias("reach"),
    )
    shapes = known.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("reach")).alias("reach"), F.count("*").alias("n")).first()
    if not shapes["n"]:
        return given.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    labels = F.array(*map(F.lit, shapes["labels"]))
    reach = F.array(*map(F.lit, shapes["reach"]))

    # one row for each different host and path: a hot URL is summed up before it moves
    keys = given.select("host", "path").distinct()
    parts = keys.withColumn("parts", F.split("host", r"\."))
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size("parts")), lambda n: F.array_join(F.slice("parts", F.size("parts") - n + 1, n), "."))
    prefixes = F.transform(F.filter(reach, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    asked = parts.select("host", "path", F.explode(expressions).alias("e")).select("host", "path", _digest(F.col("e.h"), F.col("e.p")).alias("asked"))
    asked = asked.withColumn("short", F.substring("asked", 1, PREFIX_BYTES))
    side = known.select("short", "digest", "found")
    if shapes["n"] <= BROADCAST_RULES:
        hits = asked.join(F.broadcast(side), "short").filter(F.col("asked") == F.col("digest"))
    else:
        # an expression that many URLs share meets the rules once, and goes back to its URLs without filling one task
        each = asked.select("asked", "short").distinct().join(side, "short").filter(F.col("asked") == F.col("digest"))
        hits = skew_join(asked, each.groupBy("asked").agg(F.max("found").alias("found")), "asked")
    best = hits.groupBy("host", "path").agg(F.max("found").alias("found"))
    key, found = free_name("key", given), free_name("found", given)
    best = best.select(_digest(F.col("host"), F.col("path")).alias(key), F.col("found").alias(found))
    joined = skew_join(given.withColumn(key, _digest(F.col("host"), F.col("path"))), best, key, "left")
    return joined.withColumns({"rule": F.col(f"{found}.rule"), "verdict": F.coalesce(f"{found}.verdict", F.lit(otherwise))}).drop(found, key)
