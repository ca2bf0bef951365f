"""Queries over the standard tables, each with the SQL that gives the same rows.

Stand-ins: importer file = customer (module = nation, test = segment MACHINERY), imported file = supplier (module = nation,
test = negative balance), import = lineitem joined to orders, symbol = part (module = brand, kind = first word of type).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovelens.functions import globs, paths, text
from grovelens.operators import conventions, drift, graph, modules, regions, resolve, state
from grovelens.operators.nearest import nearest
from grovelens.sources import extract, facts, languages

#: Distinct tokens that are broadcast at most, counted before.
BROADCAST_TOKENS = 500_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("module"), (F.col("c_mktsegment") == "MACHINERY").alias("is_test"))


def imported(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("module"), (F.col("s_acctbal") < 0).alias("is_test"))


def references(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("importer"), F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("symbol"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.file_edges(references(spark, d), "importer", "target")


EDGES = "e AS (SELECT DISTINCT o_custkey AS f, l_suppkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
MODULES = f"{EDGES}, m AS (SELECT c_nationkey AS from_module, s_nationkey AS to_module, count(*) AS weight FROM e JOIN customer ON f = c_custkey JOIN supplier ON t = s_suppkey WHERE c_mktsegment <> 'MACHINERY' AND s_acctbal >= 0 AND c_nationkey <> s_nationkey GROUP BY ALL)"
BY = f"{EDGES}, b AS (SELECT t, count(*) AS imported_by FROM e JOIN customer ON f = c_custkey WHERE c_mktsegment <> 'MACHINERY' GROUP BY t)"


@query(f"WITH {MODULES} SELECT * FROM m")
def module_edges(spark, d):
    """Test files at either end go before references are made distinct."""
    live = references(spark, d).join(importers(spark, d).filter("not is_test").select(F.col("path").alias("importer")), "importer", "left_semi")
    live = live.join(imported(spark, d).filter("not is_test").select(F.col("path").alias("target")), "target", "left_semi")
    return graph.module_edges(graph.file_edges(live, "importer", "target"), importers(spark, d), imported(spark, d))


@query(f"WITH {EDGES} SELECT count(*) AS n_edges, count(DISTINCT f) AS n_importers, count(DISTINCT t) AS n_targets FROM e")
def file_edges_distinct(spark, d):
    return edges(spark, d).agg(F.count("*").alias("n_edges"), F.countDistinct("from_path").alias("n_importers"), F.countDistinct("to_path").alias("n_targets"))


@query(f"WITH {MODULES} SELECT to_module AS module, from_module AS used_by, weight, row_number() OVER (PARTITION BY to_module ORDER BY weight DESC, from_module) AS rank FROM m")
def used_by(spark, d):
    w = Window.partitionBy("to_module").orderBy(F.desc("weight"), "from_module")
    return module_edges(spark, d).select(F.col("to_module").alias("module"), F.col("from_module").alias("used_by"), "weight", F.row_number().over(w).cast("long").alias("rank"))


@query(f"WITH {BY} SELECT t AS path, imported_by FROM b WHERE imported_by >= 2 ORDER BY imported_by DESC, t LIMIT 10")
def key_files(spark, d):
    by = graph.imported_by(edges(spark, d), importers(spark, d)).filter("imported_by >= 2")
    return graph.top(by.select(F.col("to_path").alias("path"), "imported_by"), [F.desc("imported_by"), F.col("path")], 10)


REFS = "r AS (SELECT l_partkey, count(DISTINCT o_custkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1), s AS (SELECT p_partkey, p_brand, p_name, split_part(p_type, ' ', 1) AS kind, coalesce(n, 0) AS ref_count FROM part LEFT JOIN r ON p_partkey = l_partkey)"


def symbols(spark, d) -> DataFrame:
    live = importers(spark, d).filter("not is_test").select(F.col("path").alias("importer"))
    counts = graph.file_edges(references(spark, d).join(live, "importer", "left_semi"), "importer", "symbol").groupBy(F.col("to_path").alias("p_partkey")).agg(F.count("*").alias("n"))
    parts = read(spark, d, "part").select("p_partkey", "p_brand", "p_name", F.substring_index("p_type", " ", 1).alias("kind"))
    return parts.join(counts, "p_partkey", "left").select("p_partkey", "p_brand", "p_name", "kind", F.coalesce("n", F.lit(0)).alias("ref_count"))


@query(f"WITH {REFS} SELECT p_partkey, ref_count FROM s")
def symbol_refcounts(spark, d):
    return symbols(spark, d).select("p_partkey", "ref_count")


@query(f"WITH {REFS} SELECT p_brand, p_partkey, ref_count, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY ref_count DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS total FROM s) WHERE rank <= 40")
def module_public_symbols(spark, d):
    ranked = graph.top_per_group(symbols(spark, d), "p_brand", [F.desc("ref_count"), F.col("p_partkey")], 40)
    return ranked.select("p_brand", "p_partkey", "ref_count", F.col("rank").cast("long").alias("rank"), "total")


@query(f"WITH {REFS} SELECT p_partkey, kind, ref_count FROM s WHERE kind IN ('ECONOMY', 'LARGE', 'PROMO', 'SMALL') ORDER BY ref_count DESC, p_brand, p_partkey LIMIT 20")
def key_abstractions(spark, d):
    some = symbols(spark, d).filter(F.col("kind").isin("ECONOMY", "LARGE", "PROMO", "SMALL"))
    return graph.top(some, [F.desc("ref_count"), F.col("p_brand"), F.col("p_partkey")], 20).select("p_partkey", "kind", "ref_count")


@query("SELECT c_nationkey AS module, count(*) AS files, count(*) FILTER (c_mktsegment = 'MACHINERY') AS test_files, bool_and(c_mktsegment = 'MACHINERY') AS is_test FROM customer GROUP BY 1")
def module_summary(spark, d):
    return importers(spark, d).groupBy("module").agg(F.count("*").alias("files"), F.count_if("is_test").alias("test_files"), F.bool_and("is_test").alias("is_test"))


@query("SELECT lang, count(*) AS files, row_number() OVER (ORDER BY count(*) DESC, lang) AS rank FROM documents GROUP BY lang")
def language_counts(spark, d):
    counts = read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("files"))
    # one row for each language: the single-partition window sees no more than that
    return counts.select("lang", "files", F.row_number().over(Window.orderBy(F.desc("files"), "lang")).cast("long").alias("rank"))


DOMINANT = "g AS (SELECT p_brand, p_type, count(*) AS matched FROM part GROUP BY ALL), k AS (SELECT *, sum(matched) OVER (PARTITION BY p_brand) AS sample_size, row_number() OVER (PARTITION BY p_brand ORDER BY matched DESC, p_type) AS rank FROM g), dv AS (SELECT p_brand, p_type, matched, sample_size::BIGINT AS sample_size FROM k WHERE rank = 1 AND sample_size >= 3 AND matched >= sample_size * 0.18)"


@query(f"WITH {DOMINANT} SELECT * FROM dv")
def dominant_value(spark, d):
    return graph.dominant_value(read(spark, d, "part").select("p_brand", "p_type"), "p_brand", "p_type", 3, 0.18)


def _old_conventions(spark, d) -> DataFrame:
    brands = read(spark, d, "part").select("p_brand").distinct()
    n = F.length("p_brand") + F.ascii(F.right("p_brand", F.lit(1)))
    return brands.filter(n % 3 != 0).select(F.col("p_brand").alias("id"), F.lit(1).cast("long").alias("matched"), F.lit(2).cast("long").alias("sample_size"), F.when(n % 3 == 1, "confirmed").otherwise("pending").alias("status"), F.lit(True).alias("active"))


OLD = "o AS (SELECT p_brand AS id, 1 AS matched, 2 AS sample_size, CASE WHEN (length(p_brand) + ascii(right(p_brand, 1))) % 3 = 1 THEN 'confirmed' ELSE 'pending' END AS status FROM (SELECT DISTINCT p_brand FROM part) WHERE (length(p_brand) + ascii(right(p_brand, 1))) % 3 <> 0)"
SYNC = f"{DOMINANT}, {OLD}, sy AS (SELECT coalesce(o.id, dv.p_brand) AS id, coalesce(dv.matched, o.matched)::BIGINT AS matched, coalesce(dv.sample_size, o.sample_size)::BIGINT AS sample_size, coalesce(o.status, 'pending') AS status, dv.p_brand IS NOT NULL AS active FROM o FULL JOIN dv ON o.id = dv.p_brand)"


@query(f"WITH {SYNC} SELECT * FROM sy")
def convention_sync(spark, d):
    return state.sync_conventions(_old_conventions(spark, d), dominant_value(spark, d).withColumnRenamed("p_brand", "id"))


@query(f"WITH {SYNC} SELECT * FROM sy WHERE status = 'pending' AND active ORDER BY matched::DOUBLE / greatest(sample_size, 1) DESC, sample_size DESC, id LIMIT 10")
def pending_ranked(spark, d):
    return state.pending_ranked(convention_sync(spark, d))


@query(f"""WITH {SYNC}, de AS (SELECT DISTINCT p_brand AS id, CASE WHEN p_brand LIKE '%1' THEN 'confirmed' ELSE 'rejected' END AS status FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%2')
SELECT coalesce(sy.id, de.id) AS id, coalesce(matched, 0) AS matched, coalesce(sample_size, 0) AS sample_size, coalesce(de.status, 'pending') AS status, coalesce(active, false) AS active FROM sy FULL JOIN de USING (id)""")
def convention_decisions(spark, d):
    brand = F.col("p_brand")
    decided = read(spark, d, "part").filter(brand.endswith("1") | brand.endswith("2")).select(brand.alias("id"), F.when(brand.endswith("1"), "confirmed").otherwise("rejected").alias("status")).distinct()
    return state.apply_decisions(convention_sync(spark, d), decided)


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = docs.filter("doc_id % 10 <> 1").select("doc_id", F.sha1("text").alias("hash"))
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\nedited"))).otherwise(F.col("text"))
    return old, docs.filter("doc_id % 10 <> 0").select("doc_id", F.sha1(edited).alias("hash"))


SNAPS = "o AS (SELECT doc_id, sha1(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 10 <> 1), n AS (SELECT doc_id, sha1(CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || chr(10) || 'edited' ELSE coalesce(text, '') END) AS hash FROM documents WHERE doc_id % 10 <> 0)"


@query(f"WITH {SNAPS} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def changeset(spark, d):
    return state.changeset(*_snapshots(spark, d), "doc_id", "hash")


@query(f"WITH {SNAPS} SELECT * FROM n")
def ledger_merge(spark, d):
    old, new = _snapshots(spark, d)
    return state.apply_changes(old, new, "doc_id", "hash")


@query("SELECT doc_id, strlen(text) AS size FROM documents WHERE strlen(text) >= 10240 AND strlen(text) / (strlen(text) - strlen(replace(text, chr(10), '')) + 1) > 300")
def generated_filter(spark, d):
    return read(spark, d, "documents").filter(text.minified(F.col("text"))).select("doc_id", F.octet_length("text").cast("long").alias("size"))


#: Blanks as functions.text has them, in RE2's form.
B = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@query(rf"""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\{{@link{B}+([^}}|\s\x{{00A0}}\x{{2028}}\x{{2029}}\x{{FEFF}}]+)[^}}]*\}}', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '{B}+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, t, coalesce(nullif(regexp_extract(t, '^(.+?[.!?])(?: |$)', 1), ''), t) AS s FROM p)
SELECT doc_id, CASE WHEN t <> '' AND NOT regexp_matches(t, '(?i)\bcopyright\b|\blicen[cs]e\b|eslint-|@ts-|prettier-ignore') THEN CASE WHEN length(s) > 160 THEN rtrim(substr(s, 1, 159)) || '…' ELSE s END END AS summary FROM s""")
def doc_summary(spark, d):
    return read(spark, d, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("summary"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS hash FROM documents")
def content_hash12(spark, d):
    return read(spark, d, "documents").select("doc_id", text.content_hash12(F.col("text")).alias("hash"))


@query("SELECT sha1(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, d):
    hashes = read(spark, d, "documents").filter("text is not null").select("doc_id", F.sha1("text").alias("hash"))
    return hashes.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


HREF = "a AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages), u AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)"


def links(spark, d) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def url_paths(spark, d) -> DataFrame:
    return read(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))


@query(f"WITH {HREF} SELECT href, count(*) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.path = a.href) GROUP BY href")
def link_targets(spark, d):
    counted = links(spark, d).groupBy("href").agg(F.count("*").alias("n"))
    return counted.join(url_paths(spark, d).distinct(), F.col("href") == F.col("path"), "left_anti")


PATHS = "p AS (SELECT page_id, ltrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS path FROM pages)"


def page_paths(spark, d) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.ltrim(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("/")).alias("path"))


@query(f"WITH {PATHS}, x AS (SELECT page_id, string_split(path, '/') AS w FROM p), y AS (SELECT page_id, w, unnest(range(0, len(w))) AS depth FROM x) SELECT CASE WHEN depth = 0 THEN '.' ELSE array_to_string(w[1:depth], '/') END AS dir, depth::INTEGER AS depth, count(*) AS files FROM y GROUP BY 1, 2")
def path_ancestors(spark, d):
    each = page_paths(spark, d).select(F.explode(paths.ancestors(F.col("path"))).alias("a"))
    return each.groupBy(F.col("a.dir").alias("dir"), F.col("a.depth").alias("depth")).agg(F.count("*").alias("files"))


@query(f"WITH {PATHS} SELECT page_id, CASE WHEN path LIKE 'en/%' THEN 'en' WHEN path LIKE 'de/%' THEN 'de' ELSE '.' END AS dir, CASE WHEN path LIKE 'en/%' OR path LIKE 'de/%' THEN 1 ELSE 0 END AS depth FROM p")
def deepest_root(spark, d):
    roots = spark.createDataFrame([(".",), ("en",), ("de",)], "root string")
    each = page_paths(spark, d).select("page_id", F.explode(paths.ancestors(F.col("path"))).alias("a")).select("page_id", "a.dir", "a.depth")
    return graph.deepest(each, "page_id", "dir", "depth", roots, "root")


@query(f"WITH {PATHS}, q AS (SELECT DISTINCT regexp_extract(url, '([^/?#]+)([?#].*)?$', 1) AS name FROM pages) SELECT name, count(DISTINCT path) AS n FROM q JOIN p ON path = name OR path LIKE '%/' || name GROUP BY name")
def suffix_match(spark, d):
    """How many paths end in each page's last segment. The index is counted by its suffixes before the join, with partial sums, so a common name is one row."""
    asked = read(spark, d, "pages").select(F.regexp_extract("url", r"([^/?#]+)([?#].*)?$", 1).alias("name")).distinct()
    ends = page_paths(spark, d).select("path").distinct().select(F.explode(paths.suffixes(F.col("path"))).alias("name"))
    return ends.groupBy("name").agg(F.count("*").alias("n")).join(asked, "name", "left_semi")


@query("""WITH m AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN substr(p_name, 2) ELSE p_name || 'x' END AS name FROM part),
c AS (SELECT m.p_partkey, p_name AS best, least(levenshtein(name, p_name)::DOUBLE, CASE WHEN starts_with(name, p_name) OR starts_with(p_name, name) THEN 1 + abs(length(name) - length(p_name)) / 100.0 END) AS distance FROM m JOIN part USING (p_brand))
SELECT p_partkey, best, distance FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY distance, best) AS rank FROM c WHERE distance <= 3) WHERE rank = 1""")
def nearest_name(spark, d):
    """Every part's altered name against the names of its brand, by shared parts of names instead of pairs."""
    part = read(spark, d, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.expr("substring(p_name, 2)")).otherwise(F.concat("p_name", F.lit("x")))
    asked = part.select("p_brand", "p_partkey", name.alias("name"))
    return nearest(asked, part.select("p_brand", F.col("p_name").alias("best")), ["p_brand"], ["p_partkey"], "name", "best", 3)


@query("WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+')) AS token FROM benchmark), u AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+')) AS token FROM documents) SELECT token FROM t ANTI JOIN u USING (token)")
def unused_tokens(spark, d):
    """Only tokens that the benchmark has are looked for among the documents' and shuffled."""
    tokens = lambda name: read(spark, d, name).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_$]+"), F.lit(0))).alias("token"))
    asked = tokens("benchmark").distinct()
    small = asked.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    used = tokens("documents").join(F.broadcast(asked) if small else asked, "token", "left_semi").distinct()
    return asked.join(used, "token", "left_anti")


@query("SELECT event_type, count(*) AS n, coalesce(nullif(list_position(['purchase', 'click', 'view'], event_type), 0), 4)::INTEGER AS place FROM events GROUP BY event_type ORDER BY place, event_type LIMIT 15")
def top_commands(spark, d):
    place = F.array_position(F.array(*map(F.lit, ("purchase", "click", "view"))), F.col("event_type"))
    counts = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return graph.top(counts.withColumn("place", F.coalesce(F.nullif(place, F.lit(0).cast("long")), F.lit(4)).cast("int")), [F.col("place"), F.col("event_type")], 15)


STYLE = "CASE WHEN regexp_matches(x, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab-case' WHEN regexp_matches(x, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake_case' WHEN regexp_matches(x, '^[A-Z][a-z0-9]+([A-Z][a-z0-9]*)+$') THEN 'PascalCase' WHEN regexp_matches(x, '^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$') THEN 'camelCase' END"


@query(f"SELECT style, count(*) AS n FROM (SELECT {STYLE} AS style FROM (SELECT replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '_' ELSE '' END) AS x FROM part UNION ALL SELECT replace(c_name, '#', '') FROM customer)) GROUP BY style")
def file_name_style(spark, d):
    sep = F.when(F.col("p_partkey") % 3 == 0, "-").when(F.col("p_partkey") % 3 == 1, "_").otherwise("")
    names = read(spark, d, "part").select(F.replace("p_name", F.lit(" "), sep).alias("x")).union(read(spark, d, "customer").select(F.replace("c_name", F.lit("#"), F.lit(""))))
    return names.select(text.file_name_style(F.col("x")).alias("style")).groupBy("style").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS ref, unnest([{'prio': 1, 'cand': l_suppkey + 95}, {'prio': 2, 'cand': l_suppkey * 2}, {'prio': 3, 'cand': l_suppkey}]) AS s FROM lineitem) SELECT ref, s.cand AS candidate, s.prio::INTEGER AS prio FROM c WHERE s.cand IN (SELECT s_suppkey FROM supplier) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY s.prio, s.cand) = 1")
def prioritized_lookup(spark, d):
    key = F.col("l_suppkey")
    options = F.array(*[F.struct(F.lit(p).alias("prio"), c.alias("candidate")) for p, c in ((1, key + 95), (2, key * 2), (3, key))])
    each = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), F.explode(options).alias("o")).select("ref", "o.prio", "o.candidate")
    return graph.first_existing(each, "ref", "prio", "candidate", read(spark, d, "supplier"), "s_suppkey")


@query("WITH c AS (SELECT o_orderkey AS ref, unnest([{'root': 0, 'cand': o_custkey * 3}, {'root': 0, 'cand': o_custkey * 5}, {'root': 1, 'cand': o_custkey}, {'root': 1, 'cand': o_custkey + 1}]) AS s FROM orders), f AS (SELECT DISTINCT ref, s.root::INTEGER AS root, s.cand AS candidate FROM c WHERE s.cand IN (SELECT c_custkey FROM customer)) SELECT * FROM f QUALIFY root = min(root) OVER (PARTITION BY ref)")
def first_root_wins(spark, d):
    key = F.col("o_custkey")
    options = F.array(*[F.struct(F.lit(r).alias("root"), c.alias("candidate")) for r, c in ((0, key * 3), (0, key * 5), (1, key), (1, key + 1))])
    each = read(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), F.explode(options).alias("o")).select("ref", "o.root", "o.candidate")
    return graph.first_root_wins(each, "ref", "root", "candidate", read(spark, d, "customer"), "c_custkey")


@query(f"WITH {PATHS} SELECT page_id, rtrim(regexp_replace(path, '/+', '/', 'g'), '/') AS normalized, true AS same FROM p WHERE path <> ''")
def posix_normalize(spark, d):
    """Page paths with detours added; as long as normalisation works, `same` is true in every row."""
    p = page_paths(spark, d).filter("path <> ''")
    detour = F.concat(F.lit("./x/../"), F.replace("path", F.lit("/"), F.lit("//y/../")))
    return p.select("page_id", paths.normalize(detour).alias("normalized"), (paths.normalize(detour) == paths.normalize(F.col("path"))).alias("same"))


@query("SELECT word, row_number() OVER (ORDER BY strip_accents(lower(word)), lower(word), word DESC) AS rank FROM (SELECT DISTINCT regexp_extract(text, '[A-Za-z]+') AS word FROM documents WHERE regexp_matches(text, '[A-Za-z]'))")
def collated_rank(spark, d):
    """The documents' first words of Latin letters in the order of the Unicode collation: small letters before capitals where nothing else differs."""
    words = read(spark, d, "documents").select(F.regexp_extract("text", "[A-Za-z]+", 0).alias("word")).filter("word <> ''").distinct()
    place = words.select("word", F.row_number().over(Window.orderBy(paths.collated(F.col("word")))).cast("long").alias("rank"))
    return place


# Sources, imports and documents made from keys: the SQL states what must come out of them.
def source_files(spark, d) -> DataFrame:
    """(path, language, text, k): a file for each part, in the folder of its brand; even ones are TypeScript, odd ones Python."""
    k = F.col("p_partkey")
    folder = F.concat(F.lit("src/b"), F.regexp_extract("p_brand", r"(\d+)", 1))
    even = k % 2 == 0
    path = F.concat(folder, F.lit("/f"), k.cast("string"), F.when(even, ".ts").otherwise(".py"))
    near = F.concat(F.lit("import { v"), F.abs(k - 2).cast("string"), F.lit(" } from './f"), F.abs(k - 2).cast("string"), F.lit("';\n"))
    script = F.concat(F.lit("/** Part "), k.cast("string"), F.lit(". More. */\n"), near, F.lit("export const v"), k.cast("string"), F.lit(" = 1;\nclass Inner {}\n"))
    module = F.concat(F.lit('"""Part '), k.cast("string"), F.lit('. More."""\nfrom . import f'), F.abs(k - 2).cast("string"), F.lit("\n\n\ndef v"), k.cast("string"), F.lit("():\n    return 1\n\n\nclass _Inner:\n    pass\n"))
    return read(spark, d, "part").select(path.alias("path"), F.when(even, "typescript").otherwise("python").alias("language"), F.when(even, script).otherwise(module).alias("text"), k.alias("k"))


SOURCES = "f AS (SELECT p_partkey AS k, 'src/b' || regexp_extract(p_brand, '([0-9]+)', 1) AS folder, CASE WHEN p_partkey % 2 = 0 THEN '.ts' ELSE '.py' END AS ext FROM part), g AS (SELECT k, folder, folder || '/f' || k || ext AS path FROM f)"


@query(f"WITH {SOURCES} SELECT path, 'v' || k AS name, CASE WHEN k % 2 = 0 THEN 'variable' ELSE 'function' END AS kind, true AS exported FROM g UNION ALL SELECT path, CASE WHEN k % 2 = 0 THEN 'Inner' ELSE '_Inner' END, 'class', false FROM g")
def extracted_symbols(spark, d):
    rows = extract.extract(source_files(spark, d)).select("path", F.explode("symbols").alias("s"))
    return rows.select("path", "s.name", "s.kind", "s.exported")


@query(f"WITH {SOURCES} SELECT path, 'Part ' || k || '.' AS summary FROM g")
def file_summaries(spark, d):
    return extract.extract(source_files(spark, d)).select("path", text.first_sentence(F.col("doc")).alias("summary"))


@query(f"WITH {SOURCES} SELECT a.path AS from_path, b.path AS to_path FROM g a JOIN g b ON b.k = a.k - 2 AND a.folder = b.folder")
def resolved_imports(spark, d):
    """Imports of the part before, which are files of the same folder for some and external for others."""
    files = source_files(spark, d)
    rows = extract.extract(files).select(F.col("path").alias("file_path"), F.posexplode("imports").alias("ordinal", "i")).select("file_path", "ordinal", "i.specifier", "i.names")
    return resolve.resolve(rows, files.select("path", "language")).select("from_path", "to_path")


@query("SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN NULL WHEN 3 THEN 'cpp' ELSE NULL END AS language FROM part")
def path_languages(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "a.b/x.TSX").when(k % 5 == 1, "x.py").when(k % 5 == 2, "x.d.ts").when(k % 5 == 3, "x.hpp").otherwise("dir.ts/.py")
    return read(spark, d, "part").select(k.alias("k"), languages.language_of(name).alias("language"))


GLOBS = ("en/", "*.html", "!de/1*.html")


@query(f"WITH {PATHS} SELECT page_id, path LIKE 'en/%' OR path LIKE '%/en/%' OR (path LIKE '%.html' AND NOT regexp_matches(path, '^de/1[^/]*\\.html$')) AS ignored FROM p WHERE path <> '' AND path NOT LIKE '%/'")
def ignored_paths(spark, d):
    """Ignore rules with a folder, a suffix and an exception."""
    p = page_paths(spark, d).filter("path <> '' and path not like '%/'")
    return p.select("page_id", globs.ignored(F.col("path"), globs.compiled(GLOBS)).alias("ignored"))


@query(f"WITH {SOURCES} SELECT path, CASE WHEN k % 3 = 0 THEN 'lib/' || (k % 7) WHEN k % 3 = 1 THEN folder ELSE '.' END AS module FROM g")
def module_ids(spark, d):
    """A third of the files in a folder that an override covers, a third inferred through `src`, a third at the top."""
    f = source_files(spark, d)
    place = F.when(F.col("k") % 3 == 0, F.concat(F.lit("lib/"), (F.col("k") % 7).cast("string"), F.lit("/deep/er/"), paths.basename(F.col("path")))).when(F.col("k") % 3 == 1, F.col("path")).otherwise(paths.basename(F.col("path")))
    return f.select("path", modules.module_id(place, ["lib/*"]).alias("module"))


NAMED = f"{SOURCES}, n AS (SELECT folder AS module, CASE WHEN k % 10 = 0 THEN 'snake_case' ELSE 'kebab-case' END AS value, count(*) AS matched FROM g GROUP BY ALL), r AS (SELECT *, sum(matched) OVER (PARTITION BY module) AS sample_size, row_number() OVER (PARTITION BY module ORDER BY matched DESC, value) AS rank FROM n)"


@query(f"WITH {NAMED} SELECT module || ':file-naming:' || value AS id, 'Multi-word file names in `' || module || '/` are ' || value || '.' AS statement, matched, sample_size::BIGINT AS sample_size FROM r WHERE rank = 1 AND sample_size >= 3 AND matched / sample_size >= 0.8")
def detected_conventions(spark, d):
    """File names of each folder, nine in ten of them in kebab case."""
    f = source_files(spark, d)
    name = F.concat(F.lit("one"), F.when(F.col("k") % 10 == 0, "_").otherwise("-"), F.col("k").cast("string"), F.lit(".go"))
    placed = f.select(F.concat(paths.dirname(F.col("path")), F.lit("/"), name).alias("path"), F.lit("go").alias("language"), paths.dirname(F.col("path")).alias("module"), F.lit(False).alias("is_test"))
    none = spark.createDataFrame([], "file_path string, exported boolean, is_default boolean")
    return conventions.detect(placed, none).select("id", "statement", "matched", "sample_size")


@query("SELECT item_id::VARCHAR AS path, '# T' || chr(10) || chr(10) || CASE WHEN item_id % 2 = 0 THEN '<!-- grovelens:start:a sha=' || substr(sha256(text), 1, 12) || ' -->' || chr(10) || text || chr(10) || '<!-- grovelens:end:a -->' ELSE '<!-- grovelens:start:a sha=000000000000 -->' || chr(10) || 'mine' || chr(10) || '<!-- grovelens:end:a -->' END || chr(10) AS text, CASE WHEN item_id % 2 = 0 THEN 'updated' ELSE 'conflict' END AS status FROM benchmark WHERE text IS NOT NULL AND NOT contains(text, chr(13)) AND NOT contains(text, '<!--')")
def region_updates(spark, d):
    """Documents whose region is rewritten, or was edited by hand and stays."""
    items = read(spark, d, "benchmark").filter(F.col("text").isNotNull() & ~F.col("text").contains("\r") & ~F.col("text").contains("<!--")).select(F.col("item_id").cast("string").alias("path"), "text", "item_id")
    start = F.concat(F.lit("# T\n\n<!-- grovelens:start:a sha="), F.when(F.col("item_id") % 2 == 0, F.substring(F.sha2(F.lit("old"), 256), 1, 12)).otherwise("000000000000"), F.lit(" -->\n"))
    docs = items.select("path", F.concat(start, F.when(F.col("item_id") % 2 == 0, "old").otherwise("mine"), F.lit("\n<!-- grovelens:end:a -->\n")).alias("text"))
    done = regions.apply(docs, items.select("path", F.lit(1).alias("ord"), F.lit("a").alias("id"), F.col("text").alias("content")))
    return done.select("path", "text", F.get("outcomes", F.lit(0))["status"].alias("status"))


@query(f"""WITH {SOURCES}, x AS (SELECT k, folder, path, k % 3 AS form FROM g)
SELECT 'docs/' || k || '.md' AS file, CASE form WHEN 1 THEN '../gone/f' || k || '.ts' ELSE 'gone/f' || k || '.x.ts' END AS reference, CASE WHEN form = 1 THEN (SELECT min(path) FROM g WHERE g.k = x.k AND path LIKE '%.ts') END AS suggestion FROM x WHERE form <> 0""")
def broken_references(spark, d):
    """Documents that name a file rightly by the end of its path, through a link to a folder that is gone, or not at all."""
    f = source_files(spark, d)
    k, form = F.col("k").cast("string"), F.col("k") % 3
    said = F.when(form == 0, F.concat(F.lit("See `"), F.expr("substring(path, 5)"), F.lit("`."))).when(form == 1, F.concat(F.lit("See [it](../gone/f"), k, F.lit(".ts)."))).otherwise(F.concat(F.lit("See `gone/f"), k, F.lit(".x.ts`.")))
    refs = drift.extract_references(f.select(F.concat(F.lit("docs/"), k, F.lit(".md")).alias("path"), said.alias("text")))
    return drift.missing_paths(refs, f.select("path")).select("file", "reference", "suggestion")


@query("SELECT 'p' || p_partkey || '/README.md' AS file, CASE WHEN p_partkey % 2 = 0 THEN '`biuld` is not a script in p' || p_partkey || '/package.json' ELSE 'Makefile has no `tets` target' END AS message, CASE WHEN p_partkey % 2 = 0 THEN 'build' ELSE 'test' END AS suggestion FROM part")
def missing_scripts(spark, d):
    """Documents beside their manifests, each with a wrong and a right command."""
    k = F.col("p_partkey")
    home = F.concat(F.lit("p"), k.cast("string"))
    given = read(spark, d, "part").select(home.alias("dir"), (k % 2 == 0).alias("node"))
    docs = given.select(F.concat("dir", F.lit("/README.md")).alias("path"), F.when(F.col("node"), "`npm run biuld` and `npm test`").otherwise("`make tets` and `make test`").alias("text"))
    texts = given.select(F.concat("dir", F.when(F.col("node"), "/package.json").otherwise("/Makefile")).alias("path"), F.when(F.col("node"), '{"scripts": {"build": "x", "test": "y"}}').otherwise("test: all\n\tx\n").alias("text"))
    return drift.missing_scripts(drift.extract_references(docs), facts.scripts(texts), texts.select("path")).select("file", "message", "suggestion")


@query("""SELECT 'p' || p_partkey AS root, fact, label FROM part, (VALUES ('stack', 'Node.js', 0), ('stack', 'pnpm', 0), ('stack', 'React', 0), ('command', 'pnpm build', 0), ('stack', 'Python', 1), ('stack', 'Poetry', 1), ('stack', 'FastAPI', 1), ('stack', 'pytest', 1), ('command', 'poetry run pytest', 1)) AS v(fact, label, rest) WHERE p_partkey % 2 = rest""")
def manifest_facts(spark, d):
    """Two kinds of projects, one for each part."""
    k = F.col("p_partkey")
    root = F.concat(F.lit("p"), k.cast("string"))
    node = F.array(F.struct(F.lit("package.json").alias("name"), F.lit('{"scripts": {"build": "x", "prebuild": "y"}, "dependencies": {"react": "1"}}').alias("text")), F.struct(F.lit("pnpm-lock.yaml").alias("name"), F.lit("").alias("text")))
    python = F.array(F.struct(F.lit("pyproject.toml").alias("name"), F.lit('[tool.poetry.dependencies]\nfastapi = "1"\npytest = "1"\n').alias("text")), F.struct(F.lit("poetry.lock").alias("name"), F.lit("").alias("text")))
    rows = read(spark, d, "part").select(root.alias("root"), F.explode(F.when(k % 2 == 0, node).otherwise(python)).alias("f")).select("root", "f.name", "f.text")
    return facts.facts(rows).filter("fact in ('stack', 'command')").select("root", "fact", "label")


#: The names that suffix_match and nearest_name over whole tables were first registered by, and are still asked for by.
for _name in ("suffix_match", "nearest_name"):
    QUERIES[f"{_name}_all"], ORACLE_SQL[f"{_name}_all"] = QUERIES[_name], ORACLE_SQL[_name]
