"""Import resolution and module membership as joins over the set of files.

Every import becomes rows of candidate paths with a rank; an equi-join with the files and the lowest rank decide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovelens.functions import paths

# Fixed values.
JS_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
CONTAINERS = ("src", "lib", "packages", "apps", "libs", "services", "modules", "features", "cmd", "internal", "pkg")
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "e2e", "testing", "integration_test", "androidTest", "fixtures", "__fixtures__")
TEST_FILES = r"\.(test|spec)\.[cm]?[jt]sx?\z|(^|/)test_[^/]+\.py\z|_test\.(py|go|dart)\z|Tests?\.(swift|kt|java|cs)\z"


def is_test(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, TEST_DIRS))) | path.rlike(TEST_FILES)


def module_of(path: Column, roots: Sequence[str] = (), containers: Sequence[str] = ()) -> Column:
    """The module of a file: its first folder below the deepest project root, descending through container folders; `.` at the top.

    containers: further folders, as whole paths, to descend through.
    """
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    whole = F.array_join(dirs, "/")
    base = F.lit(0)
    for root in sorted(roots, key=lambda r: r.count("/")):
        base = F.when((whole == root) | whole.startswith(f"{root}/"), root.count("/") + 1).otherwise(base)
    prefix = lambda n: F.array_join(F.slice(dirs, F.lit(1), n), "/")
    opens = lambda n: F.get(dirs, n - 1).isin(*CONTAINERS) | (prefix(n).isin(*containers) if containers else F.lit(False))
    # descend while the folder reached is a container
    depth = F.aggregate(F.sequence(base + 1, F.greatest(F.size(dirs), base + 1)), base + 1, lambda d, n: F.when((n == d) & opens(d) & (d < F.size(dirs)), d + 1).otherwise(d))
    return F.when(F.size(dirs) == 0, ".").when(F.size(dirs) == base, prefix(base)).otherwise(prefix(depth))


def _ranked(items: list[Column]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("prio"), x.alias("candidate")) for k, x in enumerate(items)])


def _javascript(imports: DataFrame, aliases: Sequence[tuple[str, str]]) -> DataFrame:
    spec = F.col("specifier")
    base = F.when(spec.rlike(r"^\.\.?(/|\z)"), paths.normalize(F.concat_ws("/", F.when(paths.dirname(F.col("file_path")) != ".", paths.dirname(F.col("file_path"))), spec)))
    for prefix, target in sorted(aliases, key=lambda a: -len(a[0])):
        base = base.when(spec.startswith(prefix), paths.normalize(F.concat(F.lit(target), F.expr(f"substring(specifier, {len(prefix) + 1})"))))
    stem = F.when(F.col("base").rlike(r"\.(js|jsx|mjs|cjs)\z"), F.regexp_replace("base", r"\.[a-z]+\z", ""))
    items = [F.col("base"), *[F.concat(stem, F.lit(e)) for e in JS_EXTENSIONS], *[F.concat("base", F.lit(e)) for e in JS_EXTENSIONS], *[F.concat("base", F.lit(f"/index{e}")) for e in JS_EXTENSIONS]]
    return imports.withColumn("base", base).filter("base is not null").withColumn("c", F.explode(_ranked(items))).select("file_path", "ordinal", "names", F.lit(0).alias("root"), F.lit("").alias("part"), "c.prio", "c.candidate")


def _dart(imports: DataFrame, package: str | None) -> DataFrame:
    spec = F.col("specifier")
    own = F.when(spec.startswith(f"package:{package}/"), F.concat(F.lit("lib/"), F.expr(f"substring(specifier, {len(f'package:{package}/') + 1})"))) if package else F.lit(None).cast("string")
    beside = F.when(~spec.rlike("^(dart|package):"), paths.normalize(F.concat_ws("/", F.when(paths.dirname(F.col("file_path")) != ".", paths.dirname(F.col("file_path"))), spec)))
    return imports.select("file_path", "ordinal", "names", F.lit(0).alias("root"), F.lit("").alias("part"), F.lit(0).alias("prio"), F.coalesce(own, beside).alias("candidate"))


def _python(imports: DataFrame) -> DataFrame:
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    rest = F.array_join(F.filter(F.split(F.expr("ltrim('.', specifier)"), r"\."), lambda x: x != ""), "/")
    dirs = F.slice(F.split("file_path", "/"), F.lit(1), F.size(F.split("file_path", "/")) - 1)
    relative = F.array_join(F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - dots + 1, F.lit(0))), "/")
    roots = F.when(dots > 0, F.array(relative)).otherwise(F.array(F.lit(""), F.lit("src")))
    joined = lambda *x: F.array_join(F.filter(F.array(*x), lambda p: p != ""), "/")
    rows = imports.withColumns({"rest": rest}).select("file_path", "ordinal", "names", "rest", F.posexplode(roots).alias("root", "dir"))
    # the module itself (part ''), then each imported name as a submodule; a bare package only where nothing else is found
    parts = F.concat(F.array(F.lit("")), F.coalesce("names", F.array().cast("array<string>")))
    each = rows.withColumn("part", F.explode(F.array_distinct(parts))).withColumn("place", joined(F.col("dir"), F.col("rest"), F.col("part"))).filter("place <> ''")
    bare = (F.col("part") == "") & (F.col("rest") == "")
    shift = F.when(bare, 2).otherwise(0)
    items = F.array(F.struct(shift.alias("prio"), F.concat("place", F.lit(".py")).alias("candidate")), F.struct((shift + 1).alias("prio"), F.concat("place", F.lit("/__init__.py")).alias("candidate")))
    return each.withColumn("c", F.explode(items)).select("file_path", "ordinal", "names", "root", F.when(bare, F.lit("\0bare")).otherwise(F.col("part")).alias("part"), "c.prio", "c.candidate")


def resolve(imports: DataFrame, files: DataFrame, aliases: Sequence[tuple[str, str]] = (), dart_package: str | None = None) -> DataFrame:
    """(from_path, ordinal, to_path, names) for imports (file_path, ordinal, specifier, names) and files (path, language).

    External imports give no row; an import that resolves to its own file neither.
    """
    joined = imports.join(files.select(F.col("path").alias("file_path"), "language"), "file_path")
    of = lambda *names: joined.filter(F.col("language").isin(*names))
    candidates = _javascript(of("typescript", "javascript"), aliases).unionByName(_dart(of("dart"), dart_package)).unionByName(_python(of("python")))
    found = candidates.join(files.select(F.col("path").alias("candidate")), "candidate", "left_semi")
    one = Window.partitionBy("file_path", "ordinal")
    best = found.withColumns({"first_root": F.min("root").over(one), "first": F.min("prio").over(Window.partitionBy("file_path", "ordinal", "root", "part"))})
    best = best.filter("root = first_root and prio = first").withColumn("others", F.max(F.col("part") != "\0bare").over(one)).filter("part <> '\0bare' or not others")
    return best.filter("candidate <> file_path").select(F.col("file_path").alias("from_path"), "ordinal", F.col("candidate").alias("to_path"), "names").distinct()


def reference_counts(resolved: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols (file_path, ordinal, name, is_default, ...) with ref_count: distinct importers, tests excluded, of that name from that file.

    `default` stands for the target's first default symbol.
    """
    live = files.filter(~is_test(F.col("path"))).select(F.col("path").alias("from_path"))
    first = symbols.filter("is_default").groupBy(F.col("file_path").alias("to_path")).agg(F.min(F.struct("ordinal", "name")).alias("d")).select("to_path", F.col("d.name").alias("default_name"))
    named = resolved.join(live, "from_path", "left_semi").select("from_path", "to_path", F.explode("names").alias("name")).join(first, "to_path", "left")
    name = F.when(F.col("name") == "default", F.coalesce("default_name", F.lit("default"))).otherwise(F.col("name"))
    counts = named.select("from_path", F.col("to_path").alias("file_path"), name.alias("name")).distinct().groupBy("file_path", "name").agg(F.count("*").alias("ref_count"))
    return symbols.join(counts, ["file_path", "name"], "left").withColumn("ref_count", F.coalesce("ref_count", F.lit(0)))
