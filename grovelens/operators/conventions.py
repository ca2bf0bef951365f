"""Conventions that the files of a module, or of a whole tree, follow almost without exception.

A candidate is the value that at least a given share of a scope's files agree on; its id holds the value, so that a
decision never passes on to another one. Evidence is kept as its own frame, a row a file, with the first few paths in the candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovelens.functions import paths, text
from grovelens.operators.modules import ROOT

# Fixed values.
MIN_SAMPLE = 3
MIN_AGREEMENT = 0.8
PREVIEW = 3
EXPORT_LABELS = {"named": "named exports only (no default exports)", "default": "a single default export"}

SCHEMA = ("id", "module", "pattern", "value", "statement", "matched", "sample_size", "evidence")


def convention_id(module: Column, pattern: Column, value: Column) -> Column:
    return F.concat_ws(":", module, pattern, value)


def place(module: Column) -> Column:
    """How a statement names a module."""
    return F.when(module == ROOT, "the repository root").otherwise(F.concat(F.lit("`"), module, F.lit("/`")))


def export_styles(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(module, value, path): default, named or mixed for source files of TypeScript or JavaScript that export anything."""
    given = files.filter(~F.col("is_test") & F.col("language").isin("typescript", "javascript")).select("path", "module")
    own = symbols.filter("exported").groupBy(F.col("file_path").alias("path")).agg(F.bool_or("is_default").alias("d"), F.bool_or(~F.col("is_default")).alias("n"))
    value = F.when(F.col("d") & F.col("n"), "mixed").when(F.col("d"), "default").otherwise("named")
    return given.join(own, "path").select("module", value.alias("value"), "path")


def file_namings(files: DataFrame) -> DataFrame:
    """(module, value, path) of source files whose name has several words."""
    stem = F.substring_index(paths.basename(F.col("path")), ".", 1)
    return files.filter(~F.col("is_test")).select("module", text.file_name_style(stem).alias("value"), "path").filter("value is not null")


def real_tests(files: DataFrame) -> DataFrame:
    """Test files, without those that fixtures folders hold (or are named so)."""
    return files.filter(F.col("is_test") & ~F.arrays_overlap(F.split("path", "/"), F.array(F.lit("fixtures"), F.lit("__fixtures__"))))


def test_namings(files: DataFrame) -> DataFrame:
    return real_tests(files).select(F.lit(ROOT).alias("module"), text.test_name_style(F.col("path")).alias("value"), "path").filter("value is not null")


def test_locations(files: DataFrame) -> DataFrame:
    """`colocated`, or `dir:` and the module where a test lies in a module of tests only."""
    alone = files.groupBy(F.col("module").alias("m")).agg(F.bool_and("is_test").alias("only_tests"))
    value = F.when(F.col("only_tests"), F.concat(F.lit("dir:"), F.col("module"))).otherwise("colocated")
    return real_tests(files).join(alone, F.col("module") == F.col("m")).select(F.lit(ROOT).alias("module"), value.alias("value"), "path")


def observations(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(pattern, module, value, path): what each file shows. files: (path, language, module, is_test); modules of tests only have no own patterns."""
    sourced = files.filter(~F.col("is_test")).select(F.col("module").alias("m")).distinct()
    own = lambda df: df.join(sourced, F.col("module") == F.col("m"), "left_semi")
    parts = {"export-style": own(export_styles(files, symbols)), "file-naming": own(file_namings(files)), "test-location": test_locations(files), "test-naming": test_namings(files)}
    out = None
    for pattern, rows in parts.items():
        rows = rows.select(F.lit(pattern).alias("pattern"), "module", "value", "path")
        out = rows if out is None else out.unionByName(rows)
    return out


def statement() -> Column:
    """What a candidate says, without counts, so that a new file doesn't rewrite it."""
    module, value = F.col("module"), F.col("value")
    exports = F.lit(None).cast("string")
    for style, words in EXPORT_LABELS.items():
        exports = F.when(value == style, words).otherwise(exports)
    tests = F.lit(None).cast("string")
    for _, style, written in text.TEST_STYLES:
        tests = F.when(value == style, written).otherwise(tests)
    separate = F.concat(F.lit("Tests live in a separate `"), F.expr("substring(value, 5)"), F.lit("/` tree, not next to source files."))
    return (
        F.when(F.col("pattern") == "export-style", F.concat(F.lit("Files in "), place(module), F.lit(" use "), exports, F.lit(".")))
        .when(F.col("pattern") == "file-naming", F.concat(F.lit("Multi-word file names in "), place(module), F.lit(" are "), value, F.lit(".")))
        .when(F.col("pattern") == "test-naming", F.concat(F.lit("Test files are named "), tests, F.lit(".")))
        .when(value == "colocated", "Tests are colocated with the source files they cover.")
        .otherwise(separate)
    )


def dominant(observed: DataFrame, min_sample: int = MIN_SAMPLE, min_agreement: float = MIN_AGREEMENT) -> DataFrame:
    """(pattern, module, value, matched, sample_size) of scopes that agree; ties go to the smaller value. Values are few, files are counted with partial sums."""
    scope = Window.partitionBy("pattern", "module")
    counts = observed.groupBy("pattern", "module", "value").agg(F.count("*").alias("matched"))
    ranked = counts.withColumns({"sample_size": F.sum("matched").over(scope), "rank": F.row_number().over(scope.orderBy(F.desc("matched"), paths.collated(F.col("value"))))})
    return ranked.filter((F.col("rank") == 1) & (F.col("sample_size") >= min_sample) & (F.col("matched") / F.col("sample_size") >= min_agreement)).drop("rank")


def evidence(observed: DataFrame, found: DataFrame) -> DataFrame:
    """(id, path) of every file behind a candidate."""
    return observed.join(found.select("pattern", "module", "value"), ["pattern", "module", "value"]).select(convention_id(F.col("module"), F.col("pattern"), F.col("value")).alias("id"), "path")


def detect(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """SCHEMA of every candidate; a scope whose files mostly mix export styles has none of that pattern."""
    observed = observations(files, symbols)
    found = dominant(observed).filter("not (pattern = 'export-style' and value = 'mixed')")
    first = Window.partitionBy("id").orderBy(paths.collated(F.col("path")))
    shown = evidence(observed, found).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= PREVIEW)
    preview = shown.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("e")).select("id", F.col("e.path").alias("evidence"))
    named = found.withColumn("id", convention_id(F.col("module"), F.col("pattern"), F.col("value"))).withColumn("statement", statement())
    return named.join(preview, "id").select(*SCHEMA)


def prompt(conventions: DataFrame) -> DataFrame:
    """(id, prompt) for a human to answer."""
    more = F.when(F.col("matched") > F.size("evidence"), ", …").otherwise("")
    words = F.concat("statement", F.lit("\n  evidence: "), F.col("matched").cast("string"), F.lit("/"), F.col("sample_size").cast("string"), F.lit(" files agree ("), F.array_join("evidence", ", "), more, F.lit(")\nConfirm? Confirmed conventions are written into AGENTS.md. (y/n/s to skip) "))
    return conventions.select("id", words.alias("prompt"))
