"""Everything that a document may state, as lazy frames over the graph's tables and the manifests.

Files, symbols, edges and modules stay normalised; a section joins what it needs. Generated files are left out everywhere,
as targets of imports too. Orders follow the root Unicode collation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovelens.functions import paths, text
from grovelens.operators import graph, modules, resolve
from grovelens.sources import languages
from grovelens.sources.scratch import Scratch

#: Base names of files whose own description speaks for their folder, in order (fixed value).
ENTRY_NAMES = ("index", "__init__", "main", "mod", "lib", "app")
READMES = ("README.md", "readme.md", "README")


@dataclass
class Model:
    """files: path, language, module, is_test, parse_status, doc_summary, imported_by. symbols: with ref_count, module, is_test.
    edges: from_path, to_path. module_edges: from_module, to_module, weight. modules: module, label, files, source_files, is_test, languages,
    unparsed, description. facts: ord, fact, label, source, runs, note."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    module_edges: DataFrame
    modules: DataFrame
    facts: DataFrame
    overrides: Sequence[str] = ()
    roots: Sequence[str] = ()
    containers: Sequence[str] = ()
    command: str = "grovelens"

    def module_of(self, path: Column) -> Column:
        """The module of any path, a deleted one too, by this run's rules."""
        return modules.module_id(path, self.overrides, self.roots, self.containers)

    def languages(self) -> DataFrame:
        return language_counts(self.files.filter(~F.col("is_test")))

    def counts(self) -> DataFrame:
        """One row: files, test_files, resolved_imports."""
        return self.files.agg(F.count("*").alias("files"), F.count_if("is_test").alias("test_files")).crossJoin(self.edges.agg(F.count("*").alias("resolved_imports")))


def language_counts(files: DataFrame, *scope: str) -> DataFrame:
    """scope, language, files, label: by the number of files, then by label."""
    return files.groupBy(*scope, "language").agg(F.count("*").alias("files")).withColumn("label", languages.label(F.col("language")))


def live_edges(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (from_path, to_path) whose importer is no test."""
    live = files.filter(~F.col("is_test")).select(F.col("path").alias("from_path"))
    return resolved.select("from_path", "to_path").join(live, "from_path", "left_semi").distinct()


def readme_descriptions(texts: DataFrame, module_ids: DataFrame) -> DataFrame:
    """(module, description) from the first README that a module's folder has; the top has none."""
    rank = F.array_position(F.array(*map(F.lit, READMES)), paths.basename(F.col("path")))
    own = texts.filter(rank > 0).select(paths.dirname(F.col("path")).alias("module"), rank.alias("rank"), "text").filter(F.col("module") != modules.ROOT)
    first = own.join(module_ids.select("module").distinct(), "module", "left_semi").groupBy("module").agg(F.min(F.struct("rank", "text")).alias("r"))
    return first.select("module", text.readme_summary(F.col("r.text")).alias("readme")).filter("readme is not null")


def entry_descriptions(files: DataFrame) -> DataFrame:
    """(module, entry): the summary of a module's best-placed described file directly in its folder, if that is an entry file."""
    depth = F.when(F.col("module") == modules.ROOT, 0).otherwise(F.size(F.split("module", "/")))
    direct = files.filter(~F.col("is_test") & F.col("doc_summary").isNotNull() & (F.size(F.split("path", "/")) == depth + 1))
    stem = F.regexp_replace(paths.basename(F.col("path")), r"\.[^.]+\z", "")
    rank = F.array_position(F.array(*map(F.lit, ENTRY_NAMES)), stem)
    order = Window.partitionBy("module").orderBy(F.when(rank > 0, rank).otherwise(len(ENTRY_NAMES) + 1), paths.collated(F.col("path")))
    best = direct.withColumns({"entry_rank": rank, "place": F.row_number().over(order)}).filter("place = 1 and entry_rank > 0")
    return best.select("module", F.col("doc_summary").alias("entry"))


def module_table(files: DataFrame, readmes: DataFrame) -> DataFrame:
    own = files.groupBy("module").agg(F.count("*").alias("files"), F.count_if(~F.col("is_test")).alias("source_files"), F.bool_and("is_test").alias("is_test"))
    spoken = language_counts(files, "module").groupBy("module").agg(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("n"), paths.collated(F.col("label")).alias("label"), "language"))).alias("l"))
    joined = own.join(spoken, "module").join(readmes, "module", "left").join(entry_descriptions(files), "module", "left")
    unparsed = F.filter(F.col("l.language"), lambda x: ~languages.is_parsed(x))
    return joined.select("module", modules.label(F.col("module")).alias("label"), "files", "source_files", "is_test", F.col("l.language").alias("languages"), unparsed.alias("unparsed"), F.coalesce("readme", "entry").alias("description"))


def build_model(
    files: DataFrame,
    symbols: DataFrame,
    imports: DataFrame,
    facts: DataFrame,
    readmes: DataFrame,
    scratch: Scratch,
    overrides: Sequence[str] = (),
    roots: Sequence[str] = (),
    aliases: Sequence[tuple[str, str]] = (),
    dart_package: str | None = None,
    command: str = "grovelens",
) -> Model:
    """The model over the tables files, symbols, imports (sources.store.TABLES), merged facts and readmes (path, text). What sections read is kept in the scratch."""
    live = files.filter("parse_status <> 'generated'")
    containers = modules.dominant_folders(live, overrides, roots)
    path = F.col("path")
    placed = live.select("path", "language", modules.module_id(path, overrides, roots, containers).alias("module"), resolve.is_test(path).alias("is_test"), "parse_status", "doc_summary")
    placed = scratch.keep(placed)
    resolved = scratch.keep(resolve.resolve(imports, placed, aliases, dart_package))
    edges = scratch.keep(live_edges(resolved, placed))
    by = edges.groupBy(F.col("to_path").alias("path")).agg(F.count("*").alias("imported_by"))
    file_table = scratch.keep(placed.join(by, "path", "left").withColumn("imported_by", F.coalesce("imported_by", F.lit(0))))
    own = symbols.join(placed.select(F.col("path").alias("file_path"), "module", "is_test"), "file_path")
    counted = scratch.keep(resolve.reference_counts(resolved, own, placed))
    module_edges = scratch.keep(graph.module_edges(edges, placed, placed))
    table = scratch.keep(module_table(placed, readme_descriptions(readmes, placed)))
    return Model(file_table, counted, edges, module_edges, table, facts, overrides, roots, containers, command)
