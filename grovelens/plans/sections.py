"""The sections that documents are made of: each a projection of the model into (module, content) rows of Markdown.

A project section is one row with a null module, a module section a row for each module. Texts are built by expressions:
lines with their order are gathered per section and joined, so rendering runs where the data are. Ordering is total and no clock
is read: the same code gives the same bytes.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovelens.functions import paths
from grovelens.operators import modules
from grovelens.operators.conventions import place
from grovelens.plans.model import Model
from grovelens.sources import facts as project_facts
from grovelens.sources import languages

# What is shown at most, kinds of symbols that are abstractions.
MAX_LAYOUT, MAX_SYMBOLS, MAX_KEY_FILES, MAX_ABSTRACTIONS, MAX_DIAGRAM, MAX_RUNS = 40, 40, 10, 20, 60, 90
ABSTRACTIONS = ("class", "interface", "type", "enum")


@dataclass
class Context:
    """What a section may refer to besides the model: the artifact being written, and all configured ones with their sections."""

    model: Model
    conventions: DataFrame
    artifact: str
    artifacts: list[tuple[str, list[str]]]

    @property
    def spark(self) -> SparkSession:
        return self.model.files.sparkSession


@dataclass
class Section:
    name: str
    per_module: bool
    summary: str
    render: Callable[[Context], DataFrame]


SECTIONS: dict[str, Section] = {}


def section(name: str, summary: str, per_module: bool = False):
    def register(f: Callable[[Context], DataFrame]):
        SECTIONS[name] = Section(name, per_module, summary, f)
        return f

    return register


def region_id(name: Column, module: Column) -> Column:
    return F.when(module.isNull(), name).otherwise(F.concat_ws(":", name, module))


def parse_region_id(region: Column) -> tuple[Column, Column]:
    """Section and module (null: none) of a region's id; the first colon parts them."""
    return F.substring_index(region, ":", 1), F.when(region.contains(":"), F.substr(region, F.instr(region, ":") + 1))


# Renderers of parts of a line.
def code(text: Column) -> Column:
    return F.when(text.contains("`"), F.concat(F.lit("`` "), text, F.lit(" ``"))).otherwise(F.concat(F.lit("`"), text, F.lit("`")))


def cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def shorten(text: Column, size: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size - 1), F.lit("…"))).otherwise(flat)


def language_list(names: Column) -> Column:
    return F.array_join(F.transform(names, languages.label), ", ")


def listed(rows: DataFrame, order: list[Column], text: Column, *scope: str, name: str = "lines", separator: str = "\n") -> DataFrame:
    """scope, name: the rows' texts joined in order. The rows of a scope are one section's lines, or one cell's list."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*scope).orderBy(*order) if scope else Window.orderBy(*order))).withColumn("__t", text)
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("__n", "__t")))["__t"], separator)
    return ranked.groupBy(*scope).agg(joined.alias(name)) if scope else ranked.agg(joined.alias(name))


def whole(frame: DataFrame, *parts: Column | str) -> DataFrame:
    """(module: null, content) of a one-row frame."""
    made = F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])
    return frame.select(F.lit(None).cast("string").alias("module"), made.alias("content"))


def constant(context: Context, content: str) -> DataFrame:
    return whole(context.spark.range(1), content)


def others_with(context: Context, *names: str) -> list[str]:
    """Paths of other artifacts, not made for single modules, that hold one of the sections."""
    return [p for p, held in context.artifacts if p != context.artifact and "{module}" not in p and set(held) & set(names)]


def in_order(edges: DataFrame, own: str, other: str, name: str) -> DataFrame:
    """(module, name): a module's edges as a list, by weight and id."""
    text = F.concat(code(modules.label(F.col(other))), F.lit(" ("), F.col("weight").cast("string"), F.lit(")"))
    return listed(edges, [F.desc("weight"), paths.collated(F.col(other))], text, own, name=name, separator=", ").withColumnRenamed(own, "module")


def with_edges(model: Model, table: DataFrame) -> DataFrame:
    """Module rows with depends_on and used_by as lists; a dash where there is none."""
    joined = table.join(in_order(model.module_edges, "from_module", "to_module", "depends_on"), "module", "left").join(in_order(model.module_edges, "to_module", "from_module", "used_by"), "module", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("—")) for c in ("depends_on", "used_by")})


def by_id(module: str = "module") -> list[Column]:
    """The top first, then by id."""
    return [F.col(module) != modules.ROOT, paths.collated(F.col(module))]


def symbol_order() -> list[Column]:
    return [F.desc("ref_count"), paths.collated(F.col("file_path")), F.col("ordinal")]


@section("overview", "Project name, description, languages and stack, with the manifest that each fact came from.")
def overview(context: Context) -> DataFrame:
    model = context.model
    named = model.facts.agg(F.first(F.when(F.col("fact") == "name", F.col("label")), True).alias("name"), F.first(F.when(F.col("fact") == "description", F.col("label")), True).alias("description"))
    spoken = listed(model.languages(), [F.desc("files"), paths.collated(F.col("label"))], F.col("label"), name="spoken", separator=", ")
    stack = listed(project_facts.stack_by_source(model.facts), [F.col("ord")], F.concat(F.array_join("labels", ", "), F.lit(" ("), code(F.col("source")), F.lit(")")), name="stack", separator="; ")
    more = [f"{what}: {', '.join(f'`{p}`' for p in found)}" for what, names in (("module dependencies and key files", ("architecture", "key-files")), ("each module's public API", ("module", "module-api"))) if (found := others_with(context, *names))]
    pointers = f"\n- **More context (read on demand):** {'; '.join(more)}" if more else ""
    return whole(
        named.crossJoin(spoken).crossJoin(stack),  # one row each
        "# ",
        F.col("name"),
        "\n\n",
        F.when(F.col("description").isNotNull(), F.concat("description", F.lit("\n\n"))),
        "- **Languages:** ",
        F.when(F.col("spoken") != "", F.col("spoken")).otherwise("_no source files found_"),
        F.when(F.col("stack") != "", F.concat(F.lit("\n- **Stack:** "), F.col("stack"))),
        f"{pointers}\n\n_Sections between `grovelens` markers are generated from the code and refreshed by `grovelens sync` — edit outside them._",
    )


@section("commands", "Commands that the project defines, or those of its toolchain.")
def commands(context: Context) -> DataFrame:
    given = context.model.facts.filter("fact = 'command'")
    text = F.concat(
        F.lit("- "),
        code(F.col("label")),
        F.when(F.col("runs").isNotNull() & (F.col("runs") != ""), F.concat(F.lit(" — runs "), code(shorten(F.col("runs"), MAX_RUNS))))
        .when(F.col("note").isNotNull(), F.concat(F.lit(" — "), F.col("note"), F.lit(" ("), code(F.col("source")), F.lit(")")))
        .otherwise(""),
    )
    shown = listed(project_facts.rank_commands(given), [F.col("rank"), F.col("ord")], text)
    ranked = given.withColumn("source_ord", F.col("ord"))
    sources = listed(ranked.groupBy("source").agg(F.min("source_ord").alias("o")), [F.col("o")], F.col("source"), name="sources", separator=", ")
    total = given.agg(F.count("*").alias("n"))
    left = F.col("n") - project_facts.MAX_COMMANDS
    return whole(
        shown.crossJoin(sources).crossJoin(total),
        "## Commands\n\n",
        F.when(F.col("n") == 0, "_No commands found: no package.json scripts, Makefile targets, or recognised toolchain manifest._").otherwise(F.col("lines")),
        F.when(left > 0, F.concat(F.lit("\n- …and "), left.cast("string"), F.lit(" more (see "), F.col("sources"), F.lit(")"))),
    )


@section("layout", "Where things live: a row for each module with its languages and its own description.")
def layout(context: Context) -> DataFrame:
    table = context.model.modules
    total = table.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(~F.col("is_test") & F.col("description").isNotNull()), F.lit(False)).alias("described"))
    first = table.orderBy(*by_id()).limit(MAX_LAYOUT)
    row = F.concat(F.lit("| "), code(F.col("label")), F.lit(" | "), F.when(F.col("is_test"), "tests").otherwise("source"), F.lit(" | "), language_list(F.col("languages")))
    plain = listed(first, by_id(), F.concat(row, F.lit(" |")), name="plain")
    wide = listed(first, by_id(), F.concat(row, F.lit(" | "), cell(F.coalesce("description", F.lit(""))), F.lit(" |")), name="wide")
    left = F.col("n") - MAX_LAYOUT
    body = F.when(F.col("described"), F.concat(F.lit("| Path | Kind | Languages | Description |\n|---|---|---|---|\n"), F.col("wide"))).otherwise(F.concat(F.lit("| Path | Kind | Languages |\n|---|---|---|\n"), F.col("plain")))
    return whole(
        total.crossJoin(plain).crossJoin(wide),
        "## Layout\n\n",
        F.when(F.col("n") == 0, "_No source files found._").otherwise(body),
        F.when(left > 0, F.concat(F.lit("\n\n_…and "), left.cast("string"), F.lit(" more modules._"))),
    )


@section("conventions", "Conventions that a human confirmed and that still hold.")
def conventions(context: Context) -> DataFrame:
    rows = context.conventions.withColumn("place", F.row_number().over(Window.orderBy("module", "pattern", "id")))
    # one rule of several modules is stated once, with all of them
    token = place(F.col("module"))
    keyed = rows.withColumns({"token": token, "form": F.replace("statement", token, F.lit("\0"))})
    groups = keyed.groupBy("pattern", "value", "form").agg(F.array_sort(F.collect_list(F.struct("place", "token", "statement"))).alias("x"), F.min("place").alias("place"))
    of = lambda n: F.get(F.col("x.token"), n)
    n = F.size("x")
    names = F.when(n == 2, F.concat(of(F.lit(0)), F.lit(" and "), of(F.lit(1)))).otherwise(F.concat(F.array_join(F.slice(F.col("x.token"), F.lit(1), n - 1), ", "), F.lit(", and "), of(n - 1)))
    merged = F.concat(F.lit("- "), F.replace(F.col("form"), F.lit("\0"), names))
    single = F.array_join(F.transform(F.col("x.statement"), lambda s: F.concat(F.lit("- "), s)), "\n")
    text = F.when((n > 1) & F.col("form").contains("\0"), merged).otherwise(single)
    lines = listed(groups, [F.col("place")], text)
    return whole(lines, "## Conventions\n\n", F.when(F.col("lines") != "", F.col("lines")).otherwise("_None confirmed yet. Run `grovelens review conventions` to confirm detected patterns._"))


@section("agent-workflow", "How to keep the documents true: sync, check, and fix what is reported.")
def agent_workflow(context: Context) -> DataFrame:
    tool = context.model.command
    return constant(
        context,
        f"## Keeping these docs true\n\n- After changing code, run `{tool} sync` (refreshes the generated sections), then `{tool} check`.\n"
        f"- `{tool} check` lists hand-written statements that no longer match the code — commands, paths, links, or code names that don't exist. "
        f"Fix that text to match the code. `{tool} check --json` gives the same list as file/line/suggestion.\n"
        f"- Never edit between `grovelens:start` / `grovelens:end` markers; those sections are regenerated.\n- All commands: `{tool} --help`.",
    )


@section("agents-import", "A pointer in a tool's own syntax to the file that all tools share.")
def agents_import(context: Context) -> DataFrame:
    from grovelens.plans.artifacts import tool_for

    shared = next((p for p, held in context.artifacts if p != context.artifact and "overview" in held), "AGENTS.md")
    target = posixpath.relpath(shared, posixpath.dirname(context.artifact) or ".")
    tool = tool_for(context.artifact)
    line = tool.import_form.format(target) if tool else f"@{target}"
    return constant(context, f"{line}\n\n_Project context lives in `{shared}`, shared by every coding agent; edit that file, not this one._")


@section("update-docs-command", "Body of a command that fixes documents that have drifted.")
def update_docs_command(context: Context) -> DataFrame:
    tool = context.model.command
    return constant(
        context,
        "Bring this project's documentation back in line with the code.\n\n"
        f"1. Run `{tool} sync` to refresh the generated sections.\n"
        f"2. Run `{tool} check --json` and read the `drift` list. Each entry has a file, a line, what is wrong, and sometimes a suggestion.\n"
        "3. For each entry, fix the hand-written text at that location so it matches the code. Use the suggestion when it is right; read the code when unsure. "
        "If a reference is intentionally hypothetical, add `<!-- grovelens-ignore -->` to that line instead.\n"
        "4. Never edit between `grovelens:start` / `grovelens:end` markers.\n"
        f"5. Run `{tool} check` again until it reports nothing, then summarize what you changed.",
    )


@section("architecture", "The modules' dependencies from resolved imports, as a diagram and a table.")
def architecture(context: Context) -> DataFrame:
    model = context.model
    sources = model.modules.filter(~F.col("is_test"))
    edges = model.module_edges.join(sources.select(F.col("module").alias("from_module")), "from_module", "left_semi")
    counts = model.counts().crossJoin(edges.agg(F.count("*").alias("n_edges")))
    # nothing is gathered for a diagram that is too large to be drawn
    drawn = edges.limit(MAX_DIAGRAM + 1)
    ends = drawn.select(F.col("from_module").alias("module")).union(drawn.select("to_module")).distinct()
    nodes = listed(ends, [F.col("module")], F.concat(F.lit("  "), modules.mermaid_id(F.col("module")), F.lit('["'), modules.label(F.col("module")), F.lit('"]')), name="nodes")
    order = [*by_id("from_module"), F.desc("weight"), paths.collated(F.col("to_module"))]
    arrows = listed(drawn, order, F.concat(F.lit("  "), modules.mermaid_id(F.col("from_module")), F.lit(" --> "), modules.mermaid_id(F.col("to_module"))), name="arrows")
    row = F.concat(F.lit("| "), code(F.col("label")), F.lit(" | "), F.col("source_files").cast("string"), F.lit(" | "), F.col("depends_on"), F.lit(" | "), F.col("used_by"), F.lit(" |"))
    table = listed(with_edges(model, sources), by_id(), row, name="table")
    unparsed = listed(model.languages().filter(~languages.is_parsed(F.col("language"))), [F.desc("files"), paths.collated(F.col("label"))], F.col("label"), name="unparsed", separator=", ")
    diagram = F.concat(F.lit("```mermaid\ngraph LR\n"), F.col("nodes"), F.lit("\n"), F.col("arrows"), F.lit("\n```\n\n"))
    return whole(
        counts.crossJoin(nodes).crossJoin(arrows).crossJoin(table).crossJoin(unparsed),  # one row each
        "## Module dependencies\n\nDerived from ",
        plural(F.col("resolved_imports"), "resolved local import"),
        " between source files (test files excluded). A count is the number of distinct file-to-file imports behind the edge.\n\n",
        F.when(F.col("n_edges") == 0, "_No imports between modules were found._\n\n").when(F.col("n_edges") <= MAX_DIAGRAM, diagram),
        "| Module | Files | Depends on | Used by |\n|---|---|---|---|",
        F.when(F.col("table") != "", F.concat(F.lit("\n"), F.col("table"))),
        F.when(F.col("test_files") > 0, F.concat(F.lit("\n\n_Plus "), plural(F.col("test_files"), "test/fixture file"), F.lit(", not shown._"))),
        F.when(F.col("unparsed") != "", F.concat(F.lit("\n\n_"), F.col("unparsed"), F.lit(" files are tracked at file level only: their symbols and imports are not indexed._"))),
    )


@section("key-files", "Entry points that manifests declare, and the files that most others import.")
def key_files(context: Context) -> DataFrame:
    model = context.model
    entries = listed(model.facts.filter("fact = 'entry'"), [F.col("ord")], F.concat(F.lit("- "), code(F.col("label")), F.lit(" → "), code(F.col("runs")), F.lit(" ("), F.col("source"), F.lit(")")), name="entries")
    order = [F.desc("imported_by"), paths.collated(F.col("path"))]
    central = model.files.filter(~F.col("is_test") & (F.col("imported_by") >= 2)).orderBy(*order).limit(MAX_KEY_FILES)
    rows = listed(central, order, F.concat(F.lit("| "), code(F.col("path")), F.lit(" | "), plural(F.col("imported_by"), "file"), F.lit(" |")), name="rows")
    declared = F.when(F.col("entries") != "", F.concat(F.lit("Entry points declared in manifests:\n\n"), F.col("entries")))
    shown = F.when(F.col("rows") != "", F.concat(F.lit("Most-imported source files (change these with care):\n\n| File | Imported by |\n|---|---|\n"), F.col("rows")))
    return whole(
        entries.crossJoin(rows),
        "## Key files\n\n",
        F.coalesce(F.nullif(F.concat_ws("\n\n", declared, shown), F.lit("")), F.lit("_No declared entry points, and no file is imported by more than one other file._")),
    )


@section("key-abstractions", "The exported classes, interfaces, types and enums that most files import.")
def key_abstractions(context: Context) -> DataFrame:
    given = context.model.symbols.filter(~F.col("is_test") & F.col("exported") & F.col("kind").isin(*ABSTRACTIONS))
    top = given.orderBy(*symbol_order()).limit(MAX_ABSTRACTIONS)
    used = F.when(F.col("ref_count") > 0, plural(F.col("ref_count"), "file")).otherwise("—")
    rows = listed(top, symbol_order(), F.concat(F.lit("| "), code(F.col("name")), F.lit(" | "), F.col("kind"), F.lit(" | "), code(F.col("file_path")), F.lit(" | "), used, F.lit(" |")), name="rows")
    none = "_No exported classes, interfaces, types, or enums found in indexed languages._"
    return whole(rows, "## Key abstractions\n\n", F.when(F.col("rows") != "", F.concat(F.lit("| Name | Kind | Defined in | Imported by |\n|---|---|---|---|\n"), F.col("rows"))).otherwise(none))


def module_head(level: str) -> Column:
    tests = F.col("files") - F.col("source_files")
    counts = F.when(F.col("is_test"), plural(tests, "test/fixture file")).otherwise(F.concat(plural(F.col("source_files"), "file"), F.when(tests > 0, F.concat(F.lit(" + "), tests.cast("string"), F.lit(" test"))).otherwise("")))
    described = F.when(F.col("description").isNotNull(), F.concat("description", F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit(f"{level} "), code(F.col("label")), F.lit("\n\n"), described, language_list(F.col("languages")), F.lit(" · "), counts)


def module_edges() -> Column:
    return F.when(~F.col("is_test"), F.concat(F.lit("\n\n- Depends on: "), F.col("depends_on"), F.lit("\n- Used by: "), F.col("used_by"))).otherwise("")


def public_symbols(model: Model) -> DataFrame:
    """(module, shown, total): a module's exported symbols, the first MAX_SYMBOLS as lines."""
    given = model.symbols.filter(~F.col("is_test") & F.col("exported"))
    first = given.withColumn("rank", F.row_number().over(Window.partitionBy("module").orderBy(*symbol_order()))).filter(F.col("rank") <= MAX_SYMBOLS)
    name = F.when(F.col("is_default") & (F.col("name") != "default"), F.concat("name", F.lit(" (default)"))).otherwise(F.col("name"))
    used = F.when(F.col("ref_count") > 0, F.concat(F.lit(" · imported by "), plural(F.col("ref_count"), "file"))).otherwise("")
    text = F.concat(F.lit("- "), code(name), F.lit(" "), F.col("kind"), F.lit(" — "), code(F.col("file_path")), used)
    return listed(first, [F.col("rank")], text, "module", name="shown").join(given.groupBy("module").agg(F.count("*").alias("total")), "module")


def module_interface() -> Column:
    more = F.when(F.col("total") > MAX_SYMBOLS, F.concat(F.lit("\n- …and "), (F.col("total") - MAX_SYMBOLS).cast("string"), F.lit(" more exported symbols"))).otherwise("")
    symbols = (
        F.when(F.col("total") > 0, F.concat("shown", more))
        .when(F.array_contains("languages", "dart"), "_No public top-level types (for Dart, only classes, mixins, enums, and typedefs are indexed)._")
        .when(F.exists("languages", languages.is_parsed), "_No exported symbols._")
    )
    rest = F.when(F.size("unparsed") > 0, F.concat(F.lit("_"), language_list(F.col("unparsed")), F.lit(" files here are tracked at file level only (symbols not indexed)._")))
    return F.when(F.col("is_test"), "_Test code: symbols are not indexed._").otherwise(F.concat_ws("\n\n", symbols, rest))


def module_rows(model: Model) -> DataFrame:
    return with_edges(model, model.modules).join(public_symbols(model), "module", "left")


@section("module", "A module's card: description, size, dependencies and exported symbols.", per_module=True)
def module_card(context: Context) -> DataFrame:
    body = F.concat(module_head("##"), module_edges(), F.lit("\n\n"), module_interface())
    return module_rows(context.model).select("module", F.rtrim(body).alias("content"))


@section("module-summary", "A module's heading, description, size and dependencies.", per_module=True)
def module_summary(context: Context) -> DataFrame:
    return with_edges(context.model, context.model.modules).select("module", F.concat(module_head("#"), module_edges()).alias("content"))


@section("module-api", "A module's exported symbols, the most imported first.", per_module=True)
def module_api(context: Context) -> DataFrame:
    return module_rows(context.model).select("module", F.concat(F.lit("## Public API\n\n"), module_interface()).alias("content"))


@section("module-files", "A module's files, each with its own summary.", per_module=True)
def module_files(context: Context) -> DataFrame:
    text = F.concat(F.lit("- "), code(F.col("path")), F.when(F.col("is_test"), " (test)").otherwise(""), F.when(F.col("doc_summary").isNotNull(), F.concat(F.lit(" — "), F.col("doc_summary"))).otherwise(""))
    lines = listed(context.model.files, [paths.collated(F.col("path"))], text, "module")
    return lines.select("module", F.concat(F.lit("## Files\n\n"), F.col("lines")).alias("content"))
