"""Artifacts: which documents a configuration maintains, the regions each must hold, and their texts against what is on disk.

The plan is a frame of wanted regions (path, ord, id, content) made by joining artifacts with rendered sections; regions on disk
that no plan wants are classified by joins too, and the texts are put together one document a row.
"""

from __future__ import annotations

import os
import posixpath
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovelens.functions import globs
from grovelens.operators import modules, regions
from grovelens.plans.model import Model
from grovelens.plans.sections import SECTIONS, Context, parse_region_id, region_id
from grovelens.sources import worktree
from grovelens.sources.config import FOLDER, Artifact, Config, ConfigError
from grovelens.sources.scratch import Scratch

MODULE, MODULE_DIR = "{module}", "{module_dir}"
#: Sections whose text depends on the artifact that holds them.
OWN_TEXT = ("overview", "agents-import")
NOTE = "<!-- Maintained by grovelens: text between grovelens:start/end markers is regenerated by `grovelens sync`; write anywhere else. -->"
#: Regions of the first format that no section writes any more (fixed value).
RETIRED = ("modules",)


@dataclass(frozen=True)
class Tool:
    """An agent tool that doesn't read the shared file itself: its own file, how that imports another, and what shows that it is used."""

    id: str
    label: str
    file: str
    import_form: str
    evidence: tuple[str, ...]
    command_file: str | None = None
    command_header: str | None = None


# File names and import forms of the tools.
TOOLS = (
    Tool("claude", "Claude Code", "CLAUDE.md", "@{}", ("CLAUDE.md", ".claude"), ".claude/commands/update-docs.md", "---\ndescription: Fix docs that no longer match the code (runs grovelens sync and check, then edits what they report)\n---"),
    Tool("gemini", "Gemini CLI", "GEMINI.md", "@./{}", ("GEMINI.md", ".gemini")),
)
DEFAULTS = (
    Artifact("AGENTS.md", ["overview", "commands", "layout", "conventions", "agent-workflow"]),
    Artifact("ARCHITECTURE.md", ["architecture", "key-files"], title="Architecture"),
    Artifact(".ai/manifest.md", ["module"], title="Module index"),
)


def tool_for(path: str) -> Tool | None:
    return next((t for t in TOOLS if t.file == posixpath.basename(path)), None)


def detect_tools(root: str) -> list[str]:
    return [t.id for t in TOOLS if any(os.path.exists(os.path.join(root, e)) for e in t.evidence)]


def agent_tools(config: Config, root: str) -> list[str]:
    """The tools that get a pointer: those configured, else those that the tree shows, with what the old adapter setting says."""
    if config.agents is not None:
        return list(dict.fromkeys(config.agents))
    found = set(detect_tools(root))
    if config.claude_adapter is not None:
        found = found | {"claude"} if config.claude_adapter else found - {"claude"}
    return sorted(found)


def is_template(path: str) -> bool:
    return MODULE in path or MODULE_DIR in path


def concrete_path(template: str, module: str) -> str:
    """A template's path for one module."""
    name = "root" if module == modules.ROOT else re.sub(r"[\\/]+", "-", module)
    return template.replace(MODULE_DIR, module).replace(MODULE, name)


def template_pattern(template: str) -> str:
    """An expression that every path which a template can give fits."""
    parts = [re.escape(p) for p in re.split(r"(\{module_dir\}|\{module\})", template)]
    kinds = {re.escape(MODULE_DIR): "(.+)", re.escape(MODULE): "([^/]+)"}
    return "^" + "".join(kinds.get(p, p) for p in parts) + r"\z"


def resolve_artifacts(config: Config, root: str) -> list[Artifact]:
    """The artifacts that a configuration maintains, pointers of agent tools among them; ConfigError for a path or section that can't be."""
    found = list(DEFAULTS if config.artifacts is None else config.artifacts)
    for tool in (t for name in agent_tools(config, root) for t in TOOLS if t.id == name):
        if not any(a.path == tool.file for a in found):
            at = next((k for k, a in enumerate(found) if a.path == "AGENTS.md"), -1)
            found.insert(at + 1, Artifact(tool.file, ["agents-import"]))
        if tool.command_file and not any(a.path == tool.command_file for a in found):
            found.append(Artifact(tool.command_file, ["update-docs-command"]))
    found = [a for a in found if a.enabled]
    seen: set[str] = set()
    for a in found:
        place = posixpath.normpath(a.path.replace("\\", "/"))
        if place.startswith("../") or os.path.isabs(a.path):
            raise ConfigError(f'artifacts: "{a.path}" must be a path inside the repository.')
        if place.startswith(f"{FOLDER}/"):
            raise ConfigError(f'artifacts: "{a.path}" is inside {FOLDER}/, which belongs to the tool.')
        if place in seen:
            raise ConfigError(f'artifacts: "{a.path}" is listed twice.')
        seen.add(place)
        if MODULE_DIR in a.path and not a.path.startswith(f"{MODULE_DIR}/"):
            raise ConfigError(f'artifacts: "{a.path}": {MODULE_DIR} must start the path, e.g. {MODULE_DIR}/AGENTS.md.')
        for name in a.sections or ():
            if name not in SECTIONS:
                raise ConfigError(f'artifacts: "{a.path}" lists unknown section "{name}". Available sections: {", ".join(SECTIONS)}.')
    return found


def header_of(artifact: Artifact) -> str:
    own = next((t.command_header for t in TOOLS if t.command_file == artifact.path and t.command_header), None)
    return own or (f"# {artifact.title}\n\n{NOTE}" if artifact.title else NOTE)


def modules_for(model: Model, artifact: Artifact) -> DataFrame:
    """Rows of modules that an artifact covers: those its globs name, else all but tests; a file in a module's own folder is never the top's."""
    if artifact.modules:
        fits = F.lit(False)
        for glob in artifact.modules:
            fits = fits | globs.matches_module(F.col("module"), glob)
        covered = model.modules.filter(fits)
    else:
        covered = model.modules.filter(~F.col("is_test"))
    return covered.filter(F.col("module") != modules.ROOT) if MODULE_DIR in artifact.path else covered


@dataclass
class Plan:
    """docs: path, header, delete_when_empty. desired: path, ord, id, content. available: path, section, module, content of every region that
    a document may hold, for markers that its author placed; fill: paths whose author decides which."""

    docs: DataFrame
    desired: DataFrame
    available: DataFrame


def plan(model: Model, conventions: DataFrame, artifacts: list[Artifact], markdown: DataFrame, scratch: Scratch) -> Plan:
    """What the artifacts must hold. markdown: (path, text) of the tree's Markdown files, among which files of modules that are gone are found.

    A section is rendered once, but for those that name other artifacts; a configuration has a handful of them, modules are rows.
    """
    spark = model.files.sparkSession
    refs = [(a.path, a.sections or []) for a in artifacts]
    fixed = [a.path for a in artifacts if not is_template(a.path)]
    docs = available = None
    rendered: dict[tuple[str, str], DataFrame] = {}
    join = lambda a, b: b if a is None else a.unionByName(b)
    for artifact in artifacts:
        covered = modules_for(model, artifact).select("module", "label")
        template = is_template(artifact.path)
        if template:
            slug = modules.slug(F.col("module"))
            path = F.lit(artifact.path)
            path = F.replace(F.replace(path, F.lit(MODULE_DIR), F.col("module")), F.lit(MODULE), slug)
            homes = covered.select("module", path.alias("path"))
            homes = homes.filter(~F.col("path").isin(*fixed)) if fixed else homes
        else:
            homes = None
        header = F.lit(header_of(artifact))
        own = spark.createDataFrame([(artifact.path,)], "path string") if homes is None else homes.select("path")
        docs = join(docs, own.select("path", header.alias("header"), F.lit(False).alias("delete_when_empty")))
        # without a list of sections, the author's own markers are filled, and nothing is wanted beyond them
        for k, name in enumerate(artifact.sections if artifact.sections is not None else SECTIONS):
            section = SECTIONS[name]
            key = (name, artifact.path if name in OWN_TEXT else "")
            if key not in rendered:
                rendered[key] = scratch.keep(section.render(Context(model, conventions, artifact.path, refs)))
            made = rendered[key]
            if section.per_module:
                kept = made.join(covered, "module")
                placed = kept.join(homes, "module") if template else kept.withColumn("path", F.lit(artifact.path))
                order = F.struct(F.lit(k).alias("k"), (F.col("module") != modules.ROOT).alias("nested"), F.collate(F.col("module"), "UNICODE").alias("m"))
            else:
                placed = homes.select("path").crossJoin(made) if template else made.withColumn("path", F.lit(artifact.path))  # made is one row
                order = F.struct(F.lit(k).alias("k"), F.lit(False).alias("nested"), F.collate(F.lit(""), "UNICODE").alias("m"))
            rows = placed.select("path", order.alias("o"), F.lit(name).alias("section"), F.col("module"), "content", F.lit(artifact.sections is not None).alias("wanted"))
            available = join(available, rows)
        if template:
            # documents of modules that are gone: every generated region goes, and the file with the last
            left = markdown.filter(F.col("path").rlike(template_pattern(artifact.path)) & F.col("text").contains(f"{regions.TOOL}:start:")).select("path").join(homes.select("path"), "path", "left_anti")
            left = left.filter(~F.col("path").isin(*fixed)) if fixed else left
            docs = docs.unionByName(left.select("path", header.alias("header"), F.lit(True).alias("delete_when_empty")))
    if available is None:
        available = spark.createDataFrame([], "path string, o int, section string, module string, content string, wanted boolean")
    ranked = available.withColumn("ord", F.row_number().over(Window.partitionBy("path").orderBy("o"))).drop("o")
    ranked = scratch.keep(ranked)
    desired = ranked.filter("wanted").select("path", "ord", region_id(F.col("section"), F.col("module")).alias("id"), "content")
    return Plan(scratch.keep(docs), desired, ranked)


def render(plan_: Plan, on_disk: DataFrame, artifacts: list[Artifact], scratch: Scratch, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """regions.RESULT_SCHEMA of each document against on_disk (path, text), and (path, id) of regions that nobody knows, which stay.

    A region on disk that isn't wanted is filled if its document has no list of sections, or is about a module that it may show;
    it goes if its section isn't listed or its module is gone; it stays if its name is no section's.
    """
    docs = scratch.keep(plan_.docs.join(on_disk.select("path", "text"), "path", "left"))
    found = regions.parse(docs.filter("text is not null").select("path", "text")).filter("error is null").select("path", "id", "start_line")
    extra = found.join(plan_.desired.select("path", "id"), ["path", "id"], "left_anti")
    section, module = parse_region_id(F.col("id"))
    # a template's region may leave its module out: it is the document's own
    known = extra.select("path", "id", "start_line", section.alias("section"), module.alias("module"))
    per_module = [n for n, s in SECTIONS.items() if s.per_module]
    own = plan_.available.filter(F.col("section").isin(*per_module)).join(_templated(plan_.available, artifacts), "path", "left_semi")
    offered = plan_.available.select("path", "section", F.coalesce("module", F.lit("")).alias("m"), "content").unionByName(own.select("path", "section", F.lit("").alias("m"), "content")).dropDuplicates(["path", "section", "m"])
    met = known.withColumn("m", F.coalesce("module", F.lit(""))).join(offered, ["path", "section", "m"], "left")
    is_section = F.col("section").isin(*SECTIONS) | F.col("id").isin(*RETIRED)
    # a project section doesn't take a module, and a module's needs one: such markers stay as they are
    misused = F.col("section").isin(*[n for n in SECTIONS if n not in per_module]) & F.col("module").isNotNull() | F.col("section").isin(*per_module) & F.col("module").isNull() & F.col("content").isNull()
    listed = F.lit(False)
    for a in artifacts:
        fits = F.col("path").rlike(template_pattern(a.path)) if is_template(a.path) else F.col("path") == a.path
        listed = F.when(fits, F.col("section").isin(*a.sections) if a.sections else F.lit(a.sections is None)).otherwise(listed)
    dying = scratch.keep(met.join(docs.select("path", "delete_when_empty"), "path"))
    stays = ~is_section | (misused & listed & ~F.col("delete_when_empty"))
    unknown = dying.filter(stays).select("path", "id")
    rows = dying.filter(~stays).select("path", (F.col("start_line") + 1_000_000).alias("ord"), "id", F.when(listed & ~F.col("delete_when_empty") & ~F.col("id").isin(*RETIRED), F.col("content")).alias("content"))
    desired = plan_.desired.unionByName(rows)
    return scratch.keep(regions.apply(docs, desired, force)), scratch.keep(unknown)


def _templated(available: DataFrame, artifacts: list[Artifact]) -> DataFrame:
    fits = F.lit(False)
    for a in artifacts:
        if is_template(a.path):
            fits = fits | F.col("path").rlike(template_pattern(a.path))
    return available.filter(fits).select("path").distinct()


def write(root: str, results: DataFrame) -> int:
    """Write or delete the files of results whose action says so, each by one rename; returns how many. Only changed documents reach the driver."""
    n = 0
    for row in results.filter(F.col("action").isin("create", "update", "delete", "restore")).select("path", "action", "text").toLocalIterator():
        place = os.path.join(root, row.path)
        n += 1
        if row.action == "delete":
            if os.path.exists(place):
                os.remove(place)
            continue
        os.makedirs(os.path.dirname(place) or ".", exist_ok=True)
        temporary = f"{place}.{os.getpid()}.tmp"
        with open(temporary, "w", encoding="utf-8", newline="") as f:
            f.write(row.text)
        os.replace(temporary, place)
    return n


def list_paths(root: str, artifacts: list[Artifact], markdown: list[str]) -> list[str]:
    """Every path that a configuration can have written: fixed ones, and those of templates that are there or were at the last commit."""
    fixed = [a.path for a in artifacts if not is_template(a.path)]
    patterns = [re.compile(template_pattern(a.path).replace(r"\z", r"\Z")) for a in artifacts if is_template(a.path)]
    if not patterns:
        return fixed
    there = {*markdown, *(p for p in worktree.files_at_head(root) if p.endswith(".md"))}
    return list(dict.fromkeys([*fixed, *(p for p in sorted(there) if any(x.search(p) for x in patterns))]))
