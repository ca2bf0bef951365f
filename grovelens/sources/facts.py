"""Project facts from manifests: name, stack labels, commands, entry points, and the roots of nested projects.

Facts of one project come from a handful of small files, so a worker reads them together, root after root; a frame of
manifests (root, name, text) with many roots is processed in parallel. Every fact names the file it comes from.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovelens.functions import paths
from grovelens.operators.resolve import is_test

# Manifests that mark a project, install hooks, lockfiles in order of precedence, commands in order of use.
MANIFESTS = ("package.json", "pubspec.yaml", "pyproject.toml", "requirements.txt", "Cargo.toml", "go.mod", "pom.xml", "composer.json", "Gemfile")
LIFECYCLE = {"prepare", "prepublish", "prepublishOnly", "preinstall", "install", "postinstall", "prepack", "postpack"}
LOCKFILES = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"), ("bun.lock", "bun"), ("package-lock.json", "npm"))
CORE = ("install", "dev", "start", "build", "test", "lint", "typecheck", "type-check", "check", "format")
MAX_COMMANDS = 15
#: Dependencies that name a framework, and its label.
JS_LABELS = """
next=Next.js|react-native=React Native|expo=Expo|react=React|vue=Vue|nuxt=Nuxt|@sveltejs/kit=SvelteKit|svelte=Svelte|@angular/core=Angular|solid-js=Solid|astro=Astro|
@remix-run/react=Remix|electron=Electron|@capacitor/core=Capacitor|express=Express|fastify=Fastify|koa=Koa|hono=Hono|@nestjs/core=NestJS|@trpc/server=tRPC|graphql=GraphQL|
@prisma/client=Prisma|prisma=Prisma|drizzle-orm=Drizzle|typeorm=TypeORM|mongoose=Mongoose|tailwindcss=Tailwind CSS|vite=Vite|vitest=Vitest|jest=Jest|mocha=Mocha|
@playwright/test=Playwright|cypress=Cypress|ai=Vercel AI SDK|@anthropic-ai/sdk=Anthropic SDK|openai=OpenAI SDK|langchain=LangChain|@langchain/core=LangChain|
@modelcontextprotocol/sdk=MCP SDK|@tensorflow/tfjs=TensorFlow.js|three=three.js
"""
PY_LABELS = """
django=Django|flask=Flask|fastapi=FastAPI|starlette=Starlette|pydantic=Pydantic|sqlalchemy=SQLAlchemy|celery=Celery|pytest=pytest|numpy=NumPy|pandas=pandas|polars=Polars|
scikit-learn=scikit-learn|torch=PyTorch|tensorflow=TensorFlow|jax=JAX|keras=Keras|transformers=Hugging Face Transformers|langchain=LangChain|llama-index=LlamaIndex|
openai=OpenAI SDK|anthropic=Anthropic SDK|mcp=MCP SDK|streamlit=Streamlit|gradio=Gradio
"""
PUB_LABELS = "flutter_riverpod=Riverpod|provider=Provider|flutter_bloc=Bloc|firebase_core=Firebase|go_router=go_router"
PY_MANIFESTS = ("pyproject.toml", "requirements.txt", "requirements-dev.txt", "setup.py", "setup.cfg", "Pipfile")
PY_MANAGERS = (("uv.lock", "uv"), ("poetry.lock", "Poetry"), ("pdm.lock", "PDM"), ("Pipfile.lock", "Pipenv"))
GRADLE = ("build.gradle", "build.gradle.kts", "app/build.gradle", "app/build.gradle.kts", "android/app/build.gradle", "android/app/build.gradle.kts")
COMPOSE = ("docker-compose.yml", "docker-compose.yaml", "compose.yaml", "compose.yml")
MAKEFILES = ("Makefile", "makefile", "GNUmakefile")
#: Files whose presence alone is a fact, and files with a mark in their text that is another one.
PLAIN = (("Package.swift", "Swift Package Manager"), ("go.mod", "Go modules"), ("Cargo.toml", "Rust (Cargo)"), ("Gemfile", "Ruby (Bundler)"), ("composer.json", "PHP (Composer)"), ("Dockerfile", "Docker"))
MARKS = {"Gemfile": (r"gem\s+[\"']rails[\"']", "Rails"), "composer.json": (r"laravel/framework", "Laravel")}
GRADLE_MARKS = ((r"com\.android\.(application|library)", "Android"), (r"compose\s*(=|\()\s*true|androidx\.compose", "Jetpack Compose"))

#: Rows of facts that a worker returns at once.
BATCH_ROWS = 5_000

SCHEMA = "root string, ord int, fact string, label string, source string, runs string, note string"


def _pairs(table: str) -> list[tuple[str, str]]:
    return [tuple(x.split("=", 1)) for x in table.replace("\n", "").split("|")]


JS_LABELS = _pairs(JS_LABELS)
PY_LABELS = _pairs(PY_LABELS)
PUB_LABELS = _pairs(PUB_LABELS)


def has_python_dependency(text: str, name: str) -> bool:
    """A requirement of that name on its own, in any manifest's form; comments don't count."""
    return bool(_requirement(name).search(re.sub(r"(?m)#.*$", "", text)))


@cache
def _requirement(name: str) -> re.Pattern:
    own = "[-_.]".join(map(re.escape, re.split("[-_.]", name)))
    return re.compile(rf"(?im)(?:^|[\s\"'\[,]){own}(?:\[[^\]]*\])?\s*(?:[<>=~!;,\"'\]]|$)")


def package_manager(manifest: dict, names: set[str]) -> tuple[str, str]:
    """The manager and the file that says so: the manifest's own field, then the first lockfile, else npm."""
    declared = str(manifest.get("packageManager") or "").split("@")[0]
    if declared in ("npm", "pnpm", "yarn", "bun"):
        return declared, "package.json packageManager"
    return next(((tool, lock) for lock, tool in LOCKFILES if lock in names), ("npm", "package.json"))


def run_form(tool: str, script: str) -> str:
    if tool == "npm":
        return f"npm {script}" if script in ("test", "start") else f"npm run {script}"
    return f"bun run {script}" if tool == "bun" else f"{tool} {script}"


def make_targets(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?m)^([A-Za-z0-9][\w.-]*)\s*:(?![=:])", text)))


def toml_section(text: str, header: str) -> str | None:
    """The lines of `[header]` up to the next one."""
    lines = text.splitlines()
    start = next((k for k, x in enumerate(lines) if x.strip() == f"[{header}]"), None)
    if start is None:
        return None
    rest = lines[start + 1 :]
    return "\n".join(rest[: next((k for k, x in enumerate(rest) if x.lstrip().startswith("[")), len(rest))])


@dataclass
class Project:
    """What one project's files say; texts: path below the project's folder to text."""

    texts: dict[str, str]
    name: str = ""
    description: str | None = None
    stack: dict[str, str] = field(default_factory=dict)
    commands: list[tuple[str, str, str | None, str | None]] = field(default_factory=list)
    entries: list[tuple[str, str, str]] = field(default_factory=list)

    def add(self, label: str, source: str) -> None:
        """The first source of a label stays."""
        self.stack.setdefault(label, source)

    def python(self) -> None:
        found = [(n, self.texts[n]) for n in PY_MANIFESTS if n in self.texts]
        if not found:
            return
        self.add("Python", found[0][0])
        for lock, label in PY_MANAGERS:
            if lock in self.texts:
                self.add(label, lock)
        for dependency, label in PY_LABELS:
            if source := next((n for n, text in found if has_python_dependency(text, dependency)), None):
                self.add(label, source)
        if text := self.texts.get("pyproject.toml"):
            own = toml_section(text, "project")
            own = toml_section(text, "tool.poetry") if own is None else own
            if (m := re.search(r"(?m)^\s*name\s*=\s*[\"']([^\"']+)[\"']", own or "")) and "package.json" not in self.texts:
                self.name = m[1]
            for header in ("project.scripts", "tool.poetry.scripts"):
                for n, target in re.findall(r"(?m)^\s*[\"']?([\w.-]+)[\"']?\s*=\s*[\"']([^\"']+)[\"']", toml_section(text, header) or ""):
                    self.entries.append((n, target, f"pyproject.toml [{header}]"))

    def pub(self) -> None:
        text = self.texts.get("pubspec.yaml")
        if text is None:
            return
        try:
            doc = yaml.safe_load(text) or {}
            used = {**(doc.get("dependencies") or {}), **(doc.get("dev_dependencies") or {})}
        except (yaml.YAMLError, AttributeError, TypeError):
            self.add("Dart", "pubspec.yaml")
            return
        if isinstance(doc.get("name"), str) and "package.json" not in self.texts:
            self.name = doc["name"]
        for label in ["Flutter" if "flutter" in used else "Dart", *(label for dependency, label in PUB_LABELS if dependency in used)]:
            self.add(label, "pubspec.yaml")

    def others(self) -> None:
        for n in GRADLE:
            if n in self.texts:
                self.add("Gradle", n)
                for mark, label in GRADLE_MARKS:
                    if re.search(mark, self.texts[n]):
                        self.add(label, n)
        folders = {p.rsplit("/", 1)[0] if "/" in p else "." for p in self.texts}
        for n, label in PLAIN:
            if n == "go.mod":  # between the Apple files and the other languages
                if "Podfile" in self.texts or "ios/Podfile" in self.texts:
                    self.add("CocoaPods", "Podfile")
                for top in (".", "ios", "macos"):
                    bundles = sorted(f for f in folders if f.endswith((".xcodeproj", ".xcworkspace")) and (f.rsplit("/", 1)[0] if "/" in f else ".") == top)
                    if bundles:
                        self.add("Xcode project", bundles[0])
            if n == "Dockerfile" and (solution := next((p for p in sorted(self.texts) if "/" not in p and p.endswith((".sln", ".csproj"))), None)):
                self.add(".NET", solution)
            if n in self.texts:
                self.add(label, n)
                if n in MARKS and re.search(MARKS[n][0], self.texts[n]):
                    self.add(MARKS[n][1], n)
        for n in COMPOSE:
            if n in self.texts:
                self.add("Docker Compose", n)

    def node(self) -> None:
        try:
            manifest = json.loads(self.texts.get("package.json", ""))
        except ValueError:
            return
        if not isinstance(manifest, dict):
            return
        for key in ("name", "description"):
            if isinstance(manifest.get(key), str) and manifest[key].strip():
                setattr(self, key, manifest[key].strip())
        tool, source = package_manager(manifest, set(self.texts))
        self.add("Node.js", "package.json")
        self.add(tool, source)
        if manifest.get("workspaces"):
            self.add(f"{tool} workspaces (monorepo)", "package.json workspaces")
        used = {n for key in ("dependencies", "devDependencies", "peerDependencies") if isinstance(manifest.get(key), dict) for n in manifest[key]}
        for dependency, label in JS_LABELS:
            if dependency in used:
                self.add(label, "package.json")
        scripts = manifest.get("scripts") if isinstance(manifest.get("scripts"), dict) else {}
        for script, body in scripts.items():
            hooked = re.sub(r"^(pre|post)", "", script)
            if isinstance(body, str) and script not in LIFECYCLE and (hooked == script or hooked not in scripts):
                self.commands.append((run_form(tool, script), "package.json", body, None))
        programs = manifest.get("bin")
        programs = {self.name: programs} if isinstance(programs, str) else programs if isinstance(programs, dict) else {}
        self.entries += [(n, target, "package.json bin") for n, target in programs.items() if isinstance(target, str)]
        if isinstance(manifest.get("main"), str):
            self.entries.append(("main", manifest["main"], "package.json main"))

    def make(self) -> None:
        if n := next((n for n in MAKEFILES if n in self.texts), None):
            self.commands += [(f"make {target}", n, None, None) for target in make_targets(self.texts[n])]

    def toolchain(self) -> None:
        """Standard commands of the toolchains at hand, only where the project defines none itself."""
        if self.commands:
            return
        pubspec = self.texts.get("pubspec.yaml", "")
        runner = "uv run " if "uv" in self.stack else "poetry run " if "Poetry" in self.stack else ""
        standard = [
            ("Flutter" in self.stack, "Flutter", "pubspec.yaml", ["flutter pub get", *(["flutter test"] if "flutter_test:" in pubspec else []), "flutter run"]),
            ("Dart" in self.stack and "Flutter" not in self.stack, "Dart", "pubspec.yaml", ["dart pub get", *(["dart test"] if re.search(r"(?m)^\s+test:", pubspec) else [])]),
            ("gradlew" in self.texts, "Gradle", "gradlew", ["./gradlew build", "./gradlew test"]),
            ("go.mod" in self.texts, "Go", "go.mod", ["go build ./...", "go test ./..."]),
            ("Cargo.toml" in self.texts, "Cargo", "Cargo.toml", ["cargo build", "cargo test"]),
            ("pytest" in self.stack, "pytest", self.stack.get("pytest", ""), [f"{runner}pytest"]),
        ]
        for there, tool, source, commands in standard:
            if there:
                self.commands += [(c, source, None, f"standard {tool} command") for c in commands]


def project_facts(files: dict[str, str | None], name: str = "") -> list[tuple[str, str, str | None, str | None, str | None]]:
    """(fact, label, source, runs, note) of one project in order; fact is name, description, stack, command or entry.

    files: path below the project's folder to text. An entry's label is its name and runs its target. A package.json's name wins.
    """
    p = Project({k: v or "" for k, v in files.items()}, name)
    for step in (p.python, p.pub, p.others, p.node, p.make, p.toolchain):
        step()
    rows = [("name", p.name, None, None, None)] if p.name else []
    rows += [("description", p.description, "package.json", None, None)] if p.description else []
    rows += [("stack", label, source, None, None) for label, source in p.stack.items()]
    return rows + [("command", *c) for c in p.commands] + [("entry", n, source, target, None) for n, target, source in p.entries]


def wanted(path: Column) -> Column:
    """Files that facts are read from or whose presence is a fact."""
    names = {*MANIFESTS, *PY_MANIFESTS, *(n for n, _ in LOCKFILES), *(n for n, _ in PY_MANAGERS), *COMPOSE, *MAKEFILES, "Package.swift", "Podfile", "Dockerfile", "gradlew", "build.gradle", "build.gradle.kts"}
    return paths.basename(path).isin(*sorted(names)) | path.rlike(r"\.(sln|csproj)\z|\.(xcodeproj|xcworkspace)/[^/]+\z")


def project_roots(files: DataFrame) -> DataFrame:
    """Folders other than the top that hold a manifest and are no test folders, outermost first."""
    path = F.col("path")
    found = files.filter(paths.basename(path).isin(*MANIFESTS) & (paths.dirname(path) != ".") & ~is_test(F.concat(paths.dirname(path), F.lit("/x")))).select(paths.dirname(path).alias("root")).distinct()
    return found.orderBy(F.size(F.split("root", "/")), paths.collated(F.col("root")))


def manifests(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, name, text): each text (path, text) under every project that may read it: the top, and roots up to three folders above it."""
    top = texts.select(F.lit(".").alias("root"), F.col("path").alias("name"), "text")
    up = texts.select("path", "text", F.explode(F.filter(paths.ancestors(F.col("path")), lambda a: a["depth"] > 0)).alias("a"))
    below = up.join(roots, F.col("a.dir") == F.col("root")).select("root", F.expr("substring(path, length(root) + 2)").alias("name"), "text")
    return top.unionByName(below).filter(F.size(F.split("name", "/")) <= 4)


def facts(manifests: DataFrame, name: str = "") -> DataFrame:
    """SCHEMA rows for manifests (root, name, text); a label that a root repeats counts once. name: the top project's own, if no manifest has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))
        rows: list[tuple] = []
        for root, group in groupby(files, key=itemgetter(0)):
            rows += [(root, k, *r) for k, r in enumerate(project_facts({n: text for _, n, text in group}, name if root == "." else ""))]
            if len(rows) >= BATCH_ROWS:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [("root", pa.string()), ("ord", pa.int32()), *((n, pa.string()) for n in ("fact", "label", "source", "runs", "note"))]
        return pa.RecordBatch.from_arrays([pa.array(column, t) for column, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], names=[n for n, _ in types])

    # a root's files come one after another, so that a call has many roots: a group of its own for each costs more than its facts
    return manifests.select("root", "name", "text").repartition("root").sortWithinPartitions("root").mapInArrow(run, SCHEMA)


def merged(facts: DataFrame) -> DataFrame:
    """Facts of the top project with those of nested ones: (ord, fact, label, source, runs, note), ord over all.

    A nested label counts only where no project before has it; nested commands get the `cd` they need, sources and targets
    the folder. Names and descriptions of nested projects are left out.
    """
    nested = F.col("root") != "."
    home = F.when(F.col("root").contains(" "), F.concat(F.lit('"'), F.col("root"), F.lit('"'))).otherwise(F.col("root"))
    label = F.when(nested & (F.col("fact") == "command"), F.concat(F.lit("cd "), home, F.lit(" && "), F.col("label"))).otherwise(F.col("label"))
    runs = F.when(nested & (F.col("fact") == "entry") & ~F.col("runs").contains(":"), F.concat("root", F.lit("/"), F.regexp_replace("runs", r"^\./", ""))).otherwise(F.col("runs"))
    source = F.when(nested, F.concat("root", F.lit("/"), F.col("source"))).otherwise(F.col("source"))
    order = [F.when(nested, F.size(F.split("root", "/"))).otherwise(0), paths.collated(F.col("root")), F.col("ord")]
    # a repository's facts: hundreds of rows at most for each of its projects
    rows = facts.filter(~nested | ~F.col("fact").isin("name", "description")).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    again = F.row_number().over(Window.partitionBy("fact", "label").orderBy("place"))
    rows = rows.withColumn("again", again).filter((F.col("fact") != "stack") | (F.col("again") == 1))
    return rows.select(F.col("place").alias("ord"), "fact", label.alias("label"), source.alias("source"), runs.alias("runs"), "note")


def rank_commands(commands: DataFrame, n: int = MAX_COMMANDS) -> DataFrame:
    """The first n commands (ord, label): those whose last word is a core task first, in the core's order, then as given."""
    place = F.array_position(F.array(*map(F.lit, CORE)), F.element_at(F.split("label", r"\s+"), -1))
    return commands.withColumn("rank", F.when(place > 0, place).otherwise(len(CORE) + 1)).orderBy("rank", "ord").limit(n)


def stack_by_source(facts: DataFrame) -> DataFrame:
    """(ord, source, labels) of the stack: labels of one source together, both in the order of their first mention."""
    return facts.filter("fact = 'stack'").groupBy("source").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("x")).select("ord", "source", F.col("x.label").alias("labels"))


def dependency_names(texts: DataFrame) -> DataFrame:
    """(name) of the dependencies of every package.json among texts (path, text)."""
    given = texts.filter(paths.basename(F.col("path")) == "package.json")
    each = F.array(*[F.map_keys(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>")) for k in ("dependencies", "devDependencies", "peerDependencies")])
    return given.select(F.explode(F.flatten(F.transform(each, lambda x: F.coalesce(x, F.array().cast("array<string>"))))).alias("name")).distinct()


def scripts(texts: DataFrame) -> DataFrame:
    """(dir, kind, name) of package scripts and make targets among texts (path, text)."""
    path = F.col("path")
    package = texts.filter(paths.basename(path) == "package.json").select(paths.dirname(path).alias("dir"), F.lit("package").alias("kind"), F.explode(F.map_keys(F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>"))).alias("name"))
    make = texts.filter(paths.basename(path) == "Makefile").select(paths.dirname(path).alias("dir"), F.lit("make").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^([A-Za-z0-9][\w.-]*)\s*:(?![:=])"), F.lit(1))).alias("name"))
    return package.unionByName(make).distinct()
