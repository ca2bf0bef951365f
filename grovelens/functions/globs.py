"""Ignore patterns and folder globs, compiled on the driver into regular expressions that run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from grovelens.functions import paths

# Dependency trees, build output, caches and tool state that no project is described by.
DEFAULT_IGNORES = (
    ".git/ .grovelens/ node_modules/ bower_components/ dist/ build/ out/ coverage/ .next/ .nuxt/ .svelte-kit/ .turbo/ .cache/ .parcel-cache/ .vite/ "
    ".angular/ .astro/ .output/ .vercel/ .netlify/ .wrangler/ .docusaurus/ .serverless/ .terraform/ .yarn/ .pnpm-store/ storybook-static/ .expo/ "
    "vendor/ venv/ .venv/ __pycache__/ .mypy_cache/ .pytest_cache/ .ruff_cache/ .tox/ .ipynb_checkpoints/ Pods/ DerivedData/ .gradle/ .dart_tool/ "
    "target/ *.min.js *.bundle.js"
).split()


def _segment(glob: str) -> str:
    """A glob without slashes as a regular expression."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        if c == "[" and (end := glob.find("]", at + 2)) > 0:
            inner = glob[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]"
            at = end
        elif c == "\\" and at + 1 < len(glob):
            at += 1
            out += re.escape(glob[at])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        at += 1
    return out


def pattern(line: str) -> tuple[str, bool] | None:
    """(expression, re-includes) of one line of an ignore file; None for a comment or blank.

    The expression is to be found in a path from its start; folders are written with a slash at their end.
    """
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    folder, body = line.endswith("/"), line.rstrip("/")
    anchored, body = "/" in body, body.lstrip("/")
    if not body:
        return None
    out = "" if anchored else "(?:.*/)?"
    parts = body.split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _segment(part) + ("" if last else "/")
    return f"^{out}{'/' if folder else '/?'}\\z", back


def compiled(lines: Iterable[str]) -> list[tuple[str, bool]]:
    """Patterns in order, neighbours of one kind merged into one expression."""
    runs: list[tuple[list[str], bool]] = []
    for found in filter(None, map(pattern, lines)):
        if runs and runs[-1][1] == found[1]:
            runs[-1][0].append(found[0])
        else:
            runs.append(([found[0]], found[1]))
    return [("|".join(x), back) for x, back in runs]


def ignores(path: str, rules: list[tuple[str, bool]]) -> bool:
    """For one path on the driver; a folder ends with a slash. A file in an ignored folder can't be included again."""
    parts = path.rstrip("/").split("/")
    levels = ["/".join(parts[: k + 1]) + "/" for k in range(len(parts) - 1)] + [path]
    for level in levels:
        hit = next((not back for e, back in reversed(rules) if re.search(e.replace("\\z", "\\Z"), level)), False)
        if hit:
            return True
    return False


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """ignores() as a column: some folder above the path, or the path, whose last fitting rule excludes it."""
    if not rules:
        return F.lit(False)
    above = F.transform(F.slice(paths.ancestors(F.rtrim(path, F.lit("/"))), 2, 1_000_000), lambda a: F.concat(a["dir"], F.lit("/")))

    def hit(level: Column) -> Column:
        said = None
        for expression, back in reversed(rules):
            said = F.when(level.rlike(expression), not back) if said is None else said.when(level.rlike(expression), not back)
        return said.otherwise(False)

    return F.exists(F.concat(above, F.array(path)), hit)


def folder_glob(glob: str) -> tuple[list[str | None], bool]:
    """Expressions of a folder glob's segments (None fits any), and whether it ends with `**`."""
    parts = glob.rstrip("/").split("/")
    deep = parts[-1] == "**"
    return [None if p in ("*", "**") else f"^{_segment(p)}\\z" for p in (parts[:-1] if deep else parts)], deep


def matched_folder(folders: Column, glob: str) -> Column:
    """The leading folders (an array) that a glob covers, joined; null where it doesn't fit. `src/*` covers one level, `src/**` is `src`."""
    segments, _ = folder_glob(glob)
    if not segments:
        return F.lit(None).cast("string")
    fits = F.size(folders) >= len(segments)
    for k, expression in enumerate(segments):
        if expression is not None:
            fits = fits & F.coalesce(F.get(folders, F.lit(k)).rlike(expression), F.lit(False))
    return F.when(fits, F.array_join(F.slice(folders, 1, len(segments)), "/"))


def matches_module(module: Column, glob: str) -> Column:
    """Whether a whole module id fits a glob; `src/**` fits `src` and everything below it."""
    segments, deep = folder_glob(glob)
    parts = F.split(module, "/")
    if deep and not segments:
        return F.lit(True)
    found = matched_folder(parts, glob).isNotNull()
    return found if deep else found & (F.size(parts) == len(segments))
