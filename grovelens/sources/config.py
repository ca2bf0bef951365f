"""The configuration of a tree and the decisions on its conventions: small YAML files, read and checked on the driver.

An unknown key is an error, so that a typing mistake never passes as a setting.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession

FOLDER = ".grovelens"
CONFIG = "config.yaml"
DECISIONS = "conventions.yaml"
STATE = "graph"


class ConfigError(ValueError):
    pass


@dataclass
class Artifact:
    path: str
    sections: list[str] | None = None
    modules: list[str] = field(default_factory=list)
    title: str | None = None
    enabled: bool = True


@dataclass
class Config:
    version: int | None = None
    agents: list[str] | None = None
    claude_adapter: bool | None = None
    modules: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    artifacts: list[Artifact] | None = None
    drift_files: list[str] = field(default_factory=list)
    drift_ignore: list[str] = field(default_factory=list)
    found: bool = False


def _kind(value: object) -> str:
    return {dict: "a mapping", list: "a list", str: "text", bool: "true or false", int: "a number", type(None): "nothing"}.get(type(value), "a value")


class _Reader:
    """Collects what is wrong with a document instead of stopping at the first fault."""

    def __init__(self) -> None:
        self.faults: list[str] = []

    def mapping(self, value: object, at: str, allowed: set[str]) -> dict:
        if not isinstance(value, dict):
            self.faults.append(f"{at or '(root)'}: expected a mapping, got {_kind(value)}")
            return {}
        for key in value:
            if key not in allowed:
                self.faults.append(f"{f'{at}.' if at else ''}{key}: unknown setting")
        return value

    def value(self, source: dict, key: str, at: str, kind: type, default: object = None) -> object:
        found = source.get(key, default)
        if found is not default and (not isinstance(found, kind) or (kind is int and isinstance(found, bool))):
            self.faults.append(f"{at}{key}: expected {_kind(kind())}, got {_kind(found)}")
            return default
        return found

    def texts(self, source: dict, key: str, at: str, default: object = None) -> list[str] | None:
        found = source.get(key, default)
        if found is default:
            return default
        if not isinstance(found, list) or any(not isinstance(x, str) or not x for x in found):
            self.faults.append(f"{at}{key}: expected a list of texts")
            return default
        return found


def parse_config(raw: object, agents: tuple[str, ...] = ("claude", "gemini")) -> Config:
    r = _Reader()
    doc = r.mapping({} if raw is None else raw, "", {"version", "agents", "adapters", "modules", "ignore", "artifacts", "drift"})
    config = Config(version=r.value(doc, "version", "", int), agents=r.texts(doc, "agents", ""), ignore=r.texts(doc, "ignore", "", []) or [])
    for name in config.agents or []:
        if name not in agents:
            r.faults.append(f"agents: unknown tool {name!r}, one of {', '.join(agents)} is expected")
    if "adapters" in doc:
        inner = r.mapping(r.mapping(doc["adapters"], "adapters", {"claude"}).get("claude"), "adapters.claude", {"enabled"})
        config.claude_adapter = r.value(inner, "enabled", "adapters.claude.", bool, True)
    for k, item in enumerate(r.value(doc, "modules", "", list, []) or []):
        entry = r.mapping(item, f"modules.{k}", {"path", "name"})
        r.value(entry, "name", f"modules.{k}.", str)
        if path := r.value(entry, "path", f"modules.{k}.", str):
            config.modules.append(path)
        else:
            r.faults.append(f"modules.{k}.path: is required")
    if "artifacts" in doc:
        config.artifacts = []
        for k, item in enumerate(r.value(doc, "artifacts", "", list, []) or []):
            at = f"artifacts.{k}"
            entry = r.mapping(item, at, {"path", "sections", "modules", "title", "enabled"})
            path = r.value(entry, "path", f"{at}.", str)
            if not path:
                r.faults.append(f"{at}.path: is required")
                continue
            config.artifacts.append(Artifact(path, r.texts(entry, "sections", f"{at}."), r.texts(entry, "modules", f"{at}.", []) or [], r.value(entry, "title", f"{at}.", str), r.value(entry, "enabled", f"{at}.", bool, True)))
    drift = r.mapping(doc.get("drift", {}), "drift", {"files", "ignore"})
    config.drift_files, config.drift_ignore = (r.texts(drift, key, "drift.", []) or [] for key in ("files", "ignore"))
    if r.faults:
        raise ConfigError(f"{FOLDER}/{CONFIG} is invalid:\n" + "\n".join(f"  - {x}" for x in r.faults))
    return config


def _yaml(root: str, name: str) -> object:
    with open(os.path.join(root, FOLDER, name), encoding="utf-8") as f:
        try:
            return yaml.safe_load(f)
        except yaml.YAMLError as e:
            raise ConfigError(f"{FOLDER}/{name} is not valid YAML: {e}") from e


def load_config(root: str) -> Config:
    """The configuration of a tree; all defaults, with found False, where it has none."""
    if not os.path.exists(os.path.join(root, FOLDER, CONFIG)):
        return Config()
    config = parse_config(_yaml(root, CONFIG))
    config.found = True
    return config


def write_own(root: str, name: str, text: str) -> bool:
    """Write a file of the tool's folder; False if it holds that text already."""
    place = os.path.join(root, FOLDER, name)
    os.makedirs(os.path.dirname(place), exist_ok=True)
    if os.path.exists(place):
        with open(place, encoding="utf-8") as f:
            if f.read() == text:
                return False
    temporary = f"{place}.{os.getpid()}.tmp"
    with open(temporary, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(temporary, place)
    return True


def ensure_ignore(root: str) -> bool:
    """The tool's own ignore file, which keeps the state out of commits; False if there is one."""
    if os.path.exists(os.path.join(root, FOLDER, ".gitignore")):
        return False
    return write_own(root, ".gitignore", f"# A cache that the next full scan makes again.\n{STATE}/\n")


def read_decisions(root: str) -> dict[str, list[str]] | None:
    """{confirmed, rejected}: ids of conventions; None without a file."""
    if not os.path.exists(os.path.join(root, FOLDER, DECISIONS)):
        return None
    doc, out = _yaml(root, DECISIONS) or {}, {}
    for key in ("confirmed", "rejected"):
        value = doc.get(key) if isinstance(doc, dict) else None
        if value is not None and (not isinstance(value, list) or any(not isinstance(x, str) for x in value)):
            raise ConfigError(f"{FOLDER}/{DECISIONS}: `{key}` must be a list of convention ids.")
        out[key] = value or []
    return out


def write_decisions(root: str, decisions: dict[str, list[str]]) -> bool:
    ordered = {key: sorted(set(decisions.get(key, ()))) for key in ("confirmed", "rejected")}
    head = "# Decisions on conventions, to be committed: confirmed ones are written into AGENTS.md, rejected ones are not proposed again.\n"
    return write_own(root, DECISIONS, head + yaml.safe_dump(ordered, sort_keys=False, width=120, allow_unicode=True))


def decisions_frame(spark: SparkSession, decisions: dict[str, list[str]] | None) -> DataFrame:
    """(id, status)."""
    return spark.createDataFrame([(i, status) for status, ids in (decisions or {}).items() for i in ids], "id string, status string")


def without_comments(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON; strings stay as they are."""
    tokens = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
    bare = tokens.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    commas = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', re.S)
    return commas.sub(lambda m: m[1] or "", bare)


def path_aliases(texts: dict[str, str]) -> list[tuple[str, str]]:
    """(prefix, target folder) of a compiler configuration's paths, longest prefix first; texts: file name to text.

    The first of tsconfig.json and jsconfig.json that is there counts. Only `x*` to a first target `y*` is an alias.
    """
    name = next((n for n in ("tsconfig.json", "jsconfig.json") if n in texts), None)
    if name is None:
        return []
    try:
        options = json.loads(without_comments(texts[name])).get("compilerOptions") or {}
        found = []
        for key, targets in (options.get("paths") or {}).items():
            if key.endswith("*") and isinstance(targets, list) and targets and targets[0].endswith("*"):
                target = posixpath.normpath(posixpath.join(options.get("baseUrl") or ".", targets[0][:-1] or "."))
                found.append((key[:-1], "" if target == "." else f"{target}/"))
    except (ValueError, AttributeError, TypeError):
        return []
    return sorted(found, key=lambda a: -len(a[0]))


def dart_package(pubspec: str | None) -> str | None:
    m = re.search(r"(?m)^name:\s*([\w-]+)", pubspec or "")
    return m[1] if m else None
