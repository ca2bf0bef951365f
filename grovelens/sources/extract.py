"""Symbols, imports and summaries of source files, in worker processes; `extract` runs them over a frame of texts.

Python is read with `ast`, and by column-0 lines where `ast` rejects a file. Dart follows the line grammar of its top
level. JavaScript and TypeScript go through a small scanner that blanks out comments, strings, templates and nested
blocks, after which the top-level statements are matched.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, symbols array<struct<kind:string,name:string,exported:boolean,is_default:boolean,line:int,signature_hash:string>>, imports array<struct<specifier:string,names:array<string>>>, doc string, failed boolean"


@dataclass
class Parsed:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    doc: str | None = None

    def add(self, kind: str, name: str, line: int, body: str, exported: bool = True, default: bool = False) -> None:
        self.symbols.append({"kind": kind, "name": name, "exported": exported, "is_default": default, "line": line, "signature_hash": hashlib.sha1(body.encode()).hexdigest()})

    def use(self, specifier: str, names: list[str]) -> None:
        self.imports.append({"specifier": specifier, "names": names})


def parse_python(text: str) -> Parsed:
    out = Parsed()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _python_lines(text)
    out.doc = ast.get_docstring(tree)
    declared = None
    for node in tree.body:
        body = ast.get_source_segment(text, node) or ""
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.add("function", node.name, node.lineno, body, not node.name.startswith("_"))
        elif isinstance(node, ast.ClassDef):
            out.add("class", node.name, node.lineno, body, not node.name.startswith("_"))
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name) and target.id == "__all__" and isinstance(node.value, ast.List | ast.Tuple):
                    declared = {x.value for x in node.value.elts if isinstance(x, ast.Constant)}
                elif isinstance(target, ast.Name) and re.fullmatch(r"_?[A-Z][A-Z0-9_]*", target.id):
                    out.add("variable", target.id, node.lineno, body, not target.id.startswith("_"))
        elif isinstance(node, ast.Import):
            for alias in node.names:
                out.use(alias.name, [])
        elif isinstance(node, ast.ImportFrom):
            out.use("." * node.level + (node.module or ""), [a.name for a in node.names if a.name != "*"])
    if declared is not None:
        for s in out.symbols:
            s["exported"] = s["name"] in declared
    return out


def _python_lines(text: str) -> Parsed:
    out = Parsed()
    if m := re.match(r"(?:\s*(?:#[^\n]*)?\n)*[rRuU]?(\"\"\"|''')(.*?)\1", text, re.S):
        out.doc = m[2].strip()
    for number, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"(?:async\s+)?(def|class)\s+(\w+)", line):
            out.add("function" if m[1] == "def" else "class", m[2], number, line, not m[2].startswith("_"))
        elif m := re.match(r"(_?[A-Z][A-Z0-9_]*)\s*(?::[^=]*)?=(?!=)", line):
            out.add("variable", m[1], number, line, not m[1].startswith("_"))
        elif m := re.match(r"from\s+([.\w]+)\s+import\s+([\w, ]+)", line):
            out.use(m[1], [re.split(r"\s+as\s+", n.strip())[0] for n in m[2].split(",") if n.strip()])
        elif m := re.match(r"import\s+([\w., ]+)", line):
            for n in m[1].split(","):
                out.use(re.split(r"\s+as\s+", n.strip())[0], [])
    return out


def parse_dart(text: str) -> Parsed:
    out, doc, seen_type = Parsed(), [], False
    for number, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"(?:import|export)\s+['\"]([^'\"]+)['\"]", line):
            out.use(m[1], [])
        elif m := re.match(r"(?:(?:abstract|sealed|base|final|interface|mixin)\s+)*(class|enum|mixin|extension|typedef)\s+(\w+)", line):
            kind = {"class": "class", "enum": "enum", "mixin": "class", "extension": "class", "typedef": "type"}[m[1]]
            out.add(kind, m[2], number, "", not m[2].startswith("_"))
            seen_type = True
        if line.startswith("///") and not seen_type and out.doc is None:
            doc.append(line[3:].strip())
        elif doc and out.doc is None:
            out.doc = " ".join(doc)
    return out


def blank_js(text: str) -> str:
    """text with comments and the inside of strings, templates and regular expressions replaced by spaces; lines keep their places."""
    out, i, n, last = [], 0, len(text), ""
    wipe = lambda s: re.sub(r"[^\n]", " ", s)
    while i < n:
        c, two = text[i], text[i : i + 2]
        if two == "//":
            j = text.find("\n", i)
            j = n if j < 0 else j
            out.append(wipe(text[i:j]))
        elif two == "/*":
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
            out.append(wipe(text[i:j]))
        elif c in "'\"`" or (c == "/" and last in "(,=:[!&|?{};\n" + "\0"[not last :]):
            j = i + 1
            bracket = False
            while j < n and (text[j] != c or bracket) and (c == "`" or text[j] != "\n"):
                if c == "/":
                    bracket = text[j] == "[" or (bracket and text[j] != "]")
                j += 2 if text[j] == "\\" else 1
            j = min(n, j + 1)
            # module names are wanted, so plain strings stay
            out.append(text[i:j] if c in "'\"" else wipe(text[i:j]))
            last = c
        else:
            j = i + 1
            out.append(c)
            if not c.isspace():
                last = c
        i = j
    return "".join(out)


def top_level(text: str) -> list[tuple[int, str]]:
    """(line, statement) for each statement outside all braces; a statement holds its own braces."""
    out, depth, start, line, at = [], 0, 0, 1, 1
    string = ""
    for i, c in enumerate(text):
        if string:
            string = "" if c == string or c == "\n" else string
        elif c in "'\"":
            string = c
        elif c in "({[":
            depth += 1
        elif c in ")}]":
            depth = max(0, depth - 1)
        closing = not string and depth == 0 and (c == ";" or c == "\n" or c == "}")
        if closing:
            piece = text[start : i + 1]
            rest = text[i + 1 : i + 200].lstrip()
            goes_on = (c == "}" and re.match(r"from\b|[,;.=(]|as\b", rest)) or (c == "\n" and (re.search(r"[,=({+|&<>?:]\s*$|\b(?:from|extends|implements)\s*$", piece) or rest[:1] in "{.,=|&?:" or not piece.strip()))
            if not goes_on:
                if piece.strip(" \t\n;"):
                    out.append((at, piece.strip()))
                start = i + 1
            if not text[start : i + 1].strip():
                at = line + (c == "\n")
        line += c == "\n"
    if text[start:].strip():
        out.append((at, text[start:].strip()))
    return out


_DECLARED = re.compile(r"(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|type|enum|const\s+enum|const|let|var)\b\s*\*?\s*([A-Za-z_$][\w$]*)?")
_FUNCTION_VALUE = re.compile(r"=\s*(?:async\s*)?(?:function\b|\([^=]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)")


def _names(clause: str) -> list[str]:
    """Imported names of a clause; the default import is called `default`, aliases are dropped."""
    names = [re.split(r"\s+as\s+", x.strip())[0].removeprefix("type ").strip() for part in re.findall(r"\{([^}]*)\}", clause) for x in part.split(",") if x.strip()]
    head = re.sub(r"\{[^}]*\}", "", clause).strip().strip(",").strip()
    return (["default"] if re.match(r"[A-Za-z_$]", head) else []) + names


def parse_js(text: str) -> Parsed:
    out = Parsed()
    if m := re.match(r"\s*/\*\*(.*?)\*/", text, re.S):
        lines = (re.sub(r"^\s*\*\s?", "", x) for x in m[1].lstrip("*").split("\n"))
        out.doc = " ".join(x for x in lines if not x.strip().startswith("@")).strip()
    for line, s in top_level(blank_js(text)):
        if m := re.match(r"(import|export)\b(?:\s+type\b)?(.*?)\bfrom\s*['\"]([^'\"]+)['\"]", s, re.S):
            if m[1] == "import" or "{" in m[2] or "*" in m[2]:
                out.use(m[3], _names(m[2]))
                if m[1] == "export":
                    if star := re.search(r"\*\s+as\s+([\w$]+)", m[2]):
                        out.add("export", star[1], line, s)
                    for x in re.findall(r"\{([^}]*)\}", m[2]):
                        for name in filter(None, (y.strip() for y in x.split(","))):
                            out.add("export", re.split(r"\s+as\s+", name)[-1], line, name)
                continue
        if m := re.match(r"import\s*['\"]([^'\"]+)['\"]", s):
            out.use(m[1], [])
            continue
        if m := re.match(r"(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]", s):
            out.use(m[2], [x.split(":")[0].strip() for x in m[1].strip("{}").split(",") if x.strip()] if m[1][0] == "{" else ["default"])
            continue
        if m := re.match(r"module\.exports\s*=\s*\{([^}]*)\}", s):
            for name in filter(None, (x.split(":")[0].strip() for x in m[1].split(","))):
                out.add("export", name, line, name)
            continue
        if m := re.match(r"(?:module\.)?exports\.([\w$]+)\s*=", s):
            out.add("export", m[1], line, s)
            continue
        if m := re.match(r"export\s*\{([^}]*)\}", s):
            known = {x["name"]: x for x in out.symbols}
            for part in filter(None, (x.strip() for x in m[1].split(","))):
                inner, *as_ = re.split(r"\s+as\s+", part)
                if inner in known and (not as_ or as_[0] == "default"):
                    known[inner] |= {"exported": True, "is_default": bool(as_)}
                else:
                    out.add("export", as_[0] if as_ else inner, line, part)
            continue
        exported = re.match(r"export\b\s*(default\b)?\s*", s)
        rest = s[exported.end() :] if exported else s
        default = bool(exported and exported[1])
        if m := _DECLARED.match(rest):
            kind = {"const": "variable", "let": "variable", "var": "variable"}.get(m[1], "enum" if "enum" in m[1] else m[1])
            if kind == "variable" and _FUNCTION_VALUE.search(rest.split("\n")[0]):
                kind = "function"
            if m[2] or default:
                out.add(kind, m[2] or "default", line, s, bool(exported), default)
        elif default and (m := re.match(r"([\w$]+)\s*;?$", rest)):
            for x in out.symbols:
                if x["name"] == m[1]:
                    x |= {"exported": True, "is_default": True}
    return out


PARSERS = {"python": parse_python, "dart": parse_dart, "typescript": parse_js, "javascript": parse_js}


def extract(files: DataFrame) -> DataFrame:
    """(path, symbols, imports, doc, failed) for files (path, language, text) of a parsed language."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, language, text in zip(frame["path"], frame["language"], frame["text"], strict=True):
                try:
                    p = PARSERS[language](text or "")
                    rows.append((path, p.symbols, p.imports, p.doc, False))
                except Exception:  # noqa: BLE001  a file that no parser survives is a row with failed set
                    rows.append((path, [], [], None, True))
            yield pd.DataFrame(rows, columns=["path", "symbols", "imports", "doc", "failed"])

    return files.filter(files["language"].isin(*PARSERS)).select("path", "language", "text").mapInPandas(run, SCHEMA)


def annotate(files: DataFrame) -> DataFrame:
    """files (path, language, text, status, ...) with symbols, imports, doc and failed, empty where status isn't `parsed`; the text goes."""
    names = [c for c in files.columns if c != "text"]
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "text")
    found = ", ".join(x.strip() for x in SCHEMA.split(",", 1)[1:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for language, text, status in zip(frame["language"], frame["text"], frame["status"], strict=True):
                try:
                    p = PARSERS[language](text or "") if status == "parsed" and isinstance(text, str) else Parsed()
                    made.append((p.symbols, p.imports, p.doc, False))
                except Exception:  # noqa: BLE001  a file that no parser survives is a row with failed set
                    made.append(([], [], None, True))
            out = frame[names].copy()
            for k, column in enumerate(("symbols", "imports", "doc", "failed")):
                out[column] = [m[k] for m in made]
            yield out

    return files.select(*names, "text").mapInPandas(run, f"{given}, {found}")
