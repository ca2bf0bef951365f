"""Languages of files by extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label of a language, and its extensions.
LANGUAGES = {
    "typescript": ("TypeScript", "ts tsx mts cts"),
    "javascript": ("JavaScript", "js jsx mjs cjs"),
    "python": ("Python", "py"),
    "swift": ("Swift", "swift"),
    "kotlin": ("Kotlin", "kt kts"),
    "java": ("Java", "java"),
    "dart": ("Dart", "dart"),
    "go": ("Go", "go"),
    "rust": ("Rust", "rs"),
    "csharp": ("C#", "cs"),
    "c": ("C", "c h"),
    "cpp": ("C++", "cc cpp cxx hpp"),
    "objective-c": ("Objective-C", "m mm"),
    "ruby": ("Ruby", "rb"),
    "php": ("PHP", "php"),
    "scala": ("Scala", "scala"),
    "elixir": ("Elixir", "ex exs"),
    "vue": ("Vue", "vue"),
    "svelte": ("Svelte", "svelte"),
    "jupyter": ("Jupyter", "ipynb"),
}
#: Languages whose symbols and imports are extracted.
PARSED = ("typescript", "javascript", "python", "dart")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[key]


def language_of(path: Column) -> Column:
    """The language of a file, null if unknown; declaration files (.d.ts) have none. A leading dot of a name starts no extension."""
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1))
    return F.when(~path.endswith(".d.ts"), _lookup({e: k for k, (_, es) in LANGUAGES.items() for e in es.split()}, extension))


def label(language: Column) -> Column:
    return _lookup({k: v[0] for k, v in LANGUAGES.items()}, language)


def is_parsed(language: Column) -> Column:
    return language.isin(*PARSED)
