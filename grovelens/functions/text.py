"""Scalar expressions over names, code and prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Banner of generated files, byte and line-length limits (fixed values).
GENERATED = r"(?i)@generated\b|code generated .*do not edit|auto-?generated|this file (was|is) (automatically )?generated|do not edit (this file|manually)"
MINIFIED_BYTES = 10_240
MINIFIED_LINE = 300
MAX_PARSE_BYTES = 524_288
MAX_SUMMARY = 160
#: Forms of test files' names: expression, style, how it is written in a statement (fixed values).
TEST_STYLES = (
    (r"\.test\.[cm]?[jt]sx?\z", "dot-test", "`*.test.*`"),
    (r"\.spec\.[cm]?[jt]sx?\z", "dot-spec", "`*.spec.*`"),
    (r"(^|/)test_[^/]+\.py\z", "test-prefix", "`test_*.py`"),
    (r"_test\.py\z", "test-suffix", "`*_test.py`"),
)
#: Words that mark license or tool text, not a description (fixed value).
NO_SUMMARY = r"(?i)\bcopyright\b|\blicen[cs]e\b|eslint-|@ts-|prettier-ignore"
#: Blanks of a regular expression's \s where text is Unicode, which Java's own \s is not.
BLANK = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def minified(text: Column) -> Column:
    """At least MINIFIED_BYTES and over MINIFIED_LINE bytes a line."""
    size = F.octet_length(text)
    lines = size - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return (size >= MINIFIED_BYTES) & (size / lines > MINIFIED_LINE)


def looks_generated(text: Column) -> Column:
    """A generator's banner within the first 8 lines of the first 1024 bytes, or minified text."""
    start = F.substring(text.cast("binary"), 1, 1024)
    head = F.array_join(F.slice(F.split(start.cast("string"), "\n"), F.lit(1), F.lit(8)), "\n")
    return head.rlike(GENERATED) | minified(text)


def parse_status(text: Column, parsed_language: Column) -> Column:
    """generated, too-large, parsed or file-only; `error` is up to the parser."""
    return F.when(looks_generated(text), "generated").when(F.octet_length(text) > MAX_PARSE_BYTES, "too-large").when(parsed_language, "parsed").otherwise("file-only")


def _shortened(text: Column) -> Column:
    """The first sentence of a text on one line, at most MAX_SUMMARY characters; null if it is empty."""
    sentence = F.coalesce(F.nullif(F.regexp_extract(text, rf"^(.+?[.!?])(?:{BLANK}|\z)", 1), F.lit("")), text)
    cut = F.concat(F.regexp_replace(F.substring(sentence, 1, MAX_SUMMARY - 1), rf"{BLANK}+\z", ""), F.lit("…"))
    return F.when(text != "", F.when(F.length(sentence) > MAX_SUMMARY, cut).otherwise(sentence))


def first_sentence(text: Column) -> Column:
    """The first sentence with links and blanks reduced, at most MAX_SUMMARY characters; null for license and tool text."""
    plain = F.regexp_replace(F.regexp_replace(text, rf"\{{@link{BLANK}+([^}}|\s\u00A0\u2028\u2029\uFEFF]+)[^}}]*\}}", "$1"), r"\[([^\]]+)\]\([^)]*\)", "$1")
    flat = F.trim(F.regexp_replace(plain, f"{BLANK}+", " "))
    return F.when(~flat.rlike(NO_SUMMARY), _shortened(flat))


def readme_summary(text: Column) -> Column:
    """The first sentence of a README's first paragraph that is no heading, image, badge or HTML."""
    paragraphs = F.transform(F.split(text, rf"\r?\n{BLANK}*\r?\n"), lambda p: F.regexp_replace(p, rf"\A{BLANK}+|{BLANK}+\z", ""))
    first = F.get(F.filter(paragraphs, lambda p: (p != "") & ~p.rlike(r"\A(#|!\[|<|\[!\[)")), F.lit(0))
    plain = F.regexp_replace(F.regexp_replace(first, r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]+)\]\([^)]*\)", "$1")
    return _shortened(F.trim(F.regexp_replace(F.regexp_replace(plain, f"{BLANK}+", " "), "[*_`]", "")))


def content_hash12(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def file_name_style(stem: Column) -> Column:
    """kebab-case, snake_case, PascalCase, camelCase, in that order of tests; null for a single word, which fits every style."""
    return (
        F.when(stem.rlike(r"^[a-z0-9]+(-[a-z0-9]+)+\z"), "kebab-case")
        .when(stem.rlike(r"^[a-z0-9]+(_[a-z0-9]+)+\z"), "snake_case")
        .when(stem.rlike(r"^[A-Z][a-z0-9]+([A-Z][a-z0-9]*)+\z"), "PascalCase")
        .when(stem.rlike(r"^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+\z"), "camelCase")
    )


def test_name_style(path: Column) -> Column:
    """dot-test, dot-spec, test-prefix, test-suffix or null, by the first of the forms that a test file's path has."""
    styled = F.when(path.rlike(TEST_STYLES[0][0]), TEST_STYLES[0][1])
    for expression, style, _ in TEST_STYLES[1:]:
        styled = styled.when(path.rlike(expression), style)
    return styled


def closeness(name: Column, option: Column) -> Column:
    """Edit distance, or a little over one if one of the two is a prefix of the other."""
    prefix = name.startswith(option) | option.startswith(name)
    near = F.when(prefix, 1 + F.abs(F.length(name) - F.length(option)) / F.lit(100.0))
    return F.least(F.levenshtein(name, option).cast("double"), near)
