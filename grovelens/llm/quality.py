r"""Quality rules: a threshold table compiled into one projection of text ratios; no user function, no shuffle.

A word is a maximal run of characters other than space and \t \n \x0b \f \r. MEASURES names the quantities, RULES
bounds some of them; `judge` evaluates every rule on every text in one pass. The words of repeated three-word windows are
found by sorting one long array for each text: the upper bits hold the window's hash, the lower ones its position, and
equal neighbours are compared word by word, so a hash collision never counts as a repetition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in a is that it for was with as on be by this are from or "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine "
    "le la les et des en un une du est que pour dans qui par sur pas "
    "el los las de que y por con para una su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= measure <= high, or if it has fewer words than `words`, where a ratio says little."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    words: int = 0


#: The contract's base rules.
BASE_RULES = (
    Rule("words", "n_words", low=50),
    Rule("repeated_windows", "repeat_ratio", high=0.5),
)
#: The method's own.
RULES = (
    Rule("symbols", "symbol_ratio", high=0.3),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("word_length", "mean_word_length", low=2, high=15),
    Rule("longest_word", "longest_word", high=1000),
    Rule("alphabetic_words", "alphabetic_ratio", low=0.5),
    Rule("capitals", "capital_ratio", high=0.6),
    Rule("exclamations", "exclamation_ratio", high=0.5),
    Rule("stop_words", "stop_word_ratio", low=0.01, words=100),
    Rule("bullets", "bullet_ratio", high=0.9),
    Rule("ellipses", "ellipsis_ratio", high=0.5),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _occurrences(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", "")).cast("long")


def keyed_windows(words: Column, n: Column) -> Column:
    """The three-word windows of the array `words` of size n, sorted: hash above, position in as many low bits as n has."""
    shift = lambda way, x: F.call_function(way, x, F.length(F.bin(n)))
    at = lambda i: F.get(words, i)
    window = lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))
    keyed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: shift("shiftleft", shift("shiftright", window(i))).bitwiseOR(i.cast("long")))
    return F.sort_array(F.when(n > 3, keyed).otherwise(F.array().cast("array<bigint>")))


def _place(key: Column, n: Column) -> Column:
    bits = F.length(F.bin(n))
    return key.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one struct column `m` of all measures; a null text has no words and no lines."""
    name = "__quality_"
    df = docs.withColumn(name + "text", F.coalesce(F.col(text), F.lit("")))
    body = F.col(name + "text")
    trimmed = F.btrim(body, F.lit(BLANKS))
    df = df.withColumn(name + "words", F.when(F.length(trimmed) > 0, F.split(trimmed, SPLIT)).otherwise(F.array().cast("array<string>")))
    words = F.col(name + "words")
    df = df.withColumns({name + "n": F.size(words), name + "lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n, lines = F.col(name + "n"), F.col(name + "lines")
    df = df.withColumn(name + "keyed", keyed_windows(words, n))
    keyed = F.col(name + "keyed")

    def twice(k: Column) -> Column:
        now, before = F.get(keyed, k), F.get(keyed, k - 1)
        low = F.call_function("shiftright", now.bitwiseXOR(before), F.length(F.bin(n))) == 0
        i, j = _place(now, n), _place(before, n)
        same = [F.get(words, i + d) == F.get(words, j + d) for d in range(3)]
        return low & same[0] & same[1] & same[2]

    df = df.withColumn(name + "twice", F.when(n > 3, F.filter(F.sequence(F.lit(1), n - 3), twice)).otherwise(F.array().cast("array<int>")))
    pairs = F.col(name + "twice")
    starts = F.array_distinct(F.concat(F.transform(pairs, lambda k: _place(F.get(keyed, k), n)), F.transform(pairs, lambda k: _place(F.get(keyed, k - 1), n))))
    covered = F.when(F.size(pairs) > 0, F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))).otherwise(0)

    squeezed = body
    for c in BLANKS:
        squeezed = F.replace(squeezed, F.lit(c), F.lit(""))
    blanks = F.octet_length(body) - F.octet_length(squeezed)
    df = df.withColumns(
        {
            name + "n_repeat": covered.cast("long"),
            name + "chars": (F.length(body) - blanks).cast("long"),
            name + "symbols": _occurrences(body, "#*$%&|<>"),
            name + "capitals": _occurrences(body, "A-Z"),
            name + "small": _occurrences(body, "a-z"),
            name + "exclamations": _occurrences(body, "!"),
            name + "alphabetic": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
            name + "stops": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
            name + "longest": F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)),
        }
    )
    c = {k: F.col(name + k) for k in ("n_repeat", "chars", "symbols", "capitals", "small", "exclamations", "alphabetic", "stops", "longest")}
    n_lines, dup = F.size(lines), F.size(lines) - F.size(F.array_distinct(lines))
    m = F.struct(
        n.cast("long").alias("n_words"),
        c["chars"].alias("word_chars"),
        c["symbols"].alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
        c["n_repeat"].alias("n_repeat_words"),
        _ratio(c["n_repeat"], n).alias("repeat_ratio"),
        _ratio(c["symbols"], n).alias("symbol_ratio"),
        _ratio(dup, n_lines).alias("dup_line_ratio"),
        F.when(n > 0, c["chars"] / n).otherwise(F.lit(0.0)).alias("mean_word_length"),
        c["longest"].cast("long").alias("longest_word"),
        _ratio(c["alphabetic"], n).alias("alphabetic_ratio"),
        _ratio(c["capitals"], c["capitals"] + c["small"]).alias("capital_ratio"),
        _ratio(c["exclamations"], n).alias("exclamation_ratio"),
        _ratio(c["stops"], n).alias("stop_word_ratio"),
        _ratio(F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\t]*[-*•]"))), n_lines).alias("bullet_ratio"),
        _ratio(F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\t\\r]*$"))), n_lines).alias("ellipsis_ratio"),
    )
    return df.withColumn("m", m).drop(*[x for x in df.columns if x.startswith(name)])


def passes(rule: Rule, m: str = "m") -> Column:
    value, ok = F.col(f"{m}.{rule.measure}"), F.lit(True)
    if rule.low is not None:
        ok = ok & (value >= rule.low)
    if rule.high is not None:
        ok = ok & (value <= rule.high)
    return ok | (F.col(f"{m}.n_words") < rule.words) if rule.words else ok


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and failed (names of the rules that a text breaks, in table order).

    One row for each row of docs, repeated rows and null ids too; a null or empty text has no words and fails the base
    rules; an empty table gives an empty result; columns other than doc_id and text are ignored. A value at a threshold passes.
    A text is measured whole, with arrays of its words: some 40 bytes a word.
    """
    df = measures(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    names = F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull())
    base_failed = ~F.lit(True)
    for r in base:
        base_failed = base_failed | ~passes(r)
    out = df.select("doc_id", *[F.col(f"m.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed.alias("base_failed"), names.alias("failed"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.size("failed") == 0).alias("kept"), F.array_join("failed", ",").alias("failed"))
