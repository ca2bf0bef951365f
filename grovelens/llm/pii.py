r"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Everything is a column expression: matches by regexp_extract_all, their places from the lengths of what split() leaves
between them. The expressions are written with possessive quantifiers and start only where a match can start, so they take
time in proportion to the text and no recursion, and find what the plain forms find:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)          parts at most 255
    card   [0-9]([\x20-]?[0-9])+                         13 to 19 digits, Luhn
    phone  \+[0-9][\x20().0-9-]+[0-9]                    9 to 15 digits

A match that fails its check is dropped; no shorter one is tried in its place. iban (mod 97), ssn and secret (a
value that looks random, behind a name such as token, or in the form of a known key) are the method's own kinds, kept at a score
of THRESHOLD or more; ssn reaches it only beside a context word.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovelens.llm.common import free_name

THRESHOLD = 0.5
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Characters before and after a span in which context words count.
NEAR = 40
BLOCK = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substring(digits, -1 * i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """True if an IBAN, without spaces, leaves 1."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(s: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n >= 65, (s * 100 + n - 55) % 97).otherwise((s * 10 + n - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(step(s, c))) == 1


#: Values that are assigned to a name of a secret, and the forms of well-known keys.
_SECRET = (
    r"(?i)(?<![A-Za-z])(?:api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|auth[_-]?token|access[_-]?token|client[_-]?secret|secret|token|passwd|password|pwd)"
    r"[\x20\t]{0,4}[\"']?[\x20\t]{0,4}[:=][\x20\t]{0,4}[\"']?[A-Za-z0-9+/_=.-]{16,200}+"
    r"|(?-i)(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,200}+|eyJ[A-Za-z0-9_-]{10,2000}+\.[A-Za-z0-9_-]{10,4000}+\.[A-Za-z0-9_-]{10,2000}+)(?![A-Za-z0-9])"
)


def _random(value: Column) -> Column:
    """Whether a value looks drawn rather than written: 16 characters or more, eight of them different, digits and letters among them."""
    return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # a text without it has no span of this kind
    valid: Callable[[Column], Column]
    score: float
    context: str  # lower-case words that raise the score
    base: bool


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]", lambda x: F.lit(True), 0.9, "mail|contact|write", True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", lambda x: F.forall(F.split(x, r"\."), lambda p: p.cast("double") <= 255), 0.6, r"\bip\b|address|host|server|login", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", lambda x: F.length(_digits(x)).between(13, 19) & luhn(_digits(x)), 0.7, "card|credit|visa|payment|karte|tarjeta|carte", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda x: F.length(_digits(x)).between(9, 15), 0.6, "phone|call|tel|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", lambda x: F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(x, F.lit(" "), F.lit(""))), 0.8, "iban|account|konto|bank", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda x: ~x.rlike("^(000|666|9)|-00-|0000$"), 0.3, r"\bssn\b|social security|taxpayer", False),
    Kind("secret", _SECRET, r"(?i)key|token|secret|passw|pwd|bearer|AKIA|gh[pousr]_|sk-|eyJ", lambda x: _random(F.regexp_replace(x, r"(?i)^[a-z_-]*[\x20\t]*[\"']?[\x20\t]*[:=][\x20\t]*[\"']?", "")), 0.7, "key|token|secret|credential|password", False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, also where body uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(sizes: Column) -> Column:
    """For each element of an int array the sum of those before it; in blocks, so that the work grows by BLOCK for each element."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    numbers = lambda s: F.sequence(F.lit(0), ((F.size(s) - 1) / BLOCK).cast("int"))
    block = lambda s, b: F.slice(s, b * BLOCK + 1, F.lit(BLOCK))

    def summed(s: Column) -> Column:
        def inside(before: Column) -> Column:
            within = lambda b: lambda part: F.transform(part, lambda _, i: F.get(before, b) + total(F.slice(part, F.lit(1), i)))
            return F.flatten(F.transform(numbers(s), lambda b: let(block(s, b), within(b))))

        sums = F.transform(numbers(s), lambda b: total(block(s, b)))
        return let(let(sums, lambda t: F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b)))), inside)

    return let(sizes, lambda s: F.when(F.size(s) > 0, summed(s)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: Column, size: Callable[[Column], Column], make: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """make(match, start, text before, text after) for all matches of pattern in text; start counts by size()."""

    def over(hit: Column, gap: Column) -> Column:
        steps = F.transform(hit, lambda x, i: size(x) + size(F.get(gap, i)))
        place = lambda at: F.transform(hit, lambda x, i: make(x, F.get(at, i) + size(F.get(gap, i)), F.get(gap, i), F.get(gap, i + 1)))
        return let(running_sums(steps), place)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hit: let(F.split(text, pattern, -1), lambda gap: over(hit, gap)))


def _span(k: Kind) -> Callable[[Column, Column, Column, Column], Column]:
    """A match to its span; score is null if the match fails its check."""

    def made(x: Column, start: Column, before: Column, after: Column) -> Column:
        near = F.lower(F.concat_ws(" ", F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR))))
        score = F.when(near.rlike(k.context), min(1.0, k.score + 0.3)).otherwise(k.score)
        return F.struct(F.lit(k.name).alias("kind"), start.alias("start"), (start + F.length(x)).alias("end"), F.when(k.valid(x), score).alias("score"))

    return made


def with_spans(docs: DataFrame, text: str = "text", into: str = "spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with `into`: an array of (kind, start, end, score) by kind in table order, then start; places are code points, end exclusive.

    A null or empty text has none. All other columns stay as they are, repeated rows and ties are each answered, an empty table
    gives an empty one. A text is searched whole, in time linear in its length.
    """
    made = []
    for k in kinds:
        found = matches(F.col(text), F.lit(k.pattern), F.length, _span(k))
        kept = F.filter(found, lambda s: s["score"].isNotNull())
        kept = kept if k.base else F.filter(kept, lambda s: s["score"] >= THRESHOLD)
        made.append(F.when(F.coalesce(F.col(text).rlike(k.gate), F.lit(False)), kept).otherwise(F.array().cast(SPANS)))
    return docs.withColumn(into, F.concat(*made))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; overlapping spans become one, named after the first.

    Rows without a span, null texts among them, stay as they are. size: a column to set to the new length in code points
    wherever a text changed; columns keep their order.
    """
    spans, merged, own = free_name("spans", docs), free_name("merged", docs), F.col(text)
    df = with_spans(docs, text, spans)
    sorted_spans = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), F.upper(s["kind"]).alias("kind"))))
    empty = F.array().cast("array<struct<s:int,e:int,kind:string>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (x["s"] < F.get(acc, F.size(acc) - 1)["e"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(x)))

    df = df.withColumn(merged, F.when(F.size(spans) > 0, F.aggregate(sorted_spans, empty, add)))
    m = F.col(merged)
    before = lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["e"])
    parts = F.transform(m, lambda x, i: F.concat(F.substring(own, before(x, i) + 1, x["s"] - before(x, i)), F.lit("<"), x["kind"], F.lit(">")))
    last = F.get(m, F.size(m) - 1)["e"]
    changed = F.concat(F.array_join(parts, ""), F.substring(own, last + 1, F.length(own)))
    names = docs.columns
    df = df.withColumn(text, F.when(m.isNotNull(), changed).otherwise(own))
    if size in names:
        df = df.withColumn(size, F.when(m.isNotNull(), F.length(text).cast(docs.schema[size].dataType)).otherwise(F.col(size)))
    return df.select(*[F.col(f"`{c}`") for c in names])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end, score) for each row of docs; other columns are ignored."""
    return with_spans(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc_id", "spans")
