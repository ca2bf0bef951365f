r"""License scans: ordered signature rules over a text's words.

A text is reduced to its words, A-Z lower-cased, joined by single spaces, and each rule is a regular expression over that
string. Rules are gated twice: a text without any word of gates() is not normalised at all, and a rule runs only where
its keyword occurs. Of overlapping detections, one that lies within a detection of higher priority (or of the same, if it
is shorter or comes later) is suppressed. Everything is a column expression; nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovelens.llm.common import ascii_lower
from grovelens.llm.pii import matches

#: A word of the text as given, before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The contract's phrases and labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class License:
    """label; ids: SPDX identifiers; names: how notices call it; links: words of its address. All as words with single spaces."""

    label: str
    ids: tuple[str, ...]
    names: tuple[str, ...]
    links: tuple[str, ...] = ()


# fmt: off
LICENSES = (
    License("mit", ("mit",), ("mit license", "mit licence", "expat license"), ("opensource org licenses mit",)),
    License("mit-0", ("mit 0",), ("mit no attribution(?: license)?",)),
    License("apache-2.0", ("apache 2 0",), ("apache license(?: version)? 2(?: 0)?", "apache software license(?: version)? 2(?: 0)?"), ("apache org licenses license 2 0",)),
    License("apache-1.1", ("apache 1 1",), ("apache(?: software)? license(?: version)? 1 1",)),
    License("gpl-2.0", ("gpl 2 0(?: only| or later)?",), ("gnu general public license(?: gpl)?(?: as published by the free software foundation either)? version 2", "gpl ?v?2(?: 0)?"), ("gnu org licenses(?: old licenses)? gpl 2 0",)),
    License("gpl-3.0", ("gpl 3 0(?: only| or later)?",), ("gnu general public license(?: gpl)?(?: as published by the free software foundation either)? version 3", "gpl ?v?3(?: 0)?"), ("gnu org licenses gpl 3 0", "gnu org licenses gpl html")),
    License("lgpl-2.1", ("lgpl 2 1(?: only| or later)?",), ("gnu lesser general public license(?: as published by the free software foundation either)? version 2 1", "lgpl ?v?2 1")),
    License("lgpl-3.0", ("lgpl 3 0(?: only| or later)?",), ("gnu lesser general public license(?: as published by the free software foundation either)? version 3", "lgpl ?v?3(?: 0)?"), ("gnu org licenses lgpl 3 0",)),
    License("lgpl", (), ("gnu lesser general public license", "gnu library general public license")),
    License("agpl-3.0", ("agpl 3 0(?: only| or later)?",), ("gnu affero general public license(?: version 3)?", "agpl ?v?3(?: 0)?"), ("gnu org licenses agpl 3 0",)),
    License("gfdl-1.3", ("gfdl 1 3(?: only| or later)?",), ("gnu free documentation license(?: version 1 3)?",), ("gnu org licenses fdl",)),
    License("bsd-2-clause", ("bsd 2 clause",), ("(?:simplified|2 clause|two clause|freebsd) bsd license", "bsd 2 clause(?: license)?"), ("opensource org licenses bsd 2 clause",)),
    License("bsd-3-clause", ("bsd 3 clause",), ("(?:new|revised|modified|3 clause|three clause) bsd license", "bsd 3 clause(?: license)?"), ("opensource org licenses bsd 3 clause",)),
    License("bsd-4-clause", ("bsd 4 clause",), ("(?:original|4 clause|four clause) bsd license",)),
    License("bsd", (), ("bsd license", "bsd style license", "berkeley software distribution license")),
    License("0bsd", ("0bsd",), ("zero clause bsd(?: license)?", "bsd zero clause license")),
    License("isc", ("isc",), ("isc license",), ("opensource org licenses isc",)),
    License("mpl-1.1", ("mpl 1 1",), ("mozilla public license(?: version| v)? 1 1",)),
    License("mpl-2.0", ("mpl 2 0",), ("mozilla public license(?: version| v)? 2(?: 0)?", "mpl ?v?2(?: 0)?"), ("mozilla org mpl 2 0",)),
    License("mpl", (), ("mozilla public license",)),
    License("epl-1.0", ("epl 1 0",), ("eclipse public license(?: version| v)? 1(?: 0)?",), ("eclipse org legal epl v10",)),
    License("epl-2.0", ("epl 2 0",), ("eclipse public license(?: version| v)? 2(?: 0)?",), ("eclipse org legal epl 2 0",)),
    License("cddl-1.0", ("cddl 1 0",), ("common development and distribution license(?: version 1 0)?",)),
    License("cpl-1.0", ("cpl 1 0",), ("common public license(?: version 1 0)?",)),
    License("eupl-1.2", ("eupl 1 2",), ("european union public licen[sc]e(?: v(?:ersion)? 1 2)?",)),
    License("artistic-2.0", ("artistic 2 0",), ("artistic license(?: version)? 2(?: 0)?",)),
    License("artistic-1.0", ("artistic 1 0",), ("artistic license(?: version)? 1(?: 0)?",)),
    License("zlib", ("zlib",), ("zlib license", "zlib libpng license")),
    License("boost-1.0", ("bsl 1 0",), ("boost software license(?: version)?(?: 1 0)?",), ("boost org license 1 0",)),
    License("unlicense", ("unlicense",), ("the unlicense",), ("unlicense org",)),
    License("wtfpl", ("wtfpl",), ("do what the fuck you want to public license",), ("wtfpl net",)),
    License("postgresql", ("postgresql",), ("postgresql license",)),
    License("python-2.0", ("python 2 0", "psf 2 0"), ("python software foundation license", "psf license")),
    License("openssl", ("openssl",), ("openssl license",)),
    License("php-3.01", ("php 3 01",), ("php license(?: version)?(?: 3 0?1)?",)),
    License("ruby", ("ruby",), ("ruby license",)),
    License("ofl-1.1", ("ofl 1 1",), ("sil open font license(?: version)?(?: 1 1)?",), ("scripts sil org ofl",)),
    License("odbl-1.0", ("odbl 1 0",), ("open database license(?: odbl)?(?: v?1 0)?",), ("opendatacommons org licenses odbl",)),
    License("odc-by-1.0", ("odc by 1 0",), ("open data commons attribution license",)),
    License("cc0-1.0", ("cc0 1 0",), ("cc0(?: 1 0)?(?: universal)?", "creative commons zero"), ("creativecommons org publicdomain zero",)),
    License("cc-by", ("cc by [1-4] [05]",), ("cc by [1-4] [05]", "creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: license)?"), ("creativecommons org licenses by [1-4]",)),
    License("cc-by-sa", ("cc by sa [1-4] [05]",), ("cc by sa(?: [1-4] [05])?", "creative commons attribution share ?alike(?: [1-4] [05])?"), ("creativecommons org licenses by sa",)),
    License("cc-by-nc", ("cc by nc [1-4] [05]",), ("cc by nc(?: [1-4] [05])?", "creative commons attribution non ?commercial(?: [1-4] [05])?"), ("creativecommons org licenses by nc",)),
    License("cc-by-nd", ("cc by nd [1-4] [05]",), ("cc by nd(?: [1-4] [05])?", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?"), ("creativecommons org licenses by nd",)),
    License("cc-by-nc-sa", ("cc by nc sa [1-4] [05]",), ("cc by nc sa(?: [1-4] [05])?", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"), ("creativecommons org licenses by nc sa",)),
    License("cc-by-nc-nd", ("cc by nc nd [1-4] [05]",), ("cc by nc nd(?: [1-4] [05])?", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?"), ("creativecommons org licenses by nc nd",)),
)
#: Sentences of license texts: (label, pattern, keyword).
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products", "endorse"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "redistribute"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0", "mozilla"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "warranty"),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "hereby"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", "(?:released|placed|dedicated) (?:in ?to|in|to) the public domain", "domain"),
    ("proprietary", "all rights reserved(?: worldwide)?", "reserved"),
    ("proprietary", "(?:confidential and proprietary|proprietary and confidential)", "proprietary"),
)
# fmt: on


@dataclass(frozen=True)
class Rule:
    """A detection of `label`; of overlapping ones, higher priority wins; confidence goes into a text's score."""

    label: str
    pattern: str
    keyword: str
    priority: int
    confidence: float


def _keyword(pattern: str) -> str:
    """The first plain word of a pattern."""
    return pattern.replace("(?:", " ").replace("|", " ").split()[0].strip("()?[]") if pattern[0] not in "([" else ""


def rule_table() -> tuple[Rule, ...]:
    """Identifier tags, notices, addresses and bare names of each license, then the sentences; highest priority first."""
    rules = []
    notice = "(?:licen[sc]ed|released|distributed|published|available|provided|offered) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
    for x in LICENSES:
        rules += [Rule(x.label, f"spdx license identifier {i}", "spdx", 5, 1.0) for i in x.ids]
        rules += [Rule(x.label, f"{notice}{n}", "under", 4, 0.95) for n in x.names]
        rules += [Rule(x.label, f"(?:https? )?(?:www )?{n}", _keyword(n), 3, 0.9) for n in x.links]
        rules += [Rule(x.label, n, _keyword(n), 2, 0.8) for n in x.names]
    rules += [Rule(label, p, k, 1, 0.6 if label == "proprietary" else 0.85) for label, p, k in SENTENCES]
    return tuple(sorted(rules, key=lambda r: -r.priority))


#: Parts of words that most rules need, A-Z lower-cased; gates() adds what the others need. `cc` counts as a word of its own.
GATES = ("licen", "spdx", "gpl", "cc0", "copyright", "warrant", "hereby", "redistribut", "public domain", "creative", "mozilla", "bsd", "mpl", "unlicense", "wtfpl", "reserved", "proprietary", "endorse", "advertising", "opensource", "gnu", "domain", "ofl", "attribution")
LONE = r"(?<![a-z0-9\x{80}-\x{10FFFF}])cc(?![a-z0-9\x{80}-\x{10FFFF}])"


def _needed(pattern: str) -> list[str]:
    """Words, or parts of words, that every match of a pattern holds."""
    if "\\" in pattern:
        return []
    plain = re.sub(r"\[[^\]]*\]", "\x00", pattern)
    while (inner := re.sub(r"\([^()]*\)", "\x00", plain)) != plain:
        plain = inner
    if "|" in plain:
        return []
    return re.sub(r".(?:[?*]|\{[^}]*\})|[\x00.^$+]", " ", plain).split()


def gates(rules: tuple[Rule, ...], phrases: tuple[tuple[str, str], ...]) -> tuple[str, ...] | None:
    """GATES and the keywords of rules and phrases whose matches may hold none of them; None if no text can be ruled out."""
    more = []
    for words, keyword in [*((_needed(r.pattern), r.keyword) for r in rules), *((p.split(), max(p.split(), key=len, default="")) for p, _ in phrases)]:
        if not any(w == "cc" or g in w for w in words for g in GATES):
            word = max(keyword.split(), key=len, default="")
            if not word or not word.isascii():
                return None
            more.append(word)
    return tuple(dict.fromkeys((*GATES, *more)))


_HIT = "array<struct<start:int,end:int,label:string,priority:int,confidence:double>>"


def _places(words: Column, pattern: Column, label: Column, priority: Column, confidence: Column) -> Column:
    """The detections of a rule in words, a string with a space before, between and after them."""
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))

    def made(x: Column, start: Column, before: Column, after: Column) -> Column:
        return F.struct((start - 1).alias("start"), (start + spaces(x)).alias("end"), label.alias("label"), priority.alias("priority"), confidence.alias("confidence"))

    return matches(words, pattern, spaces, made)


def _whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def scan(docs: DataFrame, rules: tuple[Rule, ...] | None = None, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """doc_id, n_words, base (array of start, end, label of every phrase), hits (array of kept detections) for each row of docs.

    A null or empty text has no words and no detection. Repeated rows and null ids are each answered, an empty table gives
    an empty result, other columns are ignored.
    """
    rules = rule_table() if rules is None else rules
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    low = F.lower("body")
    given = gates(rules, phrases)
    gate = F.lit(given is None)
    for g in given or ():
        gate = gate | F.contains(F.col("low"), F.lit(g))
    gate = gate | (F.contains(F.col("low"), F.lit("cc")) & F.col("low").rlike(LONE))
    df = df.withColumn("low", low).withColumn("asked", gate)
    df = df.withColumn("n_words", F.size(F.regexp_extract_all("body", F.lit(WORD), F.lit(0))).cast("long"))
    joined = F.concat(F.lit(" "), F.btrim(F.regexp_replace(ascii_lower(F.col("body")), WORD.replace("[^", "[", 1), " ")), F.lit(" "))
    df = df.select("doc_id", "n_words", F.when(F.col("asked"), joined).alias("words"))
    words = F.col("words")

    base = [_places(words, F.lit(_whole(p)), F.lit(label), F.lit(0), F.lit(0.8)) for p, label in phrases]
    none = F.array().cast(_HIT)
    # a phrase stands wherever its words do: none of PHRASES can overlap itself
    df = df.withColumn("base", F.when(words.isNotNull(), F.array_sort(F.concat(none, *base))).otherwise(none))

    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(_whole(r.pattern)).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence")) for r in rules])
    asked = F.filter(table, lambda r: F.contains(words, r["keyword"]) & F.call_function("rlike", words, r["pattern"]))
    hits = F.flatten(F.transform(asked, lambda r: _places(words, r["pattern"], r["label"], r["priority"], r["confidence"])))
    df = df.withColumn("hits", F.when(words.isNotNull(), _uncovered(hits, sorted({r.priority for r in rules}))).otherwise(none))
    return df.select("doc_id", "n_words", "base", "hits")


def _uncovered(hits: Column, priorities: list[int]) -> Column:
    """hits by start, longest first, without those that lie within another of higher priority, or of the same but longer (or first)."""
    order = lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("end"), (-h["priority"]).alias("priority"), h["label"].alias("label"), h["confidence"].alias("confidence"))
    ordered = F.transform(F.array_sort(F.transform(hits, order)), lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("end"), h["label"].alias("label"), (-h["priority"]).alias("priority"), h["confidence"].alias("confidence")))
    # reach: for each priority the furthest end of a hit of at least that priority so far
    start = F.struct(*[F.lit(-1).alias(f"p{p}") for p in priorities], F.array().cast(_HIT).alias("kept"))

    def add(acc: Column, h: Column) -> Column:
        covered = F.lit(False)
        for p in priorities:
            covered = covered | ((h["priority"] == p) & (h["end"] <= acc[f"p{p}"]))
        reach = [F.when(h["priority"] >= p, F.greatest(acc[f"p{p}"], h["end"])).otherwise(acc[f"p{p}"]).alias(f"p{p}") for p in priorities]
        return F.struct(*reach, F.when(covered, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(h))).alias("kept"))

    return F.aggregate(ordered, start, add, lambda acc: acc["kept"])


def summarise(scanned: DataFrame) -> DataFrame:
    """The contract's columns from scan()'s: counts and places of the phrases, their labels, all labels, the score of the surest detection."""
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("hits", lambda h: h["label"]))))
    sure = F.greatest(F.coalesce(F.array_max(F.transform("hits", lambda h: h["confidence"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.8).otherwise(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        sure.alias("score"),
    )
