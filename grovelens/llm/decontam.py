"""Benchmark decontamination: short test items inside long documents.

Words are runs of letters and digits, lower-cased; shingles are WORDS of them in a row, or an item's whole sequence if it has
fewer. An item is found in a document if the document holds at least THRESHOLD of the item's different shingles.

Items are partitioned by size (powers of two), and each keeps the k smallest hashes of its shingles, its bottom-k MinHash
sketch, where k is one more than the shingles that an item of the partition's upper size may lack: a document that holds
enough of the item then holds at least one hash of its sketch, so the search loses no item, however long the document is.
(A fixed number of MinHash permutations can't see a 30-word item in a 20,000-word document, whose Jaccard similarity is
about 0.001; containment needs the sketch on the item's side only.) The windows of all documents meet the sketches only; a
document that meets one is a candidate for its item. Candidates, and no other documents, are read again, and all shingles of
their items are counted in them, compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovelens.llm.common import free_name, materialize, skew_join

WORDS = 5
THRESHOLD = 0.8
#: Rows of sketches, or shingles, that are broadcast up to this number (about 150 bytes each, counted before); beyond it the join shuffles.
BROADCAST_SHINGLES = 200_000
#: Candidate documents that are broadcast as keys up to this number, counted before.
BROADCAST_DOCUMENTS = 1_000_000


def word_array(text: Column) -> Column:
    """The words of a text; a null or wordless text gives an empty array."""
    body = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(body) > 0, F.split(body, " ")).otherwise(F.array().cast("array<string>"))


def _shingles(df: DataFrame, words: str, size: int) -> DataFrame:
    """df, a row for each window of `size` words: its hash as `h`, its first word's place as `at`."""
    n = F.size(words)
    places = df.filter(n >= size).withColumn("at", F.explode(F.sequence(F.lit(0), n - size)))
    return places.withColumn("h", F.xxhash64(*[F.get(words, F.col("at") + k) for k in range(size)]))


def _window(words: str, size: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, F.col("at") + k) for k in range(size)])


def item_shingles(items: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """item, item_id, n (its different shingles), width (words of one), s (a shingle's number), shingle, h, sketch (whether h is in the sketch).

    item tells items apart by their id and words, so that two items of one id (or of none) are two.
    """
    given = items.select("item_id", word_array(F.col("text").cast("string")).alias("words"))
    given = given.withColumns({"item": F.sha2(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("item_id").isNull().cast("string"), F.array_join("words", " ")), 256), "width": F.least(F.size("words"), F.lit(size))}).filter("width > 0")
    rows = None
    for width in range(1, size + 1):
        own = _shingles(given.filter(F.col("width") == width), "words", width).select("item", "item_id", "width", _window("words", width).alias("shingle"), "h")
        rows = own if rows is None else rows.unionByName(own)
    by_item = rows.groupBy("item").agg(F.min("item_id").alias("item_id"), F.min("width").alias("width"), F.collect_set(F.struct("h", "shingle")).alias("all"))
    n = F.size("all")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int")
    k = upper - F.ceil(upper * F.lit(threshold) - 1e-9).cast("int") + 1
    ranked = by_item.select("item", "item_id", n.alias("n"), "width", F.posexplode(F.array_sort("all")).alias("s", "x"), k.alias("k"))
    return ranked.select("item", "item_id", "n", "width", "s", F.col("x.shingle").alias("shingle"), F.col("x.h").alias("h"), (F.col("s") < F.col("k")).alias("sketch"))


def text_key(text: Column) -> list[Column]:
    """Two independent hashes of a text, as columns key1 and key2."""
    return [F.xxhash64(text).alias("key1"), F.hash(text).alias("key2")]


DOCUMENT = ["doc_id", "key1", "key2"]


def _windows(given: DataFrame, widths: list[int]) -> DataFrame:
    """DOCUMENT, width, h, window for every window of the widths that items have; there is one width but for short items."""
    out = None
    for width in widths:
        rows = _shingles(given, "words", width).select(*DOCUMENT, F.lit(width).alias("width"), "h", _window("words", width).alias("window"))
        out = rows if out is None else out.unionByName(rows)
    return out


def candidates(given: DataFrame, known: DataFrame, widths: list[int]) -> DataFrame:
    """DOCUMENT, item for every item of whose sketch a document has a hash. given: DOCUMENT and words."""
    sketch = known.filter("sketch").select("item", "width", "h")
    windows = _windows(given, widths).select(*DOCUMENT, "width", "h")
    if sketch.count() <= BROADCAST_SHINGLES:
        met = windows.join(F.broadcast(sketch), ["h", "width"])
    else:
        # a window that many documents share is a hot key; it meets one row for its hash, whatever items have it
        met = skew_join(windows, sketch.select("h").distinct(), "h").join(sketch, ["h", "width"])
    return met.select(*DOCUMENT, "item").distinct()


def search(docs: DataFrame, items: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key1, key2 (of the text), item_id, n_shingles (of the item), n_found, containment for each pair found.

    One row for each doc_id, text and item, however often the row is repeated, equal items of one id too; items of one id with different
    words are found one by one. An item shorter than `size` words is found by its whole sequence. Null and wordless texts have
    no shingle and match nothing; empty tables give an empty result; columns other than doc_id, item_id and text are ignored.
    A text is taken whole, however long, and exploded into its windows within a task. Ties don't arise: every pair that reaches the threshold is there.
    """
    known = materialize(item_shingles(items, size, threshold))
    widths = sorted(r.width for r in known.select("width").distinct().collect())  # `size` values at most
    given = docs.select("doc_id", *text_key(F.col("text").cast("string")), word_array(F.col("text").cast("string")).alias("words"))
    if not widths:
        return given.limit(0).select(*DOCUMENT, F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), *[F.lit(0).cast("long").alias(c) for c in ("n_shingles", "n_found")], F.lit(0.0).alias("containment"))
    proposed = materialize(candidates(given, known, widths))
    keys = proposed.select(*DOCUMENT).distinct()
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_DOCUMENTS else keys
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"k.{c}")) for c in DOCUMENT]
    again = given.alias("g").join(keys.alias("k"), same, "left_semi")
    windows = _windows(again, widths)
    shingles = known.select("item", F.col("h").alias("item_h"), F.col("width").alias("item_width"), "s", "shingle")
    match = (F.col("h") == F.col("item_h")) & (F.col("width") == F.col("item_width")) & (F.col("window") == F.col("shingle"))
    hits = windows.join(F.broadcast(shingles) if known.count() <= BROADCAST_SHINGLES else shingles, match)
    found = hits.groupBy(*DOCUMENT, "item").agg(F.count_distinct("s").alias("n_found"))
    pair = [F.col(f"f.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (*DOCUMENT, "item")]
    sure = found.alias("f").join(proposed.alias("p"), pair, "left_semi")
    sizes = known.groupBy("item").agg(F.min("item_id").alias("item_id"), F.min("n").cast("long").alias("n_shingles"))
    sure = sure.join(sizes, "item").filter(F.col("n_found") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))
    return sure.select(*DOCUMENT, "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text holds an item; all columns and all other rows stay, null texts, repeated rows and ties too; an empty table stays empty."""
    first, second = free_name("key1", docs), free_name("key2", docs)
    dirty = search(docs, items, size, threshold).select(F.col("key1").alias(first), F.col("key2").alias(second)).distinct()
    key1, key2 = text_key(F.col("text").cast("string"))
    return docs.join(dirty, (key1 == F.col(first)) & (key2 == F.col(second)), "left_anti")
