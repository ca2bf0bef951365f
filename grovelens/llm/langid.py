"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A three-letter window is bound by multiplying
the vectors of its letters, rotated by two, one and no places; a text is the sum (bundle) of its windows, a language the
sum of its training texts. A text's language is the one whose vector makes the greatest cosine with the text's.

Bundling is linear, so training counts windows by language and sums their vectors on the executors: every window of the
training rows goes into its language's vector. What reaches the driver is that vector for each language and the codes of the
windows (8 bytes each). Windows of a text that no training row has are quasi-orthogonal to the prototypes and to each other:
they add nothing to the dot products and their expected share to the text's norm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovelens.llm.common import bound_batches, documents, materialize, remainder, trimmed

DIMENSIONS = 1024
#: Vectors of windows that a task keeps.
VECTORS = 12_288
#: Of these, those that are multiplied at a time.
PRODUCT = 1_024
#: Training rows for each language: all of them up to about this many, a share drawn by the hash of doc_id beyond it.
SAMPLE_ROWS = 20_000
SEED = 6_021
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all three-character windows (21 bits a character; a run of non-letters is one space) and the text each is from."""
    marked = " \x00 ".join(x.replace("\x00", " ") for x in texts).lower()
    points = np.frombuffer(f" {marked} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cut = points == 0
    letter = _is_letter()[points]
    owner = np.cumsum(cut)
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    # a space before the first letter of each text stands for its start
    starts = np.flatnonzero(cut) + 1
    keep[starts[starts < len(keep)]] = True
    points, owner = points[keep], owner[keep]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    real = (points[1:-1] != 32) & (owner[:-2] == owner[2:])
    return codes[real], owner[:-2][real]


def letter_vector(point: int, dimensions: int) -> np.ndarray:
    return (np.random.default_rng((SEED, point)).integers(0, 2, dimensions, np.int8) * 2 - 1).astype(np.int8)


def window_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """One row of +1 and -1 for each window code."""
    mask = (1 << 21) - 1
    parts = [codes >> 42, (codes >> 21) & mask, codes & mask]
    letters = {int(p): letter_vector(int(p), dimensions) for p in np.unique(np.concatenate(parts))} if len(codes) else {}
    out = np.ones((len(codes), dimensions), np.int8)
    for turn, part in zip((2, 1, 0), parts, strict=True):
        known, where = np.unique(part, return_inverse=True)
        out *= np.stack([np.roll(letters[int(p)], turn) for p in known])[where] if len(known) else 1
    return out


@dataclass
class Profiles:
    """languages in order; codes of all training windows, sorted; prototypes: a unit row for each language."""

    languages: list[str]
    codes: np.ndarray
    prototypes: np.ndarray

    def __post_init__(self):
        self._slots: np.ndarray | None = None

    def vectors(self, places: np.ndarray) -> np.ndarray:
        """The vectors of the windows at different places of codes; the last VECTORS or fewer are kept."""
        dimensions = self.prototypes.shape[1]
        if len(places) > VECTORS:
            return window_vectors(self.codes[places], dimensions)
        if self._slots is None:
            self._slots, self._kept, self._filled = np.full(len(self.codes), -1, np.int32), np.empty((VECTORS, dimensions), np.int8), 0
        new = places[self._slots[places] < 0]
        if self._filled + len(new) > VECTORS:
            self._slots[:] = -1
            self._filled, new = 0, places
        if len(new):
            self._slots[new] = np.arange(self._filled, self._filled + len(new))
            self._kept[self._slots[new]] = window_vectors(self.codes[new], dimensions)
            self._filled += len(new)
        return self._kept[self._slots[places]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes, owner = windows([x or "" for x in texts])
        n = len(texts)
        place = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        found = self.codes[place] == codes if len(self.codes) else np.zeros(len(codes), bool)
        used, where = np.unique(place[found], return_inverse=True)
        bundles = np.zeros((n, self.prototypes.shape[1]), np.float32)
        # a text of many windows takes them in parts
        for at in range(0, len(used), VECTORS):
            some = (where >= at) & (where < at + VECTORS)
            size = min(VECTORS, len(used) - at)
            known = np.bincount(owner[found][some] * size + where[some] - at, minlength=n * size).reshape(n, size)
            vectors = self.vectors(used[at : at + size])
            for low in range(0, size, PRODUCT):
                bundles += known[:, low : low + PRODUCT].astype(np.float32) @ vectors[low : low + PRODUCT].astype(np.float32)
        strange = np.zeros(n)
        if not found.all():
            pairs, counts = np.unique(np.stack([owner[~found], codes[~found]]), axis=1, return_counts=True)
            np.add.at(strange, pairs[0], counts.astype(np.float64) ** 2)
        norms = np.sqrt((bundles.astype(np.float64) ** 2).sum(1) + strange * self.prototypes.shape[1])
        cosines = (bundles @ self.prototypes.T) / np.maximum(norms, 1e-9)[:, None]
        letters = np.bincount(owner, minlength=n)[:n] > 0
        best = cosines.argmax(1) if self.languages else np.zeros(n, int)
        score = np.where(letters & bool(self.languages), np.clip(cosines.max(1, initial=0.0), 0.0, 1.0), 0.0)
        return [self.languages[b] if ok and self.languages else UNKNOWN for b, ok in zip(best, letters, strict=True)], score


def _window_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in dict.fromkeys(langs):
            texts = batch.column("text").take(pa.array(np.flatnonzero(langs == lang)))
            for at in range(0, len(texts), 512):
                codes, counts = np.unique(windows(texts.slice(at, 512).to_pylist())[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))], names=["lang", "code", "n"])


def _bundles(dimensions: int):
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                langs, counts = np.array(part.column("lang").to_pylist(), object), part.column("n").to_numpy().astype(np.float64)
                vectors = window_vectors(part.column("code").to_numpy(), dimensions)
                for lang in dict.fromkeys(langs):
                    rows = np.flatnonzero(langs == lang)
                    sums[lang] = sums.get(lang, 0.0) + counts[rows] @ vectors[rows]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "bundle"])

    return bundle


def _sum_bundles(table: pa.Table) -> pa.Table:
    total = np.sum(table.column("bundle").to_pylist(), 0)
    return pa.table({"lang": table.column("lang").slice(0, 1), "bundle": pa.array([total.tolist()], pa.list_(pa.float64()))})


def learn(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, dimensions: int = DIMENSIONS) -> Profiles:
    """Profiles from rows (doc_id, text, lang); rows with a null among them are left out."""
    bound_batches(rows.sparkSession)
    rows = rows.select("doc_id", "text", "lang").dropna()
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, dimensions), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_rows / n))])
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counts = drawn.select("text", "lang").mapInArrow(trimmed(_window_counts), "lang string, code long, n long")
    counts = materialize(counts.groupBy("lang", "code").agg(F.sum("n").alias("n")))
    codes = np.sort(counts.select("code").distinct().toArrow().column("code").to_numpy())
    # sums of whole numbers: their order doesn't matter
    summed = counts.mapInArrow(trimmed(_bundles(dimensions)), "lang string, bundle array<double>").groupBy("lang").applyInArrow(_sum_bundles, "lang string, bundle array<double>")
    bundles = {r["lang"]: r["bundle"] for r in summed.collect()}
    prototypes = np.array([bundles.get(lang, [0.0] * dimensions) for lang in languages])
    prototypes /= np.maximum(np.sqrt((prototypes**2).sum(1, keepdims=True)), 1e-12)
    return Profiles(languages, codes, prototypes.astype(np.float32))


def _predictor(model, pred: str, score: str):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                langs, scores = model.value.predict(part.column("text").cast(pa.string()).to_pylist())
                kept = [part.column(c) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, pred, score])

    return predict


def annotate(docs: DataFrame, model: Profiles, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns, pred and score, which docs must not have; a text that is null or has no letter is `und` with score 0.

    Of languages with equal cosines, the first in their order is taken. A text is taken whole, however long, a part of its windows at a time.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(trimmed(_predictor(shared, pred, score)), f"{schema}, `{pred}` string, `{score}` double")


def training_rows(docs: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    return docs.filter(remainder(F.col("doc_id"), modulus) != held_out)


def identify(docs: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs, learning from the rows not held out.

    held_out: the remainder of crc32(doc_id as text) by modulus is held_out (a null id is not learnt from and not held
    out). Without any labelled row every text is `und`. Repeated rows are each answered, an empty table gives an empty
    result, further columns are ignored; ties go to the first language in order; texts are taken whole; lang, source and doc_id play no part in a prediction.
    """
    model = learn(training_rows(docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang"), modulus, held_out))
    marked = annotate(documents(docs), model)
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False))
    return marked.select("doc_id", out.alias("held_out"), "lang_pred", "score")
