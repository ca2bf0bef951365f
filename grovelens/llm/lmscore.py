"""Language-model scores: a bigram model whose quantised counts lie in log-frequency Bloom filters, one for each shard of the keys.

Every training token and bigram is counted and kept. A filter of all bigrams grows with the corpus and can't be broadcast, so it is
cut into shards by the bigrams' hash, and what would be probes of a broadcast filter are sent to the shards instead. Texts are
read once into batches of about BATCH_TOKENS tokens, written as compressed numbers; each task of an executor holds one at a time
beside the JVM. Each batch sends every shard the keys of its different words and bigrams with their counts in training texts;
a shard sums the counts of all batches, puts the bigrams into its filter and answers each batch's keys by probing it: one byte
a bigram, the exact count for a word. A batch then scores its texts.
No key is hot: a batch sends it once, however often it occurs there. Messages are as many as batches times shards, so they
get smaller as the corpus grows, and their number grows with its square.

A count c has the level 1 + floor(log(c) / log(BASE)). The filter holds the keys (bigram, 1) to (bigram, level) and is read by
probing level after level until one is missing. P(w | h) = (q(h, w) + PSEUDO * P(w)) / (c(h) + PSEUDO), with q the least count of
the bigram's level, c(h) the history's count and P(w) = (c(w) + 1) / (N + V + 1): as q never exceeds the count, the
probabilities of a history sum to one at most, and to one but for what the levels round off.

Words are numbered by 64 bits of their XXH3, bigrams by a mix of their words' numbers.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovelens.llm.common import bound_batches, documents, give_back, materialize, remainder, trimmed, trimmed_after
from grovelens.llm.shingles import mix

BASE = 1.25
HASHES = 16
#: Bits of a filter for each key and level: HASHES / ln 2.
BITS = 24
PSEUDO = 20.0
BATCH_TOKENS = 1_000_000
#: Keys that a shard gets at most, on the average; what a task holds of a shard is some 100 bytes a key.
SHARD_KEYS = 1_000_000
#: Shards whose keys a batch sends in one Arrow batch.
SENT_SHARDS = 64
#: The end token; no word is empty.
END = b""


def level(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9)).astype(np.int64)


def least(levels: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0, of what was never seen."""
    return np.where(levels > 0, BASE ** (levels - 1.0), 0.0)


class CountFilter:
    """A log-frequency Bloom filter of counts of 64-bit keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        levels = level(counts)
        self.bits = max(64, int(levels.sum()) * BITS)
        field = np.zeros(self.bits, bool)
        for q in range(1, int(levels.max(initial=0)) + 1):
            some = keys[levels >= q]
            for k in range(HASHES):
                field[self._places(some, q, k)] = True
        self.field = np.packbits(field, bitorder="little")

    def _places(self, keys: np.ndarray, q: int, k: int) -> np.ndarray:
        first = mix(keys, 2 * q)
        second = mix(keys, 2 * q + 1) | np.uint64(1)
        return (first + np.uint64(k) * second) % np.uint64(self.bits)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 if it isn't there."""
        found, alive, q = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(alive):
            q += 1
            first, second = mix(keys[alive], 2 * q), mix(keys[alive], 2 * q + 1) | np.uint64(1)
            for k in range(HASHES):
                at = (first + np.uint64(k) * second) % np.uint64(self.bits)
                hit = (self.field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    alive, first, second = alive[hit], first[hit], second[hit]
            found[alive] = q
        return found


class Places(dict):
    """A batch's different words in the order of their first places, each with its place among them; the end token has place 0."""

    def __init__(self):
        self[END] = 0

    def clear(self) -> None:
        super().clear()
        self[END] = 0

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def numbers(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self), np.uint64, len(self))


def packed(places: np.ndarray) -> bytes:
    """Four-byte places, compressed byte by byte: frequent words come early, so the high bytes are mostly zero."""
    return pa.compress(np.ascontiguousarray(places.view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).reshape(n)


_BATCH = "batch long, doc_ids array<long>, held array<boolean>, trains array<boolean>, lengths array<long>, n long, words binary, tokens binary"
_KEYS = "batch long, shard int, words binary, word_counts binary, bigrams binary, bigram_counts binary"
_ANSWERS = "batch long, shard int, words binary, bigrams binary, n long, v long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_BATCH rows: texts as numbers of the batch's different words, each text with its end token."""
    places = Places()
    ids, held, trains, rows, size = [], [], [], [], 0

    def out() -> pa.RecordBatch:
        values = [[uuid.uuid4().int >> 65], [list(ids)], [list(held)], [list(trains)], [[len(r) for r in rows]], [size], [places.numbers().tobytes()], [packed(np.concatenate(rows))]]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
        for held_rows in (ids, held, trains, rows, places):
            held_rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _BATCH.split(", ")])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for text, i, h, t in zip(part.column("text").cast(pa.binary()).to_pylist(), *(part.column(c).to_pylist() for c in ("doc_id", "held", "train")), strict=True):
                rows.append(places.of([*(text or b"").lower().split(), END]))
                ids.append(i)
                held.append(h)
                trains.append(t)
                size += len(rows[-1])
                if size >= BATCH_TOKENS:
                    yield out()
                    size = 0
                    give_back()
    if rows:
        yield out()


class Batch:
    """One _BATCH row: its words, and its different bigrams (codes of two places in words) with the one at each place.

    Of the arrays as long as the text, only tokens and bigram stay, of four bytes a token; four of eight are needed in between.
    """

    def __init__(self, row: dict):
        self.words = np.frombuffer(row["words"], np.uint64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.tokens = unpacked(row["tokens"], int(self.lengths.sum()))
        self.starts = np.cumsum(self.lengths) - self.lengths
        codes = np.empty(len(self.tokens), np.int64)
        codes[1:] = self.tokens[:-1]
        codes[self.starts] = 0  # a text's first word follows an end
        codes *= len(self.words)
        codes += self.tokens
        order = np.argsort(codes)
        codes = codes[order]
        new = np.concatenate([[True], codes[1:] != codes[:-1]])
        self.bigram = np.empty(len(codes), np.int32)
        self.bigram[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        codes = codes[new]
        self.first, self.second = (codes // len(self.words)).astype(np.int32), (codes % len(self.words)).astype(np.int32)
        del codes, new
        self.keys = mix(self.words[self.first] ^ mix(self.words[self.second], 31), 37)

    def counts(self, trains: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and each bigram occurs in training texts."""
        weight = np.repeat(np.array(trains, bool), self.lengths)
        return np.bincount(self.tokens[weight], minlength=len(self.words)), np.bincount(self.bigram[weight], minlength=len(self.keys))


def shard_order(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys by shard, and where each shard's begin."""
    of = ((mix(keys, 41) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.argsort(of, kind="stable"), np.searchsorted(np.sort(of), np.arange(shards + 1, dtype=np.uint64))


def _sent(row: dict, shards: int) -> Iterator[pa.RecordBatch]:
    """_KEYS rows of one _BATCH row."""
    batch = Batch(row)
    dealt = [(keys, counts, *shard_order(keys, shards)) for keys, counts in zip((batch.words, batch.keys), batch.counts(row["trains"]), strict=True)]
    full = np.flatnonzero(sum(np.diff(cuts) for *_, cuts in dealt))
    for at in range(0, len(full), SENT_SHARDS):
        some = full[at : at + SENT_SHARDS]
        columns = [pa.array([row["batch"]] * len(some), pa.int64()), pa.array(some, pa.int32())]
        for keys, counts, order, cuts in dealt:
            parts = [order[cuts[s] : cuts[s + 1]] for s in some]
            columns += [pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([counts[p].astype(np.uint32).tobytes() for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _KEYS.split(", ")])


def _send(shards: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                yield from _sent(rows.slice(k, 1).to_pylist()[0], shards)
                give_back()

    return send


def _counted(keys: pa.ChunkedArray, counts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different keys of all rows and their counts, the place of each row's keys among them, and where the next row's begin."""
    sent = [np.frombuffer(k, np.uint64) for k in keys.to_pylist()]
    own, at = np.unique(np.concatenate(sent), return_inverse=True)
    total = np.bincount(at, np.concatenate([np.frombuffer(c, np.uint32) for c in counts.to_pylist()]), len(own)).astype(np.int64)
    return own, total, at, np.cumsum([len(s) for s in sent])[:-1]


@trimmed_after
def _answer(table: pa.Table) -> pa.Table:
    """Answers of one shard: exact counts of words, the level that the shard's filter has for bigrams; n and v add up to the training tokens and their different words."""
    _, counts, at, cuts = _counted(table.column("words"), table.column("word_counts"))
    words = [a.tobytes() for a in np.split(counts[at], cuts)]
    n, v = ([int(x)] + [0] * (len(words) - 1) for x in (counts.sum(), (counts > 0).sum()))
    keys, counts, at, cuts = _counted(table.column("bigrams"), table.column("bigram_counts"))
    levels = CountFilter(keys[counts > 0], counts[counts > 0]).levels(keys)
    bigrams = [a.tobytes() for a in np.split(levels[at], cuts)]
    return pa.table({"batch": table.column("batch"), "shard": table.column("shard"), "words": pa.array(words, pa.binary()), "bigrams": pa.array(bigrams, pa.binary()), "n": pa.array(n, pa.int64()), "v": pa.array(v, pa.int64())})


def probabilities(levels: np.ndarray, history: np.ndarray, single: np.ndarray) -> np.ndarray:
    """P(w | h) from a bigram's level, its history's count and its word's own probability."""
    return (least(levels) + PSEUDO * single) / (history + PSEUDO)


def _score(shards: int, n: int, v: int):
    @trimmed_after
    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        found = {name: [] for name in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for row in texts.to_pylist():
            batch = Batch(row)
            by_shard = answers.sort_by("shard")
            told = []
            for kind, keys, dtype in (("words", batch.words, np.int64), ("bigrams", batch.keys, np.uint8)):
                order, _ = shard_order(keys, shards)
                values = np.empty(len(keys), dtype)
                values[order] = np.frombuffer(b"".join(by_shard.column(kind).to_pylist()), dtype)
                told.append(values)
            counts, levels = told
            single = (counts + 1.0) / (n + v + 1.0)
            log = np.log10(probabilities(levels, counts[batch.first], single[batch.second]))
            of = lambda values, at: np.add.reduceat(values[at], batch.starts)  # noqa: B023, E731
            found["doc_id"] += row["doc_ids"]
            found["held_out"] += row["held"]
            found["n_tokens"] += batch.lengths.tolist()
            found["n_known"] += of((counts > 0).astype(np.int64), batch.tokens).tolist()
            found["base_score"] += of(np.log10(single), batch.tokens).tolist()
            found["score"] += of(log, batch.bigram).tolist()
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({name: pa.array(values, t) for (name, values), t in zip(found.items(), kinds, strict=True)})

    return score


def held_out_text(doc_id: int, modulus: int = 7) -> int:
    """remainder() for one id, for tests."""
    return zlib.crc32(str(doc_id).encode()) % modulus


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Texts with the remainder `held_out` are scored but not learnt from; a null doc_id has none and is learnt from neither.
    A null or empty text is its end token. Repeated rows are each learnt from and answered, ties alike; an empty table gives an
    empty result; without a training row every count is 0; columns other than doc_id and text are ignored. A text is taken
    whole: one longer than BATCH_TOKENS is a batch of its own, about 35 bytes a token in its worker.
    """
    bound_batches(docs.sparkSession)
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False))
    learnt = F.coalesce(remainder(F.col("doc_id"), modulus) != held_out, F.lit(False))
    given = documents(docs).select("doc_id", out.alias("held"), learnt.alias("train"), "text")
    texts = materialize(given.mapInArrow(trimmed(_batches), _BATCH))
    tokens = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, ceil(2 * tokens / SHARD_KEYS))
    sent = texts.select("batch", "trains", "lengths", "words", "tokens").mapInArrow(trimmed(_send(shards)), _KEYS)
    answers = materialize(sent.groupBy("shard").applyInArrow(_answer, _ANSWERS))
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    scored = texts.drop("trains", "n").groupBy("batch").cogroup(answers.select("batch", "shard", "words", "bigrams").groupBy("batch")).applyInArrow(_score(shards, n, v), _SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
