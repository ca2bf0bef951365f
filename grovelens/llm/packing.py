"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs n + n^2 / QUADRATIC: the linear part of a transformer layer and its attention within the
piece. Documents are packed in the task that reads and encodes them, a group of GROUP_TOKENS at a time, so that nothing
is shuffled and memory is bounded by a group and the longest document. In a group, documents longer than a sequence
first give whole sequences; the rest go, in descending length, each to the sequence of the lowest cost that has room for
it. The group's sequences are as many as its tokens fill, and what is left over is made up of sequences whose lengths are
powers of two, which need no padding; a document that fits nowhere is cut where the roomiest sequence ends. Every
sequence is thus full to its own length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from grovelens.llm.bpe import encoder
from grovelens.llm.common import bound_batches, documents, trimmed

LENGTH = 2048
GROUP_TOKENS = 1 << 22
#: Tokens at which attention costs as much as the linear layers (about six model widths).
QUADRATIC = 12_288
#: The token after each document.
END = 1

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cost(n: int) -> float:
    return n + n * n / QUADRATIC


class _Room:
    """Open sequences by the tokens they have room for; answers which of those with enough room costs least."""

    def __init__(self, capacities: list[int], longest: int):
        self.width = 1 << longest.bit_length()
        self.least: list[tuple] = [(float("inf"),)] * (2 * self.width)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.width)]
        for k, c in enumerate(capacities):
            self.heaps[c].append((0.0, k))
        for c, heap in enumerate(self.heaps):
            if heap:
                heapq.heapify(heap)
                self.least[self.width + c] = (*heap[0], c)
        for i in range(self.width - 1, 0, -1):
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def _update(self, c: int) -> None:
        i = self.width + c
        self.least[i] = (*self.heaps[c][0], c) if self.heaps[c] else (float("inf"),)
        while i > 1:
            i //= 2
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def with_room(self, n: int) -> tuple | None:
        low, high, best = n + self.width, 2 * self.width, (float("inf"),)
        while low < high:
            if low & 1:
                best = min(best, self.least[low])
                low += 1
            if high & 1:
                high -= 1
                best = min(best, self.least[high])
            low //= 2
            high //= 2
        return best if len(best) == 3 else None

    def roomiest(self) -> tuple:
        i = 1
        while i < self.width:
            i = 2 * i + 1 if len(self.least[2 * i + 1]) == 3 else 2 * i
        return self.least[i]

    def take(self, found: tuple, n: int) -> None:
        now, k, c = found
        heapq.heappop(self.heaps[c])
        self._update(c)
        if c > n:
            heapq.heappush(self.heaps[c - n], (now + cost(n), k))
            self._update(c - n)


def pack_group(sizes: list[int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of one group and the number of its sequences; sizes: tokens of each document."""
    pieces, n, rest = [], 0, []
    for d, size in enumerate(sizes):
        whole = size // length
        for k in range(whole):
            pieces.append((d, k * length, length, n, 0))
            n += 1
        if size % length:
            rest.append((-(size % length), d, whole * length))
    left = sum(-x[0] for x in rest)
    capacities = [length] * (left // length) + [1 << b for b in reversed(range(length.bit_length())) if left % length >> b & 1]
    room, filled = _Room(capacities, length), [0] * len(capacities)
    heapq.heapify(rest)
    while rest:
        size, d, start = heapq.heappop(rest)
        size = -size
        found = room.with_room(size)
        part = size
        if found is None:
            found = room.roomiest()
            part = found[2]
            heapq.heappush(rest, (part - size, d, start + part))
        room.take(found, part)
        pieces.append((d, start, part, n + found[1], filled[found[1]]))
        filled[found[1]] += part
    return pieces, n + len(capacities)


def _packer(tokenizer: str, length: int, group_tokens: int):
    end = END.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base, n = encoder(tokenizer), TaskContext.get().partitionId() << 40, 0
        ids: list[int | None] = []
        bodies: list[bytes] = []
        total = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal n, total
            pieces, more = pack_group([len(b) // 4 for b in bodies], length)
            pieces.sort(key=lambda p: (p[3], p[4]))
            for at in range(0, len(pieces), 4096):
                part = pieces[at : at + 4096]
                columns = [
                    [ids[d] for d, *_ in part],
                    [p[1] for p in part],
                    [p[2] for p in part],
                    [bodies[d][4 * start : 4 * (start + size)] for d, start, size, *_ in part],
                    [len(bodies[p[0]]) // 4 for p in part],
                    [base + n + p[3] for p in part],
                    [p[4] for p in part],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
            n += more
            ids.clear()
            bodies.clear()
            total = 0

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                for doc_id, body in zip(part.column("doc_id").to_pylist(), coder.encode(texts), strict=True):
                    ids.append(doc_id)
                    bodies.append(body + end)
                    total += len(body) // 4 + 1
                    if total >= group_tokens:
                        yield from close()
        if bodies:
            yield from close()

    return pack


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    length must be a power of two. A null or empty text is the end token alone. Repeated rows and null ids are packed as
    rows of their own; an empty table gives no sequence; columns other than doc_id and text are ignored. sequence_id
    holds the task's number in its upper bits, so that tasks need not agree on a count. Of documents of equal length, the first
    read goes first, and of sequences of equal cost the first one takes it. A text is encoded whole, however long: its ids
    are held by one task. Each task ends with sequences of shorter powers of two, so tables of many small partitions have
    many of them; README has figures.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    bound_batches(docs.sparkSession)
    return documents(docs).mapInArrow(trimmed(_packer(tokenizer, length, group_tokens)), SCHEMA)
