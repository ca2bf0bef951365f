"""N-gram Jaccard join: a blocked sparse product of the incidence matrix of documents by word shingles, exact for every pair.

Two texts link when their shingle sets' Jaccard similarity is at least THRESHOLD percent (integers, compared exactly). Equal
sets are one row of the matrix from the start. A row of n shingles needs need(n) = ceil(t * n) of them in common with any
other row that links, so whatever order the columns have, a link shows within its first n - need(n) + 1 of them, and at
least l columns in common show within the first n - need(n) + l. From that follow three bounds, each of which drops rows or
pairs before they cost anything, and none of which can drop a link:

1. of the first n - need(n) + l(n) columns by hash, at least l(need(n)) must also be some other row's; this leaves about a
   sixth of all rows' elements, and no text was moved for it;
2. of all columns of what is left, need(n) must also be another row's; rows of shared passages and chance go here;
3. columns of what is left are ordered by document frequency, rarest first. Only rows that share one of their first
   n - need(n) + 1 columns are multiplied, so a passage that thousands of documents share makes no candidates.

Products are taken block by block: rows are dealt into blocks of bounded size, a task multiplies two of them, and overlap
counts accumulate over groups of columns, rarest first; after each, pairs whose count can't reach (n + m) * t / (1 + t) any
more are discarded. A task hands on a forest of its links, not the pairs. The rows of one column are first multiplied with
one of them only (STARS rounds), which connects most of a group of near copies at the cost of one product a row; then what is
not connected yet is multiplied whole, so that no link between different texts is lost.

Intermediate tables are written to spark.checkpoint.dir; nothing that grows with the documents reaches the driver. Joins by
column, row or component split off hot keys (skew_join).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovelens.llm.common import bound_batches, discard, documents, free_name, materialize, skew_join, trimmed
from grovelens.llm.shingles import mix, shingle_hashes

WORDS = 4
#: Percent.
THRESHOLD = 85
#: l(n) as a percentage of n: more emits more columns for the first bound and leaves fewer rows.
SPARE = 10
STARS = 2
#: Rows that name documents to read again are broadcast up to this number (about 40 bytes each, counted before); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows, and elements on the average, of a block.
BLOCK_ROWS = 1_000
BLOCK_ELEMENTS = 1_000_000
#: Elements of two blocks that are multiplied one by one at a time, and columns that are multiplied as a dense matrix at a time.
STEP = 1_000_000
COLUMNS = 256


def need(n, percent: int):
    """The least overlap of a set of n shingles with any set that it links with; n is a number, an array or a column."""
    return F.expr(f"({percent} * {n} + 99) div 100") if isinstance(n, str) else (percent * n + 99) // 100


def spare(n: int) -> int:
    """l(n)."""
    return max(1, n * SPARE // 100)


def _spare(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n * SPARE / 100)).cast("long")


def set_number(s: np.ndarray) -> int:
    """One 63-bit number for a set."""
    return int(mix(np.array([mix(s, 17).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64), 19)[0] >> np.uint64(1))


def head(s: np.ndarray, percent: int) -> np.ndarray:
    """The columns of the first bound; none for a set so small that only its equals link with it."""
    n = len(s)
    return s[: n - need(n, percent) + spare(n)] if 100 * n >= percent * (n + 1) else s[:0]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _rows(words: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets of this task whose heads are out; a task's rows bound it
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                nodes, sizes, heads = [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    s = shingle_hashes(text or b"", words)
                    node = set_number(s) if len(s) else None
                    nodes.append(node)
                    sizes.append(len(s))
                    heads.append(s[:0] if node in seen else head(s, percent))
                    seen.add(node)
                columns = [part.column("doc_id"), part.column("mark"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _lists(heads)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "node", "n_shingles", "head"])

    return rows


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                nodes, found = [], []
                for text, node in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("node").to_pylist(), strict=True):
                    s = shingle_hashes(text or b"", words)
                    if len(s) and set_number(s) == node:  # else another text of the same hash
                        nodes.append(node)
                        found.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.arange(base + n, base + n + len(nodes))), _lists(found)], names=["node", "row", "elements"])
                n += len(nodes)

    return sets


class Block:
    """Rows of the incidence matrix: their nodes, labels and sizes, and their elements as (row, column) entries."""

    def __init__(self, table: pa.Table):
        self.nodes, self.labels, self.n = (table.column(c).to_numpy() for c in ("node", "label", "n"))
        elements = table.column("elements").combine_chunks()
        self.columns = np.asarray(elements.flatten())
        self.rows = np.repeat(np.arange(len(self.n)), np.asarray(elements.value_lengths()))

    def number(self, columns: np.ndarray) -> Block:
        """Columns numbered by their place in `columns`, others left out, entries by column."""
        at = np.minimum(np.searchsorted(columns, self.columns), len(columns) - 1)
        kept = columns[at] == self.columns if len(columns) else np.zeros(0, bool)
        order = np.argsort(at[kept], kind="stable")
        self.columns, self.rows = at[kept][order], self.rows[kept][order]
        return self


def multiply(x: Block, y: Block, percent: int) -> np.ndarray:
    """Which rows of x and y with different labels link: a matrix of truth values.

    Counts accumulate from the rarest column to the most frequent. Before the first group of columns and after each, a pair
    is kept only if its count and the columns that both rows still have can reach its bound; rows without a pair go.
    """
    shared = np.intersect1d(x.columns, y.columns)
    x.number(shared)
    y.number(shared)
    a, b = np.bincount(x.columns, minlength=len(shared)), np.bincount(y.columns, minlength=len(shared))
    order = np.argsort(a * b, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    a, b = a[order], b[order]
    sides = []
    for block in (x, y):
        columns = place[block.columns]
        by = np.argsort(columns, kind="stable")
        sides.append((columns[by], block.rows[by]))
    (xc, xr), (yc, yr) = sides
    bound = -(-(x.n[:, None] + y.n[None, :]) * percent // (100 + percent))
    alive = x.labels[:, None] != y.labels[None, :]
    counts = np.zeros(alive.shape, np.int32)
    left_x, left_y = np.bincount(xr, minlength=len(x.n)), np.bincount(yr, minlength=len(y.n))
    # products of entries pay where they are far fewer than those of a dense column
    work = np.cumsum(a * b)
    thin = int(np.searchsorted(a * b * 8, alive.size, "right"))
    low = 0
    while True:
        alive &= counts + np.minimum(left_x[:, None], left_y[None, :]) >= bound
        if low == len(shared) or not alive.any():
            break
        if low < thin:
            high = max(low + 1, min(thin, int(np.searchsorted(work, (work[low - 1] if low else 0) + STEP, "right"))))
        else:
            high = min(len(shared), low + COLUMNS)
        xs, ys = slice(*np.searchsorted(xc, (low, high))), slice(*np.searchsorted(yc, (low, high)))
        np.subtract(left_x, np.bincount(xr[xs], minlength=len(x.n)), out=left_x)
        np.subtract(left_y, np.bincount(yr[ys], minlength=len(y.n)), out=left_y)
        if low < thin:
            times = b[xc[xs]]
            first = ys.start + np.concatenate([[0], np.cumsum(b[low:high])])[xc[xs] - low]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at = np.repeat(xr[xs], times) * len(y.n) + yr[np.repeat(first, times) + within]
            counts += np.bincount(at, minlength=alive.size).reshape(alive.shape).astype(np.int32)
        else:
            rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            dense = []
            for size, kept, r, c in ((len(x.n), rows, xr[xs], xc[xs]), (len(y.n), columns, yr[ys], yc[ys])):
                ones = np.zeros((size, high - low), np.float32)
                ones[r, c - low] = 1
                dense.append(ones[kept])
            counts[np.ix_(rows, columns)] += (dense[0] @ dense[1].T).astype(np.int32)
        low = high
    return alive  # after the last column, the counts themselves reach the bound


def forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes, fewer than there are nodes, that connect what `linked` connects."""
    rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    linked, nodes = linked[np.ix_(rows, columns)], np.concatenate([a[rows], b[columns]])
    _, name = np.unique(nodes, return_inverse=True)  # a node may be on both sides
    x, y, none = name[: len(rows)], name[len(rows) :], len(nodes)
    best = np.arange(none)
    while True:
        before = best.copy()
        near_x, near_y = np.where(linked, best[y][None, :], none), np.where(linked, best[x][:, None], none)
        np.minimum.at(best, x, near_x.min(1, initial=none))
        np.minimum.at(best, y, near_y.min(0, initial=none))
        best = best[best]
        if (best == before).all():
            break
    own = np.empty(none, np.int64)
    own[name] = nodes
    ids = np.flatnonzero(best != np.arange(none))
    return own[best[ids]], own[ids]


def _products(percent: int):
    def products(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        x = Block(table.filter(pa.array(side == 0)))
        y = Block(table.filter(pa.array(side == 1))) if side.any() else Block(table)
        if not len(x.n):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = forest(multiply(x, y, percent), x.nodes, y.nodes)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return products


def products(tasks: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """(a, b) that connect the links found by tasks (pivot, i, j, side, node, label): side 0 times side 1, or side 0 with itself."""
    rows = tasks.join(matrix.select("node", "n", "elements"), "node")
    return materialize(rows.groupBy("pivot", "i", "j").applyInArrow(_products(percent), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (a, b) reach, for each node of a link.

    Each round takes the smallest label of the neighbours and then that label's own label; tables are written between rounds.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
    edges = materialize(both.filter("x <> y").distinct())
    labels = materialize(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("label")))
    while True:
        near = skew_join(edges, labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = materialize(labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("next")))
        jump = skew_join(step, labels.select(F.col("node").alias("next"), F.col("label").alias("after")), "next", "left")
        moved = materialize(jump.select("node", F.least("next", "after").alias("label"), (F.least("next", "after") < F.col("label")).alias("moved")))
        discard(labels, step)
        labels = moved
        if not moved.filter("moved").limit(1).count():
            discard(edges)
            return moved.select("node", "label")


def _again(docs: DataFrame, places: DataFrame, words: int) -> DataFrame:
    """(node, row, elements) of the texts at places (node, doc_id, mark), read once more; a repeated row may give its set twice, as two rows."""
    given = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
    side = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    texts = given.join(side.select("node", "doc_id", "mark"), (F.col("t") == F.col("mark")) & F.col("d").eqNullSafe(F.col("doc_id")))
    return texts.select("text", "node").mapInArrow(trimmed(_sets(words)), "node long, row long, elements array<long>")


def _alone(rows: DataFrame, elements: str) -> DataFrame:
    """node, alone: how many of its elements no other node has; nodes without such an element are left out."""
    entries = rows.select("node", F.explode(elements).alias("shingle"))
    once = entries.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).filter("node = last")
    return once.groupBy("node").agg(F.count("*").alias("alone"))


def incidence(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """node, n, elements, degree of the rows that pass the first two bounds.

    elements are those columns that another such row has too, rarest first; degree is how many rows share one of them, on the average.
    """
    heads = rows.filter(F.size("head") > 0)
    places = heads.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("p"), F.min("n_shingles").alias("n"), F.min(F.size("head")).alias("heads"))
    met = F.col("heads") - F.coalesce("alone", F.lit(0)) >= _spare(need("n", percent))
    first = places.join(_alone(heads, "head"), "node", "left").filter(met).select("node", "p.doc_id", "p.mark", "n")
    first = materialize(first)

    sets = materialize(_again(docs, first, words))
    enough = F.col("n") - F.coalesce("alone", F.lit(0)) >= need("n", percent)
    second = first.join(_alone(sets, "elements"), "node", "left").filter(enough).select("node", "n")
    second = materialize(second.join(sets.groupBy("node").agg(F.min("row").alias("row")), "node"))
    # sets stay where they are unless what names them is too large to be sent to them
    whole = materialize(sets.join(F.broadcast(second) if second.count() <= BROADCAST_ROWS else second, ["node", "row"]).drop("row"))
    discard(sets, first, second)

    entries = whole.select("node", "n", F.explode("elements").alias("shingle"))
    often = materialize(entries.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"))
    ordered = skew_join(entries, often, "shingle").groupBy("node").agg(
        F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("by"), (F.sum(F.col("df") - 1) / F.min("n")).alias("degree")
    )
    matrix = ordered.select("node", "n", F.col("by.shingle").alias("elements"), "degree").filter(F.size("elements") >= need("n", percent))
    matrix = materialize(matrix)
    discard(whole, often)
    return matrix


def _pivots(prefix: DataFrame) -> DataFrame:
    """prefix with p, the row of the highest degree in its column, for columns that more than one label has."""
    best = prefix.groupBy("shingle").agg(F.max(F.struct("degree", "node", "label")).alias("p"), F.min("label").alias("low"), F.max("label").alias("high"))
    return skew_join(prefix, best.filter("low < high").select("shingle", "p"), "shingle")


def _stars(named: DataFrame, second: bool) -> DataFrame:
    """Tasks of one row and up to BLOCK_ROWS others, for each row the pivot of most of its columns."""
    if second:
        others = named.filter("label <> p.label")
        best = others.groupBy("shingle").agg(F.max(F.struct("degree", "node", "label")).alias("q"))
        named = skew_join(named, best, "shingle").withColumn("p", F.col("q"))
    pairs = named.filter("label <> p.label").groupBy("node", "label", "n", F.col("p.node").alias("pivot"), F.col("p.label").alias("pivot_label")).agg(F.count("*").alias("columns"))
    chosen = materialize(pairs.groupBy("node").agg(F.max(F.struct("columns", "pivot", "pivot_label", "label", "n")).alias("x")).select("node", "x.*"))
    dealt = _dealt(chosen).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = dealt.select("pivot", "i", F.lit(0).alias("j"), F.lit(1).alias("side"), "node", "label")
    own = dealt.select("pivot", "i", F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("pivot").alias("node"), F.col("pivot_label").alias("label")).distinct()
    return rows.unionByName(own)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (a written table) with the number of blocks that their pivot's rows fill."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_ELEMENTS)).cast("int")
    return skew_join(rows, rows.groupBy("pivot").agg(blocks.alias("blocks")), "pivot")


def _blocks(named: DataFrame) -> DataFrame:
    """Tasks of every two blocks of each pivot's columns; blocks without two labels between them are left out by their products."""
    rows = materialize(named.select(F.col("p.node").alias("pivot"), "node", "label", "n").distinct())
    dealt = _dealt(rows).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = dealt.select("pivot", "node", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return every.select("pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "label")


def join(docs: DataFrame, words: int = WORDS, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, mark (xxhash64 of the text) for each row of docs.

    component_id is the smallest doc_id that links reach, the row's own included. A null or wordless text has no shingle and
    links with nothing, not even its like; its component is its own doc_id. A text of fewer than `words` words is one
    shingle. Repeated rows and ties are each answered; a null doc_id is never the smallest and is null if alone; an empty
    table gives an empty result; columns other than doc_id and text are ignored. A text is taken whole, however long: a
    worker holds the sets of up to 512 texts, or of two blocks, at once, 8 bytes a shingle.
    """
    bound_batches(docs.sparkSession)
    docs = documents(docs)
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    rows = materialize(marked.mapInArrow(trimmed(_rows(words, percent)), "doc_id long, mark long, node long, n_shingles long, head array<long>"))
    matrix = incidence(docs, rows, words, percent)
    first = F.slice("elements", F.lit(1), F.size("elements") - need("n", percent) + 1)
    prefix = materialize(matrix.select("node", "n", "degree", F.explode(first).alias("shingle")))

    labels = None
    for turn in range(STARS + 1):
        if labels is None:
            named = prefix.withColumn("label", F.col("node"))
        else:
            named = prefix.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = materialize(named)
        open_ = materialize(_pivots(named))
        if not open_.limit(1).count():
            break
        links = products(_stars(open_, turn > 0) if turn < STARS else _blocks(open_), matrix, percent)
        known = links if labels is None else links.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = components(known)
        discard(named, open_, links)

    of = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("own"))
    of = of.withColumn("group", F.col("node")) if labels is None else of.join(labels, "node", "left").select("node", "own", F.coalesce("label", "node").alias("group"))
    of = materialize(of)
    least = of.groupBy("group").agg(F.min("own").alias("component_id"))
    by_node = materialize(skew_join(of, least, "group").select("node", "component_id"))
    discard(of, prefix, matrix)
    named = skew_join(rows.drop("head"), by_node, "node", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "mark")


def representatives(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; rows without words all stay.

    Of repeated rows (equal doc_id and text) one stays. A row with a null doc_id goes if its component has a row with one;
    if all of a component's ids are null, they all stay.
    """
    groups = materialize(join(docs, words, percent).filter("n_shingles > 0"))
    own, mark = free_name("own", docs), free_name("mark", docs)
    at = (F.col(mark) == F.xxhash64(F.col("text").cast("string"))) & F.col(own).eqNullSafe(F.col("doc_id").cast("long"))
    key = [F.col("doc_id").alias(own), F.col("mark").alias(mark)]
    gone = materialize(groups.filter("not (doc_id <=> component_id)").select(*key).distinct())
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, at, "left_anti")
    twice = materialize(groups.filter("doc_id = component_id").groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(own, mark))
    if not twice.limit(1).count():
        return kept
    return kept.join(twice, at, "left_anti").unionByName(kept.join(twice, at, "left_semi").dropDuplicates(["doc_id", "text"]))
