import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from grovelens.llm import lmscore


def brute(rows):
    """doc_id, n_tokens, n_known, train_tokens, base_score, score by plain counting."""
    tokens = [(d, (t or "").encode().lower().split() + [b""]) for d, t in rows]
    c, pairs = Counter(), Counter()
    for d, words in tokens:
        if d is not None and zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(words)
            pairs.update(zip([b"", *words], words))
    n, v = sum(c.values()), len(c)
    single = lambda w: (c[w] + 1) / (n + v + 1)
    seen = lambda k: lmscore.BASE ** math.floor(math.log(k) / math.log(lmscore.BASE) + 1e-9) if k else 0.0
    p = lambda h, w: (seen(pairs[h, w]) + lmscore.PSEUDO * single(w)) / (c[h] + lmscore.PSEUDO)
    return sorted((d or -1, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(single(x)) for x in w), sum(math.log10(p(h, x)) for h, x in zip([b"", *w], w))) for d, w in tokens)


@pytest.mark.parametrize("batch,shard", [(lmscore.BATCH_TOKENS, lmscore.SHARD_KEYS), (40, 7)])
def test_scores_equal_plain_counting(spark, odd, monkeypatch, batch, shard):
    """With all texts in one batch and one shard, and with many of both."""
    monkeypatch.setattr(lmscore, "BATCH_TOKENS", batch)
    monkeypatch.setattr(lmscore, "SHARD_KEYS", 1 << 30 if shard > 100 else 400)
    rng = random.Random(9)
    lexicon = [f"w{i}" for i in range(300)]
    rows = [(d, " ".join(rng.choices(lexicon, [1 / (i + 1) for i in range(300)], k=rng.randint(1, 80)))) for d in range(100, 300)]
    rows += [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 60_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lmscore.score(docs).collect())
    want = brute(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-6)


def test_long_text(spark, odd):
    got = {r.doc_id: r.n_tokens for r in lmscore.score(odd).collect()}
    assert got[6] == 30_001 and got[7] == 2 and got[1] == got[2] == 1


def test_bytes_a_token_in_a_worker():
    """What two workers hold beside an executor's JVM is bounded by bytes for each token of a batch."""

    def peak(run):
        tracemalloc.start()
        try:
            out = run()
            return out, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    rng = np.random.default_rng(7)
    n, size = 400, 1000
    texts = [" ".join(map(str, rng.zipf(1.3, size) % 50_000)) for _ in range(n)]
    given = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": texts, "held": [False] * n, "train": [True] * n})
    rows, made = peak(lambda: list(lmscore._batches(iter([given]))))
    row = rows[0].to_pylist()[0]
    tokens = n * (size + 1)
    assert row["n"] == tokens and len(rows) == 1
    sent, held = peak(lambda: sum(b.num_rows for b in lmscore._send(64)(iter(rows))))
    assert sent >= 64 and made < 35 * tokens and held < 50 * tokens, (made / tokens, held / tokens)


def test_model_learns_word_order(spark, none):
    rng = random.Random(3)
    pairs = [(f"a{i}", f"b{i}") for i in range(40)]
    rows = [(d, " ".join(w for _ in range(60) for w in rng.choice(pairs))) for d in range(300)]
    got = lmscore.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and all(r.score > r.base_score for r in held)
    assert lmscore.score(none).count() == 0


def test_probabilities_of_a_history_sum_to_one_at_most():
    rng = np.random.default_rng(5)
    size = 200
    table = rng.integers(0, 12, (20, size)) * (rng.random((20, size)) < 0.3)
    counts = rng.integers(50, 500, size)
    single = (counts + 1) / (counts.sum() + size + 1)
    for row in table:
        levels = np.where(row > 0, lmscore.level(row), 0)
        total = lmscore.probabilities(levels, row.sum(), single).sum()
        assert 0.85 < total <= 1


def test_filter_returns_every_level():
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    counts = rng.integers(1, 5000, 5000)
    f = lmscore.CountFilter(keys, counts)
    assert (f.levels(keys) >= lmscore.level(counts)).all() and (f.levels(keys) == lmscore.level(counts)).mean() > 0.999
    assert (f.levels(rng.integers(0, 1 << 63, 20000).astype(np.uint64)) > 0).sum() <= 2
    ratio = lmscore.least(lmscore.level(counts)) / counts
    assert ratio.min() > 0.79 and ratio.max() <= 1 + 1e-9
