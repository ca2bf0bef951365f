import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from grovelens.llm import common, jaccard


def brute(rows, words=4, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append(frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where.get(g, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for g in s:
            where.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((-1 if d is None else d), len(sets[i]), least.get(find(i), -1) if sets[i] else (-1 if d is None else d)) for i, (d, _) in enumerate(rows))


def answers(df, **more):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.join(df, **more).collect())


def family(rng, words, size, copies, changes):
    base = rng.choices(words, k=size)
    for _ in range(copies):
        c = list(base)
        for _ in range(rng.randint(0, changes)):
            k, kind = rng.randrange(len(c)), rng.random()
            if kind < 0.5:
                c[k] = rng.choice(words)
            elif kind < 0.75:
                c.insert(k, rng.choice(words))
            elif len(c) > 5:
                del c[k]
        yield " ".join(c)


@pytest.mark.parametrize("words,percent,broadcast", [(4, 85, True), (5, 80, False)])
def test_join_loses_no_link(spark, odd, monkeypatch, words, percent, broadcast):
    rng = random.Random(words)
    lexicon = [f"w{i}" for i in range(2000)]
    passage = rng.choices(lexicon, k=60)
    texts = [" ".join(rng.choices(lexicon, k=rng.choice([1, 3, 7, 12, 50, 200]))) for _ in range(30)]
    texts += [" ".join(rng.choices(lexicon, k=20) + passage + rng.choices(lexicon, k=rng.randint(5, 40))) for _ in range(30)]
    for size in (8, 12, 20, 60, 150, 400):
        texts += family(rng, lexicon, size, 20, max(1, size // 25))
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in odd.collect()]
    rng.shuffle(rows)
    if not broadcast:
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
        monkeypatch.setattr(jaccard, "STARS", 1)
        monkeypatch.setattr(common, "HOT_ROWS", 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert answers(df, words=words, percent=percent) == brute(rows, words, percent)


def blocks(sets, labels):
    return jaccard.Block(pa.table({"node": np.arange(len(sets)), "label": labels, "n": [len(s) for s in sets], "elements": [sorted(s) for s in sets]}))


@pytest.mark.parametrize("step,columns", [(jaccard.STEP, jaccard.COLUMNS), (5, 3)])
def test_products_equal_set_intersections(monkeypatch, step, columns):
    monkeypatch.setattr(jaccard, "STEP", step)
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    rng = random.Random(step)
    for _ in range(40):
        base = [rng.sample(range(-200, 200), rng.randint(1, 60)) for _ in range(4)]
        x, y = ([set(rng.choice(base)) ^ set(rng.sample(range(-200, 200), rng.randint(0, 5))) or {0} for _ in range(rng.randint(1, 12))] for _ in range(2))
        a, b = [rng.randint(0, 3) for _ in x], [rng.randint(0, 3) for _ in y]
        want = [[la != lb and 100 * len(s & t) >= 85 * len(s | t) for t, lb in zip(y, b)] for s, la in zip(x, a)]
        assert jaccard.multiply(blocks(x, a), blocks(y, b), 85).tolist() == want


def test_forest_connects_what_is_linked():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.choice(50, rng.integers(1, 20), replace=False), rng.choice(50, rng.integers(1, 20), replace=False)
        linked = rng.random((len(a), len(b))) < 0.08
        groups = []
        for pairs in (list(zip(*jaccard.forest(linked, a, b))), [(a[i], b[j]) for i, j in zip(*np.nonzero(linked))]):
            parent = list(range(50))
            for p, q in pairs:
                p, q = parent[p], parent[q]
                parent = [min(p, q) if x in (p, q) else x for x in parent]
            groups.append(parent)
        assert groups[0] == groups[1]


def test_heads_of_linking_sets_share_what_the_first_bound_asks():
    rng = np.random.default_rng(9)
    for percent in (80, 85):
        for _ in range(300):
            a = np.unique(rng.integers(0, 1 << 64, int(rng.integers(4, 300)), np.uint64))
            gone = int(rng.integers(0, 1 + len(a) // 10))
            new = rng.integers(0, 1 << 64, int(rng.integers(0, 1 + len(a) // 10)), np.uint64)
            b = np.unique(np.concatenate([np.delete(a, rng.choice(len(a), gone, replace=False)), new]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                met = len(np.intersect1d(jaccard.head(a, percent), jaccard.head(b, percent)))
                assert met >= max(jaccard.spare(jaccard.need(len(s), percent)) for s in (a, b))


def test_large_family_and_common_passage(spark, monkeypatch):
    """A star of near copies, a family whose members link with none, a chain, and a passage that unrelated texts share."""
    rng = random.Random(4)
    lexicon = [f"w{i}" for i in range(5000)]
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 40)
    monkeypatch.setattr(common, "HOT_ROWS", 30)
    texts = list(family(rng, lexicon, 200, 150, 5)) + list(family(rng, lexicon, 150, 120, 9)) + list(family(rng, lexicon, 60, 100, 2))
    passage = rng.choices(lexicon, k=80)
    texts += [" ".join(rng.choices(lexicon, k=10) + passage + rng.choices(lexicon, k=rng.randint(0, 9))) for _ in range(100)]
    chain = rng.choices(lexicon, k=100)
    for _ in range(25):
        chain = [*chain[3:], *rng.choices(lexicon, k=3)]
        texts.append(" ".join(chain))
    rows = list(enumerate([*texts, *texts[:50], *[texts[0]] * 60]))
    rng.shuffle(rows)
    assert answers(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_representatives(spark, odd, none):
    kept = jaccard.representatives(odd, 5, 80)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1, len(r.text or "")) for r in kept.collect()) == sorted((d or -1, len(t or "")) for d, t in {(r.doc_id, r.text) for r in odd.collect()} if d != 5)
    assert jaccard.representatives(none, 5, 80).count() == 0 and answers(none) == []
