import random
import re
import zlib

import public_tokenizers
import tokenizers

import corpus_pipeline
from grovelens.llm.common import materialize
from test_jaccard import brute

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DIR))
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0 and sizes[1] < sizes[0]
    assert docs.agg({"length": "sum"}).first()[0] > 0


def test_pipeline_against_plain_code(spark, tmp_path):
    """Kept documents and their packed tokens by plain Python: language, near copies, benchmark items, spans, token counts."""
    rng = random.Random(12)
    words = {"en": [f"th{i}ing" for i in range(300)], "de": [f"sch{i}ung" for i in range(300)]}
    spell = lambda x: x.translate(str.maketrans("0123456789", "aeioubdgkl"))
    words = {k: [spell(w) for w in v] for k, v in words.items()}
    items = [(i, " ".join(rng.choices(words["en"], k=20))) for i in range(5)]
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "de"])
        text = rng.choices(words[lang], k=rng.randint(5, 120))
        if i % 10 == 0:
            text[3:3] = items[i % 5][1].split()
        if i % 7 == 0:
            text.append("mail anna@site.example.com now")
        rows.append((i, " ".join(text), lang))
    for i in range(150, 180):  # near copies of others, and texts without a letter
        text = rows[rng.randrange(100)][1].split()
        text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text) if i % 6 else "12 34 56", "en"))
    documents = [(i, t, lang, "s", len(t)) for i, t, lang in rows]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t)]
    component = {i: c for i, _, c in brute(kept, 5, 80)}
    kept = [(i, t) for i, t in kept if component[i] == i]
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    kept = [(i, t) for i, t in kept if not any(len(grams(x) & grams(t)) >= 0.8 * len(grams(x)) for _, x in items)]
    assert 60 < len(kept) < 150
    kept = [(i, re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>", t)) for i, t in kept]
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path(corpus_pipeline.TOKENIZER)))
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in kept}
    got, sequences = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == {i: len(x) for i, x in want.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_odd_rows_pass_every_stage(spark, odd, none):
    for given in (odd, none):
        docs = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, DIR))
            assert docs.columns == given.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() >= (given is odd)
