import random

import pytest

from grovelens.llm import langid

SYLLABLES = {"en": "th the ing and ion er re wh st ould".split(), "de": "sch ich ein ung keit über ver lich ß ö".split(), "fr": "eau eux tion ment que oi é è ç aire".split(), "el": "ος τα και ου ειν μα θη".split()}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(8, 60)))
        rows.append((i, text, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def plain_windows(text):
    """Three-character windows of a text whose middle is a letter; what is no letter is one space."""
    out, runs = [], "".join(c if c.isalpha() else " " for c in (text or "").lower())
    marked = f" {' '.join(runs.split())} "
    for i in range(len(marked) - 2):
        if marked[i + 1] != " ":
            out.append(marked[i : i + 3])
    return out


def test_prototypes_are_the_sums_of_all_training_windows(texts):
    """Learning against plain bundling: letters' vectors rotated by their place, multiplied, and summed for each language."""
    import numpy as np

    model, sums = langid.learn(texts), {}
    for r in texts.collect():
        for w in plain_windows(r.text):
            v = np.ones(langid.DIMENSIONS, int)
            for turn, c in zip((2, 1, 0), w, strict=True):
                v = v * np.roll(langid.letter_vector(ord(c), langid.DIMENSIONS), turn)
            sums[r.lang] = sums.get(r.lang, 0) + v
    assert model.languages == sorted(sums)
    for lang, prototype in zip(model.languages, model.prototypes, strict=True):
        assert abs(prototype - sums[lang] / np.linalg.norm(sums[lang])).max() < 1e-6


def test_held_out_accuracy(texts):
    got = langid.identify(texts).join(texts.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and 80 < len(held) < 200
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_prediction_is_the_cosine_of_bundled_vectors(texts):
    import numpy as np

    model = langid.learn(texts)
    text = "the ing schung é 日"
    codes, _ = langid.windows([text])
    bundle = np.sum(langid.window_vectors(codes[np.isin(codes, model.codes)], langid.DIMENSIONS).astype(float), 0)
    strange, counts = np.unique(codes[~np.isin(codes, model.codes)], return_counts=True)
    norm = np.sqrt((bundle**2).sum() + (counts.astype(float) ** 2).sum() * langid.DIMENSIONS)
    want = (model.prototypes @ bundle) / norm
    (lang,), (score,) = model.predict([text])
    assert lang == model.languages[int(want.argmax())] and abs(score - max(0, want.max())) < 1e-4


def test_odd_rows(texts, odd, none):
    got = langid.annotate(odd, langid.learn(texts), "pred", "grade").collect()
    assert len(got) == odd.count()
    marks = {(r["doc_id"], r["pred"], r["grade"]) for r in got}
    assert {d for d, lang, _ in marks if lang == "und"} == {1, 2, 3, 10}
    assert all(s == 0 for _, lang, s in marks if lang == "und")
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


def test_windows_do_not_cross_texts():
    codes, owner = langid.windows(["ab", "", "x\x00y", "1 2"])
    back = ["".join(chr(int(c) >> s & 0x1FFFFF) for s in (42, 21, 0)) for c in codes]
    assert list(zip(back, owner.tolist(), strict=True)) == [(" ab", 0), ("ab ", 0), (" x ", 2), (" y ", 2)]


def test_no_language_is_crowded_out(spark, monkeypatch):
    """A language of few rows beside one with over 20,000 more frequent windows; nor does it matter how many vectors a task keeps."""
    rng = random.Random(6)
    crowd = ["".join(chr(rng.randrange(0x4E00, 0x8E00)) for _ in range(210)) for _ in range(100)]
    rows = [(i, text, "zh") for i, text in enumerate(crowd * 3)] + [(1000, "ab cde fghij klmno", "xx")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.codes) > 20_000
    texts = ["ab cde fghij", *crowd[:3]]
    langs, scores = model.predict(texts)
    assert langs == ["xx", "zh", "zh", "zh"] and scores[0] > 0.5
    monkeypatch.setattr(langid, "VECTORS", 50)
    again = langid.Profiles(model.languages, model.codes, model.prototypes).predict(texts)
    assert again[0] == langs and abs(again[1] - scores).max() < 1e-5
