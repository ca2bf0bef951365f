import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from grovelens.llm import packing, tokencount
from grovelens.llm.bpe import WordEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_word_encoder_gives_the_library_ids(library):
    rng = random.Random(1)
    parts = [*" \n\t\r\x0b\x1c\x1f\x85\xa0ab'sZé日本ñ12٣,", "<|endoftext|>", "  ", "\n\n", " \n", "'ll", "😀", "Ⅷ", "ก", "\ufeff", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)] + ["the cat " * 3000]
    coder = WordEncoder(PATH, cache_words=500)
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_counts_on_odd_rows_and_a_kept_cache(spark, odd, none, library, tmp_path):
    cache = str(tmp_path / "cache")
    want = sorted(((r.doc_id or -1), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    for _ in range(2):
        got = tokencount.count_tokens(odd, PATH, cache=cache).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert spark.read.parquet(cache).count() == len({r.text or "" for r in odd.collect()})  # the second call encoded nothing
    assert tokencount.count_tokens(none, PATH, cache=cache).count() == 0


def test_pack_group_fills_every_sequence():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 5, rng.randint(1, 100), rng.randint(1, 9000)]) for _ in range(rng.randint(0, 40))]
        pieces, n = packing.pack_group(sizes)
        for d, size in enumerate(sizes):
            at = 0
            for start, length in sorted((p[1], p[2]) for p in pieces if p[0] == d):
                assert start == at and length > 0
                at += length
            assert at == size
        for k in range(n):
            at = 0
            for offset, length in sorted((p[4], p[2]) for p in pieces if p[3] == k):
                assert offset == at
                at += length
            assert at == 2048 or (0 < at < 2048 and at & (at - 1) == 0)


def test_packing_takes_the_cheapest_sequence_with_room():
    pieces, n = packing.pack_group([1000, 900, 800, 700, 348, 348])
    assert n == 2 and all(p[2] == s for p, s in zip(sorted(pieces), [1000, 900, 800, 700, 348, 348], strict=True))
    cost = [sum(packing.cost(p[2]) for p in pieces if p[3] == k) for k in range(n)]
    assert abs(cost[0] - cost[1]) < 300


@pytest.mark.parametrize("group", [packing.GROUP_TOKENS, 500])
def test_packed_pieces_rebuild_every_text(spark, odd, none, library, group):
    rows = packing.pack(odd.repartition(3), PATH, group_tokens=group).collect()
    want = sorted(np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for r in odd.collect())
    docs, at = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id or -1, r.doc_tokens, r.start, r.sequence_id)):
        assert len(r.ids) == 4 * r.length
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for parts in at.values():
        size = 0
        for offset, length in sorted(parts):
            assert offset == size
            size += length
        assert size == 2048 or size & (size - 1) == 0
    assert sum(r.length for r in rows) * 4 == sum(map(len, want))
    whole = sorted(zlib.crc32(b"".join(ids for _, ids in sorted(v))) for k, v in docs.items() if k[0] != 4)
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id != 4}
    assert whole == sorted(zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for t in texts.values())
    assert packing.pack(none, PATH).count() == 0


def test_another_kind_of_file_is_left_to_the_library(tmp_path):
    """A file whose texts aren't cut as the cache expects goes through the library whole."""
    import json

    with open(PATH, encoding="utf-8") as f:
        content = json.load(f)
    assert WordEncoder(PATH).plain
    content["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    (tmp_path / "other.json").write_text(json.dumps(content), encoding="utf-8")
    other = WordEncoder(str(tmp_path / "other.json"))
    texts = ["word and words", "", "Grüße <|endoftext|> x"]
    assert not other.plain and other.count(texts) == [len(other.library.encode(t, add_special_tokens=False).ids) for t in texts]
