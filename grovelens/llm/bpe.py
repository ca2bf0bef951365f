"""Byte-level BPE ids of whole texts, with a word cache in front of the libraries.

Every id comes from the vocabulary file, as `tokenizers` reads it. Natural text repeats its words, so each worker keeps
the ids of words it has seen. Splitting a text before a space that follows a non-blank character never changes its ids:
all pre-tokens begin with at most one space and either hold no blank after it or consist of blanks only. The words of a
batch that the cache lacks are encoded in one call of `tiktoken` over the same vocabulary and merges. Words with
characters whose class may differ between the two libraries' Unicode tables are given to `tokenizers`.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Words in a worker's cache, about 250 bytes each; when it is full it is emptied.
CACHE_WORDS = 150_000
#: Characters from here on are given to `tokenizers`.
OTHER_CHARACTERS = "Ԁ"
#: The pre-tokeniser of byte-level BPE (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NOT_PLAIN = re.compile(r"\s \s|\s \Z")
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")
_loaded: dict[str, WordEncoder] = {}


def _byte_of() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class WordEncoder:
    """ids of texts under the byte-level BPE in a tokenizers .json file; special strings become their ids, as is that library's default."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        added = {x["content"]: x["id"] for x in content["added_tokens"]}
        before, model = content.get("pre_tokenizer") or {}, content["model"]
        #: Whether the file is what the words' way through tiktoken stands for; any other file's texts go to `tokenizers` whole.
        self.plain = model.get("type", "BPE") == "BPE" and not content.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.plain = self.plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not self.plain:
            return
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in added}
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in added.items()}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words: dict[str, bytes] = {}

    def _one(self, text: str) -> bytes:
        if text.isascii() or max(text) < OTHER_CHARACTERS:
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Put the ids of " " + word into the cache for each word."""
        if len(self.words) + len(words) > self.cache_words:
            self.words.clear()
        together = []
        for w in words:
            if w and not w[0].isspace() and not w[-1].isspace() and (w.isascii() or max(w) < OTHER_CHARACTERS):
                together.append(w)
            else:
                self.words[w] = self._one(f" {w}")
        for at in range(0, len(together), 50_000):
            part = together[at : at + 50_000]
            text = " " + " ".join(part)
            ids = np.array(self.fast.encode_ordinary(text), "<u4")
            ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in part), np.int64, len(part)))
            cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
            raw, low = ids.tobytes(), 0
            for w, high in zip(part, (cuts * 4).tolist(), strict=True):
                self.words[w] = raw[low:high]
                low = high

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.plain:
            return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]
        split = []
        for text in texts:
            plain = [text] if self.special_cut is None else self.special_cut.split(text)
            own = []
            for k, part in enumerate(plain):
                if k % 2:
                    own.append((part, None))
                elif not _NOT_PLAIN.search(part):
                    first, *rest = part.split(" ")
                    own.append((first, rest))
                else:
                    first, *rest = _SAFE_CUT.split(part)
                    own.append((first, [x[1:] for x in rest]))
            split.append(own)
        out = []
        for at in range(0, len(split), 128):
            some = split[at : at + 128]
            seen = set()
            for own in some:
                for _, rest in own:
                    if rest:
                        seen.update(rest)
            missing = [w for w in seen if w not in self.words]
            if len(self.words) + len(missing) > self.cache_words:
                self.words.clear()
                missing = list(seen)
            if missing:
                self._learn(missing)
            words = self.words
            for own in some:
                parts = []
                for first, rest in own:
                    if rest is None:
                        parts.append(self.special[first])
                        continue
                    if first:
                        parts.append(self._one(first))
                    parts.extend(map(words.__getitem__, rest))
                out.append(b"".join(parts))
        return out

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) // 4 for ids in self.encode(texts)]


def encoder(path: str) -> WordEncoder:
    """The encoder of this process for the file at path."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
