"""Exact token ids with a word cache, for tokenizers that drop white space.

The word tokenizer treats runs of white space only as a separator, so the ids of a text
are the ids of its pieces between spaces and line ends, one after the other. Most
pieces recur, and a bounded cache per Python worker spares their merges.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_left

WORD_BPE = "word_bpe_49k.json"
CACHE_WORDS = 1_200_000
MARKS = frozenset(".,!?;:")


def default_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts, equal to ``encode(text, add_special_tokens=False).ids``."""

    _loaded: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_file(path)
        self._cache: dict[str, bytes] = {}
        self._letters = self._plain_letters()

    @classmethod
    def load(cls, path: str | None = None) -> "WordTokenizer":
        path = path or default_path()
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _plain_letters(self) -> frozenset[str]:
        """Letters below U+0250 that stand inside one word, as the tokenizer itself sees it."""
        letters = [c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1]
        seen = self._tokenizer.encode_batch([f"a{c}a" for c in letters], add_special_tokens=False)
        return frozenset(c for c, e in zip(letters, seen) if e.ids and set(e.word_ids) == {0})

    def _learn(self, words: set[str]) -> None:
        """Cache the ids of ``words``; plain words and their forms with a final mark or capitals share merges."""
        known, plain_letters = self._cache, self._letters.issuperset
        forms, plain, other = [], set(), set(MARKS.difference(known))
        for w in words:
            core, mark = (w[:-1], w[-1]) if w[-1:] in MARKS and len(w) > 1 else (w, "")
            if core and plain_letters(core):
                # the same ids by the tokenizer's own first steps: lower case, a final mark by itself
                core = core.lower()
                if core not in known:
                    plain.add(core)
                if mark or core != w:
                    forms.append((w, core, mark))
            else:
                other.add(w)
        plain = list(plain)
        for at in range(0, len(plain), 500):  # one call for many words: each is one word of the joined text
            part = plain[at : at + 500]
            e = self._tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = array("I", e.ids).tobytes()
            cuts = [bisect_left(e_words, k) * 4 for e_words in (e.word_ids,) for k in range(len(part) + 1)]
            known.update(zip(part, map(ids.__getitem__, map(slice, cuts, cuts[1:]))))
        other = list(other)
        for at in range(0, len(other), 5000):
            part = other[at : at + 5000]
            for w, e in zip(part, self._tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()
        for w, core, mark in forms:
            known[w] = known[core] + known[mark] if mark else known[core]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null texts have none."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self._cache) > CACHE_WORDS:
            self._cache.clear()
        known = self._cache
        missing = set().union(*split).difference(known)
        if missing:
            self._learn(missing)
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def counts(self, texts: list[str | None]) -> list[int]:
        return [len(b) // 4 for b in self.ids(texts)]



