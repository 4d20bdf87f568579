"""Whole texts to ids of a BPE vocabulary with word ends, word by word.

The vocabulary's own pre-tokenizer drops white space and never joins what it separates, so the
ids of a text are the ids of its words. A word's ids are asked from the tokenizers library
once and kept. Words of Latin letters, digits and ASCII marks (no apostrophe, which begins
contractions, and no ``<``, which begins special strings) are cut as the pre-tokenizer cuts
them and skip the library's normalizer, of which only the lower-casing matters to them; all
others go through it.

Edge cases: null and empty texts have no ids of their own.
"""

from __future__ import annotations

import functools
import re
import sys
from array import array

from sparkmos.llm.frames import text_blocks

#: Words kept per Python worker, and the longest one kept; more only costs time.
CACHE = 300_000
CACHED_CHARS = 64
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r'!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~'
PLAIN = re.compile(f"[{LETTERS}]+")
SIMPLE = re.compile(f"[{LETTERS}0-9{MARKS}]+")
PARTS = re.compile(f"[{LETTERS}]+|[0-9]|[{MARKS}]+")
#: Python takes these for white space, the vocabulary does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[ \t\n\r]+")


def _byte_level() -> dict[int, str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LEVEL = _byte_level()


class Words:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype, self.code = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")

    def _bytes(self, ids: list[int]) -> bytes:
        made = array(self.code, ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    @functools.lru_cache(maxsize=100_000)  # noqa: B019  one object per worker
    def _letters(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_LEVEL)
        return self._bytes([t.id for t in self.model.tokenize(word)])

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            return self._letters(word.lower())
        if SIMPLE.fullmatch(word):
            return b"".join([self._letters(p) for p in PARTS.findall(word.lower())])
        return self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, values: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``dtype``."""
        out: list[bytes] = []
        for _, block in text_blocks(values):
            if len(self.known) > CACHE:
                self.known.clear()
            known = self.known
            for v in block:
                words = [w for w in SPACE.split(v) if w] if SEPARATORS.search(v) else v.split()
                fresh = [w for w in set(words) if w not in known]
                for w in fresh:
                    known[w] = self._word(w)
                out.append(b"".join([known[w] for w in words]))
                for w in fresh:
                    if len(w) > CACHED_CHARS:
                        del known[w]
        return out


@functools.lru_cache(maxsize=2)
def words(path: str) -> Words:
    """One per Python worker, which Spark keeps from task to task."""
    return Words(path)


def release() -> None:
    words.cache_clear()
