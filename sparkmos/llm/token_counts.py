"""Token counts of whole documents, huge ones by overlapping chunks.

A text longer than ``chunk`` code points is encoded chunk by chunk, each chunk repeating the
last ``overlap`` code points of the one before, with offsets. The two encodings are spliced at
a token they share: one with the same start and end in both. That is a proven seam. Byte pair
encodings are decided pair by pair: a sequence of tokens is the encoding of its text exactly
if every two neighbours are the encoding of theirs. Before the shared token all neighbours
come from one encoding, after it from the other, and the shared token itself has its left
neighbour in the one and its right neighbour in the other. Where no token is shared, the
overlap is doubled, until it reaches back to the start of the chunk before; a text without a
seam even then is encoded whole.

Tokens at the two outer edges of an encoding do not count as shared: the first may come from
the word-start mark that the library puts before any text, the last may have been cut.

Edge cases: null text is the empty text, which has 0 tokens. Rows stay in their tasks, one
chunk is in memory at a time besides the text, nothing is shuffled.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkmos.llm.frames import map_added, text_blocks, texts, vocabulary

CHUNK = 32_768
OVERLAP = 256


@functools.lru_cache(maxsize=2)
def library(path: str):
    """The tokenizer of a vocabulary file, one per Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        return SentencePieces(sentencepiece.SentencePieceProcessor(model_file=path))
    from tokenizers import Tokenizer

    return Tokens(Tokenizer.from_file(path))


class SentencePieces:
    def __init__(self, model):
        self.model = model
        n = model.get_piece_size()
        # Code points of each piece; of a character in bytes, the first byte stands for it.
        self.length = np.array([len(model.id_to_piece(i)) for i in range(n)], dtype=np.int64)
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.length[i] = value < 0x80 or value >= 0xC0

    def counts(self, values: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(values, return_type="numpy", num_threads=1)]

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last positions of the tokens of ``text``."""
        ids = self.model.encode(text, return_type="numpy", num_threads=1)
        ends = np.cumsum(self.length[ids]) - 1  # less the word-start mark before the text
        if not len(ends) or ends[-1] != len(text):  # a model that rewrites texts
            pairs = np.array(self.model.encode(text, return_type="offset_mapping")["offsets"], dtype=np.int64).reshape(-1, 2)
            return pairs[:, 0], pairs[:, 1]
        return np.concatenate([[0], ends[:-1]]), ends


class Tokens:
    """Tokenizers that look ahead before they merge; their texts are never cut."""

    offsets = None

    def __init__(self, model):
        self.model = model

    def counts(self, values: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode_batch(values, add_special_tokens=False)]


def splice(before, after, skip: int, shift: int, last: bool) -> tuple[int, int] | None:
    """Indexes of the last token of some length that both encodings have, edges aside.

    ``shift`` is where the second text starts in the first; tokens before ``skip`` are settled.
    A character may be several byte tokens of which one has a length, so the seam lies before
    a token whose left neighbour has one too.
    """
    (b0, b1), (a0, a1) = before, after
    i = np.arange(max(skip + 1, np.searchsorted(b0, shift)), len(b0) - 1)
    i = i[(b1[i] > b0[i]) & (b1[i - 1] > b0[i - 1])]
    j = np.minimum(np.searchsorted(a1, b1[i] - shift), len(a1) - 1)
    fits = (a0[j] + shift == b0[i]) & (a1[j] + shift == b1[i]) & (j > 0) & (last | (j < len(a1) - 1))
    at = np.flatnonzero(fits)
    return (int(i[at[-1]]), int(j[at[-1]])) if len(at) else None


def count_long(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of one long text."""
    total, start, end = 0, 0, min(chunk, len(text))
    offsets = tokenizer.offsets(text[:end])
    skip = 0  # tokens of this chunk that lie before its seam with the chunk before
    while end < len(text):
        width = min(overlap, chunk // 2)
        while True:
            begin = max(start, end - width)
            to = min(len(text), max(end + chunk - width, end + chunk // 2))
            after = tokenizer.offsets(text[begin:to])
            seam = splice(offsets, after, skip, begin - start, to == len(text))
            if seam or begin == start:
                break
            width *= 2
        if seam is None:  # nothing shared within a whole chunk
            return tokenizer.counts([text])[0]
        total += seam[0] - skip
        offsets, skip, start, end = after, seam[1], begin, to
    return total + len(offsets[0]) - skip


def count_tokens(
    df: DataFrame,
    text: str = "text",
    path: str | None = None,
    count: str = "n_tokens",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``df`` with the number of tokens its texts have in the library of the vocabulary at ``path``.

    No begin, end or added special tokens, no truncation; special strings inside a text are
    what the library makes of them by default.
    """
    where = path or vocabulary("piece_bpe_32k.model")

    def make(batches):
        tokenizer = library(where)
        for b in batches:
            values = texts(b, text)
            counts = [0] * len(values)
            for first, block in text_blocks(values):
                short = [i for i, v in enumerate(block) if len(v) <= chunk or tokenizer.offsets is None]
                for i, n in zip(short, tokenizer.counts([block[i] for i in short])):
                    counts[first + i] = n
                for i in set(range(len(block))) - set(short):
                    counts[first + i] = count_long(block[i], tokenizer, chunk, overlap)
            yield [pa.array(counts, pa.int64())]

    return map_added(df, [T.StructField(count, T.LongType())], make)
