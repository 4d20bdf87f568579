"""Language identification by bit-sliced Bloom filters over letter n-grams.

One table of ``2 ** BITS`` words holds the filters of all languages: bit ``l`` of a word
belongs to language ``l``. An n-gram sets its language's bit in ``HASHES`` words; looked up, the
bitwise and of those words is the mask of all languages that contain it, in one pass whatever
their number. A text is decided by popcounts per language over its n-grams, corrected for the
false positives each language's filter gives: of ``n`` n-grams and ``h`` hits, at a false
positive rate ``f``, ``(h - f n) / (1 - f)`` are real.

N-grams are of four letters (lower case; one word mark before and after each word; everything
that is no letter separates words). A language contains the n-grams that are not much rarer in
it than in the language that has them most often, so that stray foreign lines add nothing.

Edge cases: null texts and texts without a letter are ``und`` with score 0. A text whose
n-grams are in no filter gets the first language, in alphabetical order, with score 0. With
nothing to learn from, every text is ``und``. Of equal counts the first language wins.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmos.llm.frames import begin, map_added, text_blocks, texts

GRAM = 4
BITS, HASHES = 20, 3
#: An n-gram belongs to a language if its share there is at least this part of its largest share.
SHARE = 0.1
#: Bounds of the labelled sample, per language: documents, and n-grams taken from it.
DOCS, GRAMS = 4000, 60_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Lower-case code point of every letter, 0 for everything else."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            table[cp] = ord(ch.lower()[0])
    return table


def grams(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes of all texts, the text each comes from, and which texts have letters."""
    joined = "\0".join(["", *[v.replace("\0", " ") for v in values], ""])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _lower()[raw]
    keep = np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)]) | (raw == 0)
    text = np.cumsum(raw == 0)[keep] - 1
    c = c[keep].astype(np.uint64)
    lettered = np.bincount(text[c > 0], minlength=len(values))[: len(values)] > 0
    n = len(c) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), lettered
    h, inner = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for k in range(GRAM):
        h = (h + c[k : k + n]) * MIX[0]
        h ^= h >> np.uint64(29)
        if 0 < k < GRAM - 1:
            inner &= c[k : k + n] > 0
    inner &= (c[:n] > 0) | (c[GRAM - 1 :] > 0)
    inner &= text[:n] == text[GRAM - 1 :]
    return h[inner], text[:n][inner], lettered


def places(h: np.ndarray) -> Iterator[np.ndarray]:
    """The ``HASHES`` words of each n-gram."""
    for k in range(HASHES):
        yield ((h ^ (h >> np.uint64(31))) * MIX[k]) >> np.uint64(64 - BITS)


@dataclasses.dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # one word per place, one bit per language
    false_rate: np.ndarray

    def predict(self, values: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages or not values:
            return [UNKNOWN] * len(values), np.zeros(len(values))
        h, text, lettered = grams(values)
        mask = None
        for at in places(h):
            mask = self.table[at] if mask is None else mask & self.table[at]
        n = np.bincount(text, minlength=len(values)).astype(float)[: len(values)]
        real = np.zeros((len(values), len(self.languages)))
        for k, f in enumerate(self.false_rate):
            hits = np.bincount(text, weights=(mask >> np.uint64(k)) & np.uint64(1), minlength=len(values))[: len(values)]
            real[:, k] = np.maximum(0, (hits - f * n) / (1 - f))
        best = real.argmax(axis=1)
        top = real.max(axis=1)
        # How much of the text the language explains.
        score = np.where(lettered & (n > 0), np.minimum(1.0, top / np.maximum(n, 1)), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())], score


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    held_out=None,
    docs_per_language: int = DOCS,
    grams_per_language: int = GRAMS,
) -> Filters:
    """Filters of the languages of ``docs``.

    About ``docs_per_language`` documents of each language are learnt from, those that hash
    lowest, and at most its ``grams_per_language`` commonest n-grams are kept: these alone pass
    through the driver. At most 64 languages.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if held_out is not None:
        known = known.where(~F.coalesce(held_out, F.lit(False)))
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64("doc_id", text).alias("dealt"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if len(sizes) > 64:
        raise ValueError("a bit-sliced table has room for 64 languages")
    condition = F.lit(False)
    for name, n in sizes.items():
        part = min(1.0, docs_per_language / n)
        lowest = F.shiftrightunsigned("dealt", 11) < F.lit(int(part * (1 << 53)))
        condition = condition | ((F.col("lang") == name) & lowest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(__name__)
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            names = np.array(b.column(0).to_pylist(), dtype=object)
            values = texts(b, "text")
            for name in set(names.tolist()):
                own = [v for v, m in zip(values, names == name) if m]
                for _, block in text_blocks(own):
                    h, times = np.unique(grams(block)[0], return_counts=True)
                    if name in total:
                        h = np.concatenate([total[name][0], h])
                        times = np.concatenate([total[name][1], times])
                        h, place = np.unique(h, return_inverse=True)
                        times = np.bincount(place, weights=times).astype(np.int64)
                    total[name] = h, times
        for name, (h, times) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(h)), pa.array(h.view(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "gram", "n"]
            )

    sums = known.where(condition).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    sums = sums.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    return _build(sorted(sizes), sums, grams_per_language)


def _build(names: list[str], sums: DataFrame, most: int) -> Filters:
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    rows = ranked.where(F.col("rank") <= most).select("lang", "gram", "n").toArrow()
    table = np.zeros(1 << BITS, dtype=np.uint64)
    if not rows.num_rows:
        return Filters([], table, np.zeros(0))
    index = {name: k for k, name in enumerate(names)}
    lang = np.array([index[x] for x in rows.column("lang").to_pylist()])
    h = rows.column("gram").to_numpy().view(np.uint64)
    n = rows.column("n").to_numpy().astype(float)
    share = n / np.bincount(lang, weights=n, minlength=len(names))[lang]
    gram, place = np.unique(h, return_inverse=True)
    largest = np.zeros(len(gram))
    np.maximum.at(largest, place, share)
    own = share >= SHARE * largest[place]
    for at in places(h[own]):
        np.bitwise_or.at(table, at, np.uint64(1) << lang[own].astype(np.uint64))
    rate = [((table >> np.uint64(k)) & np.uint64(1)).mean() ** HASHES for k in range(len(names))]
    return Filters(names, table, np.array(rate))


def predict(df: DataFrame, filters: Filters, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the language of every whole text and how much of the text it explains, 0 to 1."""

    def make(batches):
        for b in batches:
            values = texts(b, text)
            names: list[str] = []
            scores = [np.zeros(0)]
            for _, block in text_blocks(values, 1_000_000):
                n, s = filters.predict(block)
                names += n
                scores.append(s)
            yield [pa.array(names, pa.string()), pa.array(np.concatenate(scores), pa.float64())]

    return map_added(df, [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())], make)


def release() -> None:
    """What this operator keeps in a worker."""
    _lower.cache_clear()
