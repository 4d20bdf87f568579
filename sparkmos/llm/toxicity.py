"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

Kernel: two words are as alike as the three-letter subsequences they share, each weighted by
``DECAY`` to the power of the span it is spread over in either word, up to ``SPAN`` letters,
over both words' norms; the third power of that keeps likeness apart from chance. So an insult
with gaps, inserted letters or a varied ending is still close to the plain one. Words are
folded first: letters lose case and accents, everything that is no letter is dropped
(``id-io.t``), and words of one letter in a row are one word (``i d i o t``).

Training: sentences of documents that are labelled clean are negative, word by word. Of the
sentences of a toxic document, the words with evidence are positive: letter runs that toxic
documents have far more often than clean ones (likelihood ratio). Landmarks are picked from
both by pivoted Cholesky; words become coordinates through the landmarks' kernel matrix, and a
linear machine with squared hinge loss is fitted there. Later rounds add the words of clean
documents that came out on the wrong side.

Scoring: every word of a text is scored (a distinct one once per worker, while it is kept);
words longer than ``PIECE`` letters by overlapping pieces. A document has the score of its
highest word, through a logistic curve fitted on documents kept out of training.

Edge cases: null and empty texts, and texts without letters, get the score of a text without
evidence. With no toxic or no clean document to learn from, all scores are the share of toxic
ones (0 if none is labelled). Null labels are not learnt from; of repeated labels the highest holds.
"""

from __future__ import annotations

import dataclasses
import functools
import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmos.llm.frames import map_added, texts

LETTERS = 28  # the word mark, a to z, any other letter
SPAN, PIECE, DECAY, POWER = 5, 14, 0.7, 3
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
LANDMARKS = 96
#: Bound of the labelled sample: documents per class.
TOXIC_DOCS, CLEAN_DOCS = 1500, 3000
#: Words whose values a worker keeps, and the longest one kept; more only costs time.
CACHE, CACHED_CHARS = 150_000, 64
DROP, BREAK = 255, 254
SINGLES = re.compile(r"(?<!\S)\S(?:[ \t]\S)+(?!\S)")
LOWEST, HIGHEST = -2.0, 2.0  # decision values are held within; the first is that of a text without letters


@functools.lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Letter code of every code point."""
    table = np.full(0x110000, DROP, dtype=np.uint8)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            base = unicodedata.normalize("NFD", ch)[0].lower() if cp < 0x250 else ch
            table[cp] = ord(base) - 96 if "a" <= base <= "z" else 27
    table[0] = BREAK
    return table


def fold(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the words as rows ``mark, letters, mark...``, and the word each belongs to."""
    width = PIECE + 1 + SPAN
    joined = "\0".join([w.replace("\0", "") for w in words] + [""])
    c = _folding()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    c = c[c != DROP]
    at = np.flatnonzero(c == BREAK)
    ends = at - np.arange(len(at))
    letters = c[c != BREAK]
    length = np.diff(np.concatenate([[0], ends]))
    count = np.where(length > 0, 1 + np.maximum(0, -(-(length - PIECE) // (PIECE // 2))), 0)
    word = np.repeat(np.arange(len(words)), count)
    k = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    first = (ends - length)[word] + k * (PIECE // 2)
    size = np.minimum(ends[word] - first, PIECE)
    rows = np.zeros((len(word), width), dtype=np.int8)
    column = np.arange(PIECE)
    inside = column < size[:, None]
    rows[:, 1 : PIECE + 1][inside] = letters[(first[:, None] + column)[inside]]
    return rows, word


def _subsequences(rows: np.ndarray) -> np.ndarray:
    """The subsequences of each row; those that start behind its letters are all marks."""
    at, rows = np.arange(PIECE), rows.astype(np.int32)
    return np.concatenate([(rows[:, at] * LETTERS + rows[:, at + a]) * LETTERS + rows[:, at + b] for a, b in OFFSETS], axis=1)


#: Weight of each column of ``_subsequences``.
SPREAD = np.repeat([DECAY ** (o[-1] + 1) for o in OFFSETS], PIECE).astype(np.float32)


def _norms(subsequences: np.ndarray) -> np.ndarray:
    # A subsequence that ends in two marks says nothing; it has weight 0 on either side.
    return np.sqrt(((subsequences % LETTERS**2 > 0) * SPREAD**2).sum(axis=1) + 1e-6).astype(np.float32)


class Landmarks:
    """Landmark words and their subsequence weights, one column each.

    They are picked by pivoted Cholesky: each is the word of ``pool`` that those before leave
    most of unexplained, times its ``weight``. Up to two thirds come from the ``first`` rows.
    """

    def __init__(self, pool: np.ndarray, weight: np.ndarray, first: int, most: int):
        own = _subsequences(pool)
        found, place = np.unique(own, return_inverse=True)
        place = place.reshape(own.shape)
        told = (own % LETTERS**2 > 0) * (SPREAD / _norms(own)[:, None])
        chosen, factors = [], np.zeros((len(pool), 0))
        dense = np.zeros(len(found))

        def against(i: int) -> np.ndarray:
            dense[:] = 0
            np.add.at(dense, place[i], told[i])
            return (dense[place] * told).sum(axis=1) ** POWER

        rest = full = np.array([against(i)[i] for i in range(len(pool))])
        for _ in range(min(most, len(pool))):
            left = rest / full
            own_kind = len(chosen) < 2 * most // 3 and left[:first].max() > 0.1
            i = int((weight * left)[: first if own_kind else None].argmax())
            if rest[i] <= 1e-3:
                break
            row = (against(i) - factors @ factors[i]) / np.sqrt(rest[i])
            factors = np.hstack([factors, row[:, None]])
            rest = np.maximum(rest - row**2, 0)
            rest[i] = 0
            chosen.append(i)
        self.table = np.zeros((LETTERS**3, len(chosen)), dtype=np.float32)
        for j, i in enumerate(chosen):
            np.add.at(self.table[:, j], own[i], told[i])
        inner = self.kernel(pool[chosen]).astype(np.float64)
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        self.root = vectors / np.sqrt(np.maximum(values, 1e-3 * values.max()))

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        """Kernel values of words with the landmarks."""
        out = np.zeros((len(rows), self.table.shape[1]), dtype=np.float32)
        for lo in range(0, len(rows), 1024):
            own = _subsequences(rows[lo : lo + 1024])
            told = SPREAD / _norms(own)[:, None]
            part = out[lo : lo + 1024]
            for k in np.flatnonzero((own % LETTERS**2 > 0).any(axis=0)).tolist():
                part += told[:, k : k + 1] * self.table[own[:, k]]
        return np.power(out, POWER, out=out)


_USED: dict[str, Model] = {}


@dataclasses.dataclass
class Model:
    landmarks: Landmarks | None
    weights: np.ndarray | None  # one per landmark
    bias: float
    slope: float
    offset: float

    def __post_init__(self):
        self.known: dict[str, float] = {}
        self.key = uuid.uuid4().hex

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, known={})

    def kept(self) -> Model:
        """The copy that this worker has used before, with the words it knows."""
        if self.key not in _USED:
            _USED.clear()
            _USED[self.key] = self
        return _USED[self.key]

    def values(self, words: list[str]) -> np.ndarray:
        """Decision value of each word."""
        out = np.full(len(words), LOWEST)
        for lo in range(0, len(words), 4096):
            rows, word = fold(words[lo : lo + 4096])
            np.maximum.at(out, word + lo, self.landmarks.kernel(rows) @ self.weights + self.bias)
        return np.minimum(out, HIGHEST)

    def raw(self, texts_: list[str]) -> np.ndarray:
        """Highest word of each text."""
        if len(self.known) > CACHE:
            self.known.clear()
        known, out = self.known, np.full(len(texts_), LOWEST)
        cut = [set(t.split()) | {x.replace(" ", "").replace("\t", "") for x in SINGLES.findall(t)} for t in texts_]
        fresh = list({w for ws in cut for w in ws if w not in known})
        fresh.sort(key=len)  # words of like length share their empty columns
        known.update(zip(fresh, self.values(fresh).tolist()))
        for i, ws in enumerate(cut):
            out[i] = max([known[w] for w in ws], default=LOWEST)
        for w in fresh:
            if len(w) > CACHED_CHARS:
                del known[w]
        return out

    def score(self, texts_: list[str]) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(texts_), self.offset)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts_) + self.offset, -40, 40)))


def _grams(rows: np.ndarray) -> np.ndarray:
    """Runs of four letters, of which the first may be the mark; -1 behind a word's end."""
    rows = rows[:, : PIECE + 3].astype(np.int32)
    g = ((rows[:, :-3] * LETTERS + rows[:, 1:-2]) * LETTERS + rows[:, 2:-1]) * LETTERS + rows[:, 3:]
    return np.where(rows[:, 3:] > 0, g, -1)[:, :PIECE]


def _llr(k1, n1, k0, n0):
    """Signed log likelihood ratio of the two shares."""
    p = (k1 + k0) / (n1 + n0)

    def part(k, n, q):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(q), 0) + np.where(n - k > 0, (n - k) * np.log1p(-q), 0)

    value = 2 * (part(k1, n1, k1 / n1) + part(k0, n0, k0 / n0) - part(k1, n1, p) - part(k0, n0, p))
    return np.where(k1 / n1 > k0 / n0, value, -value)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps on the violated rows; last entry: bias."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penal = np.full(x.shape[1], ridge)
    penal[-1] = 1e-6
    for _ in range(30):
        bad = y * (x @ w) < 1
        xb = x[bad] * weight[bad, None]
        new = np.linalg.solve(xb.T @ x[bad] + np.diag(penal), xb.T @ y[bad])
        if np.allclose(new, w, rtol=1e-6, atol=1e-8):
            break
        w = new
    return w


def train(values: list[str], toxic: np.ndarray, weight: np.ndarray, rounds: int = 4, seed: int = 7) -> Model:
    """Fit on labelled documents. ``weight``: how many documents of the table each stands for."""
    toxic = np.asarray(toxic).astype(bool)
    share = float(np.average(toxic, weights=weight)) if len(toxic) else 0.0
    if not toxic.any() or toxic.all():
        return Model(None, None, 0.0, 0.0, share)
    rng = np.random.default_rng(seed)
    keep_out = np.arange(len(values)) % 4 == 3  # for the logistic curve
    if (toxic & keep_out).sum() < 5 or (~toxic & keep_out).sum() < 5:
        keep_out[:] = False
    fit = np.flatnonzero(~keep_out)
    bad = toxic[fit]

    # Distinct words and the documents of either kind that have them.
    index: dict[str, int] = {}
    bags = [np.array([index.setdefault(w, len(index)) for w in set(values[i].split())], dtype=np.int32) for i in fit]
    rows, word = fold(list(index))
    n_words = len(index)
    index.clear()
    if not len(rows):
        return Model(None, None, 0.0, 0.0, share)
    none = np.zeros(0, dtype=np.int32)
    in_docs = np.stack([np.bincount(np.concatenate([none, *[b for b, k in zip(bags, bad) if k == kind]]), minlength=n_words) for kind in (False, True)], axis=1)
    in_docs = in_docs[word]
    grams = _grams(rows)
    n1, n0 = bad.sum(), (~bad).sum()
    # Grams of word k: flat[at[k]:at[k + 1]]; pieces of a word follow one another.
    told = grams >= 0
    flat = grams[told]
    at = np.concatenate([[0], np.cumsum(np.bincount(word, weights=told.sum(axis=1), minlength=n_words))]).astype(np.int64)
    k1, k0 = np.zeros(LETTERS**4), np.zeros(LETTERS**4)
    for bag, kind in zip(bags, bad):
        own = np.unique(np.concatenate([none, *[flat[at[k] : at[k + 1]] for k in bag.tolist()]]))
        (k1 if kind else k0)[own] += 1
    evidence = _llr(k1, n1, k0, n0)
    value = np.full(len(rows), -np.inf)
    np.maximum.at(value, np.nonzero(told)[0], evidence[flat])
    del grams, told, flat
    # Positive words have a run of letters with evidence, near the best of some toxic document,
    # and are not themselves usual in clean documents.
    by_word = np.full(n_words, -np.inf)
    np.maximum.at(by_word, word, value)
    near = np.zeros(n_words, dtype=bool)
    for own, kind in zip(bags, bad):
        if kind and len(own):
            near[own[by_word[own] >= max(10.0, 0.3 * by_word[own].max())]] = True
    usual = in_docs[:, 0] / n0 > 0.1 * in_docs[:, 1] / n1
    hot = near[word] & (value >= 10) & ~usual
    cold = in_docs[:, 0] > 0
    positive, place = np.unique(rows[hot], axis=0, return_inverse=True)
    if not len(positive) or not cold.any():
        return Model(None, None, 0.0, 0.0, share)
    times = np.sqrt(np.bincount(place.ravel(), weights=in_docs[hot, 1]))
    clean = np.unique(rows[cold], axis=0)
    del rows, word, in_docs, bags
    chosen = np.zeros(len(clean), dtype=bool)
    chosen[rng.choice(len(clean), min(len(clean), 8000), replace=False)] = True
    for turn in range(rounds):
        negative = clean[chosen]
        if turn < 2:  # then the landmarks stay
            hard = negative if turn == 0 else clean[worst]
            most = np.argsort(-times)[:600]
            hard = rng.permutation(hard)[:600]
            level = np.concatenate([times[most], np.full(len(hard), np.median(times[most]))])
            marks = Landmarks(np.concatenate([positive[most], hard]), level, len(most), LANDMARKS)
        x = marks.kernel(np.concatenate([positive, negative])) @ marks.root
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        w = _svm(x, y, np.concatenate([times, np.full(len(negative), max(0.2, 4 * times.sum() / len(negative)))]))
        weights, bias = marks.root @ w[:-1], w[-1]
        score = np.concatenate([marks.kernel(clean[lo : lo + 8192]) @ weights for lo in range(0, len(clean), 8192)]) + bias
        worst = np.argsort(-score)[:3000]
        chosen[worst[score[worst] > -0.9]] = True
    model = Model(marks, weights, float(bias), 1.0, 0.0)
    use = np.flatnonzero(keep_out) if keep_out.any() else fit
    model.slope, model.offset = _logistic(model.raw([values[i] for i in use]), toxic[use], np.asarray(weight, dtype=float)[use])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, lightly held back so that separable data stay finite."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1)
    weight = weight / weight.mean()
    b = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag([0.02, 1e-6])
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - np.array([0.02, 1e-6]) * b)
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 0) / scale), float(b[1] - max(b[0], 0) * mean / scale)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    held_out=None,
    toxic_docs: int = TOXIC_DOCS,
    clean_docs: int = CLEAN_DOCS,
) -> Model:
    """Learn from ``labels`` (doc_id, toxic), but for the documents where ``held_out`` is true.

    At most ``toxic_docs`` and ``clean_docs`` documents are learnt from, those whose ids hash
    lowest: that sample alone passes through the driver.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out is not None:
        known = known.where(~F.coalesce(held_out, F.lit(False)))
    sizes = {int(r.toxic): r.n for r in known.groupBy(F.col("toxic").cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    dealt = F.xxhash64("doc_id"), F.col("doc_id")
    sample = None
    for kind, most in ((1, toxic_docs), (0, clean_docs)):
        part = known.where(F.col("toxic") == kind).orderBy(*dealt).limit(most)
        sample = part if sample is None else sample.unionByName(part)
    # The sample of ids is bounded by the two limits above.
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").orderBy(*dealt).collect()
    kinds = np.array([int(r.toxic) for r in rows], dtype=int)
    found = np.bincount(kinds, minlength=2)
    weight = np.array([sizes.get(int(k), 1) / max(1, found[k]) for k in kinds])
    return train([r.text or "" for r in rows], kinds, weight)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the toxicity of every whole text, 0 to 1. No shuffle."""

    def make(batches):
        own = model.kept()
        for b in batches:
            yield [pa.array(own.score(texts(b, text)), pa.float64())]

    return map_added(df, [T.StructField(out, T.DoubleType())], make)


def release() -> None:
    """What this operator keeps in a worker."""
    _USED.clear()
    _folding.cache_clear()
