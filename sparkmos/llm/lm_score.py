"""Scores by cross-entropy difference of two matched n-gram models.

A target model and a background model share one vocabulary (every word of the background
corpus), one order (pairs of words, with a start mark) and one smoothing; the background's
counts are brought to the target's size, so neither model is sharper for having read more. A
document's score is the mean over its tokens of the target model's loss less the background
model's: low scores are like the target.

All counts are taken over all documents, of all words and all pairs. Words, contexts and pairs
go by 64-bit hashes. Documents are dealt into blocks; a block hands on each of its keys once,
with how often it has it, by ranges of the hash (``keys``). Where a range comes together, the
blocks' numbers are added up and every block is told the sums of its keys, in the order in
which it asked (``sums``); the block's texts meet these answers and are scored. A word that all
documents share is one key per block, and the driver holds three totals. Among 3 billion
different pairs (30 GB of documents) a quarter of one clash of hashes is to be expected, which would
add up the counts of two pairs.

With ``size`` the models know the commonest words only, every other word being one unknown word;
then the table of loss differences is ``size ** 2`` numbers that go to every task.

Words are runs of characters other than space and 9 to 13, with A-Z in lower case; of equally
frequent words the smaller in UTF-8 enters a vocabulary of fixed size.

Edge cases: null and empty texts have no tokens and null scores. With an empty target or
background the loss of every word is that of the unigram floor. A word that a separate
background lacks has no counts there.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmos.llm.frames import ROWS, begin, free_name, map_added, text_blocks, texts, with_fields, without
from sparkmos.session import materialize

#: Size of a fixed vocabulary. Its ids: 0 the unknown word, 1 the start mark, then words.
VOCABULARY = 1024
#: Weight of the unigram model in a context, in counts; floor of a unigram count.
PRIOR, FLOOR = 50.0, 0.5
WORD = re.compile("[^ \t-\r]+")
UPPER = {c: c + 32 for c in range(65, 91)}
#: Distinct words counted in a task before they are handed on.
HELD = 300_000
#: Code points of a block of documents at most and at least, blocks wanted, and code points of all blocks per range of keys.
BLOCK, LEAST_BLOCK, BLOCKS, RANGE = 3_000_000, 250_000, 128, 10_000_000
#: Hash of the start mark; a word has it once in 2 ** 64.
START = 0x9E3779B97F4A7C15
#: What a key stands for: a pair, a word.
PAIR, ONE = range(2)


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(UPPER) if not text.islower() else text)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            for _, block in text_blocks(texts(b.slice(at, ROWS), "text")):
                yield block


def vocabulary(corpus: DataFrame, text: str = "text", size: int = VOCABULARY) -> list[str]:
    """The ``size - 2`` commonest words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for block in _sliced(batches):
            for v in block:
                held.update(words(v))
            if len(held) > HELD:
                yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    counted = corpus.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size - 2)
    return [r.word for r in top.collect()]


def _pairs(block: list[str], index: dict[str, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair codes of all texts and how many each text has."""
    get, flat, counts = index.get, [], []
    for v in block:
        ws = words(v)
        if ws:
            flat.append(1)
            flat += [get(w, 0) for w in ws]
        counts.append(len(ws))
    counts = np.array(counts, dtype=np.int64)
    ids = np.array(flat, dtype=np.int64)
    if not len(ids):
        return ids, counts
    return (ids[:-1] * size + ids[1:])[ids[1:] != 1], counts


def pair_counts(corpus: DataFrame, vocab: list[str], text: str = "text", size: int = VOCABULARY) -> np.ndarray:
    """How often each word follows each, over all texts."""
    index = {w: k + 2 for k, w in enumerate(vocab)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for block in _sliced(batches):
            total += np.bincount(_pairs(block, index, size)[0], minlength=size * size)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    counted = corpus.select(F.col(text).alias("text")).mapInArrow(count, "cell long, n long")
    found = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most size ** 2 rows
    out = np.zeros(size * size)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def losses(counts: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Loss of each word after each, in nats."""
    c = counts * scale
    word = c.sum(axis=0) + FLOOR
    word[1] = FLOOR  # the start mark follows nothing
    unigram = word / word.sum()
    return -np.log((c + PRIOR * unigram) / (c.sum(axis=1, keepdims=True) + PRIOR))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Keys:
    """Keys of one kind in a block: the distinct ones in order, their numbers, and where each token's are.

    Pairs have one number. Words have two: how often they occur, and how often as the first of a pair.
    """

    distinct: np.ndarray
    n: np.ndarray
    of_token: list[np.ndarray]

    def edges(self, ranges: int) -> np.ndarray:
        """Where each range of the hash begins among the distinct keys; ``ranges`` is a power of two."""
        if ranges == 1:
            return np.array([0, len(self.distinct)])
        starts = np.arange(ranges, dtype=np.uint64) << np.uint64(64 - ranges.bit_length() + 1)
        return np.append(np.searchsorted(self.distinct, starts), len(self.distinct))


def keys(block: list[str]) -> tuple[np.ndarray, list[Keys]]:
    """How many words each text has, and the keys of its pairs and of its words with the start mark."""
    index: defaultdict[str, int] = defaultdict()
    index.default_factory = index.__len__
    counts, parts = np.zeros(len(block), np.int64), [np.zeros(0, np.int32)]
    for i, v in enumerate(block):
        ws = words(v)
        counts[i] = len(ws)
        parts.append(np.fromiter(map(index.__getitem__, ws), np.int32, len(ws)))
    ids = np.concatenate(parts)
    hashes = np.frombuffer(b"".join(blake2b(w.encode(), digest_size=8).digest() for w in index), np.uint64)
    hashes = np.append(hashes, np.uint64(START))
    before = np.roll(ids, 1)
    before[(np.cumsum(counts) - counts)[counts > 0]] = len(index)
    distinct, of_token, n = np.unique(_mixed(_mixed(hashes)[before] * np.uint64(3) + hashes[ids]), return_inverse=True, return_counts=True)
    n_words, n_first = np.bincount(ids, minlength=len(hashes)), np.bincount(before, minlength=len(hashes))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return counts, [Keys(distinct, n[None, :], [of_token]), Keys(hashes[order], np.stack([n_words, n_first])[:, order], [rank[ids], rank[before]])]


def packed(x: np.ndarray) -> bytes:
    """Numbers of 64 bits, all first bytes before all second ones: zeros come together and take little room."""
    return x.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


ASKED = "kind int, part int, block long, keys binary, n binary, target boolean"
TOLD = "block long, kind int, part int, background binary, target binary, n_background long, n_target long, n_words long"
KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _table(made: list[tuple], schema: str) -> pa.Table:
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*made)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _asked(corpus: DataFrame, text: str, block: str, ranges: int, target: bool, counted: bool, answer: bool) -> DataFrame:
    """The keys of each block by kind and range, with their numbers (0 if not ``counted``)."""

    def ask(group: pa.Table) -> pa.Table:
        begin(__name__)
        number = group["block"][0].as_py() if answer else None
        made = []
        for kind, k in enumerate(keys([x or "" for x in group["text"].to_pylist()])[1]):
            at = k.edges(ranges)
            for part in np.flatnonzero(np.diff(at)).tolist():
                own = slice(at[part], at[part + 1])
                made.append((kind, part, number, packed(np.diff(k.distinct[own], prepend=np.uint64(0))), packed(k.n[:, own].ravel() * counted), target))
        return _table(made, ASKED)

    return corpus.select(F.col(text).alias("text"), F.col(block).alias("block")).groupBy("block").applyInArrow(ask, ASKED)


def sums(asked: DataFrame) -> DataFrame:
    """For each block its keys' numbers in the background and the target, and a row of totals per range of words."""

    def add(group: pa.Table) -> pa.Table:
        kind, part = group["kind"][0].as_py(), group["part"][0].as_py()
        lists = [np.cumsum(unpacked(x), dtype=np.uint64) for x in group["keys"].to_pylist()]
        sizes = [len(x) for x in lists]
        distinct, place = np.unique(np.concatenate(lists), return_inverse=True)
        n = np.concatenate([unpacked(x).reshape(-1, size) for x, size in zip(group["n"].to_pylist(), sizes)], axis=1).astype(np.float64)
        wanted = np.repeat(group["target"].to_numpy(), sizes).astype(bool)
        background, target = [np.stack([np.bincount(place, weights=x * w, minlength=len(distinct)) for x in n]).astype(np.int64) for w in (~wanted, wanted)]
        made = []
        for number, end, size in zip(group["block"].to_pylist(), np.cumsum(sizes), sizes):
            if number is not None:
                at = place[end - size : end]
                made.append((number, kind, part, packed(background[:, at].ravel()), packed(target[:, at].ravel()), None, None, None))
        if kind == ONE:
            made.append((None, kind, part, None, None, int(background[0].sum()), int(target[0].sum()), int((background[0] > 0).sum())))
        return _table(made, TOLD)

    return asked.groupBy("kind", "part").applyInArrow(add, TOLD)


def _fields() -> list[T.StructField]:
    return [T.StructField("n_words", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("loss_target", "loss_background", "lm_score")]]


def _dealt(docs: DataFrame, text: str) -> tuple[DataFrame, str, int]:
    """``docs`` with the block of each row, its name, and their code points. Blocks follow the rows' content alone."""
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = -(-chars // min(BLOCK, max(LEAST_BLOCK, chars // BLOCKS))) or 1
    name = free_name(docs, "__block")
    return docs.withColumn(name, F.pmod(F.xxhash64(*plain), F.lit(blocks))), name, chars


def _score_all_words(docs: DataFrame, target: DataFrame, background: DataFrame | None, text: str, target_text: str) -> DataFrame:
    kept = without(docs, [f.name for f in _fields()])
    dealt, block, chars = _dealt(docs, text)
    corpora = [(dealt, text, block, False, background is None, True)]
    for corpus, column, wanted in ((target, target_text, True), (background, text, False)):
        if corpus is not None:
            named, own, more = _dealt(corpus, column)
            corpora.append((named, column, own, wanted, True, False))
            chars += more
    ranges = 1 << (chars // RANGE).bit_length()
    asked = [_asked(df, column, own, ranges, *how) for df, column, own, *how in corpora]
    told = materialize(sums(functools.reduce(DataFrame.unionAll, asked)))
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_background", "n_target", "n_words")]
    n = told.where("block IS NULL").agg(*totals).first()
    level = n.n_target / n.n_background if n.n_background else 1.0
    # Every word, the unknown word and the start mark have the floor.
    floors = FLOOR * (n.n_words + 2)
    scales = ((1.0, n.n_target + floors), (level, level * n.n_background + floors))
    columns = kept.columns
    names = [*columns, *[f.name for f in _fields()]]

    def judge(group: pa.Table, answers: pa.Table) -> pa.Table:
        begin(__name__)
        counts, found = keys([x or "" for x in group[text].to_pylist()])
        own = sorted(zip(*[answers[c].to_pylist() for c in ("kind", "part", "target", "background")]), key=lambda a: a[:2])
        owner = np.repeat(np.arange(len(counts)), counts)
        none, safe = counts == 0, np.maximum(counts, 1)
        means = []
        for i, (scale, whole) in enumerate(scales, 2):
            n = []
            for kind, k in enumerate(found):
                told_ = [unpacked(a[i]).reshape(len(k.n), -1) for a in own if a[0] == kind]
                n += [x[at] * scale for x, at in zip(np.concatenate(told_, axis=1), k.of_token)] if told_ else [np.zeros(0)] * len(k.n)
            pair, word, first = n
            loss = -np.log((pair + PRIOR * (word + FLOOR) / whole) / (first + PRIOR))
            means.append(np.bincount(owner, weights=loss, minlength=len(counts)) / safe)
        made = [pa.array(counts, pa.int64()), *[pa.array(x, pa.float64(), mask=none) for x in (*means, means[0] - means[1])]]
        return pa.Table.from_arrays([*[group[c] for c in columns], *made], names=names)

    answers = told.where("block IS NOT NULL").select(F.col("block").alias(block), "kind", "part", "target", "background")
    return dealt.groupBy(block).cogroup(answers.groupBy(block)).applyInArrow(judge, with_fields(kept, _fields()))


def score(
    docs: DataFrame,
    target: DataFrame,
    background: DataFrame | None = None,
    text: str = "text",
    target_text: str = "text",
    size: int | None = None,
) -> DataFrame:
    """``docs`` with n_words, loss_target, loss_background (means per token) and their difference lm_score.

    ``background`` is ``docs`` if it is not given. ``size`` bounds the vocabulary; without it every word counts.
    """
    if size is None:
        return _score_all_words(docs, target, background, text, target_text)
    corpus = docs if background is None else background
    vocab = vocabulary(corpus, text, size)
    wanted, general = pair_counts(target, vocab, target_text, size), pair_counts(corpus, vocab, text, size)
    level = wanted.sum() / general.sum() if general.sum() else 1.0
    tables = np.stack([losses(wanted), losses(general, level)]).astype(np.float64).reshape(2, -1)
    index = {w: k + 2 for k, w in enumerate(vocab)}

    def make(batches):
        for b in batches:
            n, sums = [np.zeros(0, np.int64)], [np.zeros((2, 0))]
            for _, block in text_blocks(texts(b, text)):
                pairs, counts = _pairs(block, index, size)
                owner = np.repeat(np.arange(len(block)), counts)
                n.append(counts)
                sums.append(np.stack([np.bincount(owner, weights=t[pairs], minlength=len(block)) for t in tables]))
            count, (wanted_, general_) = np.concatenate(n), np.concatenate(sums, axis=1)
            none, safe = count == 0, np.maximum(count, 1)
            yield [
                pa.array(count, pa.int64()),
                *[pa.array(x / safe, pa.float64(), mask=none) for x in (wanted_, general_, wanted_ - general_)],
            ]

    return map_added(docs, _fields(), make)
