"""Benchmark decontamination: passages of test items inside training documents.

Items are cut into windows of ten normalised words (an item of fewer words is one window). The
windows' hash set is broadcast with the words it stands for; tasks scan the words of their
documents with a rolling hash, look every window up, verify hits word by word and mark every
word that an occurrence covers. ``scan`` adds what was found, ``drop_documents`` leaves out
contaminated documents, ``drop_spans`` cuts the covered words out of the texts.

Documents never move: there is no shuffle. The broadcast is bounded by ``PART_WORDS`` item
words. A larger benchmark is dealt into parts of that size by a hash of (item, place), long
items too, and the documents, stored with what was found so far, are scanned once per part.

Normalisation: A-Z are lower-cased; words are runs of ASCII letters, digits and characters
beyond ASCII; everything else separates.

Edge cases: null and empty texts have no words, and items without words no windows. Repeated
items and repeated documents count by row, an item's id once. A null item_id marks words but is
not named. Documents' columns named like an output are replaced. With an empty benchmark
nothing is hit; with no documents no rows come back. Texts are read in pieces, so a very long
one takes four bytes a word besides itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmos.llm.frames import ROWS, without
from sparkmos.session import materialize

WINDOW = 10
#: Words of items that are compiled and broadcast at a time.
PART_WORDS = 1_000_000
#: Places of one item that stay together.
SEGMENT = 1_000
#: Bytes of a text that are split into words at a time, and windows hashed at a time.
PIECE, BLOCK = 4_000_000, 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is between words, for Spark and for SQL.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same rule byte by byte: separators become spaces, capitals small letters.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def segments(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, at, ws): consecutive words of an item, overlapping so that no window is cut."""
    split = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - WINDOW, F.lit(0)), F.lit(SEGMENT))
    cut = split.select("item", "ws", F.explode(starts).alias("at"))
    return cut.select("item", "at", F.slice("ws", F.col("at") + 1, SEGMENT + WINDOW - 1).alias("ws")).distinct()


@dataclass
class Windows:
    """Distinct windows of one length: hashes in order, a place in ``Index.ids``, and their items."""

    length: int
    hashes: np.ndarray
    place: np.ndarray
    first: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    vocabulary: dict[bytes, int]
    ids: np.ndarray
    codes: np.ndarray
    names: list[str]
    lengths: list[Windows]


def _hashes(codes: np.ndarray, ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    h = np.zeros(len(starts), dtype=np.uint64)
    for j in range(length):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[ids[starts + j]]
    return h ^ (h >> np.uint64(29))


def compile_index(rows: list[tuple[str | None, list[bytes]]]) -> Index:
    """The windows of one part, ``PART_WORDS`` words of segments or so."""
    vocabulary: dict[bytes, int] = {}
    flat = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for _, ws in rows for w in ws], dtype=np.int32)
    names = sorted({n for n, _ in rows if n is not None})
    number = {n: i for i, n in enumerate(names)}
    sizes = np.array([len(ws) for _, ws in rows], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.array([number.get(n, -1) for n, _ in rows], dtype=np.int64)
    seed = 0
    while True:
        codes = np.random.default_rng(seed).integers(1, 2**64, len(vocabulary) + 1, dtype=np.uint64)
        lengths = []
        for n in sorted(set(np.minimum(sizes, WINDOW).tolist())):
            mine = np.flatnonzero(np.minimum(sizes, WINDOW) == n)
            count = sizes[mine] - n + 1
            starts = np.repeat(begin[mine], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            of = np.repeat(owner[mine], count)
            h = _hashes(codes, flat, starts, n)
            order = np.lexsort((of, h))
            h, starts, of = h[order], starts[order], of[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            head = starts[np.flatnonzero(new)[np.cumsum(new) - 1]]
            if any((flat[starts + j] != flat[head + j]).any() for j in range(n)):
                lengths = None  # two windows share a hash: take other codes
                break
            keep = (of >= 0) & np.concatenate([[True], new[1:] | (of[1:] != of[:-1])])
            group = np.cumsum(new) - 1
            first = np.searchsorted(group[keep], np.arange(group[-1] + 2))
            lengths.append(Windows(n, h[new], starts[new], first, of[keep]))
        if lengths is not None:
            return Index(vocabulary, flat, codes, names, lengths)
        seed += 1


class Scanner:
    """Looks up the windows of a batch of documents."""

    def __init__(self, index: Index):
        self.index = index
        self.slots = []
        for w in index.lengths:
            bits = max(10, int(len(w.hashes) * 16).bit_length())
            slots = np.zeros(1 << bits, dtype=bool)
            slots[(w.hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.slots.append((np.uint64(64 - bits), slots))

    def ids(self, data: bytes) -> np.ndarray:
        """The words' numbers; 0 for words of no item."""
        get, out, at = self.index.vocabulary.get, [], 0
        while at < len(data):
            end = min(len(data), at + PIECE)
            if end < len(data):
                # A word that goes on moves to the next piece.
                gap = data.rfind(b" ", at, end)
                gap = gap if gap >= 0 else data.find(b" ", end)
                end = gap if gap >= 0 else len(data)
            out.append(np.array([get(w, 0) for w in data[at:end].split()], dtype=np.int32))
            at = end + 1
        return np.concatenate(out) if len(out) > 1 else out[0] if out else np.zeros(0, dtype=np.int32)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, windows) of verified occurrences, block by block."""
        known = np.concatenate([[0], np.cumsum(ids == 0)])
        for (shift, slots), w in zip(self.slots, self.index.lengths):
            for at in range(0, len(ids) - w.length + 1, BLOCK):
                upto = min(at + BLOCK, len(ids) - w.length + 1)
                p = at + np.flatnonzero(known[at + w.length : upto + w.length] == known[at:upto])
                h = _hashes(self.index.codes, ids, p, w.length)
                maybe = slots[(h >> shift).astype(np.int64)]
                p, h = p[maybe], h[maybe]
                k = np.minimum(np.searchsorted(w.hashes, h), len(w.hashes) - 1)
                same = w.hashes[k] == h
                p, k = p[same], k[same]
                for j in range(w.length):
                    same = ids[p + j] == self.index.ids[w.place[k] + j]
                    p, k = p[same], k[same]
                if len(p):
                    yield w.length, p, k

    def scan(self, datas: list[bytes], spans: list, items: list) -> list[list]:
        """n_words, n_hit, spans and items per document, earlier parts' ``spans`` and ``items`` included."""
        per = [self.ids(d) for d in datas]
        sizes = np.array([len(x) for x in per], dtype=np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        # A 0 between documents: no window crosses it.
        ids = np.concatenate([x for p in per for x in (p, np.zeros(1, dtype=np.int32))])
        del per
        edge = np.zeros(len(ids) + 1, dtype=np.int32)
        found = [set(x or ()) for x in items]
        for i, old in enumerate(spans):
            for s in old or ():
                edge[begin[i] + s["start"]] += 1
                edge[begin[i] + s["end"]] -= 1
        for n, p, k in self.hits(ids):
            np.add.at(edge, p, 1)
            np.add.at(edge, p + n, -1)
            w = next(x for x in self.index.lengths if x.length == n)
            doc = np.searchsorted(begin, p, side="right") - 1
            pairs = np.unique(np.stack([doc, k]), axis=1)
            for d, g in zip(*pairs.tolist()):
                found[d].update(self.index.names[i] for i in w.items[w.first[g] : w.first[g + 1]])
        hit = np.cumsum(edge[:-1]) > 0
        turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        doc = np.searchsorted(begin, start, side="right") - 1
        merged: list[list] = [[] for _ in datas]
        for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist()):
            merged[d].append({"start": s - int(begin[d]), "end": e - int(begin[d])})
        n_hit = [sum(s["end"] - s["start"] for s in m) for m in merged]
        return [sizes.tolist(), n_hit, merged, [sorted(f) for f in found]]


def _scan(docs: DataFrame, index: Index, text: str, again: bool) -> DataFrame:
    """``docs`` with the found columns; ``again``: they are there and are added to."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    kept = [c for c in docs.columns if not again or c not in {f.name for f in FOUND}]
    schema = T.StructType([*[docs.schema[c] for c in kept], *FOUND])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = None
        for whole in batches:
            scanner = scanner or Scanner(held.value)
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                of = lambda c: b.column(b.schema.get_field_index(c))
                datas = [(x or b"").translate(BYTES) for x in of(text).cast(pa.binary()).to_pylist()]
                old = [of(c).to_pylist() if again else [None] * b.num_rows for c in ("spans", "items")]
                made = [pa.array(x, k) for x, k in zip(scanner.scan(datas, *old), kinds)]
                yield pa.RecordBatch.from_arrays([*[of(c) for c in kept], *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, spans (covered words, from the first to before the end), items, contaminated."""
    docs = without(docs, [*[f.name for f in FOUND], "contaminated"])
    cut = segments(benchmark, item, item_text)
    total = cut.agg(F.sum(F.size("ws"))).first()[0] or 0
    parts = -(-total // part_words) or 1
    if parts > 1:
        cut = materialize(cut)
    found = docs
    for k in range(parts):
        rows = cut.where(F.pmod(F.xxhash64("item", "at"), F.lit(parts)) == k).select("item", F.array_join("ws", " ").alias("ws"))
        index = compile_index([(r.item, r.ws.encode().split()) for r in rows.toLocalIterator()])
        found = _scan(found, index, text, again=k > 0)
        if k + 1 < parts:
            found = materialize(found)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def drop_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """The documents that hold no window of an item, with their own columns (found columns' names aside)."""
    found = scan(docs, benchmark, text, **names)
    return found.where(~F.col("contaminated")).drop(*[f.name for f in FOUND], "contaminated")


def drop_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """Documents less the covered words and what stands between two of them; the rest is as it was."""
    found = scan(docs, benchmark, text, **names).drop("n_words", "n_hit", "items", "contaminated")
    schema = T.StructType([f for f in found.schema.fields if f.name != "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            left = [_cut(t, s) for t, s in zip(columns[text].cast(pa.binary()).to_pylist(), columns["spans"].to_pylist())]
            columns[text] = pa.array(left, pa.binary()).cast(columns[text].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], names=schema.names)

    return found.mapInArrow(run, schema)


def _cut(data: bytes | None, spans: list[dict] | None) -> bytes | None:
    if not data or not spans:
        return data
    plain, out, at, number, where = data.translate(BYTES), [], 0, 0, 0
    bounds: list[int] = []
    wanted = [x for s in spans for x in (s["start"], s["end"] - 1)]
    # Byte places of the first and last word of each span, in one walk over the words.
    for w in plain.split():
        where = plain.index(w, where)
        while len(bounds) < len(wanted) and wanted[len(bounds)] == number:
            bounds.append(where if len(bounds) % 2 == 0 else where + len(w))
        where += len(w)
        number += 1
    for start, end in zip(bounds[::2], bounds[1::2]):
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])


def oracle() -> str:
    """DuckDB SQL for ``op13``: windows as strings, joined."""
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {split} AS ws FROM documents),
b AS (SELECT item_id, {split} AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(len(ws), {WINDOW}) AS l FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[k:k + l - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - l + 2)) AS k FROM i)),
dw AS (
  SELECT rid, l, k, array_to_string(ws[k:k + l - 1], ' ') AS w
  FROM (SELECT rid, ws, l, unnest(range(1, len(ws) - l + 2)) AS k FROM d JOIN (SELECT DISTINCT l FROM i) n ON len(ws) >= l)),
h AS (SELECT rid, k, dw.l, item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.l = bw.l),
p AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(k, k + l)) AS k FROM h) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN n USING (rid)
"""
