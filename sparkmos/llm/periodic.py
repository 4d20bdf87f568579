"""Periodic runs of words: passages that repeat a phrase over and over.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no
neighbouring word extends; those of at least ``LEAST`` words and ``TIMES`` periods are returned.

Method. Ukkonen's suffix trees of the words and of their reversal answer how far two places
agree forwards and backwards: the depth of two leaves' lowest common ancestor, a range minimum
over the tour of the tree, in constant time. At every word the longest Lyndon word that begins
there, once for the words' order and once for the opposite one, is a candidate root: it ends
where the next smaller suffix begins, and suffixes are ranked by the order of the leaves. Each
candidate is extended both ways by those look-ups; by the runs theorem every run has a root
among them.

Trees are only built where a run can be. Let a word's gap be the distance to the same word
before it. In a run of period q all words but the first q have a gap of at most q, so for
q in (Q / 2, Q] it holds a stretch of ``TIMES - 1`` times q words with gaps of at most Q, and
lies whole between that stretch's start less Q and its end. For Q = 1, 2, 4, ... these
stretches are found for a batch at a time; overlapping ones are joined. Nothing is lost by it.

Texts are read in pieces; a long one takes 8 bytes a word besides its words' distinct forms.
A tree takes about 400 bytes a word of the stretch it is built for.

Edge cases: words are what stands between ASCII white space. Null and empty texts have no runs
and collapse to the empty text. Rows are judged by themselves, so repeats and ties in doc_id do
not matter. Columns named like an output are replaced; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmos.llm.frames import map_added
from sparkmos.llm.prefix_trie import crc32_sql

#: Words and periods that a run has at least.
LEAST, TIMES = 6, 4
#: Words of a batch of documents, and bytes of a text that are split at a time.
WORDS, PIECE = 400_000, 4_000_000

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]


class SuffixTree:
    """Ukkonen's tree of ``s``, numbers from 0; a last symbol of its own is added.

    ``place[i]`` is the leaf of suffix i in the tour, ``up`` and ``down`` rank the suffixes by
    the symbols' order and by the opposite one (a prefix comes first in both).
    """

    def __init__(self, s: list[int], ranks: bool = True):
        s = [*(x + 1 for x in s), 0]
        n, base = len(s), max(s) + 1
        start, end, link = [0], [0], [0]
        leaf_of: list[int] = []
        edges: dict[int, int] = {}
        node = edge = length = left = 0
        for i, c in enumerate(s):
            left += 1
            fresh = 0
            while left:
                if not length:
                    edge = i
                key = node * base + s[edge]
                to = edges.get(key)
                if to is None:
                    edges[key] = len(start)
                    leaf_of.append(len(start))
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    span = end[to] - start[to]
                    if length >= span and end[to] <= i:
                        edge += span
                        length -= span
                        node = to
                        continue
                    at = start[to] + length
                    if s[at] == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    split = len(start)
                    start += [start[to], i]
                    end += [at, n]
                    link += [0, 0]
                    leaf_of.append(split + 1)
                    edges[key] = split
                    edges[split * base + c] = split + 1
                    start[to] = at
                    edges[split * base + s[at]] = to
                    if fresh:
                        link[fresh] = split
                    fresh = split
                left -= 1
                if node == 0 and length:
                    length -= 1
                    edge = i - left + 1
                else:
                    node = link[node]
        keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
        to = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        children = to[order].tolist()
        parent = keys[order] // base
        begin = np.searchsorted(parent, np.arange(len(start) + 1)).tolist()
        # Nodes in preorder, with the depth of their parents: between two leaves its least is their ancestor's.
        tour, above, depth = [0] * len(start), [0] * len(start), [0] * len(start)
        stack, k = [0], 0
        while stack:
            x = stack.pop()
            tour[k] = x
            k += 1
            b, e = begin[x], begin[x + 1]
            if b < e:
                d = depth[x]
                for y in children[b:e]:
                    above[y] = d
                    depth[y] = d + end[y] - start[y]
                stack += children[b:e][::-1]
        tour = np.array(tour)
        at = np.empty(len(start), dtype=np.int64)
        at[tour] = np.arange(len(start))
        leaves = np.array(leaf_of)
        self.place = at[leaves]
        self.least = Minima(np.array(above)[tour])
        if ranks:
            self.up = self.place
            suffix = [-1] * len(start)
            for i, x in enumerate(leaf_of):
                suffix[x] = i
            down, stack, k = np.empty(n, dtype=np.int64), [0], 0
            while stack:
                x = stack.pop()
                b, e = begin[x], begin[x + 1]
                if b == e:
                    down[suffix[x]] = k
                    k += 1
                elif s[start[children[b]]] == 0:
                    stack += children[b + 1 : e]  # the largest comes first, but for the end
                    stack.append(children[b])
                else:
                    stack += children[b:e]
            self.down = down

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j, which differ."""
        a, b = self.place[i], self.place[j]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b))


class Minima:
    """Range minima in constant time: prefix and suffix minima of blocks, doubling over the blocks."""

    BLOCK = 16

    def __init__(self, v: np.ndarray):
        pad = -len(v) % self.BLOCK
        self.v = np.concatenate([v, np.full(pad, np.iinfo(np.int64).max)]) if pad else v
        rows = self.v.reshape(-1, self.BLOCK)
        self.pre = np.minimum.accumulate(rows, axis=1).ravel()
        self.suf = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [rows.min(axis=1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of v[a] to v[b], a <= b."""
        x, y = a // self.BLOCK, b // self.BLOCK
        out = np.minimum(self.suf[a], self.pre[b])
        near = np.flatnonzero(x == y)
        if len(near):
            p, q = a[near], b[near]
            m = self.v[p]
            for k in range(1, self.BLOCK):
                m = np.minimum(m, self.v[np.minimum(p + k, q)])
            out[near] = m
        far = np.flatnonzero(y - x > 1)
        if len(far):
            p, q = x[far] + 1, y[far] - 1
            level = np.frexp((q - p + 1).astype(np.float64))[1] - 1
            for k in np.unique(level):
                mine = level == k
                f, t = far[mine], self.levels[k]
                out[f] = np.minimum(out[f], np.minimum(t[p[mine]], t[q[mine] - (1 << int(k)) + 1]))
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """Per place the next one of smaller rank; the last suffix is the smallest."""
    rank, out, stack = rank.tolist(), [0] * (len(rank) - 1), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, dtype=np.int64)


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) rows of the runs of ``ids``, by start, then period. ``times`` is 2 or more."""
    n = len(ids)
    if n < least:
        return np.zeros((0, 3), dtype=np.int64)
    s = np.unique(ids, return_inverse=True)[1].tolist()
    forward, backward = SuffixTree(s), SuffixTree(s[::-1], ranks=False)
    i = np.arange(n)
    found = []
    for rank in (forward.up, forward.down):
        end = _next_smaller(rank)
        p = end - i
        right = forward.agree(i, end)
        # Words that agree before i and before its root's end: suffixes n - i and n - end of the reversal.
        left = backward.agree(n - i, n - end)
        length = left + p + right
        good = (length >= times * p) & (length >= least)
        found.append(np.stack([i - left, length, p], axis=1)[good])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def stretches(codes: np.ndarray, doc: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all stretches that can hold a run; ``first[i]`` is where the document of word i starts."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(doc * (codes.max() + 1) + codes, kind="stable")
    gap = np.full(n, n + 1, dtype=np.int64)
    same = (codes[order][1:] == codes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    edge = np.zeros(n + 1, dtype=np.int64)
    size = int(np.bincount(doc).max())
    q = 1
    while times * (q // 2 + 1) <= size:
        ok = gap <= q
        turn = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
        a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        # No stretch crosses documents: a document's first word has no gap.
        shortest = max((times - 1) * (q // 2 + 1), least - q) if q > 1 else max(times - 1, least - 1)
        long = b - a >= shortest
        a, b = np.maximum(a[long] - q, first[a[long]]), b[long]
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
        q *= 2
    cover = np.cumsum(edge[:-1]) > 0
    inner = np.concatenate([[False], cover[1:] & cover[:-1] & (doc[1:] == doc[:-1])])
    a = np.flatnonzero(cover & ~inner)
    b = np.flatnonzero(cover & ~np.concatenate([inner[1:], [False]])) + 1
    return a, b


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces."""
    at, n = 0, len(data)
    while at < n:
        end = at + PIECE
        while end < n and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


def judge(datas: list[bytes]) -> list[tuple[list[dict], bytes]]:
    """Runs and collapsed text of each text."""
    number: dict[bytes, int] = {}
    per = []
    for data in datas:
        parts = [np.array([number.setdefault(w, len(number)) for w in ws], dtype=np.int32) for ws in pieces(data)]
        per.append(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32))
    sizes = np.array([len(x) for x in per], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    codes = np.concatenate(per).astype(np.int64) if per else np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(per)), sizes)
    a, b = stretches(codes, doc, np.repeat(begin, sizes))
    found: dict[int, list[np.ndarray]] = {}
    for x, y in zip(a.tolist(), b.tolist()):
        rows = runs(codes[x:y])
        if len(rows):
            rows[:, 0] += x - begin[doc[x]]
            found.setdefault(int(doc[x]), []).append(rows)
    names, out = list(number), []
    for d, data in enumerate(datas):
        if d not in found:
            out.append(([], b" ".join(w for ws in pieces(data) for w in ws)))
            continue
        rows = np.concatenate(found[d])
        edge = np.zeros(sizes[d] + 1, dtype=np.int64)
        np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
        np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
        kept = per[d][np.cumsum(edge[:-1]) == 0]
        out.append(([dict(zip(("start", "length", "period"), r)) for r in rows.tolist()], b" ".join([names[i] for i in kept.tolist()])))
    return out


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; in order) and ``collapsed``: each run's first period alone, words joined by a space."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for b in batches:
            datas = [x or b"" for x in b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
            judged: list[tuple] = []
            while len(judged) < len(datas):
                at, size = len(judged), 0
                upto = at
                while upto < len(datas) and (upto == at or size + len(datas[upto]) < 4 * WORDS):
                    size += len(datas[upto])
                    upto += 1
                judged += judge(datas[at:upto])
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names]))
            yield [pa.array([j[0] for j in judged], kind), pa.array([j[1] for j in judged], pa.binary()).cast(pa.string())]

    return map_added(docs, FIELDS, make)


def repeat_tails(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Texts in which one document of ten (by crc32 of its id) repeats a phrase up to its end; the others stay."""
    h = F.crc32(F.col(doc_id).cast("string"))
    ws = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.size("__words").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    marked = docs.withColumn("__words", F.when(h % 10 == 0, ws)).withColumn("__at", F.when(F.size("__words") > 0, F.struct(a.alias("a"), p.alias("p"))))
    i = F.sequence(F.lit(0).cast("long"), F.size("__words").cast("long") - 1)
    place = lambda k: F.when(k < F.col("__at.a"), k).otherwise(F.col("__at.a") + (k - F.col("__at.a")) % F.col("__at.p"))
    edited = F.array_join(F.transform(i, lambda k: F.get("__words", place(k).cast("int"))), " ")
    return marked.withColumn(text, F.when(F.col("__at").isNotNull(), edited).otherwise(F.col(text))).drop("__words", "__at")


def best(found: Column) -> Column:
    """The run of greatest length / period; ties: smallest start, then period, which is their order."""

    def better(x: Column, y: Column) -> Column:
        return F.when(x.isNull() | (y["length"] * x["period"] > x["length"] * y["period"]), y).otherwise(x)

    return F.aggregate(found, F.lit(None).cast(RUN), better)


def oracle() -> str:
    """DuckDB SQL for ``op12``: pairs of equal words, islands of places per distance."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    CASE WHEN doc_id IS NOT NULL THEN {crc32_sql('CAST(doc_id AS VARCHAR)')} END AS h
  FROM documents),
e AS (SELECT rid, doc_id, ws, len(ws) AS n, h // 10 AS g, coalesce(h % 10 = 0, FALSE) AND len(ws) > 0 AS edit FROM d),
f AS (SELECT *, CASE WHEN edit THEN g % n END AS a, CASE WHEN edit THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
t AS (SELECT rid, doc_id, n, CASE WHEN edit THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM f),
w AS (SELECT rid, n, unnest(range(n)) AS i, unnest(ws) AS w FROM t),
q AS (SELECT x.rid, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND {TIMES} * (y.i - x.i) <= x.n),
l AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM q),
s AS (SELECT rid, q, min(i) AS s, count(*) + q AS l FROM l GROUP BY rid, q, island HAVING count(*) + q >= greatest({LEAST}, {TIMES} * q)),
r AS (SELECT rid, s, l, min(q) AS q FROM s GROUP BY rid, s, l),
b AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
  arg_min(struct_pack(s := s, l := l, q := q), struct_pack(e := -(l / q::DOUBLE), s := s, q := q)) AS m FROM r GROUP BY rid),
o AS (SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM r),
c AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept FROM w ANTI JOIN o USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(m.s AS BIGINT) AS start, CAST(m.l AS BIGINT) AS length, CAST(m.q AS BIGINT) AS period,
  CAST(1000 * m.l // m.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (rid) LEFT JOIN c USING (rid)
"""
