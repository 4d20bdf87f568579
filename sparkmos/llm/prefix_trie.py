"""The trie of conversation prefixes, with counts per node.

``paths`` rebuilds conversations and writes each as one row: its turns' digests (16 bytes of
SHA-256 of role and text, in order, joined) and its turns' code points. Byte order of these
paths is an order in which every subtree is one stretch of rows.

``nodes`` cuts that order into shards by splitter rows (a path and a conv_id, so that copies of
one conversation are dealt out too) that are sampled from the paths. The splitters are broadcast
and place each row by binary search. A node can only lie in two shards if it is a prefix of the
splitter between them, so the trie of the splitters' shared prefixes, the skeleton, is all that
tasks must know of each other: every shard gets how many turns its first row shares with the row
before and its last row with the row after. A task walks its sorted rows with a stack; it
finishes every other node by itself and gives partial sums for the nodes of the skeleton, which
are then added up by node. What must count once (a node, a child, a leaf) is counted in the
shard where the node begins, or ends. The ids of members that end at a node are hashed as they
pass; where such a list goes on in the next shard, it is sent on in chunks and hashed in order
by one streaming task, as one SHA-256 over them asks for.

What moves: 20 bytes a turn (no texts), once to gather a conversation and once to its shard. A
conversation is one row of that size. The driver sees the splitters and two paths per shard.

Edge cases: rows without conv_id are no conversation. Turns are ordered by turn, null first,
equal turns by digest. Null role or text is empty, and counts so. conv_ids below zero borrow
from ``conv_id - conv_id % 100`` with the remainder's sign of the dividend. Other columns are
ignored. No conversation, no node; a single turnless conversation gives the root alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmos.session import materialize

#: Bytes of a turn in a path.
KEY = 16
#: Turns of a shard, at most and (as long as there are fewer shards than shuffle partitions) at least.
SHARD_TURNS, LEAST_TURNS = 500_000, 2_000
#: Sampled rows per splitter, and bytes of all samples (the driver holds them).
SAMPLES, SAMPLE_BYTES = 24, 16_000_000
#: Rows of the skeleton that are broadcast to find parents; more are joined by shuffling.
SKELETON_ROWS = 200_000
#: Ids in a chunk of an unfinished list.
CHUNK = 2_000

EMPTY = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), F.substring(digest, 1, 2 * KEY).alias("key"), F.char_length(text).alias("size"))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), order.alias("t"))


def paths(conversations: DataFrame, every: int = 100, longest: int = 6) -> DataFrame:
    """(conv_id, path, sizes): conversation c begins with the first crc32(c) % ``longest`` turns of c - c % ``every``."""
    turns = _turns(conversations)
    sort = F.array_sort(F.collect_list("t"))
    own = turns.groupBy("conv_id").agg(sort.alias("own"))
    heads = turns.where(F.col("conv_id") % every == 0).groupBy(F.col("conv_id").alias("base")).agg(F.slice(sort, 1, longest - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % longest).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left").withColumn("h", h)
    head = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    tail = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    built = joined.select("conv_id", F.concat(head, tail).alias("ts"))
    return built.select("conv_id", F.unhex(F.array_join("ts.key", "")).alias("path"), F.col("ts.size").alias("sizes"))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // KEY


NODES = "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shard int, seq long, ends string"
ARROW = pa.schema(
    [("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
     ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("shard", pa.int32()), ("seq", pa.int64()), ("ends", pa.string())]
)
NODE, PART, ENDS = range(3)


class _Open:
    """A node on the stack: its sums so far, and finished children that wait for its smallest member."""

    __slots__ = ("conv_id", "n", "children", "inner", "leaves", "saved", "size", "ends", "n_ends", "waiting", "before")

    def __init__(self, size: int, before: bool):
        self.conv_id: int | None = None
        self.n = self.children = self.leaves = self.saved = self.n_ends = 0
        self.inner, self.ends, self.waiting = False, None, []
        self.size, self.before = size, before


def _chain(path: bytes, depth: int) -> list[bytes]:
    """Names of the path's nodes down to ``depth``."""
    h, out = hashlib.sha256(), []
    out.append(h.digest())
    for d in range(depth):
        h.update(path[d * KEY : (d + 1) * KEY])
        out.append(h.copy().digest())
    return out


class Shard:
    """Walks the rows of one shard in order; ``out`` collects finished rows.

    ``before`` and ``after`` are the turns shared with the neighbouring shards' rows, -1
    without one; ``cut_before`` and ``cut_after`` tell whether those rows have the same path.
    """

    def __init__(self, number: int, before: int, cut_before: bool, after: int, cut_after: bool):
        self.first = self.last = b""
        self.number, self.before, self.cut_before, self.after, self.cut_after = number, before, cut_before, after, cut_after
        self.out: list[tuple] = []
        self.stack: list[_Open] = []
        self.path = b""
        self.started = False
        self.seq = 0
        self.pending: list[int] = []  # of a list of ends that other shards share
        self.pending_key = b""

    def row(self, conv_id: int, path: bytes, sizes: list[int]) -> None:
        if not self.started:
            self.started = True
            self.keys = _chain(path, self.before)
            self.first = path
            self.stack.append(_Open(0, self.before >= 0))
        self._close(shared(self.path, path))
        for d in range(len(self.stack), len(path) // KEY + 1):
            # Only along the first row can a node have begun in an earlier shard.
            self.stack.append(_Open(sizes[d - 1], d <= self.before and path[: d * KEY] == self.first[: d * KEY]))
        self.path = path
        top = self.stack[-1]
        top.conv_id = conv_id if top.conv_id is None else min(top.conv_id, conv_id)
        top.n += 1
        top.n_ends += 1
        if self.cut_before and path == self.first:
            self._send(self.keys[-1], conv_id)
        elif self.cut_after and path == self.last:
            self._send(self.last_keys[-1], conv_id)
        else:
            if top.ends is None:
                top.ends = hashlib.sha256(str(conv_id).encode())
            else:
                top.ends.update(f",{conv_id}".encode())

    def expect(self, last: bytes) -> None:
        """The path of the shard's last row, if it goes on in the next shard."""
        self.last = last
        self.last_keys = _chain(last, max(self.after, 0))

    def _send(self, key: bytes, conv_id: int) -> None:
        if key != self.pending_key:
            self._flush()
        self.pending_key = key
        self.pending.append(conv_id)
        if len(self.pending) >= CHUNK:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            self.out.append((ENDS, self.pending_key, None, None, None, None, None, None, None, None, None, self.number, self.seq, ",".join(map(str, self.pending))))
            self.seq += 1
            self.pending = []

    def _close(self, depth: int, after: int = -1) -> None:
        """Finishes the open nodes deeper than ``depth`` turns; those down to ``after`` go on elsewhere."""
        while len(self.stack) > depth + 1:
            d = len(self.stack) - 1
            x = self.stack.pop()
            onward = d <= after
            if not x.inner and not onward:
                x.leaves += 1
            x.saved += (x.n - (0 if x.before else 1)) * x.size
            skeleton = x.before or onward
            up = self.stack[-1] if self.stack else None
            keys = self.keys if x.before else self.last_keys if onward else None
            if skeleton:
                self.out += [(*r[:2], keys[d], *r[3:]) for r in x.waiting]
                row = (PART, keys[d], keys[d - 1] if d else None, x.conv_id, d, None, x.n, x.children, x.leaves, x.saved, self._ends(x), self.number, None, None)
                self.out.append(row)
            else:
                self.out += [(*r[:5], x.conv_id, *r[6:]) for r in x.waiting]
                row = (NODE, None, None, x.conv_id, d, None, x.n, x.children, x.leaves, x.saved, self._ends(x) or EMPTY, None, None, None)
                (up.waiting if up else self.out).append(row)
            if up:
                up.inner = True
                up.children += 0 if x.before else 1
                up.n += x.n
                up.leaves += x.leaves
                up.saved += x.saved
                up.conv_id = x.conv_id if up.conv_id is None else min(up.conv_id, x.conv_id)
                if up.before:
                    # Its name is known, so finished children need not wait.
                    self.out += [(*r[:2], self.keys[d - 1], *r[3:]) for r in up.waiting]
                    up.waiting = []

    @staticmethod
    def _ends(x: _Open) -> str | None:
        return x.ends.hexdigest() if x.ends is not None else None

    def finish(self) -> None:
        if self.started:
            self._flush()
            self._close(-1, self.after)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def nodes(built: DataFrame, shard_turns: int = SHARD_TURNS, least_turns: int = LEAST_TURNS) -> DataFrame:
    """One row per node of the trie of ``built`` (conv_id, path, sizes; each conv_id once).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    spark = built.sparkSession
    built = materialize(built)
    n_rows, n_turns, n_bytes = built.agg(F.count("*"), F.coalesce(F.sum(F.size("sizes")), F.lit(0)), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_turns += n_rows
    shards = max(1, -(-n_turns // shard_turns), min(shuffles, -(-n_turns // least_turns)))
    one_in = max(1, n_rows // (SAMPLES * shards), -(-n_bytes // SAMPLE_BYTES))
    sample = built.where(F.pmod(F.xxhash64("conv_id", F.lit(7)), F.lit(one_in)) == 0).select("path", "conv_id") if shards > 1 else built.limit(0).select("path", "conv_id")
    rows = sorted((bytes(r.path), r.conv_id) for r in sample.toLocalIterator())
    splitters = sorted({rows[len(rows) * i // shards] for i in range(1, shards)}) if rows else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(splitters, r) for r in zip(b.column(1).to_pylist(), b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], names=["shard", *b.schema.names])

    placed = built.select("conv_id", "path", "sizes").mapInArrow(place, "shard int, conv_id long, path binary, sizes array<int>")
    own = F.struct("path", "conv_id")
    # Two rows per shard: what the skeleton's tasks know of each other.
    found = sorted((r.shard, bytes(r.lo[0]), bytes(r.hi[0])) for r in placed.groupBy("shard").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).collect())
    around = {}
    for i, (s, lo, hi) in enumerate(found):
        back, ahead = found[i - 1][2] if i else None, found[i + 1][1] if i + 1 < len(found) else None
        around[s] = (-1 if back is None else shared(back, lo), back == lo, -1 if ahead is None else shared(hi, ahead), hi == ahead, hi if ahead is not None else b"")
    held = spark.sparkContext.broadcast(around)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                b = whole.slice(at, 1_000)
                for s, conv_id, path, sizes in zip(*[c.to_pylist() for c in b.columns]):
                    if shard is None or s != shard.number:
                        if shard is not None:
                            shard.finish()
                            yield _batch(shard.out)
                        shard = Shard(s, *held.value[s][:4])
                        shard.expect(held.value[s][4])
                    shard.row(conv_id, path, sizes)
                if shard is not None and shard.out:
                    yield _batch(shard.out)
                    shard.out = []
        if shard is not None:
            shard.finish()
            yield _batch(shard.out)

    ordered = placed.repartitionById(len(splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    walked = materialize(ordered.mapInArrow(walk, NODES))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    skeleton = walked.where(F.col("kind") == PART).groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends_sha256").alias("whole")
    )
    lists = walked.where(F.col("kind") == ENDS).select("key", "shard", "seq", "ends").repartition("key").sortWithinPartitions("key", "shard", "seq")
    hashed = lists.mapInArrow(_hash_lists, "key binary, ends_sha256 string")
    skeleton = materialize(skeleton.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "whole", F.lit(EMPTY))))
    names = skeleton.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    if skeleton.count() <= SKELETON_ROWS:
        names = F.broadcast(names)  # 40 bytes a row, counted just now
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    finished = walked.where(F.col("kind") == NODE)
    inside = finished.where("parent_key IS NULL").select(*columns)
    below = finished.select("parent_key", *[c for c in columns if c != "parent_conv_id"]).where("parent_key IS NOT NULL").unionByName(
        skeleton.select("parent_key", *[c for c in columns if c != "parent_conv_id"])
    )
    return inside.unionByName(below.join(names, "parent_key", "left").withColumnRenamed("found", "parent_conv_id").select(*columns))


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per key over its chunks, which come in order."""
    key, h = None, None
    made = lambda: pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [h.hexdigest()]}, pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))
    for b in batches:
        for k, ends in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
            if k != key:
                if h is not None:
                    yield made()
                key, h = k, hashlib.sha256(ends.encode())
            else:
                h.update(f",{ends}".encode())
    if h is not None:
        yield made()


# DuckDB has no crc32: the sum over the decimal digits, bit by bit.
_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string expression."""
    step = f"list_reduce(range(8), lambda c, i: {_BIT}, xor(acc, ord(ch)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda acc, ch: {step.replace('ord(ch)', 'ch')}, 4294967295::BIGINT), 4294967295)"


def oracle() -> str:
    """DuckDB SQL for ``op11``: prefixes as strings of digests, subtrees by joining nodes with their prefixes."""
    return f"""
WITH t AS (
  SELECT conv_id, turn, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))[1:32] AS key, length(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(key := key, size := size) ORDER BY turn NULLS FIRST, key) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM o),
r AS (SELECT a.conv_id, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS ts FROM h a LEFT JOIN o b ON b.conv_id = a.base),
m AS (
  SELECT conv_id, len(ts) AS n, d, array_to_string(list_transform(ts[1:d], lambda x: x.key), '') AS p, CASE WHEN d > 0 THEN ts[d].size ELSE 0 END AS size
  FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM r)),
n AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM m GROUP BY p, d),
c AS (SELECT p[:len(p) - 32] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
x AS (SELECT n.p AS node, n.saved, c.p IS NULL AS leaf, unnest(range(d + 1)) AS k FROM n LEFT JOIN c USING (p)),
s AS (SELECT node[:32 * k] AS p, sum(saved) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM x GROUP BY 1)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN c USING (p) JOIN s USING (p) LEFT JOIN n q ON n.d > 0 AND q.p = n.p[:len(n.p) - 32]
"""
