"""Byte-level BPE on segment trees.

A pretoken is a row of byte positions. Each position holds its token and, in the leaf of a
segment tree, ``rank << POS_BITS | position`` of the pair that starts there, so that the root
is the leftmost pair of the lowest rank. A merge rewrites at most three leaves (the pair, its
left neighbour and the swallowed position) and the path above each: O(log n) per merge. Trees
of equal size are worked on together as NumPy arrays; one long pretoken is an array of one row.

Edge cases: null text is the empty text and has no ids. Every byte is a token of the
vocabulary, so no text fails; texts of any length are cut at matches of the pattern, and
memory follows the longest match. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkmos.llm.frames import Kept, map_added, text_blocks, texts, vocabulary

POS_BITS = 32
NONE = np.int64(1) << 62
#: Words kept per Python worker, twice as many at most, and the longest one kept; more only costs time.
CACHE = 100_000
CACHED_CHARS = 64
#: Matches taken from one long text at a time, and bytes of ids decoded at a time.
MATCHES, DECODED = 500_000, 400_000
NOT_SINGLE, SINGLE_SPACE = re.compile(r" \s|\s "), re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class Merges:
    """Pair ranks of a rank file, as a sorted table of (left id, right id) keys."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair is no token or a side is missing (-1)."""
        key = (left << 32) | np.maximum(right, 0)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p:
                groups.setdefault(max(1, (len(p) - 1).bit_length()), []).append(i)
        for bits, members in groups.items():
            rows = max(1, (1 << 15) >> bits)  # arrays that stay in the processor's cache
            for k in range(0, len(members), rows):
                part = members[k : k + rows]
                ids, count = self._group([pieces[i] for i in part], 1 << bits)
                ends = np.cumsum(count) * 4
                data = ids.astype("<u4").tobytes()
                for i, a, b in zip(part, (ends - count * 4).tolist(), ends.tolist()):
                    out[i] = data[a:b]
        return out

    def _group(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        inside = np.arange(width) < length[:, None]
        token = np.full((n, width), -1, dtype=np.int64)
        token[inside] = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        right = np.where(np.arange(1, width + 1) < length[:, None], np.arange(1, width + 1), -1)
        left = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        rank = np.full((n, width), NONE, dtype=np.int64)
        rank[:, :-1] = self.pair(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, width:] = np.where(rank < NONE, rank << POS_BITS | np.arange(width), NONE)
        level = width // 2
        while level:
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
            level //= 2
        # From here on by flat index: row * width + position, row * 2 * width + node.
        flat, token, left, right = tree.reshape(-1), token.reshape(-1), left.reshape(-1), right.reshape(-1)
        live = np.flatnonzero(tree[:, 1] < NONE)
        levels = width.bit_length() - 1
        while len(live):
            base, top = live * width, live * (2 * width)
            root = flat[top + 1]
            p = root & ((1 << POS_BITS) - 1)
            own = root >> POS_BITS
            q = right[base + p]
            after = right[base + q]
            before = left[base + p]
            token[base + p] = own
            token[base + q] = -1
            right[base + p] = after
            has, led = after >= 0, before >= 0
            left[(base + after)[has]] = p[has]
            follow = np.where(has, token[base + np.maximum(after, 0)], -1)
            lead = np.where(led, token[base + np.maximum(before, 0)], -1)
            pair = self.pair(np.concatenate([own, lead]), np.concatenate([follow, own]))
            at = np.concatenate([p, np.where(led, before, q)])
            leaf = np.where(pair < NONE, pair << POS_BITS | at, NONE)
            top2 = np.concatenate([top, top])
            node = at + width
            flat[top + q + width] = NONE
            flat[top2 + node] = leaf
            node, top3 = np.concatenate([node, q + width]), np.concatenate([top2, top])
            for _ in range(levels):
                node >>= 1
                child = top3 + 2 * node
                flat[top3 + node] = np.minimum(flat[child], flat[child + 1])
            live = live[flat[top + 1] < NONE]
        token = token.reshape(n, width)
        kept = token >= 0
        return token[kept], kept.sum(axis=1)


class Encoder:
    """Encodes texts; remembers short words.

    A single space between two other characters that are no white space begins a match of the
    pattern, so a text is cut there and each word, with its space, is matched by itself.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        self.merges = Merges(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.words = Kept(CACHE)

    def _pieces(self, matches: list[list[str]]) -> list[bytes]:
        """Ids of each list of matches; a match that repeats among them is merged once."""
        known: dict[str, bytes] = dict.fromkeys(m for ms in matches for m in ms)
        made = self.merges.encode([m.encode("utf-8", "surrogatepass") for m in known])
        known = dict(zip(known, made))
        return [known[ms[0]] if len(ms) == 1 else b"".join([known[m] for m in ms]) for ms in matches]

    def _words(self, values: list[str]) -> list[bytes]:
        cut = [SINGLE_SPACE.split(v) if v[:1].isspace() or v[-1:].isspace() or NOT_SINGLE.search(v) else v.split(" ") for v in values]
        heads = [ws.pop(0) for ws in cut]
        fresh = self.words.missing(set().union(*cut))
        known, find = self.words.late, self.pattern.findall
        # A word of Latin letters alone is one match, with its space.
        made = self._pieces([[" " + w] if w.isascii() and w.isalpha() else find(" " + w) for w in fresh] + [find(h) for h in heads])
        known.update(zip(fresh, made))
        get = known.__getitem__
        out = [h + b"".join(map(get, ws)) for h, ws in zip(made[len(fresh) :], cut)]
        self.words.forget(fresh, CACHED_CHARS)
        return out

    def encode(self, values: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for _, block in text_blocks(values):
            if len(block) == 1 and len(block[0]) > 2_000_000:
                found, parts = self.pattern.finditer(block[0]), []
                while ms := [m.group() for m in itertools.islice(found, MATCHES)]:
                    parts += self._pieces([ms])
                out.append(b"".join(parts))
            else:
                out += self._words(block)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker, which Spark keeps from task to task."""
    return Encoder(path, pattern)


class Table:
    """The tokens' bytes, one after the other, with their starts."""

    def __init__(self, ranks: dict[bytes, int]):
        most = max(ranks.values())
        tokens = [b""] * (most + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.zeros(most + 1, dtype=bool)
        self.known[list(ranks.values())] = True
        self.size = np.array([len(t) for t in tokens], dtype=np.int32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, values: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids; KeyError for an id that is no token."""
        ids = np.frombuffer(b"".join(values), "<u4")
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise KeyError("an id is no token of the vocabulary")
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        # Places in the table: each token's start, and on from there.
        place = np.repeat(self.start[ids] - ends[:-1].astype(np.int32), size)
        place += np.arange(len(place), dtype=np.int32)
        data = self.data[place].tobytes()
        cuts = ends[np.cumsum([0, *[len(v) // 4 for v in values]])].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def table(path: str) -> Table:
    return Table(read_ranks(path))


def release() -> None:
    encoder.cache_clear()
    table.cache_clear()


def encode(
    df: DataFrame,
    text: str = "text",
    ranks: str | None = None,
    pattern: str | None = None,
    ids: str = "ids",
    count: str = "n_tokens",
) -> DataFrame:
    """``df`` with ``ids`` (little-endian unsigned 32-bit integers) and their number.

    Each match of ``pattern`` is encoded for itself by the ranks, as the rank file's library
    does it, special strings being ordinary text. No shuffle; rows stay where they are.
    """
    path = ranks or vocabulary("byte_bpe_50k.tiktoken")

    def make(batches):
        import public_tokenizers

        coder = encoder(path, pattern or public_tokenizers.PATTERN)
        for b in batches:
            made = coder.encode(texts(b, text))
            yield [pa.array(made, pa.binary()), pa.array([len(m) // 4 for m in made], pa.int64())]

    return map_added(df, [T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())], make)


def decode(df: DataFrame, ids: str = "ids", ranks: str | None = None, decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids; null ids give no bytes, an unknown id raises KeyError."""
    path = ranks or vocabulary("byte_bpe_50k.tiktoken")

    def make(batches):
        tokens = table(path)
        for b in batches:
            column = [v or b"" for v in b.column(b.schema.get_field_index(ids)).to_pylist()]
            made: list[bytes] = []
            at = 0
            while at < len(column):
                upto, size = at + 1, len(column[at])
                while upto < len(column) and size + len(column[upto]) < DECODED:
                    size += len(column[upto])
                    upto += 1
                made += tokens.decode(column[at:upto])
                at = upto
            yield [pa.array(made, pa.binary())]

    return map_added(df, [T.StructField(decoded, T.BinaryType())], make)
