"""The trie of conversation prefixes against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest

from sparkmos.llm import prefix_trie


def brute(rows):
    """rows: (conv_id, turn, role, text) with no equal turns in a conversation."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    member = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            member.setdefault(tuple(ts[:d]), []).append(c)
    out = set()
    for p, cs in member.items():
        under = [q for q in member if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in under)
        saved = sum((len(member[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p))))
        out.add((min(cs), len(p), min(member[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in under), sum(map(leaf, under)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed, n=220):
    """Few different turns, so many shared prefixes; copies of one conversation; borrowed heads."""
    rnd = random.Random(seed)
    say = lambda: (rnd.choice(["user", "bot", None]), rnd.choice(["a", "bb", "", None, "c" * 50, "日本"]))
    hot = [say() for _ in range(7)]
    rows = []
    for c in sorted({*rnd.sample(range(1, 900), n), 0, 100, 200}):
        turns = hot if rnd.random() < 0.4 else [say() for _ in range(rnd.choice([1, 2, 3, 5, 12]))]
        rows += [(c, t if t or rnd.random() < 0.5 else None, *x) for t, x in enumerate(turns)]
    rnd.shuffle(rows)
    return rows + [(None, 0, "user", "no id")]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, path int")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(df, **options):
    got = [tuple(r) for r in prefix_trie.nodes(prefix_trie.paths(df), **options).select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"shard_turns": 60, "least_turns": 10}), (3, {"shard_turns": 9, "least_turns": 1}), (4, {"shard_turns": 25, "least_turns": 1})])
def test_nodes_against_a_dictionary(spark, monkeypatch, seed, options):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "SKELETON_ROWS", 10**6 if seed % 2 else 0)
    rows = conversations(seed)
    assert trie(table(spark, rows), **options) == brute(rows)


def test_copies_are_dealt_out(spark):
    """Every row is the same conversation: the skeleton is its whole path, and all ids are hashed in one order."""
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(8)]
    got = trie(table(spark, rows), shard_turns=300, least_turns=1)
    assert got == brute(rows) and len(got) == 9


def test_edges(spark):
    none = table(spark, []).where("false")
    assert trie(none) == set()
    # The base is absent and the conversation is no longer than the borrowed head: no turn is left.
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 1, "user", "x")]
    assert trie(table(spark, rows)) == brute(rows) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}
    # Equal turns are ordered by digest, whatever the rows' order.
    ties = [(8, 1, "user", "x"), (8, 1, "user", "y"), (8, None, None, None), (8, 1, "user", "x")]
    assert trie(table(spark, ties)) == trie(table(spark, ties[::-1]))
    long = [(5, t, "user", f"{t}") for t in range(5000)] + [(6, t, "user", f"{t}") for t in range(4999)]
    deep = trie(table(spark, long), shard_turns=5000, least_turns=1)
    left = [n - zlib.crc32(str(c).encode()) % 6 for c, n in ((5, 5000), (6, 4999))]  # their base is absent
    assert max(r[1] for r in deep) == max(left) and {r[1] for r in deep} == set(range(max(left) + 1))
