"""Periodic runs against loops over all periods, and the trees against direct comparison."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sparkmos.llm import periodic
from sparkmos.llm.queries import QUERIES


def brute(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and j > i:
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def phrase(rnd, letters, n):
    w = []
    while len(w) < n:
        w += [rnd.randrange(letters) for _ in range(rnd.randrange(1, 6))] * rnd.choice([1, 1, 2, 3, 7])
    return w


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (5, 3)])
def test_runs_against_all_periods(least, times):
    rnd = random.Random(least)
    for _ in range(400):
        w = phrase(rnd, rnd.choice([1, 2, 3, 9]), rnd.randrange(70))
        got = [tuple(r) for r in periodic.runs(np.array(w, dtype=np.int64), least, times).tolist()]
        assert got == brute(w, least, times), w


def test_trees_agree_with_comparison():
    rnd = random.Random(5)
    for _ in range(60):
        w = phrase(rnd, 3, rnd.randrange(1, 90))
        tree = periodic.SuffixTree(w)
        i, j = np.triu_indices(len(w) + 1, 1)
        want = [next((k for k in range(len(w)) if w[a + k : a + k + 1] != w[b + k : b + k + 1] or b + k >= len(w)), 0) for a, b in zip(i.tolist(), j.tolist())]
        assert tree.agree(i, j).tolist() == want
        suffixes = [(w[k:], k) for k in range(len(w) + 1)]
        assert np.argsort(tree.up).tolist() == [k for _, k in sorted(suffixes)]
        assert np.argsort(tree.down).tolist() == [k for _, k in sorted(([-x for x in s], k) for s, k in suffixes)]


def test_range_minima():
    rnd = np.random.default_rng(0)
    for n in (1, 15, 16, 17, 500):
        v = rnd.integers(0, 99, n)
        a, b = np.sort(rnd.integers(0, n, (2, 300)), axis=0)
        assert periodic.Minima(v)(a, b).tolist() == [v[x : y + 1].min() for x, y in zip(a, b)]


def test_stretches_hold_every_run_and_stay_inside_documents():
    rnd = random.Random(2)
    for _ in range(200):
        docs = [phrase(rnd, rnd.choice([2, 40]), rnd.randrange(60)) for _ in range(4)]
        texts = [" ".join(map(str, w)).encode() for w in docs]
        for w, (found, kept) in zip(docs, periodic.judge(texts)):
            want = brute(w)
            assert [tuple(r.values()) for r in found] == want
            gone = {k for s, n, q in want for k in range(s + q, s + n)}
            assert kept == " ".join(str(x) for k, x in enumerate(w) if k not in gone).encode()


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 5)
    text = b"  ab cdefghijkl\tab " + b"go on\n" * 9 + "no gap é".encode()
    assert [w for ws in periodic.pieces(text) for w in ws] == text.split()
    ((found, kept),) = periodic.judge([text])
    assert found == [{"start": 3, "length": 18, "period": 2}] and kept == b"ab cdefghijkl ab go on " + "no gap é".encode()


def edited(doc_id, text):
    ws = (text or "").encode().split()
    if doc_id is None or not ws:
        return [w.decode() for w in ws]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0:
        g, n = h // 10, len(ws)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    return [w.decode() for w in ws]


def test_query_against_loops(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i, " ".join(map(str, phrase(rnd, 30, rnd.randrange(120))))) for i in range(150)]
    rows += [(3, None), (3, None), (None, "a " * 9), (1000, ""), (1001, " \n "), (1002, "x" * 10000), (1003, "the same 　 words " * 6000)]
    spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id bigint, text string, collapsed string, Runs int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(map(str, r)) for r in QUERIES["op12_periodic_runs"][0](spark, str(tmp_path)).collect())
    want = []
    for i, text in rows:
        w = edited(i, text)
        found = brute(w) if i != 1003 else [(0, len(w), 4)]
        top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert got == sorted(tuple(map(str, r)) for r in want)
    assert periodic.find(spark.createDataFrame([], "text string")).collect() == []
