"""Benchmark decontamination against loops."""

import hashlib
import random
import re

import numpy as np
import pytest

from sparkmos.llm import decontaminate
from sparkmos.llm.queries import QUERIES

WORD = re.compile(decontaminate.WORD)


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute(docs, items):
    """Per document: words, hit places, items, by comparing every window with every place."""
    out = []
    for _, text in docs:
        ws, hit, named = WORD.findall(low(text)), set(), set()
        for item, other in items:
            b = WORD.findall(low(other))
            n = min(len(b), 10)
            for i in range(len(b) - n + 1 if n else 0):
                for k in range(len(ws) - n + 1):
                    if ws[k : k + n] == b[i : i + n]:
                        hit.update(range(k, k + n))
                        if item is not None:
                            named.add(str(item))
        out.append((len(ws), hit, sorted(named)))
    return out


def made(seed=3, n=60):
    rnd = random.Random(seed)
    pool = [f"w{i}" for i in range(12)] + ["É", "ß7", "日本"]
    some = lambda k: " ".join(rnd.choice(pool) for _ in range(k))
    items = [(i, some(rnd.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(25)] + [(None, some(14)), (7, some(20)), (100, None), (101, " .,- ")]
    docs = []
    for i in range(n):
        pick = rnd.choice(items)[1] or ""
        parts = [some(rnd.randrange(15)), pick.upper() if i % 2 else pick.replace(" ", "\n-- "), some(rnd.randrange(15))]
        docs.append((i if i % 9 else None, " ".join(parts)))
    return docs + [(3, None), (4, ""), (4, ""), (5, "...")], items


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = made()
    return docs, items, spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, SPANS string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")


def rows_of(df):
    got = []
    for r in df.collect():
        hit = {k for s in r.spans for k in range(s.start, s.end)}
        got.append((str(r.doc_id), r.text or "", r.n_words, r.n_hit, sorted(hit), r["items"], r.contaminated))
    return sorted(got)


@pytest.mark.parametrize("part_words", [1_000_000, 60])
def test_every_window_is_found(tables, part_words):
    docs, items, d, b = tables
    want = sorted((str(i), t or "", n, len(h), sorted(h), named, bool(h)) for (i, t), (n, h, named) in zip(docs, brute(docs, items)))
    assert rows_of(decontaminate.scan(d, b, part_words=part_words)) == want
    assert any(w[6] for w in want) and not all(w[6] for w in want)


def test_long_items_and_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 50)
    monkeypatch.setattr(decontaminate, "BLOCK", 7)
    rnd = random.Random(1)
    ws = [f"v{rnd.randrange(10**6)}" for _ in range(2500)]
    index = decontaminate.compile_index([("a", [w.encode() for w in ws])])
    text = " ".join(["x"] * 30 + ws[995:1012] + ["y"] + ws[:9] + ["z" * 200] + ws[2490:])
    n, n_hit, spans, items = decontaminate.Scanner(index).scan([text.encode(), b""], [None, None], [None, None])
    assert spans[0] == [{"start": 30, "end": 47}, {"start": 58, "end": 68}] and n_hit == [27, 0] and items == [["a"], []] and n == [68, 0]
    cut = decontaminate.segments(spark.createDataFrame([(1, " ".join(ws))], "item_id int, text string")).collect()
    windows = {tuple(r.ws[i : i + 10]) for r in cut for i in range(len(r.ws) - 9)}
    assert windows == {tuple(ws[i : i + 10]) for i in range(len(ws) - 9)} and max(len(r.ws) for r in cut) <= 1009


def test_removal_of_documents_and_spans(spark, tables):
    docs, items, d, b = tables
    found = brute(docs, items)
    clean = sorted((str(i), t or "") for (i, t), (_, h, _) in zip(docs, found) if not h)
    assert sorted((str(r.doc_id), r.text or "") for r in decontaminate.drop_documents(d, b).collect()) == clean
    left = decontaminate.drop_spans(d, b)
    want = sorted([w for k, w in enumerate(WORD.findall(low(t))) if k not in h] for (_, t), (_, h, _) in zip(docs, found))
    assert sorted(WORD.findall(low(r.text)) for r in left.collect()) == want
    text = "Keep THIS, é: one two three four five six seven eight nine ten! Keep that."
    one = spark.createDataFrame([(1, text)], "doc_id int, text string")
    item = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id int, text string")
    assert decontaminate.drop_spans(one, item).first().text == "Keep THIS, é: ! Keep that."


def test_empty_tables(spark, tables):
    _, _, d, b = tables
    assert {r.n_hit for r in decontaminate.scan(d, b.where("false")).collect()} == {0}
    assert decontaminate.scan(d.where("false"), b).collect() == []


def test_equal_hashes_take_other_codes(monkeypatch):
    calls, real = [], decontaminate._hashes

    def clash(codes, ids, starts, length):
        calls.append(1)
        return np.zeros(len(starts), dtype=np.uint64) if len(calls) == 1 else real(codes, ids, starts, length)

    monkeypatch.setattr(decontaminate, "_hashes", clash)
    index = decontaminate.compile_index([("a", [b"p", b"q"]), ("b", [b"r", b"s"])])
    assert len(index.lengths[0].hashes) == 2 and len(calls) == 2


def test_query_digest(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op13_decontamination"][0](spark, sf).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 1500").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for (i, _), (n, hit, named) in zip(docs, brute(docs, items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(named), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
