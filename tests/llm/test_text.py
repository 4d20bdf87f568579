"""Language, toxicity, language-model scores, licenses, fingerprints and near-duplicates."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmos.llm import fingerprint, language, licenses, lm_score, near_dup, sketch, toxicity
from sparkmos.llm.queries import QUERIES

EDGES = [
    (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "A b C d"), (6, "long text here " * 20_000), (7, "same words in both of them"),
    (7, "same words in both of them"), (8, "SAME words in both of them"), (None, "no id"), (9, "123 !!! 你好"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if t else None, 0.5, "x", 1) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, Score double, licenses string, bucket int")


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# Language


def test_language_of_held_out_documents(spark, sf):
    got = QUERIES["op2_language"][0](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert len(got) == len(docs)
    both = docs.merge(got, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    assert (both.lang == both.lang_pred)[both.held_out].mean() > 0.95 and both.score.between(0, 1).all()


def test_language_filters_return_all_languages_of_a_gram(spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "alpha zeta", "x" if i % 2 else "y") for i in range(40)]
    filters = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    h, _, _ = language.grams(["alpha"])
    for at in zip(*language.places(h)):
        assert np.bitwise_and.reduce(filters.table[list(at)]) == 3
    h, _, _ = language.grams(["gamma"])
    assert np.bitwise_and.reduce([filters.table[p[1]] for p in language.places(h)]) == 1
    assert filters.predict(["beta gamma", "zeta", "", "12", "qqqq"])[0] == ["x", "y", "und", "und", "x"]


def test_language_edges(docs):
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.predict(docs, language.fit(docs)).collect()}
    assert got[(1, None)] == got[(2, "")] == got[(3, " \t\n ")] == ("und", 0.0)
    assert got[(4, "word")][0] == "en"
    nothing = language.fit(docs.where("false"))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.where("false"), nothing).count() == 0


# Toxicity


@pytest.fixture(scope="module")
def judge():
    rnd = random.Random(1)
    clean = ["".join(rnd.choice("aeinrst") + rnd.choice("ldmkp") for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    bad = ["idiot", "moron", "worthless"]
    rows, kinds = [], []
    for i in range(600):
        ws = rnd.choices(clean, k=40)
        kinds.append(i % 5 == 0)
        if kinds[-1]:
            for _ in range(2):
                ws[rnd.randrange(40)] = rnd.choice(bad)
        rows.append(" ".join(ws))
    return toxicity.train(rows, np.array(kinds), np.ones(len(rows))), clean


def test_toxicity_tolerates_gaps_and_insertions(judge):
    model, clean = judge
    said = ["you idiot", "an i d i o t here", "id-io.t", "IDIOT!!", "idiiot", "worthlesss", "mor*on"]
    assert model.score(said).min() > 0.3
    assert model.score([" ".join(clean[:50]), "", "12 !?"]).max() < 0.3


def test_kernel_is_the_sum_over_shared_subsequences():
    rows, _ = toxicity.fold(["cat", "cart"])
    own = toxicity._subsequences(rows)
    weights = [collections.Counter() for _ in rows]
    for c, row in zip(weights, rows):
        for i in range(toxicity.PIECE):
            for a, b in toxicity.OFFSETS:
                t = tuple(row[[i, i + a, i + b]].tolist())
                if t[1:] != (0, 0):
                    c[t] += toxicity.DECAY ** (b + 1)
    want = sum(weights[0][t] * weights[1][t] for t in weights[0]) / np.prod(toxicity._norms(own))
    marks = toxicity.Landmarks(rows[:1], np.ones(1), 1, 1)
    assert np.isclose(marks.kernel(rows[1:])[0, 0], want**toxicity.POWER, rtol=1e-4)


def test_toxicity_edges(spark, docs, judge):
    model, _ = judge
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got) and "Score" not in got[0].asDict()
    assert toxicity.score(docs.where("false"), model).count() == 0
    labels = spark.createDataFrame([(4, 1, None), (5, 1, 0), (5, 1, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    flat = toxicity.fit(docs, labels)
    assert {r.score for r in toxicity.score(docs, flat).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).collect()} == {0.0}


def test_toxicity_query_is_whole(spark, sf):
    got = QUERIES["op5_toxicity"][0](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()


# Language-model scores


def test_scores_tell_the_target(spark):
    rnd = random.Random(3)
    a, b = "one two three four".split(), "red green blue pink".split()
    rows = [(i, " ".join(rnd.choices(a if i % 2 else b, k=30))) for i in range(60)]
    got = {r.doc_id: r.lm_score for r in lm_score.score(table(spark, rows), table(spark, [(0, " ".join(rnd.choices(a, k=200)))])).collect()}
    assert max(v for k, v in got.items() if k % 2) < min(v for k, v in got.items() if not k % 2)


def test_score_edges(docs):
    got = lm_score.score(docs, docs.where("false")).collect()
    assert len(got) == len(EDGES)
    assert all((r.lm_score is None) == (r.n_words == 0) for r in got)
    assert lm_score.score(docs.where("false"), docs).count() == 0


def test_each_models_losses_are_a_distribution():
    counts = np.random.default_rng(0).integers(0, 9, (64, 64)).astype(float)
    counts[:, 1] = 0
    assert np.allclose(np.exp(-lm_score.losses(counts, 0.3)).sum(axis=1), 1)


def test_rare_words_carry_evidence(spark):
    """The last texts differ in one word only, and 2000 others are commoner."""
    rows = [(i, f"aa bb w{i} w{i}") for i in range(2000)] + [(3000, "aa x11"), (3001, "aa x1900")]
    for rare, other in ((3000, 3001), (3001, 3000)):
        word = dict(rows)[rare].split()[1]
        got = {r.doc_id: r.lm_score for r in lm_score.score(table(spark, rows), table(spark, [(0, f"aa {word} bb {word}")] * 3)).collect()}
        assert got[rare] < got[other] - 0.01


def by_hand(text: str, target: list[str], background: list[str]) -> tuple[float, float] | None:
    def pairs(texts):
        return [p for t in texts for p in zip(["", *t.split()], t.split())]

    wanted, general = pairs(target), pairs(background)
    n_words = len({w for _, w in general})
    level = len(wanted) / len(general)
    out = []
    for own, scale in ((wanted, 1.0), (general, level)):
        loss = [
            -np.log(
                (scale * own.count((h, w)) + 50 * (scale * sum(x == w for _, x in own) + 0.5) / (scale * len(own) + 0.5 * (n_words + 2)))
                / (scale * sum(x == h for x, _ in own) + 50)
            )
            for h, w in pairs([text])
        ]
        out.append(np.mean(loss) if loss else None)
    return out


@pytest.mark.parametrize("own_background", [False, True])
def test_scores_of_blocks_and_ranges_are_those_by_hand(spark, monkeypatch, own_background):
    """Many blocks and ranges, rows that come twice, null ids and texts."""
    monkeypatch.setattr(lm_score, "LEAST_BLOCK", 40)
    monkeypatch.setattr(lm_score, "RANGE", 50)
    rnd = random.Random(5)
    some = lambda n: [" ".join(rnd.choices("abcdefgh", k=rnd.randrange(12))) for _ in range(n)]
    texts_, target, background = some(40), some(6), some(20)
    rows = [*enumerate(texts_), *enumerate(texts_[:5]), (None, "a b c"), (None, None)]
    got = lm_score.score(table(spark, rows), table(spark, list(enumerate(target))), table(spark, list(enumerate(background))) if own_background else None).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        want = by_hand(r.text or "", target, background if own_background else [t or "" for _, t in rows])
        assert r.n_words == len((r.text or "").split())
        if r.n_words:
            assert np.allclose((r.loss_target, r.loss_background, r.lm_score), (*want, want[0] - want[1]))
        else:
            assert r.lm_score is None


def test_fixed_vocabulary_on_request(spark):
    rows = [(i, f"aa bb w{i}") for i in range(50)]
    got = lm_score.score(table(spark, rows), table(spark, [(0, "aa w7")]), size=4).collect()
    assert len({r.lm_score for r in got}) == 1 and len(got) == 50


# Licenses


def test_licenses(spark):
    mit = " ".join(licenses.SENTENCES[k][0] for k in ("mit_permission", "mit_notice", "mit_asis"))
    wrapped = re.sub(r"(\w+ \w+ \w+) ", r"\1\n  ", mit)
    rows = [
        (1, f"Copyright X\n{wrapped}, EXPRESS"), (2, "text\nReleased under the MIT License.\nmore"),
        (3, "Licensed under the Apache License, Version 2.0. All rights reserved."), (4, "unlicensed words"), (5, None), (6, ""),
        (7, " ".join(licenses.SENTENCES[k][0] for k in ("bsd_conditions", "bsd_source", "bsd_binary"))),
        (8, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
    ]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.recognise(table(spark, rows)).collect()}
    assert got == {
        1: (["MIT"], 0), 2: (["MIT"], 0), 3: (["Apache-2.0"], 1), 4: ([], 0), 5: ([], 0), 6: ([], 0), 7: (["BSD-2-Clause"], 0),
        8: (["CC-BY-NC-4.0"], 0),
    }


def test_license_edges_and_plan(docs):
    found = licenses.recognise(docs)
    assert found.count() == len(EDGES) and found.where("size(licenses) > 0").count() == 0
    assert licenses.recognise(docs.where("false")).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_every_known_sentence_has_a_keyword():
    for found in licenses.SENTENCES.values():
        assert all(re.search(licenses.HINT, s) for s in found)


# Fingerprints


def test_spans_against_strings():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) for _ in range(2))
        i, j = rnd.randint(0, len(a)), rnd.randint(0, len(b))
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        pa, pb = fingerprint.prefix(a), fingerprint.prefix(b)
        assert fingerprint.common_extension(pa, i, pb, j) == k
        assert (fingerprint.spliced(pa, i, pb, j) == fingerprint.prefix(a[:i] + b[:j])).all()


def test_likeness():
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefgh") for _ in range(1000))
    mark = lambda t: fingerprint.fingerprint(fingerprint.prefix(t))
    like = lambda x, y: fingerprint.likeness(mark(x), mark(y))
    assert like(text, text) == like("", "") == 1 and like(text, "") == like("", text) == 0 and like(text, text[::-1]) < 0.1
    assert like(text, text[:500] + "inserted" + text[500:]) > 0.8
    assert like(text, text[:300] + "#" + text[301:]) > 0.85
    assert 0.5 < like(text, text[:667] + "z" * 333) < 0.7
    for n in range(0, 40):
        for m in range(0, 40):
            x, y = "a" * n, "a" * m
            assert 0 <= like(x, y) <= 1 and like(x, y) == like(y, x)


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_neighbours_against_a_loop(spark, buckets):
    rnd = random.Random(7)
    rows = [(i * 3, "".join(rnd.choice("abcé你") for _ in range(rnd.randint(0, 50)))) for i in range(40)] + [(500, None), (501, "")]
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        want[i] = hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
    got = fingerprint.with_next(table(spark, rows).repartition(4), buckets=buckets).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == want and len(got) == len(rows)


def test_fingerprint_edges(spark, docs):
    got = fingerprint.with_next(docs, buckets=4).collect()
    assert len(got) == len(EDGES)
    assert len({r.fingerprint for r in got if r.doc_id == 7}) == 1
    assert fingerprint.with_next(docs.where("false")).count() == 0
    alone = fingerprint.with_next(table(spark, [(1, "abcdef")])).first()
    assert alone.near_next == 1.0 and alone.n_chars == 6


def test_fingerprint_query(spark, sf):
    got = QUERIES["op7_fingerprints"][0](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.near_edited.mean() > 0.5 > got.near_next.mean()


# Near-duplicates


def shingle_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_force(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    return {k: min(rows[j][0] for j in g) for g in groups.values() for k in g}, [len(s) for _, s in sets]


def copies(seed, n=240):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [rnd.choices(vocab, k=rnd.choice([3, 8, 60, 150])) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases)) if i % 3 else rnd.choices(vocab, k=rnd.randint(0, 40))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize("seed, block", [(1, 512), (2, 5)])
def test_groups_against_brute_force(spark, tmp_path, seed, block):
    rows = copies(seed)
    table(spark, rows).repartition(3).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in near_dup.groups(spark.read.parquet(str(tmp_path / "d")), block=block).collect()}
    want, sizes = brute_force(rows)
    assert {i: r.component_id for i, r in got.items()} == {rows[k][0]: v for k, v in want.items()}
    assert [got[i].n_shingles for i, _ in rows] == sizes
    assert all(r.kept == (r.component_id == r.doc_id) for r in got.values())


def test_group_edges(docs, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    got = near_dup.groups(stored).collect()
    assert len(got) == len(EDGES)
    same = [r for r in got if r.doc_id in (7, 8)]
    assert {r.component_id for r in same} == {7} and sum(r.kept for r in same) == 1
    assert all(r.kept and r.n_shingles == 0 for r in got if r.doc_id in (1, 2, 3))
    left = near_dup.deduplicate(stored)
    assert left.columns == docs.columns and left.count() == len(EDGES) - 2
    assert near_dup.groups(stored.where("false")).count() == 0 and near_dup.deduplicate(stored.where("false")).count() == 0


def test_chains_get_one_label(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002)], "a bigint, b bigint")
    got = {r.node: r.label for r in near_dup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000, 1002: 1000}
    assert near_dup.components(edges.where("false")).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    sets = [np.unique(a[:n]) for n in (0, 1, 2, 7, 100, 1000)] + [np.unique(a[250:1250])]
    s = sketch.sketch(np.concatenate(sets), np.array([len(x) for x in sets]), 120)
    assert (s[0] == sketch.EMPTY).all() and (s[1:] != sketch.EMPTY).all()
    assert abs((s[5] == s[6]).mean() - 750 / 1250) < 0.17
    assert (sketch.sketch(sets[3], np.array([7]), 120)[0] == s[3]).all()
