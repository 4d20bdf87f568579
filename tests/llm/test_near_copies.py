"""The near-duplicate stage at its own threshold, and row numbers that outlast a change of splits."""

import random

import pytest

import corpus_pipeline
from sparkmos.llm import near_dup
from tests.llm.test_text import shingle_set, table


def at_80(rows):
    """Smallest doc_id of each document's group."""
    sets, label = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if k == old else k for k in label]
    least = {}
    for k, (i, _) in zip(label, rows):
        least[k] = min(i, least.get(k, i))
    return {i: least[k] for k, (i, _) in zip(label, rows)}


def near_copies(first=0, n=40, length=100):
    """Pairs of which the second has its last words changed: 100 * common / union falls from 90 to 70."""
    rnd, rows = random.Random(8), []
    for i in range(n):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(length)]
        changed = 5 + i % 13
        rows += [(first + 2 * i, " ".join(w)), (first + 2 * i + 1, " ".join(w[:-changed] + [f"x{rnd.randrange(10**6)}" for _ in range(changed)]))]
    return rows


def test_stage_drops_copies_of_80_percent(spark, sf, tmp_path):
    rows = near_copies()
    table(spark, rows).repartition(3).write.parquet(str(tmp_path / "d"))
    left = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), sf)
    want = set(at_80(rows).values())
    between = [i for i, t in rows[1::2] if 80 <= 100 * len(shingle_set(t) & shingle_set(dict(rows)[i - 1])) / len(shingle_set(t) | shingle_set(dict(rows)[i - 1])) < 85]
    assert between and not want & set(between)
    assert sorted(r.doc_id for r in left.collect()) == sorted(want)


@pytest.mark.parametrize("percent", [50, 80, 85, 95, 100])
def test_bands_miss_a_pair_at_the_threshold_once_in_a_million(percent):
    n = near_dup.bands_for(percent)
    assert (1 - (percent / 100) ** near_dup.ROWS) ** n <= near_dup.MISS
    assert n == 1 or (1 - (percent / 100) ** near_dup.ROWS) ** (n - 1) > near_dup.MISS


def test_rows_keep_their_numbers_when_splits_change(spark, tmp_path, monkeypatch):
    rows = near_copies() + [(1000 + k, t) for k, (_, t) in enumerate(near_copies()[:20])]
    table(spark, rows).repartition(6).write.parquet(str(tmp_path / "d"))
    docs, want = spark.read.parquet(str(tmp_path / "d")), at_80(rows)
    key, kept = "spark.sql.files.maxPartitionBytes", near_dup.materialize

    def later(df):
        """As if executors came or went after the first job."""
        out = kept(df)
        spark.conf.set(key, "3000")
        return out

    before = spark.conf.get(key)
    monkeypatch.setattr(near_dup, "materialize", later)
    try:
        got = {r.doc_id: r.component_id for r in near_dup.groups(docs, percent=80).collect()}
        assert got == want
        spark.conf.set(key, before)
        left = near_dup.deduplicate(docs, percent=80)
        assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))
    finally:
        spark.conf.set(key, before)
