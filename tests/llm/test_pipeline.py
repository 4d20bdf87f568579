"""The corpus pipeline, stage by stage, against plain loops."""

import numpy as np
import pytest

import corpus_pipeline
from sparkmos.llm import language, toxicity, word_bpe
from sparkmos.llm.frames import vocabulary
from tests.llm.test_near_copies import at_80


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What every stage returned, stored and read again."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [spark.read.parquet(f"{sf}/documents.parquet"), *out]


def test_stages_against_loops(spark, sf, stages):
    docs, calm, spoken, single, packed = (d.toPandas() for d in stages)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(stages[0], labels)
    assert sorted(calm.doc_id) == sorted(docs.doc_id[model.score([t or "" for t in docs.text]) < corpus_pipeline.TOXIC])
    names, score = language.fit(stages[1]).predict([t or "" for t in calm.text])
    assert sorted(spoken.doc_id) == sorted(calm.doc_id[(np.array(names) != "und") & (score >= corpus_pipeline.EXPLAINED)])
    rows = list(zip(spoken.doc_id, spoken.text))
    assert corpus_pipeline.NEAR == 80
    assert sorted(single.doc_id) == sorted(set(at_80(rows).values()))
    coder = word_bpe.words(vocabulary("word_bpe_49k.json"))
    ids = {i: coder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in zip(single.doc_id, single.text)}
    packed = packed.sort_values(["doc_id", "start"])
    for i, part in packed.groupby("doc_id"):
        assert [x for p in part["ids"] for x in np.frombuffer(p, "<u4").tolist()] == ids[i]
    assert set(packed.doc_id) == set(ids)


def test_stages_keep_the_columns_and_clean_documents(stages):
    for d in stages[1:-1]:
        assert d.columns == stages[0].columns
    assert stages[1].count() > 0.7 * stages[0].count() and stages[2].count() > 0.9 * stages[1].count()


def test_run_gives_the_same_rows(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "start", "length", "doc_tokens"]
    assert sorted(got.select("doc_id", "doc_tokens").distinct().collect()) == sorted(stages[-1].select("doc_id", "doc_tokens").distinct().collect())
    assert got.columns == stages[-1].columns and set(key) <= set(got.columns)


def test_stages_take_empty_and_odd_tables(spark, sf):
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the cat sat on the mat", None, None, 5)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    for i, df in enumerate((odd, odd.where("false"))):
        df.write.mode("overwrite").parquet(f"{path}/odd{i}")
        docs = spark.read.parquet(f"{path}/odd{i}")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns
            stage(spark, docs, sf).count()
        corpus_pipeline.pack(spark, docs, sf).count()


def test_columns_named_like_the_stages_own_stay(spark, sf):
    text = "the quick brown fox jumps over the lazy dog and runs away from the house"
    rows = [(i, text + f" again {i}", "en", 7.5, 8.5, "own", -i) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, __toxic double, __explained double, __LANG string, __row int")
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") + "/clashing"
    docs.write.mode("overwrite").parquet(path)
    docs = spark.read.parquet(path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns
        assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}
    assert [r.doc_id for r in got.collect()] == [0]
