"""A corpus pipeline: toxic documents go, documents of no language go, one document of each
near-duplicate group stays, and what is left is packed into training windows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each stage's
result as Parquet in the shared folder and hands it, read again, to the next; the last result
is returned as it is. All stages but the last return the columns of ``documents``, whatever
they are called.

Rows are judged one by one in the first two stages, so repeated rows stay or go together; of
equal or near texts, and of rows with the same doc_id among them, one row stays (the smallest
doc_id, null last). Null and empty texts are not toxic, have no language and go there. An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmos.llm import language, near_dup, packing, toxicity
from sparkmos.llm.frames import free_name
from sparkmos.session import materialize, prepare

#: Documents that score at least this go.
TOXIC = 0.3
#: A document stays if its language explains at least this part of its letter n-grams.
EXPLAINED = 0.25
#: Documents whose sets of five-word runs have at least this Jaccard similarity, in percent, are near copies.
NEAR = 80


def _same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labels; a document without text is not toxic."""
    prepare(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = free_name(docs, "__toxic")
    return _same_columns(toxicity.score(docs, model, out=out).where(F.col(out) < TOXIC), docs)


def drop_no_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no known language, go."""
    prepare(spark)
    filters = language.fit(docs)
    lang, explained = free_name(docs, "__lang"), free_name(docs, "__explained")
    named = language.predict(docs, filters, out=lang, score=explained)
    return _same_columns(named.where((F.col(lang) != language.UNKNOWN) & (F.col(explained) >= EXPLAINED)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays."""
    prepare(spark)
    return near_dup.deduplicate(docs, percent=NEAR)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places in windows of 4096 ids."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_no_language),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: Learned stages have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
