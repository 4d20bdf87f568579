"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmos.llm import ann, byte_bpe, decontaminate, fingerprint, language, licenses, lm_score, near_dup, packing, periodic, prefix_trie, token_counts, toxicity
from sparkmos.session import prepare

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"),
    )


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    coded = byte_bpe.decode(byte_bpe.encode(read(spark, sf, "documents").select("doc_id", "text")))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def _crc(column: str) -> Column:
    return F.crc32(F.col(column).cast("string"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    held_out = F.coalesce(_crc("doc_id") % 4 == 2, F.lit(False))
    model = toxicity.fit(docs, read(spark, sf, "labels"), held_out=held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op2_language")
def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_crc("doc_id") % 3 == 1, F.lit(False))
    filters = language.fit(docs, held_out=held_out)
    return language.predict(docs.select("doc_id", "text"), filters).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP9_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""


@query("op9_near_duplicates", OP9_SQL)
def op9_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.groups(read(spark, sf, "documents")).select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")
    )


OP4_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op4_nearest", OP4_SQL)
def op4_nearest(spark: SparkSession, sf: str) -> DataFrame:
    indexed, center = ann.index(read(spark, sf, "embeddings"))
    return ann.search(indexed, center, F.col("vec_id") % 100 == 0)


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.with_next(read(spark, sf, "documents"))


OP8_SQL = f"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM benchmark),
v AS (
  SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS id
  FROM (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM t) GROUP BY word)),
tw AS (
  SELECT x.doc_id, x.i, coalesce(v.id, 0) AS id
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM t) x LEFT JOIN v USING (word)),
bw AS (
  SELECT x.item_id, x.i, coalesce(v.id, 0) AS id
  FROM (SELECT item_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM b) x LEFT JOIN v USING (word)),
tp AS (SELECT doc_id, coalesce(lag(id) OVER (PARTITION BY doc_id ORDER BY i), 1) AS h, id AS w FROM tw),
bp AS (SELECT coalesce(lag(id) OVER (PARTITION BY item_id ORDER BY i), 1) AS h, id AS w FROM bw),
s AS (SELECT (SELECT count(*) FROM bp) / (SELECT count(*) FROM tp)::DOUBLE AS scale),
gc AS (SELECT h, w, count(*) * (SELECT scale FROM s) AS c FROM tp GROUP BY h, w),
wc AS (SELECT h, w, count(*)::DOUBLE AS c FROM bp GROUP BY h, w),
ids AS (SELECT unnest(range((SELECT count(*) FROM v) + 2)) AS w),
gu AS (SELECT w, CASE WHEN w = 1 THEN 0.5 ELSE coalesce(sum(c), 0) + 0.5 END AS u FROM ids LEFT JOIN gc USING (w) GROUP BY w),
wu AS (SELECT w, CASE WHEN w = 1 THEN 0.5 ELSE coalesce(sum(c), 0) + 0.5 END AS u FROM ids LEFT JOIN wc USING (w) GROUP BY w),
gh AS (SELECT h, sum(c) AS c FROM gc GROUP BY h),
wh AS (SELECT h, sum(c) AS c FROM wc GROUP BY h),
p AS (SELECT DISTINCT h, w FROM tp),
l AS (
  SELECT p.h, p.w,
    -ln((coalesce(wc.c, 0) + 50 * wu.u / (SELECT sum(u) FROM wu)) / (coalesce(wh.c, 0) + 50)) AS lt,
    -ln((coalesce(gc.c, 0) + 50 * gu.u / (SELECT sum(u) FROM gu)) / (coalesce(gh.c, 0) + 50)) AS lb
  FROM p JOIN gu USING (w) JOIN wu USING (w) LEFT JOIN gc ON gc.h = p.h AND gc.w = p.w LEFT JOIN wc ON wc.h = p.h AND wc.w = p.w
  LEFT JOIN gh ON gh.h = p.h LEFT JOIN wh ON wh.h = p.h),
m AS (SELECT doc_id, avg(lt) AS lt, avg(lb) AS lb, avg(lt) - avg(lb) AS d FROM tp JOIN l USING (h, w) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, round(lt, 6) AS loss_target, round(lb, 6) AS loss_background, round(d, 6) AS lm_score
FROM t LEFT JOIN m USING (doc_id)
"""


@query("op8_lm_score", OP8_SQL)
def op8_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    scored = lm_score.score(docs, read(spark, sf, "benchmark").select("text"))
    rounded = [F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "lm_score")]
    return scored.select("doc_id", "n_words", *rounded)


@query("op3_licenses", licenses.oracle())
def op3_licenses(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.recognise(read(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        "unmatched",
    )


@query("op11_prefix_trie", prefix_trie.oracle())
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.paths(read(spark, sf, "conversations")))


@query("op12_periodic_runs", periodic.oracle())
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.find(periodic.repeat_tails(read(spark, sf, "documents").select("doc_id", "text")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    most = found.select("doc_id", "runs", "collapsed", periodic.best(F.col("runs")).alias("best"))
    return most.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.expr("best.length * 1000 div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_decontamination", decontaminate.oracle())
def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, read(spark, sf, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
