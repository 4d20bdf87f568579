"""Byte-level BPE, token counts and packing against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sparkmos.llm import byte_bpe, packing, token_counts, word_bpe

SCHEMA = "doc_id bigint, text string, N_TOKENS int, ids string, uid string, packed int"
EDGES = [
    (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "it's  THE end, isn't it?\n\n"), (6, "ab " * 20_000 + "x" * 5000),
    (7, "same"), (7, "same"), (8, "same"), (None, "no id"), (9, "你好 é é ﬁ ​<|endoftext|> <s> 𝔘"), (10, "\x1c\x85\xa0 !!!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def noise(n, seed, alphabet="ab 'sé\n你1!.<>|", size=200):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def tiktoken_encoding():
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(docs):
    enc = tiktoken_encoding()
    got = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert len(got) == len(EDGES) and "N_TOKENS" not in got[0].asDict()
    for r in got:
        want = enc.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == (r.text or "").encode()


def test_byte_bpe_merges_on_random_texts():
    enc, own = tiktoken_encoding(), byte_bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = [*noise(400, 1), "a" * 3000, "xyz" * 700]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_byte_bpe_takes_long_texts_in_parts(monkeypatch):
    own = byte_bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "some words, and more " * 110_000
    monkeypatch.setattr(byte_bpe, "MATCHES", 1000)
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == tiktoken_encoding().encode_ordinary(text)


def test_empty_tables(empty):
    assert byte_bpe.encode(empty).count() == 0 and token_counts.count_tokens(empty).count() == 0 and packing.pack(empty).count() == 0


def test_counts_equal_the_library(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in token_counts.count_tokens(docs, chunk=512, overlap=16).collect():
        assert r.n_tokens == len(model.encode(r.text or "")), r.doc_id


@pytest.mark.parametrize("alphabet", ["ab ", "aab", " ", "é你𝔘 a", "the quick\n.", "▁a b"])
def test_splices_equal_whole_encodings(alphabet):
    tokenizer = token_counts.library(P.path("piece_bpe_32k.model"))
    for text in noise(60, 2, alphabet, 600):
        for chunk, overlap in ((8, 1), (16, 4), (64, 16)):
            if len(text) > chunk:
                assert token_counts.count_long(text, tokenizer, chunk, overlap) == tokenizer.counts([text])[0]


def test_words_equal_the_library():
    own = word_bpe.Words(P.path("word_bpe_49k.json"))
    texts = [t or "" for _, t in EDGES] + noise(800, 3, "aB \n'sséÉ你1!.,<>|ßİΣ́\x1c\x85", 60)
    want = own.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert own.encode(texts) == [np.array(e.ids, own.dtype).tobytes() for e in want]


def check_packing(pieces, docs, window):
    """Every id in one piece, sequences gapless; returns the share of ids in padded windows."""
    own = word_bpe.Words(P.path("word_bpe_49k.json"))
    want = sorted(e.ids + [2] for e in own.tokenizer.encode_batch([t or "" for _, t in docs], add_special_tokens=False))
    by_doc, sequences = {}, {}
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    got = []
    for (_, n), parts in by_doc.items():
        # Repeated ids share a key: cut their pieces apart where starts begin again.
        ids = [x for _, piece in sorted(parts, key=lambda p: p[0]) for x in piece]
        copies = sum(1 for s, _ in parts if s == 0)
        assert len(ids) == n * copies
        if copies == 1:
            got.append(ids)
    assert all(g in want for g in got)
    used = sum(n for p in sequences.values() for _, n in p)
    return used / (len(sequences) * window)


def test_packing_edges(docs):
    check_packing(packing.pack(docs, window=64, grain=4, cell=3).collect(), EDGES, 64)


def test_packing_fills_windows(spark):
    rnd = random.Random(4)
    docs = [(i, "word " * rnd.choice([3, 20, 40, 55, 90, 300])) for i in range(3000)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), window=128, grain=2, cell=100).collect()
    assert check_packing(pieces, docs, 128) > 0.98


def test_one_length_only(spark):
    docs = [(i, "w " * 99) for i in range(500)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), window=128, grain=2, cell=50).collect()
    assert check_packing(pieces, docs, 128) > 0.98


def test_plan_never_takes_more_than_there_is():
    rng = np.random.default_rng(0)
    for h in (rng.integers(0, 1000, 65), np.eye(65, dtype=int)[40] * 500, np.zeros(65, int), (3000 * np.exp(-np.arange(65) / 9)).astype(int)):
        combos, counts = packing.plan(h)
        used = np.zeros(65, dtype=int)
        for k in range(3):
            np.add.at(used, combos[:, k], counts)
        assert (combos.sum(axis=1) == 64).all() and (used <= h)[1:].all()


def test_least_squares_explains_what_combinations_made():
    combos = packing.combinations(16)
    truth = np.zeros(len(combos))
    truth[[3, 10, 17]] = [50, 20, 7]
    hist = np.zeros(17)
    for k in range(3):
        np.add.at(hist, combos[:, k], truth * (combos[:, k] > 0))
    x = packing.nnls(combos, hist, np.ones(17))
    made = np.zeros(17)
    for k in range(3):
        np.add.at(made, combos[:, k], x * (combos[:, k] > 0))
    assert x.min() >= 0 and np.abs(made[1:] - hist[1:]).max() < 1e-4


def test_queries_against_the_libraries(spark, sf):
    from sparkmos.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc = tiktoken_encoding()
    for r in QUERIES["op10_byte_bpe"][0](spark, sf).collect():
        ids = np.array(enc.encode_ordinary(docs[r.doc_id]), "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.n_tokens == len(ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    tokenizer = token_counts.library(P.path("piece_bpe_32k.model"))
    for r in QUERIES["op6_token_counts"][0](spark, sf).collect():
        n = tokenizer.counts([docs[r.doc_id]])[0]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)
    own = word_bpe.Words(P.path("word_bpe_49k.json"))
    rows = QUERIES["op1_packing"][0](spark, sf).orderBy("doc_id", "start").collect()
    at: dict[int, int] = {}
    for r in rows:
        ids = np.array(own.tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        at[r.doc_id] = r.start + r.length
    assert len(at) == len(docs)


def test_no_row_is_lost_when_a_stage_runs_again(docs):
    total = F.sum(F.xxhash64("ids").cast("decimal(20,0)"))
    assert byte_bpe.encode(docs).select(total).first() == byte_bpe.encode(docs.repartition(3)).select(total).first()
