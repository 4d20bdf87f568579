"""Document fingerprints from prefix polynomial hashes.

``prefix(text)[i]`` is the sum of ``code[j] * BASE ** j`` over ``j < i``, modulo two primes. Any
two spans are equal exactly (but for chance of about 2 ** -62) if the differences of their
prefix entries, each times the other's power, are equal; so the longest common extension of
two places is found by binary search, and the array of a text spliced from two spans is their
arrays' sum, one shifted.

A fingerprint keeps the array at a few places: multiples of a power of two from the text's
start (8 to 16 of them), the same from its end, and its whole length. Grids of different texts
are nested, so the common prefix of two texts is found from their fingerprints alone by binary
search on the coarser grid, and so is the common suffix; past the first difference, every grid
span that is equal at the same distance from the start or from the end still counts. Likeness
is the share of the longer text that equal spans cover, 0 to 1; 1 for equal texts.

Edge cases: null is the empty text; two empty texts have likeness 1, an empty and another 0.
Rows with null ids come last, rows with the same id in the order of their texts' hashes. With
one row, its next document is itself.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmos.llm.frames import texts

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
GRID = 16


@functools.lru_cache(maxsize=1)
def _known() -> list[np.ndarray]:
    return [np.ones(1, dtype=np.uint64) for _ in PRIMES]


def powers(n: int) -> np.ndarray:
    """BASE ** 0 to BASE ** n for both primes; kept and grown by doubling."""
    known = _known()
    while len(known[0]) <= n:
        for k, p in enumerate(PRIMES):
            step = np.uint64(pow(BASES[k], len(known[k]), p))
            known[k] = np.concatenate([known[k], known[k] * step % np.uint64(p)])
    return np.stack([k[: n + 1] for k in known])


def prefix(text: str) -> np.ndarray:
    """Prefix hashes, one row per prime and ``len(text) + 1`` columns."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    power = powers(len(code))
    out = np.zeros((len(PRIMES), len(code) + 1), dtype=np.uint64)
    for k, p in enumerate(PRIMES):
        # Below 2 ** 31 each, so sums of 2 ** 32 of them fit.
        np.cumsum(code * power[k, :-1] % np.uint64(p), out=out[k, 1:])
        out[k] %= np.uint64(p)
    return out


def spliced(a: np.ndarray, upto: int, b: np.ndarray, length: int) -> np.ndarray:
    """Prefix hashes of ``A[:upto] + B[:length]`` from those of A and B."""
    power = powers(upto)[:, upto]
    out = np.empty((len(PRIMES), upto + length + 1), dtype=np.uint64)
    out[:, : upto + 1] = a[:, : upto + 1]
    for k, p in enumerate(PRIMES):
        out[k, upto:] = (a[k, upto] + b[k, : length + 1] * power[k]) % np.uint64(p)
    return out


def equal_spans(a: np.ndarray, i: int, b: np.ndarray, j: int, length: int) -> bool:
    """Whether ``A[i:i + length] == B[j:j + length]``."""
    power = powers(max(i, j))
    for k, p in enumerate(PRIMES):
        x = (int(a[k, i + length]) - int(a[k, i])) * int(power[k, j])
        y = (int(b[k, j + length]) - int(b[k, j])) * int(power[k, i])
        if (x - y) % p:
            return False
    return True


def common_extension(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """Length of the longest common run that starts at ``A[i]`` and ``B[j]``."""
    lo, hi = 0, min(a.shape[1] - 1 - i, b.shape[1] - 1 - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if equal_spans(a, i, b, j, mid):
            lo = mid
        else:
            hi = mid - 1
    return lo


def grid(n: int) -> np.ndarray:
    """Places kept of a text of ``n`` code points: from the start, then from the end."""
    step = 1
    while n // step > GRID:
        step *= 2
    up = np.arange(0, n + 1, step)
    return np.concatenate([up, n - up, [n]])


def fingerprint(p: np.ndarray) -> str:
    """Length, then 16 hexadecimal digits for each place of its grid."""
    n = p.shape[1] - 1
    at = p[:, grid(n)]
    return f"{n:x}:" + (at[0] << np.uint64(32) | at[1]).astype(">u8").tobytes().hex()


def read(mark: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Length, places and prefix hashes of a fingerprint."""
    n, data = mark.split(":")
    words = np.frombuffer(bytes.fromhex(data), dtype=">u8").astype(np.uint64)
    return int(n, 16), grid(int(n, 16)), np.stack([words >> np.uint64(32), words & np.uint64(0xFFFFFFFF)])


def likeness(x: str, y: str) -> float:
    """Share of the longer text covered by spans that the fingerprints show to be equal."""
    if x == y:
        return 1.0
    (n, at, a), (m, bt, b) = read(x), read(y)
    if not n or not m:
        return 0.0
    step = max(int(at[1] - at[0]), int(bt[1] - bt[0])) if len(at) > 3 and len(bt) > 3 else max(n, m)
    half_a, half_b = (len(at) - 1) // 2, (len(bt) - 1) // 2
    count = min(n, m) // step
    # Places by their distance from the start, and from the end, on the coarser grid.
    sa, sb = max(1, int(at[1] - at[0]) if half_a > 1 else n), max(1, int(bt[1] - bt[0]) if half_b > 1 else m)
    steps = np.arange(count + 1)
    ia, ib = steps * (step // sa), steps * (step // sb)
    if len(ia) and (ia[-1] >= half_a or ib[-1] >= half_b):
        return 0.0
    spans = []
    # From the start: prefix hashes themselves are equal up to the first difference.
    fa, fb = a[:, ia], b[:, ib]
    same = (fa == fb).all(axis=0)
    lo, hi = 0, count
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if same[mid] else (lo, mid - 1)
    spans.append((0, lo * step))
    rest = ((fa[:, 1:] + _LIFT - fa[:, :-1]) % _MOD == (fb[:, 1:] + _LIFT - fb[:, :-1]) % _MOD).all(axis=0)
    spans += [(k * step, (k + 1) * step) for k in np.flatnonzero(rest).tolist() if k >= lo]
    # From the end: spans of the same length before places at the same distance from it, whose
    # hashes differ by the power of the texts' difference in length.
    ea, eb = a[:, half_a + ia], b[:, half_b + ib]
    shift = powers(abs(n - m))[:, abs(n - m), None]
    da, db = (ea[:, :-1] + _LIFT - ea[:, 1:]) % _MOD, (eb[:, :-1] + _LIFT - eb[:, 1:]) % _MOD
    if n < m:
        da = da * shift % _MOD
    else:
        db = db * shift % _MOD
    back = (da == db).all(axis=0)
    long = max(n, m)
    spans += [(long - (k + 1) * step, long - k * step) for k in np.flatnonzero(back).tolist()]
    covered, end = 0, 0
    for lo_, hi_ in sorted(spans):
        covered += max(0, hi_ - max(lo_, end))
        end = max(end, hi_)
    return min(1.0, covered / long)


_MOD = np.array(PRIMES, dtype=np.uint64)[:, None]
_LIFT = _MOD


def _ranges(docs: DataFrame, buckets: int) -> np.ndarray:
    """Upper ends of ``buckets`` ranges of ids with about as many rows each: that many numbers."""
    share = [i / buckets for i in range(1, buckets)]
    found = docs.select(F.percentile_approx("doc_id", share, max(10_000, 10 * buckets))).first()[0] if share else []
    return np.unique(np.array(found or [], dtype=np.int64))


def with_next(docs: DataFrame, text: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness to its neighbours.

    The next document is the one with the next smaller doc_id, after the last the first; the
    edited text has its last third replaced by as much of the start of the next document's.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ids are cut into ranges from their quantiles. Each row goes to the task of its range, the
    first row of each range also to the range before it, and a task reads its rows in order:
    one shuffle of the texts, nobody sees more than two documents at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = buckets or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ends = _ranges(rows, n)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        # Bucket 0 has the largest ids; null ids come behind the last.
        known = ids.fillna(0).astype("int64").to_numpy()
        return pd.Series(np.where(ids.isna(), len(ends) + 1, len(ends) - np.searchsorted(ends, known, side="left"))).astype("int32")

    tie = F.xxhash64("text")
    keyed = rows.select("doc_id", "text", tie.alias("tie"), bucket("doc_id").alias("bucket"))
    # One row per range: its first document, and the range before it.
    first = keyed.groupBy("bucket").agg(F.min(F.struct((-F.col("doc_id")).alias("id"), "tie")).alias("head"))
    around = Window.orderBy("bucket")
    heads = first.select(
        F.col("bucket").alias("of"), F.col("head.id").alias("head_id"), F.col("head.tie").alias("head_tie"),
        F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("previous"),
    )
    # Broadcast: one row per range, that is per shuffle partition.
    keyed = keyed.join(F.broadcast(heads), F.col("bucket") == F.col("of"), "left")
    is_head = F.coalesce((F.col("tie") == F.col("head_tie")) & (-F.col("doc_id")).eqNullSafe(F.col("head_id")), F.lit(False))
    home = F.struct(F.col("bucket").alias("to"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("previous").alias("to"), F.lit(1).alias("guest"))
    sent = keyed.select("doc_id", "text", F.explode(F.when(is_head, F.array(home, guest)).otherwise(F.array(home))).alias("s"))
    placed = sent.select("s.to", "s.guest", "doc_id", "text")
    ordered = placed.repartition(n, "to").sortWithinPartitions("to", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return ordered.mapInArrow(_walk, FINGERPRINTS)


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # bucket, doc_id, text, prefix hashes, fingerprint of the row before
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            b = batch.slice(at, 200)
            out: list[tuple] = []
            for to, guest, doc_id, text in zip(*[b.column(i).to_pylist() for i in range(3)], texts(b, "text")):
                if held is not None and held[0] == to and held[5]:
                    continue  # copies of the head that came along
                p = prefix(text)
                mark = fingerprint(p)
                if held is not None and held[0] == to:
                    out.append(_row(held, text, p, mark))
                held = (to, doc_id, text, p, mark, bool(guest))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in FINGERPRINTS.split(", ")])


def _row(held: tuple, next_text: str, next_p: np.ndarray, next_mark: str) -> tuple:
    _, doc_id, text, p, mark, _ = held
    n = len(text)
    cut = n // 3
    length = min(cut, len(next_text))
    edited = text[: n - cut] + next_text[:length]
    edited_mark = fingerprint(spliced(p, n - cut, next_p, length))
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, sha, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark)


def release() -> None:
    """What this operator keeps in a worker."""
    _known.cache_clear()
