"""Nearest neighbours with randomly rotated one-bit codes.

A vector, seen from the centroid and scaled to length one, is turned by a random rotation and
kept as the signs of its coordinates, ``D`` bits, with its distance from the centroid and the
product of the turned vector with its own code. The inner product of a query with the vector
is estimated as the query's product with the code, divided by that product; the error is at
most ``EPSILON * sqrt((1 - c**2) / (c**2 (D - 1)))`` but for a vanishing share of pairs (``c``
the stored product). A vector whose distance may be, by this bound, below the k-th best found
so far, or the k-th smallest upper bound, is compared exactly, in double precision; all others
are left after their bits.

The codes of all vectors are one table, whatever their number. Queries are taken in blocks of
bounded size, each broadcast to the tasks that hold the codes; a task returns its ``k`` best
for every query of the block, and these are merged by query. Copies of one vector are spread
over tasks like any others.

Edge cases: vectors that are null, zero, empty, or hold null or non-finite components take no
part, nor do those of another length than most. Null ids take no part. Of equal distances the
smaller id comes first, also among copies. With fewer than ``k`` candidates all are returned.
Repeated ids are candidates each, except a query's own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmos.session import materialize

#: Bound of the estimate's error in standard deviations.
EPSILON = 3.0
#: Queries broadcast at a time; with their vectors a few megabytes.
BLOCK = 8192
#: Vectors estimated at a time, and pairs compared exactly at a time.
ROWS, PAIRS = 2048, 50_000


def usable(vector: str, dims: int | None = None) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    return F.coalesce(fits & (F.size(v) == dims) if dims else fits, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), dtype=np.float32)


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A random rotation, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, vector, code, length, own) of all usable vectors, and their centroid.

    ``length`` is the distance from the centroid, ``own`` the product of the turned vector and
    its code. The table is written to the shared folder.
    """
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where("vec_id IS NOT NULL")
    sized = named.where(usable("vector")).groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"))
    most = sized.orderBy(F.desc("n"), "dims").first()
    if most is None:
        empty = named.where("false").select("vec_id", "vector", *[F.lit(None).cast(t).alias(c) for c, t in CODE])
        return empty, np.zeros(0)
    dims = most.dims
    fit = named.where(usable("vector", dims)).select("vec_id", F.col("vector").cast("array<double>").alias("vector"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims), 0
        for b in batches:
            total, n = total + _matrix(b.column(0)).sum(axis=0), n + b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total), pa.array(np.full(dims, n))], names=["d", "s", "n"])

    parts = fit.select("vector").mapInArrow(sums, "d long, s double, n long").groupBy("d").agg((F.sum("s") / F.sum("n")).alias("c"))
    center = np.array([r.c for r in parts.orderBy("d").collect()])  # one number per dimension
    turn = rotation(dims)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1)) - center
            length = np.sqrt((x**2).sum(axis=1))
            y = (x / np.maximum(length, 1e-300)[:, None]) @ turn.T
            bits = np.packbits(y > 0, axis=1)
            own = np.abs(y).sum(axis=1) / np.sqrt(dims)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(length), pa.array(own)],
                names=["vec_id", "vector", "code", "length", "own"],
            )

    coded = fit.mapInArrow(code, "vec_id long, vector array<double>, code binary, length double, own double")
    return materialize(coded), center


CODE = [("code", "binary"), ("length", "double"), ("own", "double")]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` and ``b``, summed in the order of the components."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        diff = a[:, d] - b[:, d]
        total += diff * diff
    return np.sqrt(total)


def _search(queries: tuple[np.ndarray, np.ndarray], center: np.ndarray, k: int, epsilon: float):
    """A task's ``k`` best candidates for each query."""
    ids, vectors = queries
    dims = len(center)
    turn = rotation(dims)
    seen = vectors - center
    far = np.sqrt((seen**2).sum(axis=1))
    turned = ((seen / np.maximum(far, 1e-300)[:, None]) @ turn.T).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d = np.full((len(ids), k), np.inf)
        best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                own_id, x = b.column(0).to_numpy(), _matrix(b.column(1))
                bits = np.unpackbits(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(own_id), -1), axis=1, count=dims)
                sign = ((bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dims))).T
                length, own = b.column(3).to_numpy(), np.maximum(b.column(4).to_numpy(), 1e-9)
                error = epsilon * np.sqrt(np.maximum(0, 1 - own**2) / (own**2 * max(1, dims - 1))) + 1e-5
                for lo in range(0, len(ids), 256):
                    q = slice(lo, lo + 256)
                    product = (turned[q] @ sign) / own
                    other = ids[q, None] != own_id
                    sides, both = length**2 + far[q, None] ** 2, 2 * length * far[q, None]
                    low = sides - both * np.minimum(1, product + error)
                    limit = best_d[q, -1] ** 2
                    if len(own_id) > k:
                        # k vectors of this part are at least as near as the k-th smallest upper bound.
                        high = np.where(other, sides - both * np.maximum(-1, product - error), np.inf)
                        limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
                    qi, xi = np.nonzero((low <= limit[:, None] * (1 + 1e-9) + 1e-9) & other)
                    qi += lo
                    for start in range(0, len(qi), PAIRS):
                        qp, xp = qi[start : start + PAIRS], xi[start : start + PAIRS]
                        d = _exact(vectors[qp], x[xp])
                        first = np.flatnonzero(np.concatenate([[True], qp[1:] != qp[:-1]]))
                        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(qp)]):
                            j = qp[a]
                            dj = np.concatenate([best_d[j], d[a:b]])
                            ij = np.concatenate([best_id[j], own_id[xp[a:b]]])
                            top = np.lexsort((ij, dj))[:k]
                            best_d[j], best_id[j] = dj[top], ij[top]
        found = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, found.sum(axis=1))), pa.array(best_id[found]), pa.array(best_d[found])], names=["query_id", "vec_id", "score"]
        )

    return run


def search(
    indexed: DataFrame, center: np.ndarray, chosen: Column, k: int = 10, epsilon: float = EPSILON, block: int = BLOCK
) -> DataFrame:
    """The ``k`` nearest other vectors of every indexed row where ``chosen`` (of ``vec_id``) holds.

    query_id, rank from 1, vec_id, score (Euclidean distance of the original vectors).
    """
    queries = indexed.where(chosen).select("vec_id", "vector")
    count = queries.count() if len(center) else 0
    blocks = -(-count // block)
    found = None
    for i in range(blocks):
        # About ``block`` queries by hash; a few megabytes pass through the driver per block.
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow()
        ids, vectors = rows.column(0).to_numpy(), _matrix(rows.column(1))
        part = indexed.mapInArrow(_search((ids, vectors), center, k, epsilon), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return indexed.where("false").select(
            F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
