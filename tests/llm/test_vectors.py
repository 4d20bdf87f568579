"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmos.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, code string, rank int"


def rows_of(x, ids=None):
    return [(int(i), [float(v) for v in r], "c", 1) for i, r in zip(ids if ids is not None else range(len(x)), x)]


def brute_force(rows, every, k=10):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None]
    out = {}
    for q, x in ok:
        if q % every == 0:
            d = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q)
            out[q] = [i for _, i in d[:k]]
    return out


def found(spark, rows, every, block=8192):
    indexed, center = ann.index(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {}
    for r in ann.search(indexed, center, F.col("vec_id") % every == 0, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


@pytest.mark.parametrize("kind", ["uniform", "clusters"])
def test_recall(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    if kind == "clusters":
        x = rng.standard_normal((20, 64))[rng.integers(0, 20, 3000)] * 3 + 0.1 * x
    want, got = brute_force(rows_of(x), 50), found(spark, rows_of(x), 50, block=20)
    hits = sum(len(set(want[q]) & set(got[q])) for q in want)
    assert got.keys() == want.keys() and hits >= 0.99 * sum(map(len, want.values()))


def test_ties_and_copies(spark):
    x = np.vstack([np.tile([1.0, 2, 3, 4], (500, 1)), np.eye(4)])
    got = found(spark, rows_of(x), 100)
    assert got[0] == list(range(1, 11)) and got[100] == list(range(10))


def test_edges(spark):
    rows = rows_of(np.random.default_rng(3).standard_normal((5, 8)))
    odd = [(100, None, "c", 1), (200, [], "c", 1), (300, [0.0] * 8, "c", 1), (400, [1.0] * 7 + [None], "c", 1), (500, [1.0] * 7 + [float("nan")], "c", 1)]
    odd += [(600, [1.0] * 7 + [float("inf")], "c", 1), (700, [1.0] * 3, "c", 1), (None, [1.0] * 8, "c", 1)]
    got = found(spark, rows + odd, 100)
    assert got == brute_force(rows, 100) and len(got[0]) == 4
    assert found(spark, odd[:3], 100) == {}
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.search(*ann.index(empty), F.lit(True)).count() == 0


def test_the_bound_holds():
    """Estimates of inner products are off by more than the bound in hardly any pair."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x @ ann.rotation(64).T
    code = np.sign(y) / 8
    own = (y * code).sum(axis=1)
    error = np.abs(y @ code.T / own - y @ y.T)
    assert (error > ann.EPSILON * np.sqrt((1 - own**2) / (own**2 * 63))).mean() < 0.01
