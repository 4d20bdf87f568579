"""Which features moved a prediction: path-dependent Shapley values of the trees.

A tree without some of its features is read as the mean over their splits, weighted by the
training rows on either side. Per leaf, a feature on its path then gives a factor: 1 or 0 (does
the row pass its splits) when the feature is known, the share of rows that pass when it is not.
The Shapley value sums over all sets of known features; per leaf that sum is a weighted read of
the coefficients of the product of (share + passes * y) over the path's other features, so it
takes as many steps as the path has features, squared, and no enumeration. Values add up to the
prediction less the model's expected value.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos.operators.quantile_boost import ROWS, QuantileModel, Tree, matrix, narrowed, numbers


def leaf_paths(tree: Tree) -> list[tuple[int, list[tuple[int, bool]]]]:
    """(leaf, [(node, goes left)]) for every leaf."""
    out, stack = [], [(0, [])]
    while stack:
        node, path = stack.pop()
        if tree.feature[node] < 0:
            out.append((node, path))
        else:
            stack += [(tree.right[node], [*path, (node, False)]), (tree.left[node], [*path, (node, True)])]
    return out


def _share(tree: Tree, node: int, left: bool) -> float:
    """Part of a node's training rows that goes to one side."""
    return tree.cover[tree.left[node] if left else tree.right[node]] / tree.cover[node]


def expected(model: QuantileModel) -> float:
    """The prediction when no feature is known."""
    total = 0.0
    for tree in model.trees:
        for leaf, path in leaf_paths(tree):
            total += tree.value[leaf] * float(np.prod([_share(tree, n, left) for n, left in path]))
    return model.base + model.learning_rate * total


def shapley(model: QuantileModel, x: np.ndarray) -> np.ndarray:
    """Rows x features: contributions to the predictions of ``x`` (NaN for missing)."""
    out = np.zeros((len(x), len(model.features)))
    for tree in model.trees:
        f = np.array(tree.feature)
        v = x[:, np.maximum(f, 0)]
        goes_left = np.where(np.isnan(v), np.array(tree.missing_left), v <= np.array(tree.threshold))
        for leaf, path in leaf_paths(tree):
            value = model.learning_rate * tree.value[leaf]
            if not path or not value:
                continue
            passes: dict[int, np.ndarray] = {}
            share: dict[int, float] = {}
            for node, left in path:
                j = tree.feature[node]
                ok = goes_left[:, node] == left
                passes[j] = passes[j] & ok if j in passes else ok
                share[j] = share.get(j, 1.0) * _share(tree, node, left)
            m = len(passes)
            product = np.zeros((m + 1, len(x)))  # coefficients of the product over all features
            product[0] = 1.0
            for k, j in enumerate(passes):
                product[1 : k + 2] = product[1 : k + 2] * share[j] + product[: k + 1] * passes[j]
                product[0] *= share[j]
            for j, o in passes.items():
                z = share[j]
                # The product without j: divided from the top where j passes, by its share where not.
                down, flat = 0.0, 0.0
                total = np.zeros(len(x))
                for k in range(m - 1, -1, -1):
                    down = product[k + 1] - z * down
                    flat = product[k] / z
                    total += factorial(k) * factorial(m - 1 - k) / factorial(m) * np.where(o, down, flat)
                out[:, j] += value * (o - z) * total
    return out


def contributions(df: DataFrame, model: QuantileModel) -> tuple[Column, list[str]]:
    """A column of one contribution per feature that the model uses, and those features."""
    names, (narrow,) = narrowed([model])

    @F.arrow_udf("array<double>")
    def values(x: pa.Array) -> pa.Array:
        m = matrix(x, len(names))
        parts = [shapley(narrow, m[at : at + ROWS]) for at in range(0, len(m), ROWS)]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * len(names)), pa.array(flat))

    return values(numbers(df, names)) if names else F.array().cast("array<double>"), names


def top_contributors(values: Column, names: Sequence[str], n: int = 5) -> Column:
    """The largest contributions by size as (feature, value), tiny ones left out."""
    named = F.transform(
        F.arrays_zip(F.array(*[F.lit(x) for x in names]).alias("name"), values.alias("value")),
        lambda p: F.struct((-F.abs(p["value"])).alias("k"), p["name"].alias("feature"), F.round(p["value"], 3).alias("value")),
    )
    large = F.filter(named, lambda p: p["k"] < -1e-6)
    return F.transform(F.slice(F.array_sort(large), 1, n), lambda p: F.struct(p["feature"], p["value"]))


def explain(df: DataFrame, model: QuantileModel, n: int = 5) -> DataFrame:
    """``df`` plus ``contributions`` (feature to value) and the largest of them, ``top_contributors``."""
    values, names = contributions(df, model)
    if not names:
        none = F.array().cast("array<struct<feature:string,value:double>>")
        return df.withColumn("contributions", F.create_map().cast("map<string,double>")).withColumn("top_contributors", none)
    raw = df.withColumn("_c", values)
    named = F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.col("_c"))
    return raw.withColumn("contributions", named).withColumn("top_contributors", top_contributors(F.col("_c"), names, n)).drop("_c")
