"""Quantile regression by gradient boosting over histograms, any number of models in one pass.

The features are cut at their quantiles and written once as one byte each (0: missing); nothing
wide is written again. Following Friedman's boosting for the pinball loss, every round fits a
tree to the sign of the residual (``q`` above, ``q - 1`` below the current prediction), then
sets each leaf to the ``q``-quantile of its residuals. A level of all trees of all models is one
job: tasks count, per model, node, feature and bin, the rows and those below the prediction; the
counts are added up by (model, node), where the best split is chosen, so the driver sees one row
per open node. Counts are whole numbers: the same rows give the same trees however they are
partitioned. Each split sends missing values to the side where they help more.

Predictions are the trees' sums; those of finished rounds are stored every ``checkpoint_every``
rounds, in a copy of the bytes made without a shuffle, and trees since then are run anew by the
tasks. Models may differ in label, quantile and rows (``use``: a flag per sample and group of
models), which is how cross-validation paths are trained together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmos.session import materialize

SKETCH = 10_000
#: Bytes of counts that a task holds at a time; models beyond it wait for a pass of their own.
HELD = 128_000_000
#: Rows that are worked on at a time, and rows of a task at least: counts should be small against them.
ROWS, TASK_ROWS = 4_000, 20_000


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 30
    learning_rate: float = 0.1
    max_depth: int = 6
    min_leaf: int = 30
    subsample_pct: int = 90
    max_bins: int = 64
    checkpoint_every: int = 10


def number(df: DataFrame, c: str) -> Column:
    """A column as double; true is 1, NaN is missing."""
    kind = dict(df.dtypes)[c]
    x = F.col(f"`{c}`").cast("int").cast("double") if kind == "boolean" else F.col(f"`{c}`").cast("double")
    return F.nanvl(x, F.lit(None).cast("double")) if kind in ("double", "float") else x


def numbers(df: DataFrame, features: Sequence[str]) -> Column:
    return F.array(*[number(df, c) for c in features])


def matrix(x: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column as a matrix; missing is NaN."""
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def cut_points(df: DataFrame, features: Sequence[str], max_bins: int = 64) -> list[list[float]]:
    """Per feature at most ``max_bins - 2`` ascending values that its rows are split at; one pass."""
    shares = F.array(*[F.lit(i / (max_bins - 1)) for i in range(1, max_bins - 1)])
    row = df.agg(*[F.percentile_approx(number(df, c), shares, SKETCH).alias(f"c{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(row[i] or [])) for i in range(len(features))]


@dataclass
class Tree:
    """Nodes as arrays; a leaf's feature is -1. Values at most ``threshold`` go left, missing ones by ``missing_left``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, threshold: float, missing_left: bool, gain: float, n_left: int, n_right: int) -> list[int]:
        made = [len(self.feature), len(self.feature) + 1]
        self.feature[node], self.bin[node], self.threshold[node] = feature, at, threshold
        self.missing_left[node], self.gain[node], (self.left[node], self.right[node]) = missing_left, gain, made
        self.cover[node] = n_left + n_right
        for n in (n_left, n_right):
            for column, empty in zip((self.feature, self.bin, self.threshold, self.missing_left, self.left, self.right, self.value, self.cover, self.gain), (-1, 0, 0.0, False, -1, -1, 0.0, n, 0.0)):
                column.append(empty)
        return made

    def leaf_of(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """Leaf of every row of ``x``: bins, or values with NaN for missing."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        bound = np.array(self.bin if binned else self.threshold)
        missing_left = np.array(self.missing_left)
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            v = x[rows, np.maximum(f, 0)]
            goes = np.where(v == 0 if binned else np.isnan(v), missing_left[node], v <= bound[node])
            node = np.where(inner, np.where(goes, left[node], right[node]), node)

    def predict(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(x, binned)]


@dataclass
class QuantileModel:
    quantile: float
    base: float
    learning_rate: float
    features: list[str]
    trees: list[Tree] = field(default_factory=list)

    def used(self) -> list[str]:
        return sorted({self.features[f] for t in self.trees for f in t.feature if f >= 0})

    def score(self, x: np.ndarray) -> np.ndarray:
        """Predictions for rows of all features, NaN for missing."""
        return self.base + self.learning_rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        return predict(df, {out: self})

    def gains(self) -> dict[str, float]:
        total = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[self.features[f]] += g
        return total


def narrowed(models: Sequence[QuantileModel]) -> tuple[list[str], list[QuantileModel]]:
    """The features that any tree uses, and the models over these alone: less goes to Python."""
    names = sorted({c for m in models for c in m.used()})
    at = {c: i for i, c in enumerate(names)}
    out = []
    for m in models:
        trees = [Tree([at[m.features[f]] if f >= 0 else -1 for f in t.feature], t.bin, t.threshold, t.missing_left, t.left, t.right, t.value, t.cover, t.gain) for t in m.trees]
        out.append(QuantileModel(m.quantile, m.base, m.learning_rate, names, trees))
    return names, out


def predict(df: DataFrame, models: dict[str, QuantileModel]) -> DataFrame:
    """``df`` with one prediction per model, all in one pass over the features they use."""
    names, narrow = narrowed(list(models.values()))
    if not names:
        return df.withColumns({out: F.lit(m.base) for out, m in models.items()})
    kind = "struct<" + ",".join(f"p{i}:double" for i in range(len(narrow))) + ">"

    @F.arrow_udf(kind)
    def scores(x: pa.Array) -> pa.Array:
        m = matrix(x, len(names))
        parts = [np.concatenate([one.score(m[at : at + ROWS]) for at in range(0, len(m), ROWS)] or [np.zeros(0)]) for one in narrow]
        return pa.StructArray.from_arrays([pa.array(p) for p in parts], names=[f"p{i}" for i in range(len(narrow))])

    kept = [c for c in df.columns if c not in models]
    scored = df.withColumn("_scores", scores(numbers(df, names)))
    return scored.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"_scores.p{i}").alias(out) for i, out in enumerate(models)])


def pinball(label: Column, prediction: Column, q: float) -> Column:
    diff = label - prediction
    return F.when(diff >= 0, diff * q).otherwise(diff * (q - 1.0))


@dataclass(frozen=True)
class Target:
    """What one model learns: a label's quantile, from the rows whose flag ``use`` is set (None: all)."""

    label: str
    quantile: float
    use: int | None = None


def quantised(df: DataFrame, features: Sequence[str], cuts: list[list[float]], keys: Sequence[str], labels: Sequence[str], n_models: int, use: str | None = None) -> DataFrame:
    """One row per sample: hash of its keys, a byte per feature, labels, flags and predictions (0)."""
    width, bounds = len(features), [np.array(c) for c in cuts]
    flags = F.col(use) if use else F.array().cast("array<boolean>")
    rows = df.select(
        F.xxhash64(*keys).alias("h"), numbers(df, features).alias("x"), F.array(*[F.col(c).cast("double") for c in labels]).alias("y"), flags.alias("use")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = matrix(b.column(1), width)
                bins = np.zeros(x.shape, dtype=np.uint8)
                for f, c in enumerate(bounds):
                    v = x[:, f]
                    bins[:, f] = np.where(np.isnan(v), 0, 1 + np.searchsorted(c, v, side="left"))
                flat = [row.tobytes() for row in bins]
                pred = pa.FixedSizeListArray.from_arrays(pa.array(np.zeros(len(x) * n_models)), n_models).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flat, pa.binary()), b.column(2), b.column(3), pred], names=["h", "x", "y", "use", "pred"])

    return rows.mapInArrow(run, "h long, x binary, y array<double>, use array<boolean>, pred array<double>")


@dataclass
class _State:
    """What tasks need of the models: targets, and the trees since the predictions were stored."""

    targets: list[Target]
    labels: list[str]
    width: int
    bins: int
    params: BoostParams
    pending: list[list[Tree]]

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                n = b.num_rows
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(n, self.width)
                use = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(n, -1) if len(b.column(3).flatten()) else None
                yield b, b.column(0).to_numpy(), x, matrix(b.column(2), len(self.labels)), use, matrix(b.column(4), len(self.targets))

    def current(self, m: int, x: np.ndarray, pred: np.ndarray) -> np.ndarray:
        return pred[:, m] + self.params.learning_rate * sum((t.predict(x, True) for t in self.pending[m]), np.zeros(len(x)))

    def rows_of(self, m: int, h: np.ndarray, use: np.ndarray | None, turn: int | None) -> np.ndarray:
        """Rows that model m learns from in this round: its own, thinned out by hash."""
        keep = np.ones(len(h), dtype=bool)
        if self.targets[m].use is not None:
            keep &= use[:, self.targets[m].use]
        if turn is not None and self.params.subsample_pct < 100:
            z = (h.view(np.uint64) ^ np.uint64(turn)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            keep &= (z >> np.uint64(33)) % np.uint64(100) < np.uint64(self.params.subsample_pct)
        return keep


@dataclass
class _Rows:
    """Stored rows in ``tasks`` tasks of ``TASK_ROWS`` rows or more."""

    df: DataFrame
    tasks: int


def _dealt(data: DataFrame) -> _Rows:
    tasks = max(1, data.count() // TASK_ROWS)
    return _Rows(data.coalesce(tasks), tasks)


COUNTS = "model int, node int, n binary, below binary"
SPLITS = "model int, node int, feature int, bin int, missing_left boolean, gain double, n_left long, n_right long"


def _counts(state: _State, growing: dict[int, Tree], open_nodes: dict[int, list[int]], turn: int):
    """Task: counts of rows, and of rows below the prediction, per model, open node, feature and bin."""
    size = state.width * state.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {m: np.zeros(len(nodes) * size, dtype=np.int32) for m, nodes in open_nodes.items()}
        low = {m: np.zeros(len(nodes) * size, dtype=np.int32) for m, nodes in open_nodes.items()}
        offset = (np.arange(state.width) * state.bins).astype(np.int32)
        for _, h, x, y, use, pred in state.batches(batches):
            places = x + offset
            for m, nodes in open_nodes.items():
                rows = state.rows_of(m, h, use, turn)
                slot = np.full(len(growing[m].feature), -1, dtype=np.int32)
                slot[nodes] = np.arange(len(nodes))
                mine = slot[growing[m].leaf_of(x, True)]
                rows &= mine >= 0
                below = y[:, state.labels.index(state.targets[m].label)] < state.current(m, x, pred)
                for total, chosen in ((n[m], rows), (low[m], rows & below)):
                    at = places[chosen] + (mine[chosen] * size)[:, None]
                    total += np.bincount(at.ravel(), minlength=len(total)).astype(np.int32)
        for m, nodes in open_nodes.items():
            a, b = n[m].reshape(len(nodes), size), low[m].reshape(len(nodes), size)
            some = np.flatnonzero(a.any(axis=1))
            made = [(m, nodes[i], a[i].tobytes(), b[i].tobytes()) for i in some]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["model", "node", "n", "below"])

    return run


def best_splits(n: np.ndarray, below: np.ndarray, q: float, min_leaf: int) -> np.ndarray:
    """Per feature the best (gain, bin, missing_left, n_left); gain -1 without one. ``n`` is features x bins."""
    g = q * n - below
    total, whole = n.sum(axis=1)[:, None], g.sum(axis=1)[:, None]
    n_right, g_right = np.cumsum(n[:, 1:], axis=1), np.cumsum(g[:, 1:], axis=1)
    # Left sides with missing values on the right, and on the left.
    sides = [(n_right, g_right), (n_right + n[:, :1], g_right + g[:, :1])]
    gains = []
    for nl, gl in sides:
        nr, gr = total - nl, whole - gl
        ok = (nl >= max(1, min_leaf)) & (nr >= max(1, min_leaf))
        with np.errstate(divide="ignore", invalid="ignore"):
            gains.append(np.where(ok, gl * gl / nl + gr * gr / nr - whole * whole / total, -1.0))
    both = np.stack(gains, axis=2)
    flat = both.reshape(len(n), -1)
    at = flat.argmax(axis=1)
    rows = np.arange(len(n))
    b, side = at // 2, at % 2
    nl = np.where(side == 1, sides[1][0][rows, b], sides[0][0][rows, b])
    # Nothing was missing: should it be one day, it goes with the many.
    side = np.where(n[:, 0] == 0, 2 * nl >= total[:, 0], side == 1)
    return np.stack([flat[rows, at], b + 1, side, nl], axis=1)


def _summed(state: _State, finish):
    """Task: adds up the counts of each (model, node), which come together, and hands them to ``finish``."""
    shape = (state.width, state.bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, low = None, None, None
        for b in batches:
            for m, node, a, c in zip(*[x.to_pylist() for x in b.columns]):
                if (m, node) != key:
                    if key is not None:
                        yield finish(key, n.reshape(shape), low.reshape(shape))
                    key, n, low = (m, node), np.zeros(shape[0] * shape[1], np.int64), np.zeros(shape[0] * shape[1], np.int64)
                n += np.frombuffer(a, np.int32)
                low += np.frombuffer(c, np.int32)
        if key is not None:
            yield finish(key, n.reshape(shape), low.reshape(shape))

    return run


def _gathered(data: _Rows, state: _State, growing: dict[int, Tree], open_nodes: dict[int, list[int]], turn: int, finish, schema: str) -> list:
    """``finish`` over the summed counts of each open node: its rows come back."""
    counts, summed = _counts(state, growing, open_nodes, turn), _summed(state, finish)
    if data.tasks == 1:
        # One task has all counts already, in the order of its models and nodes.
        return data.df.mapInArrow(lambda batches: summed(counts(batches)), schema).collect()
    made = data.df.mapInArrow(counts, COUNTS)
    return made.repartition(F.col("model"), F.col("node")).sortWithinPartitions("model", "node").mapInArrow(summed, schema).collect()


def _level(data: _Rows, state: _State, growing: dict[int, Tree], open_nodes: dict[int, list[int]], turn: int) -> list:
    """The best split of every open node; one row per node comes back."""

    def choose(key: tuple[int, int], n: np.ndarray, below: np.ndarray) -> pa.RecordBatch:
        m, node = key
        found = best_splits(n, below, state.targets[m].quantile, state.params.min_leaf)
        f = int(found[:, 0].argmax())
        gain, at, side, nl = found[f].tolist()
        row = (m, node, f if gain > 1e-9 else -1, int(at), bool(side), gain, int(nl), int(n[f].sum() - nl))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in SPLITS.split(", ")])

    out, part, held = [], {}, 0
    for m, nodes in [*open_nodes.items(), (None, None)]:
        size = 8 * state.width * state.bins * len(nodes) if nodes else 0
        if part and (m is None or held + size > HELD):
            out += _gathered(data, state, growing, part, turn, choose, SPLITS)
            part, held = {}, 0
        if m is not None:
            part[m] = nodes
            held += size
    return out


def _leaf_values(data: _Rows, state: _State, growing: dict[int, Tree], turn: int | None) -> dict[tuple[int, int], float]:
    """The quantile of the residuals in every leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, x, y, use, pred in state.batches(batches):
            for m, tree in growing.items():
                rows = state.rows_of(m, h, use, turn)
                left = (y[:, state.labels.index(state.targets[m].label)] - state.current(m, x, pred))[rows]
                leaf = tree.leaf_of(x, True)[rows].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), m, np.int32)), pa.array(leaf), pa.array(left)], names=["model", "leaf", "left"])

    shares = sorted({t.quantile for t in state.targets})
    found = data.df.mapInArrow(run, "model int, leaf int, left double").groupBy("model", "leaf").agg(F.percentile_approx("left", F.array(*map(F.lit, shares)), SKETCH).alias("v"))
    return {(r.model, r.leaf): float(r.v[shares.index(state.targets[r.model].quantile)]) for r in found.collect()}


def _stored(data: _Rows, state: _State) -> _Rows:
    """The rows with the pending trees added to their predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, x, _, _, pred in state.batches(batches):
            now = np.stack([state.current(m, x, pred) for m in range(len(state.targets))], axis=1)
            column = pa.FixedSizeListArray.from_arrays(pa.array(now.ravel()), now.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], column], names=b.schema.names)

    return _dealt(materialize(data.df.mapInArrow(run, data.df.schema)))


def fit_models(
    df: DataFrame, features: Sequence[str], targets: Sequence[Target], keys: Sequence[str], params: BoostParams = BoostParams(), use: str | None = None
) -> list[QuantileModel]:
    """All models at once. ``keys`` identify a row; subsampling hashes them, so it is repeatable.

    ``use`` names a column of flags (array of booleans) that ``Target.use`` points into.
    """
    features, targets = list(features), list(targets)
    labels = sorted({t.label for t in targets})
    cuts = cut_points(df, features, params.max_bins)
    data = _dealt(materialize(quantised(df, features, cuts, keys, labels, len(targets), use)))
    state = _State(targets, labels, len(features), params.max_bins, params, [[] for _ in targets])
    whole = {m: Tree() for m in range(len(targets))}
    bases = _leaf_values(data, state, whole, None)
    models = [QuantileModel(t.quantile, bases.get((m, 0), 0.0), params.learning_rate, features) for m, t in enumerate(targets)]
    # A tree of one leaf stands for the base until predictions are stored.
    for m, model in enumerate(models):
        state.pending[m].append(Tree(value=[model.base / params.learning_rate]))
    for turn in range(params.rounds):
        growing = {m: Tree() for m in range(len(targets))}
        open_nodes = {m: [0] for m in growing}
        for _ in range(params.max_depth):
            if not open_nodes:
                break
            split = [r for r in _level(data, state, growing, open_nodes, turn) if r.feature >= 0]
            open_nodes = {}
            for r in sorted(split, key=lambda r: (r.model, r.node)):
                at = cuts[r.feature][r.bin - 1] if r.bin <= len(cuts[r.feature]) else float("inf")
                made = growing[r.model].split(r.node, r.feature, r.bin, at, r.missing_left, r.gain, r.n_left, r.n_right)
                # A side too small to be split again needs no counts.
                room = [c for c in made if growing[r.model].cover[c] >= 2 * params.min_leaf]
                if room:
                    open_nodes.setdefault(r.model, []).extend(room)
        values = _leaf_values(data, state, growing, turn)
        for m, tree in growing.items():
            tree.value = [values.get((m, i), 0.0) if f < 0 else 0.0 for i, f in enumerate(tree.feature)]
            models[m].trees.append(tree)
            state.pending[m].append(tree)
        if (turn + 1) % params.checkpoint_every == 0 and turn + 1 < params.rounds:
            data = _stored(data, state)
            state.pending = [[] for _ in targets]
    return models


def fit_quantile(df: DataFrame, features: Sequence[str], label: str, q: float, keys: Sequence[str], params: BoostParams = BoostParams()) -> QuantileModel:
    return fit_models(df, features, [Target(label, q)], keys, params)[0]


NODE = "target string, quantile double, base double, learning_rate double, tree int, node int, feature string, threshold double, missing_left boolean, left int, right int, value double, cover long, gain double"


@dataclass
class BiasModel:
    """Six quantile models (u and v at three quantiles) over the same features."""

    features: list[str]
    models: dict[tuple[str, float], QuantileModel]

    def predict(self, df: DataFrame) -> DataFrame:
        return predict(df, {f"bias_{t}_q{round(q * 100):02d}": m for (t, q), m in self.models.items()})

    def save(self, spark: SparkSession, path: str) -> None:
        """A table of nodes, and the features in order."""
        rows = []
        for (t, q), m in self.models.items():
            rows.append((t, q, m.base, m.learning_rate, -1, 0, None, None, None, None, None, None, None, None))
            for k, tree in enumerate(m.trees):
                for i, f in enumerate(tree.feature):
                    rows.append((t, q, m.base, m.learning_rate, k, i, m.features[f] if f >= 0 else None, tree.threshold[i], tree.missing_left[i], tree.left[i], tree.right[i], float(tree.value[i]), int(tree.cover[i]), float(tree.gain[i])))
        spark.createDataFrame(rows, NODE).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps({"features": self.features}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BiasModel:
        features = json.loads(spark.read.text(f"{path}/features").first()[0])["features"]
        at = {c: i for i, c in enumerate(features)}
        models: dict[tuple[str, float], QuantileModel] = {}
        # As many rows as the models have nodes.
        rows = spark.read.schema(NODE).parquet(f"{path}/nodes").collect()
        for r in sorted(rows, key=lambda r: (r.target, r.quantile, r.tree, r.node)):
            m = models.setdefault((r.target, r.quantile), QuantileModel(r.quantile, r.base, r.learning_rate, features))
            if r.tree < 0:
                continue
            if r.node == 0:
                m.trees.append(Tree([], [], [], [], [], [], [], [], []))
            t = m.trees[-1]
            f = at[r.feature] if r.feature is not None else -1
            for column, v in zip((t.feature, t.bin, t.threshold, t.missing_left, t.left, t.right, t.value, t.cover, t.gain), (f, 0, r.threshold, r.missing_left, r.left, r.right, r.value, r.cover, r.gain)):
                column.append(v)
        return cls(features, models)


def fit_bias(
    training: DataFrame, features: Sequence[str], quantiles: Sequence[float], keys: Sequence[str], params: BoostParams = BoostParams()
) -> BiasModel:
    """Fit u and v at every quantile, all together."""
    targets = [Target(label, q) for label in ("target_u", "target_v") for q in quantiles]
    models = fit_models(training, features, targets, keys, params)
    return BiasModel(list(features), {(t.label[-1], t.quantile): m for t, m in zip(targets, models)})


def first_gains(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], params: BoostParams = BoostParams()) -> dict[str, float]:
    """How much one split on each feature alone takes off the median's loss gradient: one pass for all features."""
    features = list(features)
    cuts = cut_points(df, features, params.max_bins)
    data = _dealt(materialize(quantised(df, features, cuts, keys, [label], 1)))
    whole = BoostParams(min_leaf=params.min_leaf, max_bins=params.max_bins, subsample_pct=100)
    state = _State([Target(label, 0.5)], [label], len(features), params.max_bins, whole, [[]])
    base = _leaf_values(data, state, {0: Tree()}, None).get((0, 0), 0.0)
    state.pending[0].append(Tree(value=[base / whole.learning_rate]))

    def every(key: tuple[int, int], n: np.ndarray, below: np.ndarray) -> pa.RecordBatch:
        gain = np.maximum(best_splits(n, below, 0.5, whole.min_leaf)[:, 0], 0.0)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(gain), dtype=np.int32)), pa.array(gain)], names=["feature", "gain"])

    rows = _gathered(data, state, {0: Tree()}, {0: [0]}, 0, every, "feature int, gain double")
    found = {r.feature: r.gain for r in rows}
    return {c: found.get(i, 0.0) for i, c in enumerate(features)}


#: Fewer samples than this say nothing about features.
MIN_DISCOVERY = 100


def ranked_features(
    training: DataFrame, features: Sequence[str], label: str = "target_u", keys: Sequence[str] = ("point_id", "valid_time"), params: BoostParams = BoostParams(rounds=10)
) -> list[tuple[str, float, float]]:
    """(feature, share of a boosted median model's gain, gain of a single split on it), best first, all of them.

    Empty below ``MIN_DISCOVERY`` samples.
    """
    training = materialize(training.select(*dict.fromkeys([*keys, label, *features])).where(F.col(label).isNotNull()))
    if training.count() < MIN_DISCOVERY:
        return []
    gains = fit_quantile(training, features, label, 0.5, list(keys), params).gains()
    alone = first_gains(training, features, label, list(keys), params)
    total = sum(gains.values()) or 1.0
    return sorted(((c, gains[c] / total, alone[c]) for c in features), key=lambda r: (-r[1], -r[2], r[0]))


def discover_features(training: DataFrame, features: Sequence[str], top_n: int = 50, threshold: float = 0.001, **options) -> list[str]:
    return [c for c, share, _ in ranked_features(training, features, **options)[:top_n] if share > threshold]
