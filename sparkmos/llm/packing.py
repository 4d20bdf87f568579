"""Packing documents into windows by non-negative least squares on the length histogram.

A document is tokenized and ends with an end id. What fills whole windows is cut off first;
the rest of each document, shorter than a window, is one piece. The histogram of these rests
(by length, rounded up to ``grain`` ids) is bounded by the window, whatever the input. All
combinations of at most three rounded lengths that fill a window exactly are enumerated, the
repeat counts that explain the histogram best are solved for (non-negative least squares),
rounded down and capped by what the histogram has, and exact combinations of what is left are
added greedily. Pieces without a place in a combination are packed greedily one after the
other and cut where a window ends, so these windows have no padding at all but the last one.

Only the histogram and the solved plan pass through the driver. Ranks and running sums are
taken within cells of about ``cell`` documents, dealt by a hash of the row, so no length,
source or group of copies makes a large group.

Edge cases: null and empty texts have the end id alone. Repeated rows and null doc_ids are
documents of their own. An empty table gives no pieces. Columns of the input other than
``doc_id`` and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmos.llm import word_bpe
from sparkmos.llm.frames import ROWS, begin, texts, vocabulary
from sparkmos.session import materialize

WINDOW = 4096
GRAIN = 16
CELL = 20_000


def combinations(units: int) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c >= 0 and a + b + c = units."""
    c, b = np.meshgrid(np.arange(units // 3 + 1), np.arange(units // 2 + 1))
    a = units - b - c
    ok = (b >= c) & (a >= b)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def nnls(combos: np.ndarray, hist: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted distance of A x and ``hist`` (Lawson-Hanson).

    Column s of A counts the lengths of combination s. Every column has at most three entries,
    so gradients are gathered, never multiplied out.
    """
    n, size = len(combos), len(hist)
    parts = combos > 0

    def column(s: np.ndarray) -> np.ndarray:
        a = np.zeros((size, len(s)))
        for k in range(3):
            np.add.at(a, (combos[s, k], np.arange(len(s))), parts[s, k])
        return a * weight[:, None]

    target = hist * weight
    x, passive = np.zeros(n), np.zeros(0, dtype=np.int64)
    scale = max(1.0, float(np.abs(target).max()))
    for _ in range(6 * size):
        rest = weight * (target - (column(passive) @ x[passive] if len(passive) else 0))
        gradient = (rest[combos] * parts).sum(axis=1)
        gradient[passive] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= 1e-7 * scale or len(passive) >= size:
            break
        passive = np.append(passive, best)
        while len(passive):
            a = column(passive)
            z = np.linalg.lstsq(a, target, rcond=None)[0] if len(passive) < 3 else np.linalg.solve(
                a.T @ a + 1e-9 * np.eye(len(passive)), a.T @ target
            )
            if z.min() > 0:
                x[passive] = z
                break
            low = z <= 0
            old = x[passive]
            step = np.min(old[low] / np.maximum(old[low] - z[low], 1e-300))
            x[passive] = old + step * (z - old)
            gone = low & (x[passive] <= 1e-9 * scale)
            if not gone.any():
                gone = low & (x[passive] == x[passive][low].min())
            x[passive[gone]] = 0
            passive = passive[~gone]
    return x


def plan(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and how often each is used; never more of a length than ``hist`` has."""
    units = len(hist) - 1
    combos = combinations(units)
    left = hist.astype(np.int64).copy()
    left[0] = 0
    # Short lengths left over are cheap to pack greedily: they weigh less.
    weight = np.where(np.arange(units + 1) * 4 >= units, 1.0, 0.3)
    combos = combos[((left[combos] > 0) | (combos == 0)).all(axis=1)]
    counts = np.zeros(len(combos), dtype=np.int64)
    if not len(combos):
        return combos, counts
    x = nnls(combos, left.astype(float), weight)

    def take(s: int, most: float) -> None:
        lengths, times = np.unique(combos[s][combos[s] > 0], return_counts=True)
        k = int(min(most, (left[lengths] // times).min()))
        if k > 0:
            counts[s] += k
            left[lengths] -= k * times

    for s in np.argsort(-x, kind="stable")[: int((x > 0).sum())]:
        take(int(s), np.floor(x[s] + 1e-6))
    for s in range(len(combos) - 1, -1, -1):
        take(s, np.inf)
    used = counts > 0
    return combos[used], counts[used]


def _tokenize(docs: DataFrame, text: str, path: str, end_id: int) -> DataFrame:
    """One row per document: uid, doc_id, ids of two or four bytes each, their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(word_bpe.__name__)
        coder = word_bpe.words(path)
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        size = np.dtype(coder.dtype).itemsize
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                made = [ids + end for ids in coder.encode(texts(b, text))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(made, pa.binary()), pa.array([len(m) // size for m in made], pa.int64())],
                    names=["uid", "doc_id", "packed", "n"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col(text).alias(text))
    return rows.mapInArrow(run, "uid long, doc_id long, packed binary, n long")


def pack(
    docs: DataFrame,
    text: str = "text",
    path: str | None = None,
    end_id: int = 2,
    window: int = WINDOW,
    grain: int = GRAIN,
    cell: int = CELL,
) -> DataFrame:
    """Pieces of the documents with their ids and places.

    Returns doc_id, start (ids of the document before the piece), length, ids (little-endian
    unsigned 32-bit integers), doc_tokens, sequence_id and offset (place in the sequence).
    """
    where = path or vocabulary("word_bpe_49k.json")
    width = 2 if word_bpe.words(where).size <= 1 << 16 else 4
    # Two passes need the ids; a copy of them is cheaper than tokenizing twice, and row numbers
    # read back from it are the same in every job and after a lost executor.
    tokens = materialize(_tokenize(docs, text, where, end_id))

    units = window // grain
    n_rows = tokens.count()
    cells = max(8, n_rows // cell)
    rest = F.col("n") % window
    lengths = tokens.select(
        "uid", "n", (F.col("n") / window).cast("long").alias("full"), rest.alias("rest"),
        F.ceil(rest / grain).cast("int").alias("unit"), F.pmod(F.xxhash64("uid"), F.lit(cells)).alias("cell"),
    )
    by_cell = materialize(lengths.groupBy("cell", "unit").agg(F.count("*").alias("docs"), F.sum("full").alias("full")))
    hist = np.zeros(units + 1, dtype=np.int64)
    full_total = 0
    for unit, docs_in, full in by_cell.groupBy("unit").agg(F.sum("docs"), F.sum("full")).collect():
        hist[unit] = docs_in
        full_total += full
    combos, counts = plan(hist)

    # Places of a length, one after the other: those of combination s start at ``first``.
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    base = np.concatenate([[0], np.cumsum(counts)])
    at = np.zeros(units + 1, dtype=np.int64)
    for s, combo in enumerate(combos.tolist()):
        for part, unit in enumerate(combo):
            if unit:
                places.setdefault(unit, []).append((int(at[unit]), int(base[s]), part, int(counts[s])))
                at[unit] += counts[s]
    combined = int(base[-1])
    starts = {u: np.array([p[0] for p in v]) for u, v in places.items()}
    values = {u: np.array([p[1:3] for p in v]) for u, v in places.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit, rank = b.column("unit").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            sequence, part = np.full(len(unit), -1, dtype=np.int64), np.zeros(len(unit), dtype=np.int32)
            for u in np.unique(unit).tolist():
                mine = np.flatnonzero((unit == u) & (rank < at[u]))
                if len(mine):
                    k = np.searchsorted(starts[u], rank[mine], side="right") - 1
                    sequence[mine] = values[u][k, 0] + rank[mine] - starts[u][k]
                    part[mine] = values[u][k, 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(part)], names=[*b.schema.names, "sequence", "part"])

    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ranks_before = F.coalesce(F.sum("docs").over(before.partitionBy("unit").orderBy("cell")), zero)
    unit_starts = by_cell.select("cell", "unit", ranks_before.alias("rank0"))
    full_cells = by_cell.groupBy("cell").agg(F.sum("full").alias("full"))
    # One row per cell: a cell is about 20,000 documents, so this window is small for any input.
    full_starts = full_cells.select("cell", F.coalesce(F.sum("full").over(before.orderBy("cell")), zero).alias("full0"))

    in_cell = Window.partitionBy("cell").orderBy("unit", "uid")
    ranked = lengths.repartition("cell").select(
        "*",
        (F.row_number().over(Window.partitionBy("cell", "unit").orderBy("uid")) - 1).cast("long").alias("rank"),
        F.coalesce(F.sum("full").over(in_cell.rowsBetween(Window.unboundedPreceding, -1)), zero).alias("full_in"),
    )
    ranked = (
        ranked.join(unit_starts, ["cell", "unit"])
        .join(full_starts, "cell")
        .select(
            "uid", "cell", "unit", "full", "rest", (F.col("rank") + F.col("rank0")).alias("rank"),
            (F.col("full_in") + F.col("full0") + combined).alias("full_sequence"),
        )
    )
    placed = materialize(
        ranked.mapInArrow(
            place,
            "uid long, cell long, unit int, full long, rest long, rank long, full_sequence long, sequence long, part int",
        )
    )

    loose = placed.where((F.col("sequence") < 0) & (F.col("rest") > 0))
    loose_cells = loose.groupBy("cell").agg(F.sum("rest").alias("rest"))
    loose_starts = loose_cells.select("cell", F.coalesce(F.sum("rest").over(before.orderBy("cell")), zero).alias("rest0"))
    loose = loose.select(
        "uid", "cell", "full", "full_sequence", F.lit(True).alias("loose"),
        F.coalesce(F.sum("rest").over(in_cell.rowsBetween(Window.unboundedPreceding, -1)), zero).alias("at"),
    ).join(loose_starts, "cell").select(
        "uid", "full", "full_sequence", "loose", F.lit(combined + full_total).cast("long").alias("sequence"), (F.col("at") + F.col("rest0")).alias("at"),
    )
    in_sequence = before.partitionBy("sequence").orderBy("part")
    fitted = placed.where(F.col("sequence") >= 0).select(
        "uid", "full", "full_sequence", F.lit(False).alias("loose"), "sequence",
        F.coalesce(F.sum("rest").over(in_sequence), zero).alias("at"),
    )
    whole = placed.where(F.col("rest") == 0).select(
        "uid", "full", "full_sequence", F.lit(False).alias("loose"), F.lit(-1).cast("long").alias("sequence"), zero.alias("at")
    )
    where_to = fitted.unionByName(loose).unionByName(whole)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if width == 2 else "<u4"
        for b in batches:
            col = {c: b.column(c).to_pylist() for c in ("doc_id", "packed", "n", "full", "full_sequence", "loose", "sequence", "at")}
            out: list[tuple] = []
            size = 0
            for doc_id, packed, n, full, first, loose_, sequence, place_ in zip(*col.values()):
                ids = np.frombuffer(packed, kind).astype("<u4")
                pieces = [(k * window, window, first + k, 0) for k in range(full)]
                start = full * window
                while start < n:
                    if loose_:
                        length = min(n - start, window - place_ % window)
                        pieces.append((start, length, sequence + place_ // window, place_ % window))
                        place_ += length
                    else:
                        length = n - start
                        pieces.append((start, length, sequence, place_))
                    start += length
                out += [(doc_id, s, m, ids[s : s + m].tobytes(), n, q, o) for s, m, q, o in pieces]
                size += n
                if size > 4_000_000:
                    yield _pieces(out)
                    out, size = [], 0
            yield _pieces(out)

    return tokens.join(where_to, "uid").mapInArrow(cut, PIECES)


PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in PIECES.split(", ")])
