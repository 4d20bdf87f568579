"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

1. Every text gets the set of its word shingles and a sketch of ``bands * rows`` coordinates
   (``sketch.sketch``). Texts with the same set are one class, of which one row goes on.
2. Classes that agree in all rows of a band meet in that band's bucket. There are as many bands
   as the threshold needs (``bands_for``): two sets just as similar as it miss each other in all
   bands at most once in a million times.
3. Each bucket's hub, the member that meets most others over all its bands, is compared with
   the members on the full sets; linked ones become one component. In a group of copies that
   settles nearly all members with one comparison each.
4. What is left are buckets with members of several components. All pairs across components
   are compared on the full sets, inside tasks that hold at most ``BLOCK`` members on either
   side, each pair in the first band it shares. A task returns only links that join
   components, fewer than it has members; pairs are never written out.
5. Components are labelled by alternating large and small stars, which shrinks chains
   exponentially and keeps no group in one task.

Nothing is capped: a bucket of any size is cut into blocks, and every candidate is compared.

Rows are numbered once and written with their numbers; every pass reads that copy, because a
number computed anew follows the splits, and they follow the cores there are at that moment.

Edge cases: null and empty texts, and texts of separators, have the empty set; they are linked
with nothing and kept. Texts shorter than a shingle have their whole word sequence as one.
Repeated rows are exact copies; of rows with the same id the first read is kept. Null ids are
documents of their own, and name a component only if it has no other id (then null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmos.llm import sketch
from sparkmos.llm.frames import ROWS as BATCH
from sparkmos.llm.frames import begin, free_name, text_blocks, texts
from sparkmos.session import materialize

ROWS = 5
#: How often two sets at the threshold may miss each other in all bands.
MISS = 1e-6
BLOCK = 512
#: Bits of the filter that spares a second shingling to documents without any candidate.
FILTER_BITS = 22


def bands_for(percent: int, rows: int = ROWS) -> int:
    """The fewest bands in which sets of that similarity miss each other at most ``MISS`` of the time."""
    met = (percent / 100) ** rows
    return max(1, math.ceil(math.log(MISS) / math.log1p(-met))) if met < 1 else 1


def _numbered(docs: DataFrame, text: str) -> DataFrame:
    """A stored copy with uid, doc_id and text."""
    own = (F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(docs.select(F.monotonically_increasing_id().alias("uid"), *own))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            part = b.slice(at, BATCH)
            for first, block in text_blocks(texts(part, "text"), 1_000_000):
                yield part.slice(first, len(block)), [v.encode("utf-8", "surrogatepass") for v in block]


def signatures(numbered: DataFrame, words: int = 5, bands: int = bands_for(85), rows: int = ROWS) -> DataFrame:
    """uid, doc_id, n_shingles, two keys of the whole set, and one hash per band, from uid, doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(__name__)
        for part, values in _blocks(batches):
            h, n = sketch.shingles(values, words)
            k1, k2 = sketch.set_keys(h, n)
            keys = sketch.bands(sketch.sketch(h, n, bands * rows), rows)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n), pa.array(k1), pa.array(k2), flat],
                names=["uid", "doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return numbered.mapInArrow(run, "uid long, doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def _sets(numbered: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """uid and sorted shingle hashes of the ``wanted`` rows.

    A filter of fixed size goes to the tasks first, so that hardly any other document is
    shingled again or shuffled; the join makes it exact.
    """
    slot = F.pmod(F.xxhash64("uid"), F.lit(1 << FILTER_BITS)).cast("int").alias("slot")
    hits = wanted.select(slot).distinct().toArrow().column(0).to_numpy()  # at most 2 ** FILTER_BITS rows
    marked = np.zeros(1 << FILTER_BITS, dtype=bool)
    marked[hits] = True
    packed = np.packbits(marked).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(__name__)
        mask = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)

        def chosen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(mask[b.column(2).to_numpy()]))

        for part, values in _blocks(chosen()):
            h, n = sketch.shingles(values, words)
            ends = np.cumsum(n)
            data = [h[e - m : e].tobytes() for e, m in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["uid", "items"])

    slotted = numbered.select("uid", "text", slot)
    return slotted.mapInArrow(run, "uid long, items binary").join(wanted.select("uid"), "uid", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node it is joined with.

    Alternating large and small stars, each a minimum per node and a join; stops when a round
    changes nothing.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = materialize(pairs)

    def fingerprint(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = fingerprint(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.where("u <> v").distinct())
        after = fingerprint(pairs)
        if after == before:
            break
        before = after
    tops = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops).distinct()


def _hub_links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members and the hubs of their buckets, compared on the full sets."""
    sizes = buckets.groupBy("band", "key").agg(F.count("*").alias("size"))
    degree = buckets.join(sizes, ["band", "key"]).groupBy("uid").agg(F.sum("size").alias("degree"))
    ranked = F.struct(F.col("degree"), (-F.col("uid")).alias("first"))
    hubs = buckets.join(degree, "uid").groupBy("band", "key").agg((-F.max(ranked)["first"]).alias("hub"))
    pairs = buckets.join(hubs, ["band", "key"]).where("uid <> hub").select(F.col("uid").alias("a"), F.col("hub").alias("b")).distinct()
    rows = pairs.join(sets.select(F.col("uid").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("uid").alias("b"), F.col("items").alias("y")), "b"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(__name__)
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _cross_links(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links that join components, from buckets with members of several.

    ``members``: band, key, uid, label, bands. In each bucket the members outside its largest
    component (side 0) are compared with all members (side 1), block by block.
    """
    by_label = members.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    largest = by_label.groupBy("band", "key").agg(
        F.max(F.struct("n", "label"))["label"].alias("top"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("others")
    )
    open_ = members.join(largest.where("others > 0"), ["band", "key"])
    count_a = F.ceil(F.col("others") / block).cast("int")
    count_b = F.ceil(F.col("all") / block).cast("int")
    own_a = F.pmod(F.xxhash64("uid"), count_a).cast("int")
    own_b = F.pmod(F.xxhash64("uid"), count_b).cast("int")
    side_a = open_.where(F.col("label") != F.col("top")).select(
        "band", "key", "uid", "label", "bands", F.lit(0).alias("side"), own_a.alias("i"), F.explode(F.sequence(F.lit(0), count_b - 1)).alias("j")
    )
    side_b = open_.select(
        "band", "key", "uid", "label", "bands", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), count_a - 1)).alias("i"), own_b.alias("j")
    )
    rows = side_a.unionByName(side_b).join(sets, "uid")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        band = int(pdf.band.iloc[0])
        ka, kb = np.stack(a.bands.to_numpy()), np.stack(b.bands.to_numpy())
        la, lb = a.label.to_numpy(), b.label.to_numpy()
        allowed = la[:, None] != lb[None, :]
        for k in range(band):  # met in an earlier band
            allowed &= ka[:, k][:, None] != kb[:, k][None, :]
        x = [np.frombuffer(v, np.uint64) for v in a["items"]]
        y = [np.frombuffer(v, np.uint64) for v in b["items"]]
        found = sketch.links(x, y, allowed, percent, (la, lb))
        ua, ub = a.uid.to_numpy(), b.uid.to_numpy()
        return pd.DataFrame({"a": [ua[i] for i, _ in found], "b": [ub[j] for _, j in found]}, dtype=np.int64)

    return rows.groupBy("band", "key", "i", "j").applyInPandas(compare, "a long, b long")


def groups(
    docs: DataFrame,
    text: str = "text",
    percent: int = 85,
    words: int = 5,
    bands: int | None = None,
    rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: uid, doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Documents are linked if ``100 * common >= percent * union`` of their shingle sets. ``kept``
    is true for one row of each component: the one with the smallest doc_id. ``bands`` is
    ``bands_for(percent, rows)`` if it is not given.
    """
    return _grouped(_numbered(docs, text), percent, words, bands or bands_for(percent, rows), rows, block)


def _grouped(numbered: DataFrame, percent: int, words: int, bands: int, rows: int, block: int) -> DataFrame:
    """``groups`` of a stored table of uid, doc_id and text."""
    signed = materialize(signatures(numbered, words, bands, rows))
    filled = signed.where("n_shingles > 0")
    classes = filled.groupBy("k1", "k2", "n_shingles").agg(F.min("uid").alias("class"))
    reps = classes.select(F.col("class").alias("uid")).join(filled, "uid")
    entries = reps.select("uid", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1").select("band", "key")
    buckets = materialize(entries.join(shared, ["band", "key"]))
    sets = materialize(_sets(numbered, buckets.select("uid").distinct(), words))

    hub_links = materialize(_hub_links(buckets, sets, percent))
    first = materialize(components(hub_links))
    labelled = buckets.join(first.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    members = labelled.join(reps.select("uid", "bands"), "uid")
    cross_links = _cross_links(members, sets, percent, block)
    label_of = first.select(F.col("node").alias("uid"), "label")

    def lifted(df: DataFrame, side: str) -> DataFrame:
        own = label_of.select(F.col("uid").alias(side), F.col("label").alias(f"{side}_label"))
        return df.join(own, side, "left").withColumn(side, F.coalesce(f"{side}_label", side)).drop(f"{side}_label")

    second = components(lifted(lifted(cross_links, "a"), "b"))
    top = label_of.join(second.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select(
        "uid", F.coalesce("top", "label").alias("component")
    )
    alone = second.join(label_of.select(F.col("uid").alias("node")), "node", "left_anti").select(
        F.col("node").alias("uid"), F.col("label").alias("component")
    )
    of_class = top.unionByName(alone).distinct()

    rows_ = signed.select("uid", "doc_id", "n_shingles", "k1", "k2")
    named = rows_.join(classes, ["k1", "k2", "n_shingles"], "left").withColumn("class", F.coalesce("class", "uid"))
    named = named.join(of_class.withColumnRenamed("uid", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    heads = named.groupBy("component").agg(
        F.min("doc_id").alias("component_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))["uid"].alias("head"),
    )
    return named.join(heads, "component").select(
        "uid", "doc_id", "n_shingles", "component_id", (F.col("uid") == F.col("head")).alias("kept")
    )


def deduplicate(docs: DataFrame, text: str = "text", percent: int = 85, words: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate group; same conditions as ``groups``."""
    columns = [docs[f"`{c}`"] for c in docs.columns]
    row = free_name(docs, "__row")
    stored = materialize(docs.select(F.monotonically_increasing_id().alias(row), *columns))
    own = stored.select(F.col(row).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = _grouped(own, percent, words, bands_for(percent), ROWS, BLOCK)
    gone = named.where(~F.col("kept")).select(F.col("uid").alias(row))
    return stored.join(gone, row, "left_anti").drop(row)
