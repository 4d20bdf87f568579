"""Helpers shared by the operators: clashing names, batches of texts, tokenizer files."""

from __future__ import annotations

import gc
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Rows worked on at a time; what a worker holds besides its batch follows it.
ROWS = 500


_last: list[str] = []


def begin(module: str) -> None:
    """Called where a task of an operator begins: what other operators keep in this worker is let go.

    A worker serves the tasks of one stage after the other; only the caches of the operator at
    work should take memory. Modules with caches have a function ``release``.
    """
    if _last and _last[0] != module:
        getattr(sys.modules.get(_last[0]), "release", lambda: None)()
        gc.collect()
        pa.default_memory_pool().release_unused()
    _last[:] = [module]


class Kept:
    """Results by key, kept for reuse: ``keys`` of late, and as many before them.

    Keys that are asked for again move over to the late ones, so only rare keys are made twice.
    """

    def __init__(self, keys: int):
        self.keys, self.late, self.old = keys, {}, {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Those of ``wanted`` that must be made; the others are in ``late`` from now on."""
        if len(self.late) > self.keys:
            self.old, self.late = self.late, {}
        late, old, out = self.late, self.old, []
        for k in wanted.difference(late):
            if k in old:
                late[k] = old[k]
            else:
                out.append(k)
        return out

    def forget(self, keys: list[str], longest: int) -> None:
        """Long keys are not worth their memory."""
        for k in keys:
            if len(k) > longest:
                del self.late[k]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less every column that is named like an output: the operator's own value wins."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def with_fields(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def map_added(df: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    """``df`` with columns added by ``make(batches)``.

    ``make`` gets the Arrow batches of a task and yields, for each, the arrays of the new
    columns in the order of ``fields``. The other columns pass through untouched.
    """
    df = without(df, [f.name for f in fields])
    names = [*df.columns, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(make.__module__)
        held: list[pa.RecordBatch] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    held.append(b.slice(at, ROWS))
                    yield held[-1]

        for made in make(seen()):
            b = held.pop()
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=names)

    return df.mapInArrow(run, with_fields(df, fields))


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def text_blocks(values: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive pieces of ``values`` with about ``chars`` code points each, with their starts.

    A longer text makes a piece of its own.
    """
    start = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > chars:
            yield start, values[start:i]
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, values[start:]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; installed on every machine, never shipped with jobs."""
    import public_tokenizers

    return public_tokenizers.path(name)
