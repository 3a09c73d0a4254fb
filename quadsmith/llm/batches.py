"""Frozen batches of rows, and the exchange of packed keys between them.

An operator that looks at a corpus more than once, and must know its own rows again, writes them first as frozen
batches: one Parquet row holds some megabytes of text with all columns, as an Arrow message. What it then learns about a
batch is kept in the shared folder under the batch's number and read back by the task that reads the batch, so that
texts are never shuffled.

Keys are shuffled packed: each batch sorts its distinct 64-bit keys, and sends every bucket (a range of keys) one row
with the differences of its keys and two bits a key. A key that a third of all rows hold thus arrives once from each
batch. Buckets are as many as the input asks for, so that rows are batches times buckets: nothing is done row by row in
Python, and buckets are wide (they are judged in ranges), so that rows stay few beside keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ragged, text_slices
from .common import bounded, give_back, map_batches, release, shared_dir, trim

BATCH_BYTES = 1 << 20
ROW_BITS = 20  # batches of a task, and rows of a batch, are fewer than 2**20
BUCKET_KEYS = 1_000_000
_U = np.uint64


def freeze(df: DataFrame, text_col: str = "text", size: int = BATCH_BYTES) -> DataFrame:
    """Write df as batches of about `size` bytes of text; a longer text comes alone. Columns: batch, n_bytes, data."""
    give_back(df.sparkSession)
    at = df.columns.index(text_col)

    def message(rows: list[pa.RecordBatch]) -> bytes:
        table = pa.Table.from_batches(rows).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number = TaskContext.get().partitionId() << ROW_BITS
        held: list[pa.RecordBatch] = []
        have = 0

        def row() -> pa.RecordBatch:
            nonlocal number, held, have
            made = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([have]), pa.array([message(held)], pa.large_binary()).cast(pa.binary())], names=["batch", "n_bytes", "data"])
            number, held, have = number + 1, [], 0
            return made

        for batch in batches:
            for a, b, buf, _ in text_slices(batch.column(at), size // 4):
                if have and have + len(buf) > size or held and b - a + sum(h.num_rows for h in held) >= 1 << (ROW_BITS - 1):
                    yield row()
                held.append(batch.slice(a, b - a))
                have += len(buf)
        if held:
            yield row()

    path = shared_dir(df.sparkSession)
    out = bounded(df).mapInArrow(run, "batch long, n_bytes long, data binary")
    out.write.option("parquet.block.size", 2 * size).parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def thaw(data: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks().to_batches(max_chunksize=1 << 40)[0]


def each(frozen: DataFrame, fn: Callable[[int, pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """fn(batch number, rows) for every frozen batch; it yields dicts of columns."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = thaw(data)
            if rows.num_rows:
                yield from fn(number, rows)
                trim()

    return map_batches(frozen.select("batch", "data"), run, schema)


@lru_cache(maxsize=16)
def _lows(buckets: int, bits: int) -> np.ndarray:
    """The least key of each bucket."""
    return np.array([-(-(b << bits) // buckets) for b in range(buckets)], _U)


def _places(n: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of n values each, `per` to a byte, whole bytes a row: every value's place, and the bytes' bounds by row."""
    bounds = np.append(0, np.cumsum(-(-n // per)))
    return ragged(bounds[:-1] * per, n), bounds


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the rows' bounds in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8), bounds - bounds[0]


def fold(values: np.ndarray, n: np.ndarray, bits: int) -> pa.Array:
    """Small numbers of `bits` (2 or 4) bits, n of them a row, as a binary column."""
    per = 8 // bits
    at, bounds = _places(n, per)
    wide = np.zeros(bounds[-1] * per, np.uint8)
    wide[at] = values
    data = np.zeros(bounds[-1], np.uint8)
    for k in range(per):
        data |= wide[k::per] << np.uint8(bits * k)
    return _binary(data, bounds)


def unfold(column: pa.ChunkedArray | pa.Array, n: np.ndarray, bits: int) -> np.ndarray:
    per = 8 // bits
    at, bounds = _places(n, per)
    data, have = _bytes(column)
    if not np.array_equal(have, bounds):
        raise RuntimeError("rows of other lengths than said")
    wide = np.empty(len(data) * per, np.uint8)
    for k in range(per):
        wide[k::per] = data >> np.uint8(bits * k) & np.uint8((1 << bits) - 1)
    return wide[at]


def pack_keys(number: int, keys: np.ndarray, marked: np.ndarray, many: np.ndarray, buckets: int, bits: int) -> dict:
    """Rows of one batch for the exchange: keys sorted, distinct, below 2**bits."""
    low = _lows(buckets, bits)
    cut = np.append(np.searchsorted(keys, low), len(keys))
    n = np.diff(cut)
    full = np.flatnonzero(n)
    first, n = cut[full], n[full]
    step = np.diff(keys, prepend=_U(0))
    step[first] = keys[first] - low[full]
    width = 8 if (step >> _U(32)).any() else 4
    steps = _binary(step.astype(f"<u{width}").view(np.uint8), np.append(first, len(keys)) * width)
    return {"bucket": full, "batch": np.full(len(full), number), "n": n, "keys": steps, "marks": fold(marked + 2 * many.astype(np.uint8), n, 2)}


def _keys(column: pa.ChunkedArray, n: np.ndarray) -> np.ndarray:
    """The keys of the rows of one bucket, from the bucket's start."""
    column = column.combine_chunks()
    data, bounds = _bytes(column)
    wide = np.diff(bounds) > 4 * n
    if wide.all() or not wide.any():
        step = data.view("<u8" if wide.all() else "<u4").astype(_U)
    else:
        step, long = np.empty(n.sum(), _U), np.repeat(wide, n)
        for kind, rows, own in (("<u4", ~wide, ~long), ("<u8", wide, long)):
            step[own] = _bytes(column.filter(pa.array(rows)))[0].view(kind)
    first = np.cumsum(n) - n
    total = np.cumsum(step)
    return total - np.repeat(total[first] - step[first], n)


def _judge(rows: pa.Table, many_places: int) -> pa.Table:
    """For each key of a bucket three flags: it stands at two places or more; it is marked somewhere; at more than many_places.

    A range of about BUCKET_KEYS keys at a time, so that a bucket may hold more.
    """
    n = rows.column("n").to_numpy().astype(np.int64)
    keys, marks = _keys(rows.column("keys"), n), unfold(rows.column("marks"), n, 2)
    flags = np.empty(len(keys), np.uint8)
    parts = 1 + len(keys) // BUCKET_KEYS
    part = keys // (keys.max() // _U(parts) + _U(1)) if parts > 1 else None
    for p in range(parts):
        own = np.flatnonzero(part == _U(p)) if parts > 1 else np.arange(len(keys))
        own = own[np.argsort(keys[own])]
        if len(own):
            here = keys[own]
            first = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
            mark = marks[own]
            places = np.add.reduceat(1 + (mark >> np.uint8(1)).astype(np.int64), first)
            found = (places > 1) * 1 + (np.maximum.reduceat(mark & np.uint8(1), first) > 0) * 2 + (places > many_places) * 4
            flags[own] = np.repeat(found.astype(np.uint8), np.diff(np.append(first, len(own))))
    out = pa.table({"batch": rows.column("batch"), "bucket": rows.column("bucket"), "n": rows.column("n"), "flags": fold(flags, n, 4)})
    del keys, marks, flags, part, own
    trim()
    return out


class Store:
    """Rows about batches in the shared folder, read by the tasks that work on the batch."""

    have: tuple = (None, None)  # the part read last, in the task

    def __init__(self, rows: DataFrame):
        self.folder = shared_dir(rows.sparkSession)
        rows.withColumn("part", F.shiftright("batch", ROW_BITS)).repartition("part").sortWithinPartitions("part", "batch").write.partitionBy("part").parquet(self.folder)

    def part(self, part: int):
        """The rows of one part, as `opened` has them; None for a part without any. A task reads the file of its batches once."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        if self.have[0] != part:
            self.have = (None, None)
            store, place = fs.FileSystem.from_uri(self.folder)
            place = f"{place}/part={part}"
            there = store.get_file_info(place).type != fs.FileType.NotFound
            self.have = (part, self.opened(pq.read_table(place, filesystem=store, partitioning=None)) if there else None)
        return self.have[1]

    def opened(self, rows: pa.Table):
        return rows

    def of(self, number: int) -> pa.Table:
        """The rows of one batch; those of a batch without any are None."""
        rows = self.part(number >> ROW_BITS)
        return None if rows is None else rows.filter(pa.compute.equal(rows.column("batch"), number))


class Verdicts:
    """What an exchange found, by batch."""

    def __init__(self, rows: DataFrame):
        self.store = Store(rows)

    def of(self, number: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flags of the batch's `count` keys, in order: several places, marked, many places."""
        if not count:
            return (np.zeros(0, dtype=bool),) * 3
        found = self.store.of(number).sort_by("bucket")
        flags = unfold(found.column("flags"), found.column("n").to_numpy().astype(np.int64), 4)
        out = tuple((flags >> np.uint8(k) & np.uint8(1)).astype(bool) for k in range(3))
        if len(out[0]) != count:
            raise RuntimeError(f"batch {number}: {len(out[0])} verdicts for {count} keys")
        return out


def exchange(packed: DataFrame, many_places: int = 1) -> Verdicts:
    """Bring equal keys of all batches together (rows of pack_keys) and keep each batch's verdicts."""
    return Verdicts(packed.groupBy("bucket").applyInArrow(lambda rows: _judge(rows, many_places), "batch long, bucket int, n int, flags binary"))


PACKED = "bucket int, batch long, n int, keys binary, marks binary"
