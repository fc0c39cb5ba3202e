"""Rows written once, in blocks that stay where they are, and small messages that go to the blocks.

A block is one row: its number, and a bounded number of rows of the table as a compressed Arrow stream. The blocks are a table
bucketed by number, and a block's number is chosen so that all blocks of a writing task fall into a few buckets; so writing needs no
shuffle and gives a few files a task. A join of blocks with messages (block, ...) by number then shuffles the messages only, however
many there are. A row is named by its block and its place there: row = block << PLACE_BITS | place.
"""

from __future__ import annotations

import atexit
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ratingmill.llm.common import _remove, partitions, plain, release, shared_dir, tune

BLOCK_BYTES = 2 << 20
PLACE_BITS = 16
MOST_ROWS = 1 << PLACE_BITS
#: Bits of a block's number that its task has for itself.
OWN_BITS = 23
#: Buckets that a task writes.
SPREAD = 8


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def bucket_of(number: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket to which Spark deals longs: its 32-bit Murmur hash with seed 42, modulo the number of buckets."""
    v, h = np.asarray(number, np.int64).view(np.uint64), np.full(len(number), 42, np.uint32)
    for half in (v & np.uint64(0xFFFFFFFF), v >> np.uint64(32)):
        k = _rotate(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = _rotate(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    h ^= h >> np.uint32(16)
    return h.view(np.int32).astype(np.int64) % buckets


def numbers(task: int, buckets: int) -> Iterator[int]:
    """Numbers for the blocks of a task, which fall into SPREAD of the buckets at most, in turn."""
    step = max(1, buckets // SPREAD)
    held = {(task + i * step) % buckets: deque() for i in range(min(SPREAD, buckets))}
    tries, first = 64 * buckets, 0
    for own in cycle(held.values()):
        while not own:
            if first >= 1 << OWN_BITS:
                raise OverflowError("too many blocks in a task")
            tried = (np.int64(task) << OWN_BITS) + np.arange(first, min(first + tries, 1 << OWN_BITS))
            found, first = bucket_of(tried, buckets), first + tries
            for k, those in held.items():
                those.extend(tried[found == k].tolist())
        yield own.popleft()


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """df (block long, ...) as a table in the shared folder, bucketed by block."""
    spark, name = df.sparkSession, f"ratingmill_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(buckets, "block").option("path", path).option("compression", "uncompressed").saveAsTable(name)

    def drop() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session has ended, and its catalog with it
            pass
        _remove(spark, path)

    atexit.register(drop)
    return spark.table(name)


def _packed(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _table(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def _writer(buckets: int, names: list[str]):
    schema = pa.schema([("block", pa.int64()), ("body", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = numbers(TaskContext.get().partitionId(), buckets)
        held, rows, size = [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([next(own)], pa.int64()), pa.array([_packed(pa.Table.from_batches(held).rename_columns(names))], pa.binary())], schema=schema)

        for b in batches:
            i = 0
            while i < b.num_rows:
                # rows of about equal size each: a slice of a batch is cut so that a block stays near its size
                one = max(1, b.nbytes // b.num_rows)
                n = min(b.num_rows - i, max(1, (BLOCK_BYTES - size) // one), MOST_ROWS - rows)
                held.append(b.slice(i, n))
                i, rows, size = i + n, rows + n, size + n * one
                if size >= BLOCK_BYTES or rows >= MOST_ROWS:
                    yield flush()
                    held, rows, size = [], 0, 0
        if rows:
            yield flush()

    return each


class Blocks:
    """The rows of a table, all columns, in blocks."""

    def __init__(self, df: DataFrame):
        tune(df.sparkSession)
        self.schema, self.spark = df.schema, df.sparkSession
        self.table = bucketed(plain(df).mapInArrow(_writer(partitions(self.spark), df.columns), "block long, body binary"), partitions(self.spark))

    def map(self, f: Callable[[int, pa.Table], pa.Table], schema: pa.Schema) -> DataFrame:
        """f(block, rows of the block) -> rows of schema, for every block."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, body in zip(b.column(0).to_pylist(), b.column(1)):
                    yield from f(block, _table(body.as_py())).to_batches()
                    release()

        return self.table.select("block", "body").mapInArrow(each, from_arrow_schema(schema))

    def join(self, messages: DataFrame, f: Callable[[int, pa.Table, pa.Table], pa.Table], schema: pa.Schema) -> DataFrame:
        """f(block, rows of the block, its messages) -> rows of schema, for every block with messages. messages: (block long, ...)."""

        def each(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            release()
            return f(left.column("block")[0].as_py(), _table(left.column("body")[0].as_py()), right)

        return self.table.select("block", "body").groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(each, from_arrow_schema(schema))

    def without(self, rows: DataFrame) -> DataFrame:
        """The table without the named rows (column row), its columns as they were."""

        def keep(left: pa.Table, gone: pa.Table) -> pa.Table:
            if not left.num_rows:
                return none
            t = _table(left.column("body")[0].as_py())
            mask = np.ones(t.num_rows, bool)
            mask[gone.column("row").to_numpy() & (MOST_ROWS - 1)] = False
            return t.filter(pa.array(mask)).rename_columns(names)

        flat = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(self.schema)])
        names, none = flat.names, to_arrow_schema(flat).empty_table()
        messages = rows.select(block_of("row").alias("block"), "row")
        return self.table.select("block", "body").groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(keep, flat).toDF(*self.schema.names)


def block_of(row: str):
    """The block of a row, as a column."""
    return F.shiftright(F.col(row), PLACE_BITS)


def rows_of(block: int, t: pa.Table) -> np.ndarray:
    """The names of a block's rows."""
    return (np.int64(block) << PLACE_BITS) + np.arange(t.num_rows)


def places(rows) -> np.ndarray:
    """Where rows lie in their block."""
    return np.asarray(rows, np.int64) & (MOST_ROWS - 1)
