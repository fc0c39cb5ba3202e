"""What the operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that goes to Python; texts may be long.
ARROW_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a Python worker holds a bounded number of texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs in this process, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = tempfile.mkdtemp(prefix="ratingmill-")
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the shared folder has its own housekeeping
        pass


def stash(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, is computed once and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ratingmill-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives back what this Python worker's allocators hold unused, as a worker outlives its task and shares its executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_rows(f: Callable[[dict[str, list]], dict[str, object]], schema: pa.Schema) -> Callable:
    """A function for mapInArrow from one on columns as Python lists; it makes columns of any length."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = f({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in schema], schema=schema)
            del out
            release()

    return each


def pack(a: np.ndarray) -> bytes:
    """A number array, its bytes plane by plane, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else a.view(np.uint8)
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(b: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def plain(df: DataFrame) -> DataFrame:
    """df with columns named by place, as functions on Arrow batches need: other names may be repeated or hold dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def filtered(docs: DataFrame, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of docs, with all columns as they are, whose texts are kept; a row is decided where it lies."""
    flat, at = plain(docs), docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))
            release()

    return flat.mapInArrow(each, flat.schema).toDF(*docs.columns)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n nodes is linked to through the edges (a, b); pointer jumping, no recursion."""
    root = np.arange(n, dtype=np.int64)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


#: Edges that one task resolves at once: 16 bytes each, whatever the size of the graph that they are left of.
FEW_EDGES = 100_000


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to) of the edges of a task."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if got:
        a, b = (np.concatenate(x) for x in zip(*got))
        names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(code[: len(a)], code[len(a) :], len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["node", "to"])


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of edges (a long, b long): (node, root) for every node of an edge between different nodes; root is
    one node of the component, the same for all of it.

    Each round maps every node to the first of itself and its neighbours, in the order of a hash, and contracts the edges by that
    map. Only nodes that come before all their neighbours stay, about a third of a path, so a few rounds leave no edge; a node's
    root is what the maps of all rounds make of it. Rounds are checkpointed. Sides are pre-aggregated before each shuffle; joins
    are plain equi-joins, which adaptive execution splits where a node is hot. When rounds leave no more than `few` edges, one task
    resolves these: the last rounds have little to do, but each is many stages that the driver keeps account of.
    """
    spark = edges.sparkSession
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    out = None
    left_over = e.count()
    while left_over:
        last = out is not None and left_over <= few
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("low"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("v"))
        step = cut(e.coalesce(1).mapInArrow(_resolved, "node long, to long") if last else first.select("node", F.least(own, "low")["v"].alias("to")))
        if out is None:
            out = step.select("node", F.col("to").alias("root"))
        else:
            s = step.select(F.col("node").alias("root"), "to")
            out = out.join(s, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        if last:
            break
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        e = e.join(left, "a").join(right, "b").where("ta <> tb")
        e = cut(e.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        left_over = e.count()
    if out is None:
        return spark.createDataFrame([], "node long, root long")
    return cut(out)
