"""Arrays in numpy's files: matrices (npy) read and written by byte ranges, members of archives (npz) read as streams.

A row is a place in all dimensions but the last, in C order, and its values are the last dimension. A missing number is NaN in a file
and null here. Only arrays in row order without Python objects are read.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator, Sequence
from math import prod

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "numpy_arrays"
#: Bytes of a matrix that a task reads, and of an archive's member at once.
RANGE_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20


def _header(f) -> tuple[np.dtype, tuple[int, ...], int]:
    """(type, shape, length of the header) of a file or stream at its start."""
    counted = _Counted(f)
    version = npy.read_magic(counted)
    shape, fortran, kind = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(counted)
    if fortran and len(shape) > 1:
        raise ValueError("the array is not in row order")
    if kind.hasobject or kind.kind not in "fiubU":
        raise ValueError(f"arrays of type {kind} are not read")
    return kind, shape, counted.n


class _Counted:
    def __init__(self, f):
        self.f, self.n = f, 0

    def read(self, n: int) -> bytes:
        b = self.f.read(n)
        self.n += len(b)
        return b


def _columns(shape: Sequence[int]) -> tuple[int, int]:
    """(rows, values of a row)."""
    return (prod(shape[:-1]), shape[-1]) if len(shape) > 1 else (prod(shape), 1)


def _files(uri: str, ending: str) -> list[str]:
    store, top = fs.FileSystem.from_uri(uri)
    info = store.get_file_info(top)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top))
    return sorted(x.path for x in found if x.type == fs.FileType.File and x.base_name.endswith(ending) and x.base_name[0] not in "._")


class NumpyArrays(DataSource):
    """Options: path, a file or a folder of files; member, for archives; kind, double or string; range_bytes, chunk_bytes; to write: rows,
    columns."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"source string, shape array<long>, row long, values array<{self.options.get('kind', 'double')}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.member, self.kind = options["path"], options.get("member"), options.get("kind", "double")
        self.range_bytes, self.chunk_bytes = int(options.get("range_bytes", RANGE_BYTES)), int(options.get("chunk_bytes", CHUNK_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        store, out = fs.FileSystem.from_uri(self.uri)[0], []
        if self.member is not None:
            return [InputPartition((f, 0, 0)) for f in _files(self.uri, ".npz")]
        for path in _files(self.uri, ".npy"):
            with store.open_input_file(path) as f:
                kind, shape, _ = _header(f)
            rows, columns = _columns(shape)
            step = max(1, self.range_bytes // max(1, columns * kind.itemsize))
            out += [InputPartition((path, a, min(rows, a + step))) for a in range(0, rows, step)]
        return out

    def _batches(self, path: str, kind: np.dtype, shape: tuple[int, ...], first: int, last: int, f) -> Iterator[pa.RecordBatch]:
        _, columns = _columns(shape)
        source, step = os.path.splitext(os.path.basename(path))[0], max(1, self.chunk_bytes // max(1, columns * kind.itemsize))
        for at in range(first, last, step):
            n = min(step, last - at)
            body = f.read(n * columns * kind.itemsize)
            if len(body) < n * columns * kind.itemsize:
                raise ValueError(f"{path} ends too soon")
            flat = np.frombuffer(body, kind)
            if self.kind == "string":
                values = pa.array(flat.astype(str).tolist(), pa.string())
            else:
                number = flat.astype(np.float64)
                values = pa.array(number, pa.float64(), mask=np.isnan(number))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * columns + 1, columns) if columns else np.zeros(n + 1, int), pa.int32()), values)
            shapes = pa.array([list(shape)] * n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([source] * n), shapes, pa.array(range(at, at + n), pa.int64()), lists], names=["source", "shape", "row", "values"])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, first, last = partition.value
        with fs.FileSystem.from_uri(self.uri)[0].open_input_file(path) as f:
            if self.member is None:
                kind, shape, start = _header(f)
                columns = _columns(shape)[1]
                f.seek(start + first * columns * kind.itemsize)
                yield from self._batches(path, kind, shape, first, last, f)
                return
            with zipfile.ZipFile(f) as z, z.open(f"{self.member}.npy") as m:
                kind, shape, _ = _header(m)
                yield from self._batches(path, kind, shape, 0, _columns(shape)[0], m)


class _Writer(DataSourceArrowWriter):
    """Tasks write their rows at their place in one file, which must lie in a file system that driver and executors share."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        store, self.path = fs.FileSystem.from_uri(options["path"])
        if not isinstance(store, fs.LocalFileSystem):
            raise ValueError("a matrix is written to a shared file system")
        if not overwrite and os.path.exists(self.path):
            raise ValueError(f"{self.path} is there")
        self.rows, self.columns, self.part = int(options["rows"]), int(options["columns"]), f"{self.path}.part"
        head = io.BytesIO()
        npy.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": (self.rows, self.columns)})
        self.start = len(head.getvalue())
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(self.part, "wb") as f:
            f.write(head.getvalue())
            f.truncate(self.start + self.rows * self.columns * 8)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        n = 0
        with open(self.part, "r+b") as f:
            for b in iterator:
                for row, values in zip(b.column("row").to_pylist(), b.column("values")):
                    x = np.array([np.nan if v is None else v for v in values.as_py()], "<f8")
                    if not 0 <= row < self.rows or len(x) != self.columns:
                        raise ValueError(f"row {row} of {len(x)} values is not of a matrix of {self.rows} x {self.columns}")
                    f.seek(self.start + row * self.columns * 8)
                    f.write(x.tobytes())
                    n += 1
        return _Rows(n)

    def commit(self, messages) -> None:
        n = sum(m.n for m in messages if m is not None)
        if n != self.rows:
            self.abort(messages)
            raise ValueError(f"{n} rows for a matrix of {self.rows}")
        os.replace(self.part, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class _Rows(WriterCommitMessage):
    def __init__(self, n: int):
        self.n = n


def read_arrays(spark: SparkSession, path: str, member: str | None = None, kind: str = "double", range_bytes: int = RANGE_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(source, shape, row, values): source is the file's name without its ending. A task reads range_bytes of a matrix, chunk_bytes at once."""
    spark.dataSource.register(NumpyArrays)
    reader = spark.read.format(FORMAT).options(kind=kind, range_bytes=range_bytes, chunk_bytes=chunk_bytes)
    return (reader if member is None else reader.option("member", member)).load(path)


def write_matrix(df: DataFrame, rows: int, columns: int, path: str) -> None:
    """(row, values) as one npy file of doubles; raises unless there are as many rows and values as told."""
    df.sparkSession.dataSource.register(NumpyArrays)
    df.select(F.col("row").cast("long").alias("row"), F.col("values").cast("array<double>").alias("values")).write.format(FORMAT).option("rows", rows).option("columns", columns).mode("overwrite").save(path)


def ratings_npy(ratings: DataFrame, path: str) -> None:
    """Ratings (conv_ord, attr_ord, score) as a matrix: a row for each conversation, from 0 on, a column for each attribute."""
    about = ratings.agg((F.max("conv_ord") + 1).alias("rows"), (F.max("attr_ord") + 1).alias("columns")).first()
    by_place = F.map_from_entries(F.collect_list(F.struct("attr_ord", "score")))
    wide = ratings.groupBy(F.col("conv_ord").alias("row")).agg(by_place.alias("of"))
    values = F.transform(F.sequence(F.lit(0), F.lit((about.columns or 1) - 1)), lambda i: F.try_element_at("of", i))
    write_matrix(wide.select("row", values.alias("values")), about.rows or 0, about.columns or 0, path)


def read_ratings_npy(spark: SparkSession, path: str, attributes: Sequence[str]) -> DataFrame:
    """A matrix as ratings (conv_ord, attr_ord, attribute, score); raises if it has another number of columns than there are attributes."""
    rows = read_arrays(spark, path)
    wrong = F.raise_error(F.concat(F.lit(f"{len(attributes)} attributes listed, rated: "), F.size("values")))
    checked = rows.withColumn("values", F.when(F.size("values") == len(attributes), F.col("values")).otherwise(wrong.cast("array<double>")))
    long = checked.select(F.col("row").alias("conv_ord"), F.posexplode("values").alias("attr_ord", "score"))
    return long.withColumn("attribute", F.get(F.array(*[F.lit(a) for a in attributes]), F.col("attr_ord"))).select("conv_ord", "attr_ord", "attribute", "score")


def cubes_npz(scores: DataFrame, path: str) -> None:
    """Scores (judge, pair_ord, pair, rep, slot, score) as an archive for each judge: scores (pairs, 2, reps) and pairs (pairs, 2).

    A judge's cube must be whole. Its file is written by one task, as a stream of its rows in order; other readers want one file."""
    spark = scores.sparkSession
    size = scores.groupBy("judge").agg(F.count("*").alias("n"), (F.max("pair_ord") + 1).alias("pairs"), (F.max("rep") + 1).alias("reps"), F.count_distinct("pair_ord", "rep", "slot").alias("different"))
    names = scores.groupBy("judge").agg(F.array_sort(F.collect_set(F.struct("pair_ord", "pair"))).alias("names"))
    if not size.where((F.col("n") != F.col("pairs") * F.col("reps") * 2) | (F.col("different") != F.col("n"))).isEmpty():
        raise ValueError("a judge's cube is not whole")
    store, top = fs.FileSystem.from_uri(path)
    store.create_dir(top, recursive=True)
    cells = scores.select("judge", "pair_ord", "slot", "rep", F.col("score").cast("double").alias("score"))
    about = size.join(names, "judge").select("judge", F.struct("pairs", "reps", F.transform("names", lambda x: x["pair"]).alias("names")).alias("about"))
    # what a file's header needs comes as a row before the judge's scores
    first = about.select("judge", F.lit(-1).alias("pair_ord"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("rep"), F.lit(None).cast("double").alias("score"), "about")
    rows = cells.withColumn("about", F.lit(None).cast(first.schema["about"].dataType)).select(first.columns).unionAll(first)
    dealt = rows.repartition("judge").sortWithinPartitions("judge", "pair_ord", "slot", "rep").select("judge", "score", "about")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, done = fs.FileSystem.from_uri(path)[0], []
        now = None

        def closed() -> None:
            judge, names, out, archive, member = now
            member.close()
            with archive.open("pairs.npy", "w") as m:
                npy.write_array(m, np.array([n.split("/", 1) for n in names], str), allow_pickle=False)
            archive.close()
            out.close()
            name = judge.replace("/", "_")
            target.move(f"{top}/_{name}.npz", f"{top}/{name}.npz")
            done.append(judge)

        for b in batches:
            values, marks = b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            starts = [i for i in range(b.num_rows) if marks[i].is_valid]
            edges = [*starts, b.num_rows]
            if now is not None and (not starts or starts[0] > 0):
                now[4].write(values[: edges[0]].astype("<f8").tobytes())
            for a, z in zip(starts, edges[1:], strict=True):
                if now is not None:
                    closed()
                judge, mark = b.column(0)[a].as_py(), marks[a].as_py()
                out = target.open_output_stream(f"{top}/_{judge.replace('/', '_')}.npz")
                archive = zipfile.ZipFile(out, "w")
                member = archive.open("scores.npy", "w", force_zip64=True)
                npy.write_array_header_1_0(member, {"descr": "<f8", "fortran_order": False, "shape": (mark["pairs"], 2, mark["reps"])})
                now = (judge, mark["names"], out, archive, member)
                member.write(values[a + 1 : z].astype("<f8").tobytes())
        if now is not None:
            closed()
        yield pa.RecordBatch.from_pydict({"judge": pa.array(done, pa.string())})

    dealt.mapInArrow(each, "judge string").collect()  # a name for each judge


def read_cubes_npz(spark: SparkSession, path: str) -> DataFrame | None:
    """Cubes of all judges of a folder, an archive each, as pair scores; None if there is none."""
    if not _files(path, ".npz"):
        return None
    cells = read_arrays(spark, path, "scores").select("source", F.expr("row div shape[1]").cast("int").alias("pair_ord"), F.expr("row % shape[1]").cast("int").alias("slot"), F.posexplode("values").alias("rep", "score"))
    pairs = read_arrays(spark, path, "pairs", "string").select("source", F.col("row").cast("int").alias("pair_ord"), F.array_join("values", "/").alias("pair"))
    return cells.join(pairs, ["source", "pair_ord"]).select(F.col("source").alias("judge"), "pair_ord", "pair", F.col("rep").cast("long").alias("rep"), "slot", "score")
