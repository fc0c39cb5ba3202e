"""Parts of a Parquet dataset: its first rows in a windowed shuffle, and rows by ordinal, without reading the rest.

`row_groups` is a data source whose partitions are chosen row groups, each row with its position in the dataset (files by name, rows as
they lie). The first rows of a windowed shuffle are read in steps, a few windows ahead, until there are enough. Rows by ordinal are
found by an index of files that is written with the dataset; within the file, its row groups' statistics prune the rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructType

from ratingmill.functions.portable import order_key
from ratingmill.functions.text import persona
from ratingmill.operators import conversations as conv

FORMAT, POSITION = "row_groups", "__position"
# fixed values: the columns of a persona corpus that make a persona
PERSONA_PARTS = ("persona", "cultural_background", "skills_and_expertise", "hobbies_and_interests")


@dataclass(frozen=True)
class RowGroup:
    file: str
    group: int
    start: int
    rows: int


def groups(path: str) -> Iterator[RowGroup]:
    """The row groups of a dataset in order; footers are read one file after the other, as far as the groups are asked for."""
    store, top = fs.FileSystem.from_uri(path)
    info = store.get_file_info(top)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
    start = 0
    for x in sorted((x for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._"), key=lambda x: x.path):
        with store.open_input_file(x.path) as f:
            about = pq.read_metadata(f)
        for i in range(about.num_row_groups):
            rows = about.row_group(i).num_rows
            yield RowGroup(x.path, i, start, rows)
            start += rows


class RowGroups(DataSource):
    """Options: path; groups, a JSON list of [file, group, start]; columns, a JSON list (default: all)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        store, top = fs.FileSystem.from_uri(self.options["path"])
        with store.open_input_file(json.loads(self.options["groups"])[0][0]) as f:
            whole = pq.read_schema(f).remove_metadata()
        names = json.loads(self.options.get("columns", "null")) or whole.names
        return from_arrow_schema(pa.schema([whole.field(n) for n in names])).add(POSITION, LongType())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema.names[:-1])


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.uri, self.columns, self.groups = options["path"], columns, json.loads(options["groups"])

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(tuple(g)) for g in self.groups]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        file, group, at = partition.value
        with fs.FileSystem.from_uri(self.uri)[0].open_input_file(file) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=1000, row_groups=[group], columns=self.columns):
                position = pa.array(range(at, at + b.num_rows), pa.int64())
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in self.columns), position], names=[*self.columns, POSITION])


def read_groups(spark: SparkSession, path: str, some: Sequence[RowGroup], columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of chosen row groups (one at least), with their position."""
    spark.dataSource.register(RowGroups)
    reader = spark.read.format(FORMAT).option("groups", json.dumps([[g.file, g.group, g.start] for g in some]))
    return (reader if columns is None else reader.option("columns", json.dumps(list(columns)))).load(path)


def streamed_personas(spark: SparkSession, path: str, key: str, n: int, parts: Sequence[str] = PERSONA_PARTS, seed: int = 42, buffer: int = 10_000, report=None) -> DataFrame:
    """(persona_id, persona): the first n non-empty personas of a windowed shuffle, numbered in its order.

    Windows are `buffer` rows in the dataset's order; windows come one after the other, rows within a window by a seeded hash of their
    key. Row groups are read until the windows that they complete hold n personas, or all are read, so the result depends on the
    dataset alone and not on tasks. Null and empty parts are left out, personas without parts don't count; a dataset without rows gives
    none. report: gets the number of row groups that were read."""
    if n < 1 or buffer < 1:
        raise ValueError("n and buffer are one or more")
    source, made, whole, read = groups(path), None, 0, 0
    windows = -(-n // buffer)
    while True:
        some, end = [], None
        for g in source:
            some.append(g)
            end = g.start + g.rows
            if end >= windows * buffer:
                break
        if some:
            read += len(some)
            rows = read_groups(spark, path, some, list(dict.fromkeys([key, *parts])))
            text = persona(*[F.col(p).cast("string") for p in parts])
            rows = rows.select(F.floor(F.col(POSITION) / buffer).cast("long").alias("window"), F.col(key).cast("string").alias("key"), text.alias("persona")).where("persona is not null")
            made = rows if made is None else made.unionAll(rows)
            whole = end // buffer
        done = len(some) == 0 or end is None or end < windows * buffer
        if done or made.where(F.col("window") < whole).limit(n).count() >= n:
            break
        windows *= 2
    if report is not None:
        report(read)
    if made is None:
        return spark.createDataFrame([], "persona_id int, persona string")
    order = [F.col("window"), order_key(F.col("key"), seed), F.col("key")]
    first = made.orderBy(*order).limit(n)
    return conv.numbered(first, order, "persona_id").select(F.col("persona_id").cast("int").alias("persona_id"), "persona")


def write_indexed(df: DataFrame, order: Sequence, path: str, rows_a_file: int = 100_000) -> None:
    """df with its ordinal (column ord) in the order, as Parquet, and an index: the ordinals that each file has."""
    numbered = conv.numbered(df, order, "ord")
    dealt = numbered.repartitionByRange("ord").sortWithinPartitions("ord")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/rows")
    files = df.sparkSession.read.parquet(f"{path}/rows").select("ord", F.col("_metadata.file_path").alias("file"))
    index = files.groupBy("file").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    index.coalesce(1).sortWithinPartitions("first").write.mode("overwrite").parquet(f"{path}/index")


class Indexed:
    """Random access to what write_indexed wrote. Rows have no labels where they were dropped before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.index = spark.read.schema("file string, first long, last long").parquet(f"{path}/index")
        self.size = (self.index.agg(F.max("last")).first()[0] or -1) + 1 if not self.index.isEmpty() else 0

    def __len__(self) -> int:
        return self.size

    def at(self, i: int) -> DataFrame:
        """The row with ordinal i, counted from the end if negative: a scan of one file with a pushed filter. IndexError beyond the ends."""
        place = i if i >= 0 else i + self.size
        if not 0 <= place < self.size:
            raise IndexError(i)
        file = self.index.where((F.col("first") <= place) & (F.col("last") >= place)).first().file
        return self.spark.read.parquet(file).where(F.col("ord") == place)

    def __getitem__(self, i: int) -> Row:
        return self.at(i).first()

    def many(self, places: DataFrame) -> DataFrame:
        """The rows with the ordinals in places (ord long): a join, for access in bulk; ordinals beyond the ends give no row."""
        return self.spark.read.parquet(f"{self.path}/rows").join(places.select("ord").distinct(), "ord")
