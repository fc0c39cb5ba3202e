"""Requests dealt into chunks at users' boundaries, as a stream: a micro-batch is a chunk, its offset the chunk's number.

`write_chunks` lays requests out as Parquet, a folder for each chunk; `read_chunks` streams them. The source's offset counts chunks, so
what a micro-batch holds is settled when the chunks are written, by requests and not by files: a restart goes on behind the last chunk
that the query has planned. Tasks read files; the driver lists the folders of the chunks that a micro-batch asks for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructType

from ratingmill.operators import synthetic

FORMAT = "request_chunks"


def write_chunks(requests: DataFrame, key: Sequence[str], order: Sequence[Column], size: int, path: str) -> None:
    """Requests in chunks of `size` or a little more: a chunk ends with the user (key) whose requests bring it to that number. order: of
    the users, made of columns of key. A column `requests` has the number of the user's requests."""
    users = requests.groupBy(*key).agg(F.count("*").alias("requests"))
    chunks = synthetic.chunked(users, order, F.col("requests"), size).select(*key, "requests", "chunk")
    dealt = requests.join(chunks, list(key)).repartitionByRange("chunk", *key).sortWithinPartitions("chunk", *key)
    dealt.write.mode("overwrite").partitionBy("chunk").parquet(path)


def read_chunks(spark: SparkSession, path: str, per_batch: int = 1, until: int | None = None) -> DataFrame:
    """A stream of the requests with their chunk, per_batch chunks in a micro-batch; until: chunks from this number on aren't there yet."""
    spark.dataSource.register(RequestChunks)
    source = spark.readStream.format(FORMAT).option("per_batch", per_batch)
    return (source if until is None else source.option("until", until)).load(path)


class _File(InputPartition):
    def __init__(self, chunk: int, path: str):
        self.chunk, self.path = chunk, path


class RequestChunks(DataSource):
    """Options: path, a folder that write_chunks has written; per_batch; until."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        reader = _ChunkReader(self.options)
        number = next(iter(reader.numbers()), None)
        if number is None:
            raise ValueError(f"no chunk in {self.options['path']}")
        with reader.store.open_input_file(reader.files(number)[0]) as f:
            own = from_arrow_schema(pq.read_schema(f).remove_metadata())
        return own.add("chunk", LongType())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _ChunkReader(self.options)


class _ChunkReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.per_batch = options["path"], int(options.get("per_batch", 1))
        self.until = int(options["until"]) if "until" in options else None
        self.planned: int | None = None  # the chunk behind the last one that the query has planned

    @property
    def store(self) -> fs.FileSystem:
        return fs.FileSystem.from_uri(self.uri)[0]

    @property
    def path(self) -> str:
        return fs.FileSystem.from_uri(self.uri)[1]

    def numbers(self) -> list[int]:
        folders = [x.base_name for x in self.store.get_file_info(fs.FileSelector(self.path)) if x.type == fs.FileType.Directory]
        return sorted(int(x.removeprefix("chunk=")) for x in folders if x.startswith("chunk="))

    def files(self, number: int) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(f"{self.path}/chunk={number}"))
        return sorted(x.path for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._")

    def initialOffset(self) -> dict:
        return {"chunk": 0}

    def latestOffset(self) -> dict:
        there = max(self.numbers(), default=-1) + 1
        there = there if self.until is None else min(there, self.until)
        self.planned = min((self.planned or 0) + self.per_batch, max(there, self.planned or 0))
        return {"chunk": self.planned}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.planned is None:  # after a restart the query first plans its last micro-batch again
            self.planned = end["chunk"]
        return [_File(n, path) for n in range(start["chunk"], end["chunk"]) for path in self.files(n)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with self.store.open_input_file(partition.path) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=1000):
                chunk = pa.array([partition.chunk] * b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns, chunk], names=[*b.schema.names, "chunk"])

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass
