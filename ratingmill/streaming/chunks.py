"""Requests processed as a stream: bounded micro-batches, durable output, and state of what was kept by split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ratingmill.operators.scoring import Generator, valid
from ratingmill.streaming.users import capped


def read_chunks(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files of requests as a stream, `files` in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def process(requests: DataFrame, generate: Generator, out: str, checkpoint: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Generates for each micro-batch and appends the valid ones; all that is there is processed, and a restart goes on from the
    checkpoint, without a request twice in the output."""
    done = then(generate(requests).withColumn("ok", valid(F.col("response"))))
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def kept_by_split(users: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """Stream of (split, user_idx, ok): (split, user_idx) of the first wanted valid users in order of arrival, by state in two levels."""
    return capped(users.select("split", "user_idx", "ok"), wanted).where("ok").select("split", "user_idx")
