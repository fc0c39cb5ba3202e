"""Whole users out of a stream of responses: state by user, caps by split in two levels, output by micro-batch.

A user's turns may come in several micro-batches. Its state holds them until all are there and valid, or one is not; then the user
leaves once, and its state goes with its last turn. Caps are held in two levels: by (split, bucket), where a bucket forwards no more
valid users than its split wants, and by split, which sees those alone; so no task sees all users of a split. State is kept by the
RocksDB provider, as transformWithState needs; `with_state` sets it for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from ratingmill import schema
from ratingmill.operators import synthetic
from ratingmill.operators.scoring import valid

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 32
KEY = ["split", "user_idx"]
TURNS = "array<struct<slot:int,turn:long,content:string>>"


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class _Whole(StatefulProcessor):
    """For a user: (split, user_idx, ok, responses) once, when all its turns are there (ok) or one is not valid (not ok)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, bad boolean")
        self.turns = handle.getListState("turns", "slot int, turn long, content string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, bad = self.seen.get() if self.seen.exists() else (0, False)
        known, new, needed = (seen, bad), [], 0
        for r in rows:
            needed, seen = int(r["requests"].iloc[0]), seen + len(r)
            bad = bad or not bool(r["ok"].all())
            new += zip(r["slot"].tolist(), r["turn"].tolist(), r["content"].tolist(), strict=True)
        if bad and not known[1]:
            yield self._told(key, False, [])
        elif not bad and seen >= needed:
            yield self._told(key, True, [*(self.turns.get() if known[0] else ()), *new])
        if seen >= needed:
            self.seen.clear()
            self.turns.clear()
            return
        self.seen.update((seen, bad))
        if bad:
            self.turns.clear()
        else:
            self.turns.appendList(new)

    def _told(self, key, ok: bool, turns: list) -> pd.DataFrame:
        said = [{"slot": int(s), "turn": int(t), "content": c} for s, t, c in sorted(turns, key=lambda x: (x[0], x[1]))]
        return pd.DataFrame({"split": [key[0]], "user_idx": [key[1]], "ok": [ok], "responses": [said]})

    def close(self) -> None:
        pass


class _Cap(StatefulProcessor):
    """For a split (or a bucket of it): its rows in order, up to the one with which the wanted number is reached, over all micro-batches."""

    def __init__(self, wanted: dict[str, int], columns: list[str], order: str):
        self.wanted, self.columns, self.order = wanted, columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.kept.get()[0] if self.kept.exists() else 0
        left, held = self.wanted.get(key[0], 0) - n, None
        for r in rows:
            if left > 0:
                held = (r if held is None else pd.concat([held, r])).sort_values(self.order, kind="stable")
                before = held["ok"].cumsum() - held["ok"]
                held = held[before < left]
        if held is not None and len(held):
            self.kept.update((n + int(held["ok"].sum()),))
            yield held[self.columns]

    def close(self) -> None:
        pass


def whole_users(responses: DataFrame) -> DataFrame:
    """Stream of (split, user_idx, slot, turn, requests, response) as (split, user_idx, ok, responses), a row a user.

    requests: the number of the user's requests. A user is ok if all of them are valid; what comes after an invalid one is dropped."""
    with_state(responses.sparkSession)
    flat = responses.select(*KEY, F.col("slot").cast("int").alias("slot"), F.col("turn").cast("long").alias("turn"), "requests", F.col("response.content").alias("content"), valid(F.col("response")).alias("ok"))
    kinds = dict(flat.dtypes)
    return flat.groupBy(*KEY).transformWithStateInPandas(_Whole(), f"split {kinds['split']}, user_idx {kinds['user_idx']}, ok boolean, responses {TURNS}", "Append", "None")


def capped(users: DataFrame, wanted: dict[str, int], order: str = "user_idx", buckets: int = BUCKETS) -> DataFrame:
    """Stream of (split, ok, …), a row a user, up to the row of each split with which the wanted number of ok ones is there: in order of
    arrival, and by `order` within a micro-batch. Rows that are not ok and come before it stay, so that they can be counted."""
    with_state(users.sparkSession)
    out = StructType([StructField(f.name, f.dataType) for f in users.schema])
    dealt = users.withColumn("ok", F.coalesce(F.col("ok").cast(BooleanType()), F.lit(False))).withColumn("__bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    shares = dealt.groupBy("split", "__bucket").transformWithStateInPandas(_Cap(wanted, users.columns, order), out, "Append", "None")
    return shares.groupBy("split").transformWithStateInPandas(_Cap(wanted, users.columns, order), out, "Append", "None")


def write_users(done: DataFrame, users: DataFrame, corpus: DataFrame, per_user: int, sources: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the ok users of a stream (split, user_idx, ok, responses) as JSON lines, each once, and counts of kept and discarded ones.

    A micro-batch has a folder of its own, named by its number, and overwrites it: what a failed attempt left is replaced. users and
    corpus are as in synthetic.requests."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            kept = batch.where("ok")
            response = F.struct(F.col("r.content").alias("content"))
            said = kept.select(*KEY, F.explode("responses").alias("r")).select(*KEY, "r.slot", "r.turn", response.alias("response"))
            synthetic.rewritten(users.join(kept.select(*KEY), KEY), corpus, said, per_user, sources).write.mode("overwrite").json(f"{path}/users/batch={number}")
            counts = batch.groupBy("split").agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("discarded"))
            counts.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        finally:
            batch.unpersist()

    return done.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """The users that write_users wrote: users_json rows with split."""
    return spark.read.schema(f"split string, {schema.USERS}").json(f"{path}/users", mode="FAILFAST")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(split, kept, discarded) over all micro-batches."""
    return spark.read.schema("split string, kept long, discarded long").parquet(f"{path}/counts").groupBy("split").agg(F.sum("kept").alias("kept"), F.sum("discarded").alias("discarded"))


def drained(query: StreamingQuery) -> StreamingQuery:
    """Runs a query until all that is there is processed, then stops it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query
