"""Conversations, nested or flat: filters, prefixes, truncation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.functions.portable import draw


def nest(flat: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """(keys, turn, role, text) as (keys, messages), by turn."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return flat.groupBy(*keys).agg(F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def flatten(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.posexplode("messages").alias("turn", "m")).select(*keys, F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def running_total(df: DataFrame, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """df with the sum of `value` over the rows before each in the order, in two passes: rows are split by range and summed within
    their partition, and a partition's offset comes from the totals of those before it. No task sees all rows; the driver sees a
    total for each partition."""
    ranged = df.withColumn("__o", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])).repartitionByRange("__o")
    ranged = ranged.withColumn("__p", F.spark_partition_id()).persist()
    totals = sorted((r.p, r.n) for r in ranged.groupBy(F.col("__p").alias("p")).agg(F.sum(value).alias("n")).collect())
    before, starts = 0, []
    for p, n in totals:
        starts += [F.lit(p), F.lit(before).cast("long")]
        before += n or 0
    base = F.element_at(F.create_map(*starts), F.col("__p")) if starts else F.lit(0)
    w = Window.partitionBy("__p").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(out, (base + F.coalesce(F.sum(value).over(w), F.lit(0))).cast("long")).drop("__o", "__p")


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """df with its ordinal from 0 in the order."""
    return running_total(df.withColumn("__one", F.lit(1)), order, "__one", out).drop("__one")


def opens_well(messages: Column) -> Column:
    """At least two messages, the first by the user, the second by the assistant."""
    role = lambda i: F.get(messages, F.lit(i))["role"]
    return F.coalesce((F.size(messages) >= 2) & (role(0) == "user") & (role(1) == "assistant"), F.lit(False))


def flat_opens_well(flat: DataFrame) -> DataFrame:
    """The conv_id of conversations that open well, from the flat form: two rows of each are looked at, pushed down to the scan."""
    head = flat.where(((F.col("turn") == 0) & (F.col("role") == "user")) | ((F.col("turn") == 1) & (F.col("role") == "assistant")))
    return head.groupBy("conv_id").agg(F.count("*").alias("n")).where("n = 2").select("conv_id")


def checked(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df; the query raises if a row is not ok."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def ends_with_answer(messages: Column) -> Column:
    n = F.size(messages)
    return (n >= 2) & (F.get(messages, n - 1)["role"] == "assistant") & (F.get(messages, n - 2)["role"] == "user")


def ends_with_question(messages: Column) -> Column:
    return (F.size(messages) >= 1) & (F.get(messages, F.size(messages) - 1)["role"] == "user")


def without_last(messages: Column) -> Column:
    return F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))


def random_truncation(messages: Column, key: Column, seed: int, ends_on_user: bool = False) -> Column:
    """2 k of the messages, k drawn from 1 to half their number; one less to end on the user. Conversations of one message: none."""
    half = F.floor(F.size(messages) / 2).cast("long")
    keep = (1 + draw(F.greatest(half, F.lit(1)), key, seed)) * 2
    return F.slice(messages, 1, F.when(half < 1, 0).otherwise(keep - int(ends_on_user)).cast("int"))


def user_turns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every second turn from the first one on, whoever speaks: (keys, turn, role, content, context); context: what is before it."""
    every = df.select(*keys, "messages", F.posexplode("messages").alias("turn", "m")).where(F.col("turn") % 2 == 0)
    return every.select(*keys, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"), F.slice("messages", 1, F.col("turn")).alias("context"))


def prefix_context(flat: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each turn with the texts before it, from the flat form."""
    w = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("context", F.collect_list("text").over(w))


def history_and_current(conversations: Column) -> tuple[Column, Column]:
    """All conversations but the last, and the last (null if there is none)."""
    return without_last(conversations), F.try_element_at(conversations, F.lit(-1))
