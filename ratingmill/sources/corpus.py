"""Readers: chat corpora, personas, labelled items, ratings and attribute lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingmill import schema
from ratingmill.functions.portable import order_key
from ratingmill.functions.text import any_prefix, persona
from ratingmill.operators import conversations as conv
from ratingmill.sources.sinks import CSV


def corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Conversations of a corpus partitioned by split; a split is a partition filter."""
    df = spark.read.schema(schema.CORPUS).parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def nested(flat: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as (prompt_id, prompt, messages): messages by turn."""
    return conv.nest(flat).select(F.col("conv_id").cast("string").alias("prompt_id"), F.get("messages", F.lit(0))["content"].alias("prompt"), "messages")


def seeded_limit(df: DataFrame, key: Column, seed: int, limit: int | None) -> DataFrame:
    """The first rows of a seeded shuffle; no limit and 0 keep all."""
    return df.orderBy(order_key(key, seed), key).limit(limit) if limit else df


def prompts(df: DataFrame, prefixes: Sequence[str] | None = None, limit: int | None = None, seed: int = 42) -> DataFrame:
    kept = df.where(any_prefix(F.col("prompt_id"), prefixes)).select("prompt_id", "prompt")
    return seeded_limit(kept, F.col("prompt_id"), seed, limit)


def conversations(df: DataFrame, prefixes: Sequence[str] | None = None, limit: int | None = None, seed: int = 42) -> DataFrame:
    """(prompt_id, messages) of conversations that a user opens and the assistant answers."""
    kept = df.where(any_prefix(F.col("prompt_id"), prefixes) & conv.opens_well(F.col("messages"))).select("prompt_id", "messages")
    return seeded_limit(kept, F.col("prompt_id"), seed, limit)


def prompt_response_pairs(df: DataFrame, prefixes: Sequence[str] | None = None, limit: int | None = None, seed: int = 42) -> DataFrame:
    m = F.col("messages")
    return conversations(df, prefixes, limit, seed).select("prompt_id", F.get(m, F.lit(0))["content"].alias("prompt"), F.get(m, F.lit(1))["content"].alias("response"))


def personas(df: DataFrame, parts: Sequence[str], key: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """(persona_id, persona): the first n non-empty personas of a seeded shuffle, numbered in its order."""
    made = df.select(F.col(key).alias("__key"), persona(*[F.col(p).cast("string") for p in parts]).alias("persona")).where("persona is not null")
    made = seeded_limit(made, F.col("__key"), seed, n)
    return conv.numbered(made, [order_key(F.col("__key"), seed), F.col("__key")], "persona_id").select(F.col("persona_id").cast("int"), "persona")


def labelled_items(spark: SparkSession, path: str, split: str, limit: int | None = None, history: int | None = None) -> DataFrame:
    """Items with labels: (ord, user_id, user_attributes, conversation_history, current_messages), the last answer taken off.

    A limit beyond the split's size raises, as a slice by position would."""
    df = conv.numbered(spark.read.schema(schema.ITEMS).parquet(path).where(F.col("split") == split), [F.col("user_id").cast("long"), F.col("user_id")], "ord")
    if limit is not None:
        size = df.count()
        if limit > size:
            raise ValueError(f"limit {limit} is beyond the split's {size} items")
        df = df.where(F.col("ord") < limit)
    past = F.col("conversation_history") if history is None else F.slice("conversation_history", 1, history)
    return df.select("ord", "user_id", "user_attributes", past.alias("conversation_history"), conv.without_last(F.col("current_messages")).alias("current_messages"))


def unlabelled(items: DataFrame) -> DataFrame:
    return items.drop("user_attributes")


def users_json(spark: SparkSession, path: str) -> DataFrame:
    """Users, a JSON object a line; blank lines are skipped, other faults raise."""
    return spark.read.schema(schema.USERS).json(path, mode="FAILFAST")


def generated_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.GENERATED).csv(path, multiLine=True, **CSV)


def ratings(spark: SparkSession, path: str, attributes: Sequence[str]) -> DataFrame:
    """A rating matrix in long form; raises if its attributes aren't as many as the list has."""
    df = spark.read.schema(schema.RATINGS).parquet(path)
    n = df.select(F.count_distinct("attr_ord")).first()[0]
    if n != len(attributes):
        raise ValueError(f"{n} attributes rated, {len(attributes)} listed")
    return df


def judge_scores(spark: SparkSession, path: str) -> DataFrame | None:
    """Score cubes of all judges, a folder judge=... each; None if there is none."""
    df = spark.read.schema(schema.PAIR_SCORES).parquet(path)
    return None if df.isEmpty() else df


def attributes(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(ord, attribute); a parameter table, as long as the list."""
    return spark.createDataFrame(list(enumerate(names)), "ord int, attribute string")


def attributes_json(spark: SparkSession, path: str) -> DataFrame:
    """(ord, attribute) of a JSON list of strings in a file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("ord", "attribute"))


def attributes_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(ord, attribute) of a YAML list of strings, an item a line: `- name`, plain or in quotes."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"^\s*-\s+\S"))
    name = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*-\s+|\s+$", ""), r"""^(["'])(.*)\1$""", "$2")
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.transform(lines, name)).alias("ord", "attribute"))


def bias_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.BIAS).csv(path, multiLine=True, **CSV)


def item(df: DataFrame, i: int):
    """The row with ordinal i (column ord), counted from the end if negative; raises IndexError beyond the last."""
    at = i if i >= 0 else i + df.count()
    row = df.where(F.col("ord") == at).first()
    if row is None:
        raise IndexError(i)
    return row
