"""How well a judge recovers the attribute by which a response was made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_prompt(df: DataFrame, key: str) -> DataFrame:
    """(key, hit, strict, margin): whether the ground truth's score is the largest, the only largest, and how far above the mean.

    df: (key, response_attr, gt_attr, score), a few rows for each prompt."""
    top = F.max("score").over(Window.partitionBy(key))
    own = F.max(F.when(F.col("response_attr") == F.col("gt_attr"), F.col("score")))
    out = df.withColumn("top", top).groupBy(key).agg(own.alias("own"), F.max("top").alias("top"), F.count_if(F.col("score") == F.col("top")).alias("tops"), F.avg("score").alias("mean"))
    hit = F.col("own") == F.col("top")
    return out.select(key, hit.alias("hit"), (hit & (F.col("tops") == 1)).alias("strict"), (F.col("own") - F.col("mean")).alias("margin"))


def accuracy(df: DataFrame, key: str) -> DataFrame:
    p = per_prompt(df, key)
    return p.agg(F.avg(F.col("hit").cast("double")).alias("accuracy"), F.avg(F.col("strict").cast("double")).alias("strict_accuracy"), F.avg("margin").alias("mean_margin"), F.count("*").alias("prompts"))
