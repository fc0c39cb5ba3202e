"""Queries over training by epochs and over remote models."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ratingmill.operators import remote, scoring
from ratingmill.operators.training import EpochClassifier, EpochOptions
from ratingmill.plans.catalog import h, query, scratch, table


@query()
def classifier_epochs(spark, sf_dir):
    """Losses by epoch of a classifier of languages; a fifth of the documents is for validation."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", 1).otherwise(0).alias("label"))
    held = F.pmod("doc_id", F.lit(5)) == 0
    return EpochClassifier(EpochOptions()).train(d.where(~held), d.where(held), ["doc_id"]).losses(spark)


def answer(prompt: str) -> str:
    """What stands for a remote model: a rating from the prompt's hash, or none."""
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    return "I can't say." if number(f"{prompt}|silent") % 7 == 0 else f"Between 1 and 10: {1 + number(prompt) % 10}"


@query(f"SELECT item_id, CASE WHEN {h('text', chr(39) + 'silent' + chr(39))}%7=0 THEN 5 ELSE 1+{h('text')}%10 END::DOUBLE AS score FROM benchmark")
def remote_ratings(spark, sf_dir):
    """Ratings by a remote model, asked for within a budget and read from the log of its answers."""
    requests = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt"))
    score = remote.remote(answer, ["item_id"], f"{scratch(spark)}/log", scoring.JudgeOptions(default=5.0, retries=5, concurrency=6, backoff_s=0.0))
    return score(requests).select("item_id", "score")
