"""Personalised against unpersonalised answers, over worlds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.operators import expand, reward
from ratingmill.operators.classify import COUNTS, AttributeSystem
from ratingmill.operators.scoring import Generator, Scorer


def world_labels(items: DataFrame, names: list[str], world: DataFrame, most: int | None = None) -> DataFrame:
    """(split, user_id, attribute, side): what each user's answers should be like in a world. An attribute out of the list raises."""
    table = expand.parameters(items.sparkSession, list(enumerate(names)), "i int, attribute string")
    own = items.select("split", "user_id", F.explode("user_attributes").alias("a")).select("split", "user_id", "a.attribute", "a.side")
    own = own.join(table, "attribute", "left")
    own = own.withColumn("i", F.coalesce("i", F.raise_error(F.lit("unknown attribute")).cast("int")))
    wants = reward.attributes_of(reward.apply_world(own, world, ["split", "user_id"]), ["split", "user_id"], most)
    return wants.join(table.withColumnRenamed("i", "j"), "j").select("split", "user_id", "attribute", "side")


def run(items: DataFrame, names: list[str], worlds: dict[int, DataFrame], generate: Generator, scorer: Scorer, keep: Callable[[DataFrame], DataFrame], train: bool = True, most: int | None = None) -> DataFrame:
    """A row for each world: rates, means and deviations on the test split. keep materialises what models made.

    What does not depend on the world is made once for all: answers with each attribute and without one, and the words of histories. Of
    answers their keys and responses are kept, not the conversations."""
    out = []
    learn, test = items.where("split = 'train'"), items.where("split = 'test'")
    answered = lambda df: keep(df.select("split", "user_id", "attribute", "response"))
    plain = answered(generate(test.withColumn("attribute", F.lit(""))))
    if train:
        first = AttributeSystem(names)
        tried = keep(first.tried(learn, generate))
        histories, asked = keep(first.counted(learn).select("split", "user_id", COUNTS)), keep(first.counted(test))
    else:
        answers = answered(generate(test.withColumn("attribute", F.lit(""))))
    for number, world in worlds.items():
        labels = keep(world_labels(items, names, world, most))
        if train:
            system = AttributeSystem(names)
            system.learn(histories, tried, labels, scorer, keep)
            answers = answered(system.answer(asked, generate))

        def rewards(df: DataFrame) -> DataFrame:
            request = df.select("split", "user_id", F.col("attribute").alias("tried"), F.col("response.content").alias("content"))
            return reward.judge_users(request, labels, scorer, ["tried"])

        row = reward.compare(keep(rewards(answers)), keep(rewards(plain)), ["split", "user_id"])
        length = lambda df, n: df.agg(F.avg(F.char_length("response.content")).alias(n))
        row = row.crossJoin(length(answers, "length_personalised")).crossJoin(length(plain, "length_plain"))  # one row each
        out.append(row.withColumn("world", F.lit(number)))
    return reduce(DataFrame.unionByName, out)
