"""Users' rewards from attribute ratings, worlds that turn user attributes into response attributes, paired comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingmill.functions import stats
from ratingmill.functions.portable import draw, normal, order_key
from ratingmill.functions.text import AVOID, FOLLOW
from ratingmill.operators import expand
from ratingmill.operators.scoring import Scorer


def signed(score: Column, side: Column) -> Column:
    """The score, negative for an attribute to avoid; a side that is neither raises."""
    known = side.isin(FOLLOW, AVOID)
    return F.when(side == AVOID, -score).when(known, score).otherwise(F.raise_error(F.lit("unknown side")).cast("double"))


def signed_mean(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By key: the mean signed score; null if any score is missing, whose number is in `missing`."""
    s = signed(F.col("score"), F.col("side"))
    out = df.groupBy(*keys).agg(F.avg(s).alias("reward"), F.count_if(F.col("score").isNull()).alias("missing"))
    return out.withColumn("reward", F.when(F.col("missing") == 0, F.col("reward")))


def judge_users(requests: DataFrame, user_attributes: DataFrame, scorer: Scorer, request: Sequence[str], user: Sequence[str] = ("split", "user_id")) -> DataFrame:
    """(user, request, reward, missing): each request is rated by each attribute of its user."""
    return signed_mean(scorer(expand.join_attributes(requests, user_attributes, user)), [*user, *request])


class RewardJudge:
    """Rewards users' requests and counts how many it was asked to judge, whatever the number of attributes of their users."""

    def __init__(self, user_attributes: DataFrame, scorer: Scorer, user: Sequence[str] = ("split", "user_id")):
        self.user_attributes, self.scorer, self.user = user_attributes, scorer, user
        self.reset()

    def judge(self, requests: DataFrame, request: Sequence[str]) -> DataFrame:
        self._asked += requests.count()
        return judge_users(requests, self.user_attributes, self.scorer, request, self.user)

    def statistics(self) -> dict[str, int]:
        return {"num_judge_requests": self._asked}

    def reset(self) -> None:
        self._asked = 0


def best_attribute(df: DataFrame, keys: Sequence[str], attributes: int) -> DataFrame:
    """By key: the attribute with the largest absolute reward (the first of equals), its label and side."""
    from ratingmill.functions.text import encode_label

    best = stats.first_max(df.where("reward is not null"), list(keys), F.abs("reward"), "attr_ord")
    side = F.when(F.col("reward") >= 0, FOLLOW).otherwise(AVOID)
    return best.withColumns({"label": encode_label(F.col("attr_ord"), F.col("reward"), attributes), "side": side})


def permutation_world(spark: SparkSession, users: int, responses: int, seed: int) -> DataFrame:
    """(i, j, w): a signed permutation matrix; raises unless it is square."""
    if users != responses:
        raise ValueError("a permutation needs as many response attributes as user attributes")
    rows = spark.range(users).select(F.col("id").cast("int").alias("i"))
    ranked = rows.withColumn("j", (F.row_number().over(Window.orderBy(order_key(F.col("i"), seed))) - 1).cast("int"))  # a few dozen rows
    return ranked.withColumn("w", F.when(draw(2, F.col("i"), seed, "sign") == 0, 1.0).otherwise(-1.0))


def dense_world(spark: SparkSession, users: int, responses: int, seed: int) -> DataFrame:
    """(i, j, w): normal draws keyed by place, by the Box-Muller rule."""
    ij = spark.range(users * responses).select(F.floor(F.col("id") / responses).cast("int").alias("i"), F.pmod("id", F.lit(responses)).cast("int").alias("j"))
    return ij.withColumn("w", normal(F.col("i"), F.col("j"), seed))


def apply_world(user_attributes: DataFrame, world: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, j, value): the world's matrix times each user's vector of sides, 1 to follow and -1 to avoid. user_attributes: (key, i, side).

    A join and a sum: the world is as large as the attribute lists' product and broadcast if that is a parameter table."""
    v = F.when(F.col("side") == FOLLOW, 1.0).when(F.col("side") == AVOID, -1.0).otherwise(0.0)
    out = user_attributes.withColumn("v", v).join(expand.small(world), "i")
    return out.groupBy(*key, "j").agg(F.sum(F.col("w") * F.col("v")).alias("value"))


def apply_matrix(matrix: Column, vector: Column) -> Column:
    """An array of rows times an array."""
    return F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, vector, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))


def attributes_of(values: DataFrame, key: Sequence[str], most: int | None = None) -> DataFrame:
    """(key, j, side, rank): the attributes that a vector asks for.

    Without a cap those above zero are followed and those below avoided, zero is left out. With one, the `most` largest by absolute
    value (the first of equals) are taken, and zero is avoided."""
    if most is None:
        return values.where("value <> 0").select(*key, "j", F.when(F.col("value") > 0, FOLLOW).otherwise(AVOID).alias("side"))
    w = Window.partitionBy(*key).orderBy(F.desc(F.abs("value")), "j")
    ranked = values.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.select(*key, "j", F.when(F.col("value") > 0, FOLLOW).otherwise(AVOID).alias("side"), "rank")


def compare(personalised: DataFrame, plain: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: win, tie and loss rate of personalised rewards against plain ones, means and sample deviations of both."""
    a, b = F.col("a"), F.col("b")
    both = personalised.select(*key, F.col("reward").alias("a")).join(plain.select(*key, F.col("reward").alias("b")), list(key))
    return both.agg(
        *stats.win_tie_loss(a, b), F.avg("a").alias("mean_personalised"), F.stddev_samp("a").alias("std_personalised"),
        F.avg("b").alias("mean_plain"), F.stddev_samp("b").alias("std_plain"), F.count("*").alias("n"),
    )
