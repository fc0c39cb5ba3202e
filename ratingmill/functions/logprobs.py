"""Scores from the log-probabilities of a model's tokens (MAP<INT, DOUBLE> by digit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_add(xs: Column) -> Column:
    """log(sum(exp(x))) of an array; null if it is empty."""
    top = F.array_max(xs)
    return F.when(F.size(xs) > 0, top + F.log(F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))))


def log_sum_exp(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By key: (top, log_sum) of a column; the largest value is aggregated first, so that no group is gathered."""
    top = df.groupBy(*keys).agg(F.max(value).alias("top"))
    return df.join(top, keys).groupBy(*keys).agg(F.first("top").alias("top"), (F.first("top") + F.log(F.sum(F.exp(F.col(value) - F.col("top"))))).alias("log_sum"))


def _p(m: Column, digit: int) -> Column:
    return F.coalesce(F.exp(F.try_element_at(m, F.lit(digit))), F.lit(0.0))


def rating_distribution(first: Column, second: Column) -> Column:
    """Probabilities of the ratings 1 to 10 from the first token's digits and, for a first "1", the second token's.

    10 is a first 1 and a second 0; 1 is a first 1 that no digit follows."""
    digits = F.aggregate(F.array(*[_p(second, d) for d in range(10)]), F.lit(0.0), lambda a, x: a + x)
    one = F.when(digits >= 1 - 1e-10, 0.0).otherwise(_p(first, 1) * (1 - digits))
    return F.array(one, *[_p(first, d) for d in range(2, 10)], _p(first, 1) * _p(second, 0))


def weighted_rating(probabilities: Column, least: float = 0.5) -> Column:
    """The mean rating under the renormalised probabilities; raises if they sum to less than `least`."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x)
    ranked = F.transform(probabilities, lambda p, i: p * (i + 1))
    mean = F.aggregate(ranked, F.lit(0.0), lambda a, x: a + x) / total
    return F.when(total >= least, mean).otherwise(F.raise_error(F.lit("the ratings have too little probability")).cast("double"))


def low_mass(probabilities: Column, least: float = 0.9) -> Column:
    """Whether a weighted rating deserves a warning."""
    return F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x) < least


def yes_probability(yes: Column, no: Column, least: float = 0.98) -> Column:
    """P(yes) against no; raises if a token is missing or both have less than `least` together."""
    sound = yes.isNotNull() & no.isNotNull() & (F.exp(yes) + F.exp(no) >= least)
    return F.when(sound, 1 / (1 + F.exp(no - yes))).otherwise(F.raise_error(F.lit("yes and no have too little probability")).cast("double"))
