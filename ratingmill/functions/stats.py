"""Statistics as columns and aggregates. Missing is null; NaN is turned into null where data come in."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def known(c: Column) -> Column:
    """c, null where it is NaN."""
    return F.when(~F.isnan(c), c)


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: the correlation over rows that have both; null for fewer than two rows or a constant side."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(a) > 1, F.try_divide(F.covar_pop(a, b), F.when(spread > 0, spread)))


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_part(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    return beta_part(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The p quantile of Student's t, p > 0.5, by bisection."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def pearson_p(r: float | None, n: int | None) -> float | None:
    if r is None or n is None or r != r or n < 3:
        return None if r is None or n is None or r != r or n < 2 else 1.0
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation r over n rows; for the few rows of a summary."""

    def each(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([pearson_p(None if x is None or x != x else float(x), None if k is None or k != k else int(k)) for x, k in zip(r, n)], dtype="float64")

    return F.pandas_udf(each, DoubleType())(r, n)


def t_975(n: Column) -> Column:
    """The 0.975 quantile of Student's t with n - 1 degrees of freedom; null for fewer than two rows."""

    def each(n: pd.Series) -> pd.Series:
        known = {k: t_quantile(0.975, int(k) - 1) for k in n.dropna().unique() if k > 1}  # a few sizes of groups
        return n.map(known).astype("float64")

    return F.pandas_udf(each, DoubleType())(n)


def mean_ci95(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """By key: mean, half width of the 95 % interval, count of scores. The interval is null if a score is missing or there is one."""
    out = df.groupBy(*keys).agg(
        F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.count(score).alias("count"), F.count("*").alias("rows")
    )
    ci = F.when((F.col("rows") == F.col("count")) & (F.col("rows") > 1), t_975(F.col("rows")) * F.col("sd") / F.sqrt("rows"))
    return out.select(*keys, "mean", ci.alias("ci95"), "count")


def entropy(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """By key: bits of entropy of the scores rounded half to even."""
    n = df.where(F.col(score).isNotNull()).groupBy(*keys, F.rint(score).cast("int").alias("value")).count()
    n = n.withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy(*keys)))
    return n.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))).alias("entropy"))


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """By key and bin: count and share of values in [low, high]; bins are half open, the last one is closed."""
    v, width = F.col(value), (high - low) / bins
    at = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
    n = df.where(v.between(low, high)).groupBy(*keys, at.alias("bin")).count()
    share = F.col("count") / F.sum("count").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    return n.select(*keys, "bin", F.col("count"), share.alias("share"))


def first_max(df: DataFrame, keys: list[str], by: Column, ordinal: str) -> DataFrame:
    """By key: the row with the largest `by`, the first in ordinal order of equals."""
    best = df.select(*keys, F.struct(by.alias("__by"), (-F.col(ordinal)).alias("__ord"), *[F.col(c) for c in df.columns if c not in keys]).alias("__row"))
    best = best.groupBy(*keys).agg(F.max("__row").alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in df.columns if c not in keys])


def win_tie_loss(a: Column, b: Column) -> list[Column]:
    """Aggregates over rows that have both numbers."""
    a, b = known(a), known(b)
    win, tie = F.avg((a > b).cast("double")), F.avg((a == b).cast("double"))
    return [win.alias("win_rate"), tie.alias("tie_rate"), (1 - win - tie).alias("loss_rate")]
