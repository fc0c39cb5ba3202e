"""Factor analysis of rating matrices in long form (conv_ord, attr_ord, attribute, score).

All that is as long as the conversations is distributed; what is as large as the attributes' square is numpy on the driver.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingmill.functions import stats
from ratingmill.functions.portable import normal
from ratingmill.operators.expand import small

#: Attributes whose correlation matrix may come to the driver.
MOST_ATTRIBUTES = 5000
FLAT = 1e-10


def imputed(ratings: DataFrame) -> DataFrame:
    """Missing scores become their attribute's mean. Means are aggregated first and broadcast: one row for each attribute."""
    score = stats.known(F.col("score"))
    means = ratings.groupBy("attr_ord").agg(F.avg(score).alias("__mean"))
    return ratings.join(small(means), "attr_ord").withColumn("score", F.coalesce(score, "__mean")).drop("__mean")


def spreads(ratings: DataFrame) -> DataFrame:
    """(attr_ord, attribute, n, mean, std, flat) in one aggregate: population deviation; flat: no spread at all."""
    own = ratings.groupBy("attr_ord", "attribute").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return own.withColumn("flat", F.col("std") <= FLAT)


def attribute_stats(ratings: DataFrame) -> DataFrame:
    """(attr_ord, attribute, n, mean, std, flat, entropy)."""
    return spreads(ratings).join(stats.entropy(ratings, ["attr_ord"], "score"), "attr_ord", "left")


def informative(ratings: DataFrame, least: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Ratings of the attributes with enough entropy, and the attributes that are removed."""
    s = attribute_stats(ratings).select("attr_ord", "attribute", "entropy")
    keep = s.where(F.col("entropy") >= least)
    return ratings.join(small(keep.select("attr_ord")), "attr_ord", "left_semi"), s.join(keep, "attr_ord", "left_anti")


def standardised(ratings: DataFrame, noise: int | None = None) -> DataFrame:
    """With z: score less mean by population deviation. A flat attribute is divided by one, so that z is zero; with a seed for noise
    it gets normal draws keyed by conversation and attribute instead."""
    s = spreads(ratings).select("attr_ord", "mean", "std", F.col("flat").alias("__flat"))
    safe = F.when(F.col("std") > FLAT, F.col("std")).otherwise(1.0)
    z = (F.col("score") - F.col("mean")) / safe
    if noise is not None:
        z = F.when(F.col("__flat"), normal(F.col("conv_ord"), F.col("attr_ord"), noise)).otherwise(z)
    return ratings.join(small(s), "attr_ord").withColumn("z", z).drop("mean", "std", "__flat")


def correlations(ratings: DataFrame, noise: int | None = None) -> DataFrame:
    """(i, j, r) of all pairs of attributes: sums of z products over n - 1, the diagonal one.

    Each conversation's row of z is gathered (as long as the attribute list) and tasks add up their outer products, so that what is
    shuffled is one matrix for each task and not a row for each pair and conversation."""
    z = standardised(ratings, noise)
    k = ratings.select(F.max("attr_ord")).first()[0]
    if k is None:
        return ratings.sparkSession.createDataFrame([], "i int, j int, r double")
    if k >= MOST_ATTRIBUTES:
        raise ValueError(f"{k + 1} attributes are too many for a matrix")
    k += 1
    rows = z.groupBy("conv_ord").agg(F.array_sort(F.collect_list(F.struct("attr_ord", "z"))).alias("row"))
    rows = rows.select(F.transform("row", lambda c: c["attr_ord"]).alias("at"), F.transform("row", lambda c: c["z"]).alias("z"))

    def outer(batches):
        total, seen = np.zeros((k, k)), np.zeros(k)
        n = 0
        for b in batches:
            at, size = np.concatenate(b["at"].to_numpy()), b["at"].map(len).to_numpy()
            x = np.zeros((len(b), k))
            x[np.repeat(np.arange(len(b)), size), at] = np.concatenate(b["z"].to_numpy())
            seen += np.bincount(at, minlength=k)
            total += x.T @ x
            n += len(b)
        i, j = np.nonzero(np.outer(seen, seen))
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j], "n": n})

    parts = rows.mapInPandas(outer, "i int, j int, s double, n long")
    r = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.sum("s") / (F.sum("n") - 1))
    return parts.groupBy("i", "j").agg(r.alias("r"))


def distances(corr: DataFrame) -> DataFrame:
    """(i, j, distance) of all pairs of attributes: one less the size of their correlation, the same both ways, zero to itself."""
    other = corr.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("r").alias("back"))
    d = 1 - (F.abs("r") + F.abs("back")) / 2
    return corr.join(other, ["i", "j"]).select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(d).alias("distance"))


def antonyms(ratings: DataFrame, pairs) -> DataFrame:
    """For each pair of names that are both rated: correlation, and mean, deviation, least and largest of each pole and of the sum."""
    spark = ratings.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair_ord int, a string, b string"))
    side = lambda c, s: ratings.select("conv_ord", F.col("attribute").alias(c), F.col("score").alias(s))
    both = side("a", "x").join(table, "a").join(side("b", "y"), ["conv_ord", "b"])
    of = lambda c, n: [F.avg(c).alias(f"mean_{n}"), F.stddev_pop(c).alias(f"std_{n}"), F.min(c).alias(f"min_{n}"), F.max(c).alias(f"max_{n}")]
    total = F.col("x") + F.col("y")
    return both.groupBy("pair_ord", "a", "b").agg(stats.pearson(F.col("x"), F.col("y")).alias("corr"), *of(F.col("x"), "a"), *of(F.col("y"), "b"), *of(total, "sum"))


def matrix(corr: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The correlation matrix on the driver and its attributes; raises if a number is not finite."""
    rows = corr.toPandas()
    names = sorted(set(rows["i"]))
    at = {a: n for n, a in enumerate(names)}
    out = np.eye(len(names))
    out[rows["i"].map(at), rows["j"].map(at)] = rows["r"]
    if not np.isfinite(out).all():
        raise ValueError("the correlation matrix has missing values")
    return out, names


def spectrum(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, the largest first, and their vectors."""
    value, vector = np.linalg.eigh(r)
    return value[::-1], vector[:, ::-1]


def random_spectra(spark: SparkSession, rows: int, columns: int, rounds: int = 100, seed: int = 42) -> DataFrame:
    """(round, rank, value): eigenvalues of correlation matrices of normal noise, a task for each few rounds.

    The scatter of so many centred normal rows has Wishart's distribution, which is drawn by Bartlett's triangular factor: as many
    numbers as half a matrix, however many rows there are. With fewer rows than columns the rows themselves are drawn."""

    def scatter(rng: np.random.Generator) -> np.ndarray:
        if rows <= columns:
            x = rng.normal(size=(rows, columns))
            x -= x.mean(0)
            return x.T @ x
        factor = np.tril(rng.normal(size=(columns, columns)), -1)
        factor[np.diag_indices(columns)] = np.sqrt(rng.chisquare(rows - 1 - np.arange(columns)))
        return factor @ factor.T

    def each(batches):
        for b in batches:
            out = []
            for k in b["id"]:
                s = scatter(np.random.default_rng([seed, int(k)]))
                sd = np.sqrt(np.diag(s))
                r = s / np.outer(sd, sd) * rows / (rows - 1)
                np.fill_diagonal(r, 1.0)
                out.append(pd.DataFrame({"round": int(k), "rank": np.arange(columns, dtype=np.int32), "value": np.linalg.eigvalsh(r)[::-1]}))
            if out:
                yield pd.concat(out)

    ids = spark.range(0, rounds, 1, min(rounds, 4 * spark.sparkContext.defaultParallelism))
    return ids.mapInPandas(each, "round long, rank int, value double")


def parallel_analysis(spark: SparkSession, eigenvalues: np.ndarray, rows: int, rounds: int = 100, seed: int = 42) -> tuple[int, DataFrame]:
    """(k, table): how many eigenvalues exceed the 95th percentile of noise at their rank, at least one; (rank, value, threshold)."""
    noise = random_spectra(spark, rows, len(eigenvalues), rounds, seed).groupBy("rank").agg(F.percentile("value", 0.95).alias("threshold"))
    own = spark.createDataFrame([(i, float(v)) for i, v in enumerate(eigenvalues)], "rank int, value double")
    table = own.join(noise, "rank")
    return max(1, table.where("value > threshold").count()), table


def leading(z: DataFrame, k: int, rounds: int = 300, tolerance: float = 1e-10, seed: int = 42, extra: int = 8) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(eigenvalues, vectors, attributes) of the correlation matrix of standardised ratings (conv_ord, attr_ord, z), the k largest.

    Blocked subspace iteration for lists that are too wide for a matrix of all pairs: the driver holds attributes x (k + extra)
    numbers, tasks multiply their rows by them and by themselves again, and a row for each attribute and task is added up. extra: more
    vectors that are carried along, which makes the last of the k converge; rounds end when the eigenvalues of the k stay the same."""
    spark = z.sparkSession
    squares = {r.attr_ord: r.s for r in z.groupBy("attr_ord").agg(F.sum(F.col("z") * F.col("z")).alias("s")).collect()}  # as many as the list has
    attributes = sorted(squares)
    at, p = {a: i for i, a in enumerate(attributes)}, len(attributes)
    width = min(p, k + extra)
    rows = z.groupBy("conv_ord").agg(F.collect_list(F.struct("attr_ord", "z")).alias("own")).select("own.attr_ord", "own.z").persist()
    try:
        n = rows.count()
        own_square = np.array([squares[a] for a in attributes])[:, None] / n  # one, or zero without spread
        q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, width)))
        names, before = [f"v{i}" for i in range(width)], np.zeros(width)
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(q)

            def each(batches, sent=sent):
                total, own = np.zeros((p, width)), sent.value
                for b in batches:
                    for places, values in zip(b["attr_ord"], b["z"]):
                        i, x = np.fromiter((at[a] for a in places), np.int64), np.asarray(values, float)
                        total[i] += np.outer(x, x @ own[i])
                yield pd.DataFrame({"i": np.arange(p), **{c: total[:, j] for j, c in enumerate(names)}})

            added = rows.mapInPandas(each, "i long, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
            y = added.toPandas().set_index("i").sort_index().to_numpy() / n  # attributes x (k + extra)
            y = (y - own_square * q) * n / (n - 1) + q  # sums over n - 1 beside a diagonal of one, as in correlations
            sent.unpersist()
            small = q.T @ y
            value, turn = np.linalg.eigh((small + small.T) / 2)
            value, turn = value[::-1], turn[:, ::-1]
            vectors = q @ turn
            if np.abs(value[:k] - before[:k]).max() <= tolerance * max(1.0, value[0]):
                break
            before = value
            q, _ = np.linalg.qr(y @ turn)
    finally:
        rows.unpersist()
    return value[:k], vectors[:, :k], attributes


def schedule(k95: int) -> list[int]:
    """2, 4, … up to k95, and k95 itself."""
    out = list(range(2, k95 + 1, 2))
    return out if out and out[-1] == k95 else [*out, k95]


def explained(value: Column, rank: Column) -> Column:
    """Window: the share of variance up to a rank. For a spectrum, which has a row for each attribute."""
    return F.sum(value).over(Window.orderBy(rank)) / F.sum(value).over(Window.partitionBy(F.lit(1)))


def varimax(loadings: np.ndarray, tolerance: float = 1e-6, sweeps: int = 500) -> np.ndarray:
    """Loadings rotated to the largest variance of squared loadings, without row scaling.

    A sweep turns each pair of components by the angle at which Kaiser's criterion is largest for the pair; sweeps end when all
    angles are small. Warns if they are not after the last sweep."""
    out = np.array(loadings, float)
    n, k = out.shape
    for _ in range(sweeps):
        largest = 0.0
        for p in range(k - 1):
            for q in range(p + 1, k):
                z = out[:, p] + 1j * out[:, q]
                square = z * z
                criterion = (square * square).sum() - square.sum() ** 2 / n
                angle = np.angle(criterion) / 4
                if abs(angle) > largest:
                    largest = abs(angle)
                if abs(angle) > tolerance:
                    z = z * np.exp(-1j * angle)
                    out[:, p], out[:, q] = z.real, z.imag
        if largest <= tolerance:
            break
    else:
        warnings.warn(f"varimax: an angle of {largest:.2g} is left after {sweeps} sweeps", stacklevel=2)
    return out


def components(spark: SparkSession, r: np.ndarray, names: dict[int, str], attributes: list[int], ks: list[int]) -> DataFrame:
    """(k, comp, rank, ssl, attr_ord, attribute, loading): rotated components for each k; rank orders them by squared loadings."""
    value, vector = spectrum(r)
    rows = []
    for k in ks:
        turned = varimax(vector[:, :k] * np.sqrt(np.maximum(value[:k], 0)))
        ssl = (turned**2).sum(0)
        rank = {c: i + 1 for i, c in enumerate(sorted(range(k), key=lambda c: -ssl[c]))}
        for c in range(k):
            rows += [(k, c, rank[c], float(ssl[c]), a, names[a], float(turned[i, c])) for i, a in enumerate(attributes)]
    return spark.createDataFrame(rows, "k int, comp int, rank int, ssl double, attr_ord int, attribute string, loading double")


def top_loadings(comps: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("k", "comp").orderBy(F.desc(F.abs("loading")), "attr_ord")
    return comps.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def representatives(comps: DataFrame) -> DataFrame:
    """(k, comp, rank, attribute): the attribute with the largest absolute loading; both component orders are columns."""
    return top_loadings(comps, 1).select("k", "comp", "rank", "attribute")


def analyse(ratings: DataFrame, least_entropy: float = 1.5, rounds: int = 100, seed: int = 42) -> dict[str, DataFrame]:
    """The whole analysis: stats, removed attributes, spectrum, components and representatives."""
    spark = ratings.sparkSession
    full = imputed(ratings)
    kept, removed = informative(full, least_entropy)
    r, attributes = matrix(correlations(kept))
    value, _ = spectrum(r)
    k95, table = parallel_analysis(spark, value, kept.select("conv_ord").distinct().count(), rounds, seed)
    names = {x.attr_ord: x.attribute for x in kept.select("attr_ord", "attribute").distinct().collect()}
    comps = components(spark, r, names, attributes, schedule(min(k95, len(attributes))))
    return {"stats": attribute_stats(full), "removed": removed, "spectrum": table.withColumn("explained", explained(F.col("value"), F.col("rank"))), "components": comps, "representatives": representatives(comps)}
