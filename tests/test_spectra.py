import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingmill.operators import factors


def direct(rows, columns, rounds, seed):
    """Spectra of correlations of normal rows that are drawn one by one."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(rounds):
        r = np.corrcoef(rng.normal(size=(rows, columns)).T) * rows / (rows - 1)
        np.fill_diagonal(r, 1.0)
        out.append(np.linalg.eigvalsh(r)[::-1])
    return np.array(out)


@pytest.mark.parametrize("rows,columns", [(200, 8), (9, 8), (6, 8)])
def test_noise_spectra_are_those_of_drawn_rows(spark, rows, columns):
    got = factors.random_spectra(spark, rows, columns, 400).toPandas().pivot(index="round", columns="rank", values="value").to_numpy()
    want = direct(rows, columns, 3000, 1)
    error = want.std(0) * np.sqrt(1 / 400 + 1 / 3000)
    assert got.shape == (400, columns) and (np.abs(got.mean(0) - want.mean(0)) < 5 * error + 1e-9).all()
    assert np.abs(np.percentile(got, 95, axis=0) - np.percentile(want, 95, axis=0)).max() < 0.25 * want.std(0).max() + 1e-9


def test_many_rows_cost_no_more_than_few(spark):
    top = factors.random_spectra(spark, 10**9, 12, 5).where("rank = 0").agg(F.max("value")).first()[0]
    assert 1 < top < 1.001


def test_leading_components_agree_with_the_whole_matrix(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 40)) + np.repeat(r.normal(size=(300, 5)), 8, axis=1) * [[0.5, 1, 1.5, 2, 2.5] * 8]
    rows = [(i, j, f"a{j:02d}", float(x[i, j]) if j != 39 else 4.0) for i in range(300) for j in range(40)]  # the last one is flat
    df = spark.createDataFrame(rows, "conv_ord long, attr_ord int, attribute string, score double").repartition(5)
    matrix, names = factors.matrix(factors.correlations(df))
    value, vector = factors.spectrum(matrix)
    got, own, attributes = factors.leading(factors.standardised(df), 5)
    assert attributes == names and np.allclose(got, value[:5], atol=1e-8)
    assert np.allclose(np.abs((own * vector[:, :5]).sum(0)), 1, atol=1e-5)


def test_wide_lists(spark):
    n, p = 40, 3000
    df = spark.range(n * p).select((F.col("id") % n).alias("conv_ord"), F.floor(F.col("id") / n).cast("int").alias("attr_ord"), F.randn(7).alias("z"))
    value, vector, attributes = factors.leading(df, 3, rounds=4)
    assert vector.shape == (p, 3) and len(attributes) == p and value[0] >= value[1] >= value[2] > 0


def test_varimax_warns_when_sweeps_are_not_enough():
    x = np.random.default_rng(1).normal(size=(30, 4))
    with pytest.warns(UserWarning, match="is left after 1 sweeps"):
        factors.varimax(x, sweeps=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        factors.varimax(x)
