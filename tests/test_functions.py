import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratingmill.functions import logprobs, stats, text
from ratingmill.operators import factors, recovery, reward, scoring


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items()))
    return df.select(col.alias("x")).first().x


def test_rating_parser(spark):
    want = {"8": 8, "10/10": 10, "100": None, "": None, "score: ten": None, "7th": None, "9\n": 9, "1_0": None, "Rating: 8/10": 10, "7.5": 5, "0": None, "11 then 3": 3, "-3": 3, "é5": None, "I'd say 6 or 7.": 7, "4 out of 5 stars": 5}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.x for r in df.select("t", text.parse_rating(F.col("t")).alias("x")).collect()} == want


def test_reasoning(spark):
    want = {
        "analysisR assistantfinalA": ("R", "A"), "<think> r </think> a ": ("r", "a"), "<think>x</think>y assistantfinal z": ("</think>y", "z"),
        "<think>unterminated": (None, "<think>unterminated"), "  plain ": (None, "  plain "),
    }
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", text.split_reasoning(F.col("t")).alias("x"))
    got = {r.t: (r.x.reasoning, r.x.content) for r in df.collect()}
    del want["<think>x</think>y assistantfinal z"]
    assert got.pop("<think>x</think>y assistantfinal z")[1] == "z" and got == want


def test_style_and_templates(spark):
    df = spark.createDataFrame([([("verbose", "follow"), ("formal", "avoid"), ("dry", "avoid")],), ([("warm", "avoid")],), ([],)], "a array<struct<attribute:string,side:string>>")
    assert [r.x for r in df.select(text.style_phrase(F.col("a")).alias("x")).collect()] == ["VERY: verbose\nNOT AT ALL: formal, dry", "NOT AT ALL: warm", ""]
    assert one(spark, text.fill("a {t} b {u}", t=F.col("t"), u=F.lit("{t}")), t="{u}") == "a {u} b {t}"


def test_statistics(spark):
    df = spark.createDataFrame([(8.0, 3.0), (6.0, 5.0), (9.0, 2.0), (3.0, 7.0)], "a double, b double")
    r = df.agg(stats.pearson(F.col("a"), F.col("b")).alias("r"), F.stddev_pop(F.col("a") + F.col("b")).alias("s"), stats.pearson(F.lit(1.0), F.col("b")).alias("none")).first()
    assert r.r == pytest.approx(-0.9943343, abs=1e-6) and r.s == pytest.approx(0.4330127) and r.none is None
    assert stats.pearson_p(r.r, 4) == pytest.approx(0.0056658, abs=1e-6) and stats.pearson_p(None, 4) is None
    for n, want in {1: 12.706205, 2: 4.302653, 9: 2.262157, 49: 2.009575, 99: 1.984217}.items():
        assert stats.t_quantile(0.975, n) == pytest.approx(want, abs=1e-5)
    e = spark.createDataFrame([("a", x) for x in (1.0, 1.0, 2.0, 2.0)] + [("b", float(x)) for x in (1, 2, 3, 4)] + [("c", 5.0)] * 3 + [("d", x) for x in (0.5, 1.5, 2.5)], "k string, v double")
    got = {x.k: x.entropy for x in stats.entropy(e, ["k"], "v").collect()}
    assert got["a"] == pytest.approx(1) and got["b"] == pytest.approx(2) and abs(got["c"]) < 1e-9 and got["d"] == pytest.approx(0.9182958)
    bins = stats.histogram(spark.createDataFrame([(10.0,), (11.0,), (-10.0,), (0.0,)], "v double"), [], "v", -10, 10, 20).collect()
    assert sorted((b.bin, b["count"]) for b in bins) == [(0, 1), (10, 1), (19, 1)]
    ci = stats.mean_ci95(spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 2.0), ("z", None), ("z", 1.0), ("z", 2.0)], "k string, s double"), ["k"], "s")
    got = {x.k: (x.mean, x.ci95, x["count"]) for x in ci.collect()}
    assert got["x"][1] == pytest.approx(12.706205, abs=1e-4) and got["y"] == (2.0, None, 1) and got["z"] == (1.5, None, 2)


def test_published_judge_table_invariants():
    """The overall row of a judge recomposes from its pairs: mean by weight, deviation by the law of total variance."""
    pairs = [(10.5438, 1.7495), (11.6188, 1.7098), (11.4438, 1.9129), (10.4312, 1.2481), (10.7812, 2.0361), (11.575, 2.1724)]
    mean = sum(m for m, _ in pairs) / 6
    assert mean == pytest.approx(11.0656, abs=1e-4)
    assert math.sqrt(sum(s * s + m * m for m, s in pairs) / 6 - mean**2) == pytest.approx(1.8943, abs=1e-4)
    for r, p in ((-0.1432, 0.0708), (-0.2106, 0.0075), (-0.088, 0.2687), (0.1729, 0.0288), (-0.0125, 0.8753)):
        assert stats.pearson_p(r, 160) == pytest.approx(p, abs=2e-3)


def test_log_probabilities(spark):
    df = spark.createDataFrame([({1: math.log(0.6), 7: math.log(0.4)}, {0: math.log(0.5)})], "first map<int,double>, second map<int,double>")
    d = df.select(logprobs.rating_distribution(F.col("first"), F.col("second")).alias("d")).first().d
    assert [round(x, 6) for x in d] == [0.3, 0, 0, 0, 0, 0, 0.4, 0, 0, 0.3]
    assert df.select(logprobs.weighted_rating(logprobs.rating_distribution(F.col("first"), F.col("second"))).alias("x")).first().x == pytest.approx(0.3 + 2.8 + 3)
    assert one(spark, logprobs.yes_probability(F.log(F.col("a")), F.log(F.col("b"))), a=0.75, b=0.25) == pytest.approx(0.75)
    with pytest.raises(Exception, match="too little"):
        one(spark, logprobs.yes_probability(F.log(F.col("a")), F.log(F.col("b"))), a=0.5, b=0.25)
    assert one(spark, logprobs.log_add(F.array(F.col("a"), F.col("b"))), a=1000.0, b=1000.0) == pytest.approx(1000 + math.log(2))


def test_labels_and_rewards(spark):
    df = spark.createDataFrame([("u", 0, -9.0), ("u", 1, 9.0), ("u", 2, 2.0), ("v", 0, 2.0), ("v", 1, 9.0), ("v", 2, -3.0)], "k string, attr_ord int, reward double")
    got = {r.k: (r.label, r.side) for r in reward.best_attribute(df, ["k"], 3).collect()}
    assert got == {"u": (0, "avoid"), "v": (4, "follow")}
    s = spark.createDataFrame([("a", 8.0, "follow"), ("a", 3.0, "avoid"), ("b", None, "follow"), ("b", 1.0, "avoid")], "k string, score double, side string")
    assert {r.k: (r.reward, r.missing) for r in reward.signed_mean(s, ["k"]).collect()} == {"a": (2.5, 0), "b": (None, 1)}
    v = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, -2.0)], "j int, value double").withColumn("k", F.lit(1))
    free = {(r.j, r.side) for r in reward.attributes_of(v, ["k"]).collect()}
    assert free == {(1, "follow"), (2, "avoid")}
    assert [(r.j, r.side) for r in reward.attributes_of(v, ["k"], 3).orderBy("rank").collect()] == [(2, "avoid"), (1, "follow"), (0, "avoid")]
    x = spark.createDataFrame([(1, 3.0), (2, 5.0), (3, 5.0)], "u int, reward double")
    y = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 6.0)], "u int, reward double")
    r = reward.compare(x, y, ["u"]).first()
    assert (round(r.win_rate, 4), round(r.tie_rate, 4), round(r.loss_rate, 4)) == (0.3333, 0.3333, 0.3333)
    with pytest.raises(ValueError):
        reward.permutation_world(spark, 2, 3, 1)
    assert reward.dense_world(spark, 40, 50, 3).agg(F.stddev("w")).first()[0] == pytest.approx(1, abs=0.06)


def test_recovery(spark):
    rows = [(1, "a", "a", 9.0), (1, "b", "a", 9.0), (2, "a", "b", 1.0), (2, "b", "b", 5.0)]
    r = recovery.accuracy(spark.createDataFrame(rows, "p int, response_attr string, gt_attr string, score double"), "p").first()
    assert (r.accuracy, r.strict_accuracy, r.mean_margin, r.prompts) == (1.0, 0.5, 1.0, 2)


def test_scorers(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "i int, prompt string")
    made = scoring.asked(lambda p: "no" if p == "p3" else f"Rating: {len(p)}", scoring.JudgeOptions(default=5.0, concurrency=4))(df).collect()
    assert {r.score for r in made} == {2.0, 3.0, 5.0}
    out = scoring.retried(lambda d, k: d.withColumn("score", F.when(F.col("i") % 3 <= k, 7.0)), lambda d: d.persist(), scoring.JudgeOptions(retries=2))(df).collect()
    assert len(out) == 40 and sum(r.score is None for r in out) == sum(i % 3 == 2 for i in range(40))
    same = scoring.deduplicated(scoring.surrogate_scorer("prompt"), ["prompt"])(df.unionAll(df))
    assert same.count() == 80 and same.where("score is null").count() == 0


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 5), st.integers(0, 10**6))
def test_varimax_keeps_communalities(k, seed):
    import numpy as np

    a = np.random.default_rng(seed).normal(size=(9, k))
    b = factors.varimax(a)
    assert np.allclose((a**2).sum(1), (b**2).sum(1)) and ((b**2).var(0).sum() >= (a**2).var(0).sum() - 1e-9)


def test_schedule():
    assert factors.schedule(12) == [2, 4, 6, 8, 10, 12] and factors.schedule(5) == [2, 4, 5] and factors.schedule(1) == [1]


def test_factor_analysis(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    f = rng.normal(size=(300, 2))
    x = np.c_[f[:, [0]] + 0.3 * rng.normal(size=(300, 3)), f[:, [1]] + 0.3 * rng.normal(size=(300, 3)), np.ones((300, 1))] * 2 + 5
    rows = [(i, j, f"a{j}", None if (i, j) == (0, 0) else float(x[i, j])) for i in range(300) for j in range(7)]
    out = factors.analyse(spark.createDataFrame(rows, "conv_ord long, attr_ord int, attribute string, score double"), rounds=20)
    assert [r.attribute for r in out["removed"].collect()] == ["a6"]
    reps = {r.attribute for r in out["representatives"].where("k = 2").collect()}
    assert len({int(r[1]) // 3 for r in reps}) == 2
    filled = factors.imputed(spark.createDataFrame(rows, "conv_ord long, attr_ord int, attribute string, score double"))
    r, names = factors.matrix(factors.correlations(filled.where("attr_ord < 6")))
    z = x[:, :6].copy()
    z[0, 0] = z[1:, 0].mean()
    z = (z - z.mean(0)) / z.std(0)
    want = z.T @ z / 299
    np.fill_diagonal(want, 1)
    assert np.allclose(r, want)
