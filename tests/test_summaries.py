import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ratingmill.functions import stats
from ratingmill.operators import benchmark, expand, factors, reward, scoring
from ratingmill.sources import corpus, sinks

TEXTS = ["a\r\nb", "a\rb", "x\\", '\\"q\\"', '"', "  blanks  ", None, 'a,b\n"c"', "\r", '\\,"', "end\n", '"\\"', "", " é "]


def test_csv_keeps_all_texts(spark, tmp_path):
    rows = [(i, 1, "warm", "follow", t, t) for i, t in enumerate(TEXTS)]
    ddl = "id int, prompt_id int, attribute string, side string, prompt string, response string"
    at = str(tmp_path / "generated")
    sinks.plain_csv(spark.createDataFrame(rows, ddl), at)
    got = {r.id: (r.prompt, r.response) for r in corpus.generated_csv(spark, at).collect()}
    assert got == {i: (t or None, t or None) for i, t in enumerate(TEXTS)}  # an empty text is read as null


def test_bias_csv_keeps_texts_and_missing_scores(spark, tmp_path):
    rows = [("m", "plain", i, t, i, t, t, None if i % 2 else i) for i, t in enumerate(TEXTS)]
    ddl = "model string, system_prompt string, persona_id int, persona string, prompt_id int, prompt string, response string, score int"
    at = str(tmp_path / "bias")
    sinks.bias_csv(spark.createDataFrame(rows, ddl), at)
    got = sorted((r.persona_id, r.persona, r.response, r.score) for r in corpus.bias_csv(spark, at).collect())
    assert got == [(i, t or None, t or None, None if i % 2 else i) for i, t in enumerate(TEXTS)]


def test_report_is_printed_in_order_and_bounded(spark, capsys):
    df = spark.createDataFrame([(2, 1.005, None), (1, 2.5, 0.125), (3, None, None)], "k int, mean double, ci95 double")
    assert sinks.printed(df, sinks.mean_line("mean", "ci95"), [F.col("k")]) == 3
    assert capsys.readouterr().out.splitlines() == ["2.50 ± 0.12", "1.00 ± nan", "nan ± nan"]
    with pytest.raises(ValueError):
        sinks.printed(df, F.col("k").cast("string"), [F.col("k")], most=2)
    assert capsys.readouterr().out == ""


def test_interval_of_a_run(spark):
    scores = [1.0, 4.0, 4.0, 7.0]
    rows = [("a", s) for s in scores] + [("b", 1.0), ("b", None), ("c", 3.0)]
    got = {r.run: r for r in stats.mean_ci95(spark.createDataFrame(rows, "run string, score double"), ["run"], "score").collect()}
    assert got["a"].ci95 == pytest.approx(3.182446305284263 * np.std(scores, ddof=1) / 2)
    assert got["b"].ci95 is None and got["b"]["count"] == 1 and got["c"].ci95 is None


def test_tables_too_large_in_rows_or_bytes_are_not_broadcast(spark, monkeypatch):
    left, right = spark.range(3).withColumnRenamed("id", "k"), spark.createDataFrame([(i, "x" * 100) for i in range(20)], "id int, text string")
    assert expand.with_each(left, right).count() == 60
    monkeypatch.setattr(expand, "MOST_BYTES", 1000)
    assert expand.small(right) is right
    with pytest.raises(ValueError):
        expand.with_each(left, right)
    numbers = right.select("id")
    assert expand.with_each(left, numbers).count() == 60  # numbers have a fixed width
    monkeypatch.setattr(expand, "MOST_PARAMETERS", 19)
    assert expand.small(numbers) is numbers
    with pytest.raises(ValueError):
        expand.with_each(left, numbers)


def test_empty_table_is_small(spark):
    none = spark.createDataFrame([], "id int, text string")
    assert expand.with_each(spark.range(3).withColumnRenamed("id", "k"), none).count() == 0


def test_pairs_with_an_unlisted_name_are_left_out(spark):
    pairs = [("warm", "cold"), ("warm", "unrated"), ("unrated", "cold"), ("terse", "wordy")]
    got = expand.known_pairs(spark, pairs, ["warm", "cold", "terse", "wordy"]).collect()
    assert [tuple(r) for r in got] == [(0, "warm", "cold"), (3, "terse", "wordy")]
    rows = [(c, i, n, float(c * (i + 1) % 5)) for c in range(6) for i, n in enumerate(["warm", "cold", "terse"])]
    ratings = spark.createDataFrame(rows, "conv_ord int, attr_ord int, attribute string, score double")
    assert [(r.a, r.b) for r in factors.antonyms(ratings, pairs).collect()] == [("warm", "cold")]


def test_whole_numbers_of_columns_are_those_of_integers(spark):
    got = spark.range(1, 3000).select("id", expand.oversampled(F.col("id")).alias("o"), expand.even_limit(F.col("id"), 7).alias("e")).collect()
    assert all((r.o, r.e) == (expand.oversampled(r.id), expand.even_limit(r.id, 7)) for r in got)


def test_written_prompts_are_not_rendered(spark):
    df = spark.createDataFrame([(1, "rate <this>"), (2, "")], "id int, text string")
    got = {r.id: (r.system, r.prompt) for r in scoring.raw_requests(df, F.col("text"), scoring.JudgeOptions(thinking=True)).collect()}
    assert got == {1: (scoring.SYSTEM[True], "rate <this>"), 2: (scoring.SYSTEM[True], "")}
    with pytest.raises(PySparkException):
        scoring.raw_requests(spark.createDataFrame([(1, None)], "id int, text string"), F.col("text")).collect()


def test_benchmark_without_training_judges_the_plain_answers(spark):
    names = ["warm", "cold"]
    ddl = "split string, user_id string, user_attributes array<struct<attribute:string,side:string>>, messages string"
    rows = [(s, str(i), [(names[i % 2], "follow")], f"m{i}") for s in ("train", "test") for i in range(6)]
    items, trained = spark.createDataFrame(rows, ddl), []

    def generate(df):
        trained.append(df.where("split = 'train'").count())
        return scoring.surrogate_generator("split", "user_id", "attribute")(df)

    out = benchmark.run(items, names, {0: reward.permutation_world(spark, 2, 2, 1)}, generate, scoring.surrogate_scorer("user_id", "attribute"), lambda df: df, train=False).first()
    assert sum(trained) == 0 and out.n == 6
    assert out.tie_rate == 1 and out.length_personalised == out.length_plain
