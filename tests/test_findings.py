"""Findings of a review, each held by a small case that failed before."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingmill import schema
from ratingmill.operators import benchmark, classify, expand, reward, scoring, synthetic, training
from ratingmill.operators.training import EpochClassifier, EpochOptions
from ratingmill.plans import streams
from ratingmill.sources import corpus, sinks


def test_rows_are_dealt_out_before_they_are_multiplied(spark):
    df = spark.range(1000).coalesce(1)  # as a small file is read
    out = expand.with_each(df, spark.createDataFrame([(i,) for i in range(3)], "k int"))
    assert out.count() == 3000
    own = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(own) >= 4 and max(own) < 1500


def test_shares_are_rounded_as_decimals(spark):
    df = spark.createDataFrame([(0, 436 / 1600), (1, 460 / 1600), (2, 0.0), (3, 1e30)], "k int, p double")
    out = [r.s for r in df.orderBy("k").select(sinks.share_line("p").alias("s")).collect()]
    assert out[:3] == ["27.2%", "28.8%", "0.0%"] and out[3].endswith(".0%")


def test_rows_of_a_prompt_lie_together_and_take_little_room(spark, tmp_path):
    c = spark.range(1000).select(F.col("id").cast("int").alias("persona_id"), F.format_string("Customer %d", "id").alias("persona"))
    prompts = spark.createDataFrame([(i, f"{i} " * 200) for i in range(20)], "prompt_id int, prompt string")
    fixed = {"model": F.lit("m"), "system_prompt": F.lit("s"), "response": F.lit('a, "b"'), "score": F.lit(1)}
    room = lambda at: sum(p.stat().st_size for p in (tmp_path / at).glob("*.csv*"))
    sinks.bias_csv(expand.with_each_in_turn(c, prompts).withColumns(fixed), str(tmp_path / "a"), "gzip")
    sinks.bias_csv(expand.with_each(c, prompts).withColumns(fixed), str(tmp_path / "b"))
    got, want = (corpus.bias_csv(spark, str(tmp_path / x)) for x in "ab")
    assert got.count() == 20_000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert room("a") * 20 < room("b")


def test_an_epoch_of_many_steps_has_few_exchanges(spark):
    """An exchange among tasks takes a second or so."""
    df = spark.range(150).select(F.format_string("word%d and", F.col("id") % 7).alias("text"), (F.col("id") % 2).cast("int").alias("label"))
    began = time.monotonic()
    made = EpochClassifier(EpochOptions(width=64, epochs=1, batch_size=1, accumulate=1, tasks=2)).train(df.withColumn("k", F.monotonically_increasing_id()), key=["k"])
    assert len(made.history) == 1 and time.monotonic() - began < 75


def test_a_segment_of_chunks_is_bounded_whatever_their_size(spark, monkeypatch):
    monkeypatch.setattr(synthetic, "MOST_REQUESTS", 50)
    n = [1 + (i * 7919) % 9 for i in range(400)]
    users = spark.createDataFrame(list(enumerate(n)), "u int, n int")
    for size, rows in ((1, 10**6), (7, 10**6), (60, 10**6), (130, 0), (900, 0), (10_000, 0)):
        monkeypatch.setattr(synthetic, "MOST_ROWS", rows)
        want, held, chunk = [], 0, 0
        for i, k in enumerate(n):
            if held >= size:
                held, chunk = 0, chunk + 1
            held += k
            want.append((i, chunk))
        got = synthetic.chunked(users, [F.col("u")], F.col("n"), size)
        assert sorted((r.u, r.chunk) for r in got.collect()) == want


def test_many_chunks_share_a_micro_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "SIZE", 5)
    monkeypatch.setattr(streams, "MICRO_BATCHES", 10)
    numbers = []
    real = streams.chunked.read_chunks
    monkeypatch.setattr(streams.chunked, "read_chunks", lambda s, p, per_batch=1, until=None: numbers.append(per_batch) or real(s, p, per_batch, until))
    spark.range(300).select((F.col("id") % 150).alias("user_id"), F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    rows = streams.chunk_stream(spark, str(tmp_path)).collect()
    assert set(numbers) == {6} and len(rows) == 150
    assert all(r.requests == 2 and r.chunk == r.batch == r.user_id // 3 for r in rows)


def test_texts_are_split_once_for_training(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return f"word{x % 5} and word{x % 2}"

    df = spark.range(200).select("id", seen.asNondeterministic()("id").alias("text"), (F.col("id") % 2).cast("int").alias("label"))
    c = classify.TextClassifier(options=classify.ClassifierOptions(width=64, rounds=5)).train(df)
    assert read.value == 200
    plain = spark.range(200).select("id", F.concat(F.lit("word"), F.col("id") % 5, F.lit(" and word"), F.col("id") % 2).alias("text"), (F.col("id") % 2).cast("int").alias("label"))
    assert c.accuracy(plain).first().accuracy >= 0.9


def test_worlds_share_answers_and_words_of_histories(spark):
    names, asked, kept = ["warm", "cold", "terse", "formal"], [], []
    own = lambda i: [("warm", "follow" if i % 2 else "avoid"), ("terse", "avoid")]
    rows = [(s, str(i), own(i), [[("user", f"u{i % 2} {i}"), ("assistant", "a")]], [("user", f"q{i}")]) for s in ("train", "test") for i in range(12)]
    items = spark.createDataFrame(rows, schema.ITEMS).persist()
    worlds = {k: reward.permutation_world(spark, 4, 4, k) for k in (0, 1)}

    def generate(df):
        asked.append(df.where("split = 'train'").count())
        return scoring.surrogate_generator("split", "user_id", "attribute")(df)

    def keep(df):
        kept.append(df.columns)
        return df.persist()

    run = lambda w: benchmark.run(items, names, w, generate, scoring.surrogate_scorer("content", "attribute"), keep).collect()
    both = {r.world: r for r in run(worlds)}
    assert sum(asked) == 12 * 4  # as for one world
    assert len(asked) == 1 + 1 + 2  # with each attribute, without one, with that of each world
    assert not any({"conversation_history", "current_messages"} & set(c) for c in kept if {"response", "content"} & set(c))
    assert sum(classify.COUNTS in c for c in kept) == 2  # train and test, once each
    assert run({1: worlds[1]})[0].asDict() == pytest.approx(both[1].asDict()) and both[0].n == both[1].n == 12


def test_counted_texts_train_and_are_judged_as_texts(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{'warm' if i % 2 else 'terse'} word{i % 5} {i}", i % 2) for i in range(40)], "id int, text string, label int")
    options = classify.ClassifierOptions(width=128, rounds=10)
    a, b = classify.TextClassifier(options=options), classify.TextClassifier(options=options)
    counted = a.counted(df)
    assert counted.columns == ["id", "label", classify.COUNTS]
    a.train(df).save(str(tmp_path / "a"))
    b.train(counted)
    said = lambda c, rows: [tuple(r) for r in c.predict(rows).select("id", "prediction").orderBy("id").collect()]
    assert said(a, df) == said(b, counted) == said(a, counted) == said(b, df) == said(classify.TextClassifier.load(str(tmp_path / "a")), df)


def test_an_epoch_trains_on_each_row_once_and_tells_no_task_of_all_rows(spark):
    """Every task judged every row, after all features had passed through the driver."""
    word = lambda x: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", x), F.lit(5000)))
    df = spark.range(80_000).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(50)), word)).alias("text"), (F.col("id") % 2).cast("int").alias("label"))
    began = time.monotonic()
    made = EpochClassifier(EpochOptions(width=4096, epochs=2)).train(df, key=["id"])
    assert time.monotonic() - began < 25
    assert made.history[0][1] > made.history[1][1] > 0


def test_steps_are_the_same_however_rows_are_cut_into_parts_and_blocks():
    r, o = np.random.default_rng(4), EpochOptions(width=40, batch_size=4, accumulate=3)
    sizes = r.integers(0, 9, 101)
    pairs = [np.stack([np.sort(r.choice(40, k, False)), r.integers(1, 5, k)], 1).astype(np.int32).tobytes() for k in sizes]
    texts, got = training.Texts.of(r.integers(0, 3, 101).astype(np.int32), pairs), []
    for cut in (1, 7, 12, 50, 101):
        p, left = training._Progress(training.Weights.zero(40, 3)), texts
        while len(left):
            now, left = left.split(cut)
            p.train(now, 101, o)
        assert p.done == 101 and len(p.rest) == 0 and p.state.steps == 9
        got.append(p)
    assert all((p.state.w == got[0].state.w).all() and (p.state.v == got[0].state.v).all() and p.lost == got[0].lost for p in got)
    for most in (1, 5, 1000):
        cuts = list(training._cuts(sizes, most))
        assert [a for a, _ in cuts] == [0, *[b for _, b in cuts[:-1]]] and cuts[-1][1] == 101
        assert all(sizes[a:b].sum() <= most + sizes[a:b].max() for a, b in cuts)
    assert list(training._cuts(sizes[:0], 5)) == []
