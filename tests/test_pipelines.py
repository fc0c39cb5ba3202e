import pytest
from pyspark.sql import functions as F

from ratingmill import schema
from ratingmill.operators import benchmark, classify, conversations, expand, reward, scoring, synthetic
from ratingmill.plans import catalog
from ratingmill.sources import corpus, sinks
from ratingmill.streaming import chunks

NAMES = ["warm", "terse", "formal", "playful"]


def talk(*roles):
    return [(r, f"{r} {i}") for i, r in enumerate(roles)]


def test_conversation_rules(spark):
    rows = [(1, talk("user", "assistant")), (2, talk("system", "user", "assistant")), (3, talk("user")), (4, talk("user", "assistant", "user", "assistant", "user")), (5, [])]
    df = spark.createDataFrame(rows, f"k int, messages {schema.MESSAGES}")
    m = F.col("messages")
    assert {r.k for r in df.where(conversations.opens_well(m)).collect()} == {1, 4}
    assert [(r.turn, len(r.context)) for r in conversations.user_turns(df.where("k = 4"), ["k"]).orderBy("turn").collect()] == [(0, 0), (2, 2), (4, 4)]
    cut = df.select("k", F.size(conversations.random_truncation(m, F.col("k"), 1)).alias("n"), F.size(conversations.random_truncation(m, F.col("k"), 1, True)).alias("u")).collect()
    assert all(r.n % 2 == 0 and r.u == max(r.n - 1, 0) for r in cut) and {r.k: r.n for r in cut}[3] == 0
    with pytest.raises(Exception, match="must end"):
        scoring.response_requests(df.withColumn("attribute", F.lit("warm"))).count()
    flat = conversations.flatten(df, ["k"]).withColumnRenamed("k", "conv_id")
    back = conversations.nest(flat)
    assert {r.conv_id: [tuple(x) for x in r.messages] for r in back.collect()} == {k: v for k, v in rows if v}


def test_ordinals_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = conversations.numbered(df, [F.col("v")], "ord").collect()
    assert all(r.v == r.ord for r in got) and len(got) == 1000
    assert conversations.numbered(df.limit(0), [F.col("v")], "ord").count() == 0


def test_limits_and_pairs(spark):
    assert expand.even_limit(50, 6) == 48 and expand.oversampled(100) == 105
    df = spark.createDataFrame([(str(i), f"p{i}") for i in range(20)], "prompt_id string, prompt string")
    assert corpus.prompts(df, limit=0).count() == 20 and corpus.prompts(df, ["1"], 5).count() == 5
    assert corpus.prompts(df, limit=5).collect() == corpus.prompts(df.repartition(5), limit=5).collect()


def test_readers_and_writers(spark, tmp_path):
    items = spark.createDataFrame([("train", str(i), [("warm", "follow")], [talk("user", "assistant")] * 3, talk("user", "assistant")) for i in range(12)] + [("test", "0", [("warm", "avoid")], [], talk("user", "assistant"))], schema.ITEMS)
    sinks.split_dataset(items, f"{tmp_path}/items")
    got = corpus.labelled_items(spark, f"{tmp_path}/items", "train", limit=3, history=2).orderBy("ord").collect()
    assert [r.user_id for r in got] == ["0", "1", "2"] and all(len(r.conversation_history) == 2 and len(r.current_messages) == 1 for r in got)
    with pytest.raises(ValueError):
        corpus.labelled_items(spark, f"{tmp_path}/items", "test", limit=5)
    assert "user_attributes" not in corpus.unlabelled(items).columns
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.json").write_text('{"user_idx": 1, "rewrite_style_attributes": [], "conversations": []}\n\n{"user_idx": 2}\n')
    assert corpus.users_json(spark, f"{tmp_path}/u").count() == 2
    gen = spark.createDataFrame([(1, 2, "a", "follow", 'p "q"\nr', "x,y")], schema.GENERATED)
    sinks.plain_csv(gen, f"{tmp_path}/g")
    assert corpus.generated_csv(spark, f"{tmp_path}/g").collect() == gen.collect()
    sinks.attributes_json(corpus.attributes(spark, NAMES), f"{tmp_path}/a")
    assert [r.attribute for r in corpus.attributes_json(spark, f"{tmp_path}/a").orderBy("ord").collect()] == NAMES
    ratings = spark.createDataFrame([(1, 0, "warm", 3.0)], schema.RATINGS)
    sinks.matrix(ratings, f"{tmp_path}/m")
    assert corpus.ratings(spark, f"{tmp_path}/m", ["warm"]).count() == 1
    with pytest.raises(ValueError):
        corpus.ratings(spark, f"{tmp_path}/m", NAMES)
    sinks.judge_scores(spark.createDataFrame([("j", 0, "a/b", 0, 0, 1.0)], schema.PAIR_SCORES), f"{tmp_path}/s")
    assert corpus.judge_scores(spark, f"{tmp_path}/s").first().judge == "j"
    sinks.rounded_csv(spark.createDataFrame([("a", 0.123456), ("b", None)], "k string, v double"), f"{tmp_path}/r")
    assert {r.value for r in spark.read.text(f"{tmp_path}/r").collect()} == {"a,0.1235", "b,", "k,v"}  # each file has its header
    reps = spark.createDataFrame([(2, 1, "b"), (2, 0, "a")], "k int, comp int, attribute string")
    assert sinks.representatives_yaml(reps) == "k2:\n  - a\n  - b\n"


def test_synthetic_users(spark):
    source = spark.createDataFrame([(i, talk("user", "assistant", "user")) for i in range(5)], f"source_ord long, messages {schema.MESSAGES}")
    users = synthetic.users(spark, {"train": 10, "test": 4}, NAMES, 2, 7, 1.5)
    assert users.count() == 21 and users.where("split = 'test' and user_idx = 0").count() == 1
    generate = scoring.surrogate_generator("split", "user_idx", "slot", "turn", fails=4)
    got, counts = synthetic.assemble(users, source, generate, 3, 5, {"train": 10, "test": 4})
    rows = got.collect()
    n = {r.split: (r.valid, r.discarded) for r in counts.collect()}
    assert sum(n["train"]) == 15 and sum(n["test"]) == 6
    assert {s: sum(r.split == s for r in rows) for s in n} == {"train": min(10, n["train"][0]), "test": min(4, n["test"][0])}
    for r in rows:
        assert len(r.conversations) == 3
        for c in r.conversations:
            assert [m.content.startswith("re: ") for m in c.messages] == [True, False, True]
    data = synthetic.dataset(got).first()
    assert len(data.conversation_history) == 2 and len(data.current_messages) == 3


def test_classifier_and_benchmark(spark, tmp_path):
    rows = [(f"warm friendly hello {i}", 0) if i % 2 else (f"terse short no {i}", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "text string, label int")
    c = classify.TextClassifier(options=classify.ClassifierOptions(width=256, rounds=10)).train(df)
    c.save(f"{tmp_path}/c")
    assert classify.TextClassifier.load(f"{tmp_path}/c").accuracy(df).first().accuracy == 1.0
    items = spark.createDataFrame(
        [(s, str(i), [("warm", "follow" if i % 2 else "avoid"), ("terse", "avoid")], [[("user", f"u{i % 2} {i}"), ("assistant", "a")]], [("user", f"q{i}")]) for s in ("train", "test") for i in range(16)], schema.ITEMS
    )
    keep = lambda d: d.persist()
    generate = scoring.surrogate_generator("split", "user_id", "attribute")
    scorer = scoring.surrogate_scorer("content", "attribute")
    out = benchmark.run(items, NAMES, {0: reward.permutation_world(spark, 4, 4, 0)}, generate, scorer, keep)
    (r,) = out.collect()
    assert r.n == 16 and abs(r.win_rate + r.tie_rate + r.loss_rate - 1) < 1e-9 and r.length_personalised > 0
    with pytest.raises(Exception, match="unknown attribute"):
        benchmark.world_labels(items, ["warm"], reward.permutation_world(spark, 1, 1, 0)).count()


def test_users_without_attributes_raise(spark):
    requests = spark.createDataFrame([("t", "1", 1), ("t", "2", 2)], "split string, user_id string, k int")
    own = spark.createDataFrame([("t", "1", "warm", "follow")], "split string, user_id string, attribute string, side string")
    judged = reward.judge_users(requests, own, scoring.surrogate_scorer("k", "attribute"), ["k"])
    with pytest.raises(Exception, match="no attributes for user 2"):
        judged.collect()


def test_stream_equals_batch(spark, tmp_path):
    requests = spark.range(60).select(F.when(F.col("id") < 30, "train").otherwise("test").alias("split"), (F.col("id") % 30).cast("int").alias("user_idx"))
    requests.repartition(6).write.parquet(f"{tmp_path}/in")
    generate = scoring.surrogate_generator("split", "user_idx", fails=30)
    for _ in range(2):  # a second run has nothing left to do
        chunks.process(chunks.read_chunks(spark, f"{tmp_path}/in", "split string, user_idx int", 2), generate, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    want = generate(requests).select("split", "user_idx", "response.raw_text").collect()
    assert sorted(spark.read.parquet(f"{tmp_path}/out").select("split", "user_idx", "response.raw_text").collect()) == sorted(want)
    kept = chunks.kept_by_split(chunks.read_chunks(spark, f"{tmp_path}/in", "split string, user_idx int", 6).withColumn("ok", F.col("user_idx") % 2 == 0), {"train": 3, "test": 100})
    q = kept.writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("kept").collect()
    assert sorted(r.user_idx for r in rows if r.split == "train") == [0, 2, 4] and sum(r.split == "test" for r in rows) == 15


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    sf = "/root/testdata/sf0.001"
    p = plan(catalog.prefix_filter(spark, sf))
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string>" in p
    assert "PushedFilters: [Or(" in plan(conversations.flat_opens_well(catalog.table(spark, sf, "conversations")))
    assert "CartesianProduct" not in plan(catalog.cross_attributes(spark, sf)) and "BroadcastNestedLoopJoin" in plan(catalog.cross_attributes(spark, sf))
    assert "TakeOrderedAndProject" in plan(catalog.seeded_prompts(spark, sf))
    assert "WindowGroupLimit" in plan(catalog.first_n_valid(spark, sf))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_classifier_query_reads_whole_texts(spark, tmp_path):
    start = "same words " * 60
    rows = [(i, start + ("the house" if i % 2 else "das Haus"), "en" if i % 2 else "de") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.classifier_predict(spark, str(tmp_path)).collect()
    assert len(got) == 40 and all(r.prediction == r.label for r in got)


def test_persona_bias_ci_has_all_personas(spark, tmp_path):
    spark.range(30).selectExpr("id AS c_custkey", "id % 25 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(20).selectExpr("id AS item_id", "'x' AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalog.persona_bias_ci(spark, str(tmp_path)).collect()
    assert {r.persona_id for r in got} == set(range(30)) and len(got) == 30 * 4


def test_factor_queries_take_all_components(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16)) + np.repeat(rng.normal(size=(300, 4)), 4, axis=1) * 2
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r["rank"] for r in catalog.parallel_analysis(spark, str(tmp_path)).collect()} == set(range(16))
    got = catalog.varimax_components(spark, str(tmp_path)).collect()
    assert {r.attr_ord for r in got} == set(range(16)) and {r.k for r in got} == {2, 4}


def test_chunks_start_anew_after_a_cut(spark, monkeypatch):
    import random

    r = random.Random(3)
    rows = [(i, r.choice([1, 2, 3, 7, 40])) for i in range(600)]
    df = spark.createDataFrame(rows, "user_idx int, n int").repartition(5)
    for size, segment in ((10, 1), (25, 2), (25, 1000), (1, 3), (10**6, 1)):
        monkeypatch.setattr(synthetic, "SEGMENT", segment)
        want, held, chunk = {}, 0, 0
        for i, n in rows:
            want[i] = chunk
            held += n
            if held >= size:
                held, chunk = 0, chunk + 1
        got = synthetic.chunked(df, [F.col("user_idx")], F.col("n"), size)
        assert got.columns == ["user_idx", "n", "chunk"] and {x.user_idx: x.chunk for x in got.collect()} == want


def test_cut_off_responses_are_asked_once_more(spark):
    df = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3")], "k int, prompt string")
    asked = []

    def said(df, content, stop):
        return df.withColumn("response", F.struct(content.alias("content"), F.lit(None).cast("string").alias("reasoning"), F.lit("7 of").alias("raw_text"), stop.alias("finish_reason_stop")))

    def generate(df):
        return said(df, F.when(F.col("k") == 1, "8").otherwise("7 of"), F.col("k") == 1)

    def short(df):
        asked.extend(r.prompt for r in df.collect())
        return said(df, F.when(F.col("k") == 2, " 3").otherwise("none"), F.lit(False))

    got = {r.k: (r.prompt, r.score) for r in scoring.parsed_rating(generate, short=short)(df).collect()}
    assert got == {1: ("p1", 8.0), 2: ("p2", 3.0), 3: ("p3", None)}
    assert sorted(asked) == ["p27 of</think>\n\nRating: ", "p37 of</think>\n\nRating: "]
    left = scoring.parsed_rating(generate, scoring.JudgeOptions(force_rating=False))(df).collect()
    assert {r.k: r.score for r in left} == {1: 8.0, 2: None, 3: None}


def test_lists_places_and_loss(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("attributes:\n  - warm\n  - 'very terse' \n# no\n- \"x: y\"\n")
    assert [r.attribute for r in corpus.attributes_yaml(spark, str(tmp_path / "a.yaml")).orderBy("ord").collect()] == ["warm", "very terse", "x: y"]
    df = spark.range(3).withColumnRenamed("id", "ord")
    assert corpus.item(df, 1).ord == 1 and corpus.item(df, -1).ord == 2
    with pytest.raises(IndexError):
        corpus.item(df, 3)
    rows = [(f"warm friendly {i}", 0) if i % 2 else (f"terse short {i}", 1) for i in range(40)]
    data = spark.createDataFrame(rows, "text string, label int")
    r = classify.TextClassifier(options=classify.ClassifierOptions(width=64, rounds=10)).train(data).loss(data).first()
    assert 0 < r.loss < 0.5 and r.accuracy == 1.0 and r.n == 40
    assert issubclass(classify.AttributeSystem, classify.PersonalizationSystem)
    with pytest.raises(TypeError):
        classify.PersonalizationSystem()
