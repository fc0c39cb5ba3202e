import random

import pytest
from pyspark.sql import functions as F

from ratingmill import schema
from ratingmill.operators import conversations as conv
from ratingmill.operators import scoring, synthetic
from ratingmill.plans import streams
from ratingmill.sources import chunked
from ratingmill.streaming import users

NAMES = ["warm", "terse", "formal"]
NOW = {"processingTime": "0 seconds"}


def talk(n):
    return [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(n)]


def lined(rows):
    return sorted((r.split, r.user_idx, tuple((c.conversation_id, tuple((m.role, m.content) for m in c.messages)) for c in r.conversations)) for r in rows)


def test_chunks_are_micro_batches_and_a_restart_goes_on(spark, tmp_path):
    r = random.Random(1)
    rows = [(u, i) for u in range(40) for i in range(r.choice([1, 2, 9]))]
    df = spark.createDataFrame(rows, "user int, i int").repartition(3)
    chunked.write_chunks(df, ["user"], [F.col("user")], 20, f"{tmp_path}/in")
    want, held, chunk = {}, 0, 0
    for u in range(40):
        want[u] = chunk
        held += sum(x == u for x, _ in rows)
        if held >= 20:
            held, chunk = 0, chunk + 1
    seen = []

    def start(there):
        stream = chunked.read_chunks(spark, f"{tmp_path}/in", until=there)
        assert stream.columns == ["user", "i", "requests", "chunk"]
        return stream.writeStream.foreachBatch(lambda b, n: seen.append((n, b.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(**NOW).start()

    streams.twice(start, 2)
    n = max(want.values()) + 1
    assert [x for x, _ in seen] == list(range(n)) and n > 4
    assert sorted((x.user, x.i) for _, b in seen for x in b) == sorted(rows)
    assert all(want[x.user] == x.chunk == number for number, b in seen for x in b)
    two = chunked.read_chunks(spark, f"{tmp_path}/in", per_batch=3).writeStream.format("memory").queryName("by_three").trigger(**NOW).start()
    users.drained(two)
    assert len([p for p in two.recentProgress if p["numInputRows"]]) == -(-n // 3) and spark.table("by_three").count() == len(rows)
    with pytest.raises(Exception, match="no chunk|not exist|No such"):
        chunked.read_chunks(spark, f"{tmp_path}/none").writeStream.format("memory").queryName("none").start()


def test_whole_users_equal_the_batch(spark, tmp_path):
    source = spark.createDataFrame([(i, talk(3 + i % 3)) for i in range(7)], f"source_ord long, messages {schema.MESSAGES}")
    own = synthetic.users(spark, {"train": 16, "test": 6}, NAMES, 2, 7, 1.0)
    generate = scoring.surrogate_generator("split", "user_idx", "slot", "turn", fails=6)
    wanted = {"train": 5, "test": 4}
    rows, counts = synthetic.assemble(own, source, generate, 2, 7, wanted)
    want = lined(rows.collect())
    asked = synthetic.requests(own, source, 2, 7).select("split", "user_idx", "slot", F.col("turn").cast("long").alias("turn"))
    n = asked.groupBy("split", "user_idx").agg(F.count("*").alias("requests"))
    # turns of a user in several micro-batches: dealt by turn, not by user
    for name, chunk in (("apart", F.pmod(F.xxhash64("slot", "turn"), F.lit(2))), ("together", F.lit(0))):
        at = f"{tmp_path}/{name}"
        asked.join(n, ["split", "user_idx"]).withColumn("chunk", chunk).write.partitionBy("chunk").parquet(f"{at}/in")

        def start(there, at=at):
            whole = users.whole_users(generate(chunked.read_chunks(spark, f"{at}/in", until=there)))
            return users.write_users(users.capped(whole, dict.fromkeys(wanted, 100) if "apart" in at else wanted, buckets=3), own, source, 2, 7, f"{at}/out", f"{at}/state", **NOW)

        streams.twice(start, 1)
        got = lined(users.read_users(spark, f"{at}/out").collect())
        told = {r.split: (r.kept, r.discarded) for r in users.read_counts(spark, f"{at}/out").collect()}
        every = {r.split: (r.valid, r.discarded) for r in counts.collect()}
        if name == "apart":
            assert {x[:2] for x in want} <= {x[:2] for x in got} and set(want) <= set(got) and told == every
        else:
            assert got == want and all(told[s][0] == min(wanted[s], every[s][0]) for s in told)
    assert all(m[0] == "user" for _, _, c in want for _, ms in c for m in ms[::2])


def test_caps_hold_over_micro_batches(spark, tmp_path):
    rows = [(c, s, c * 50 + i, i % 3 > 0) for c in range(3) for s in ("a", "b") for i in range(50)]
    spark.createDataFrame(rows, "chunk int, split string, user_idx int, ok boolean").write.partitionBy("chunk").parquet(f"{tmp_path}/in")
    seen = []

    def start(there):
        done = users.capped(chunked.read_chunks(spark, f"{tmp_path}/in", until=there).drop("chunk"), {"a": 45, "b": 10_000}, buckets=4)
        return done.writeStream.foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(**NOW).start()

    streams.twice(start, 2)
    want, kept = [], {"a": 0, "b": 0}
    for c, s, u, ok in sorted(rows, key=lambda x: (x[1], x[2])):
        if kept[s] < {"a": 45, "b": 10_000}[s]:
            want.append((s, u, ok))
            kept[s] += ok
    assert sorted(seen) == sorted(want) and kept == {"a": 45, "b": 99}


def test_rewritten_turns_are_the_users(spark):
    flat = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "assistant", "a")], "k int, turn long, role string, text string")
    said = spark.createDataFrame([(1, 0, ("new", None, None, True))], f"k int, turn long, response {schema.RESPONSE}")
    assert sorted(map(tuple, synthetic.back_filled(flat, said, ["k"]).collect())) == [(1, 0, "user", "new"), (1, 1, "assistant", "a")]
    assert conv.nest(flat, ["k"]).count() == 1
