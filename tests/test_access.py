import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ratingmill.sources import access


def plain(rows, n, buffer, seed=42):
    made = []
    for at, (k, *parts) in enumerate(rows):
        text = " ".join(p.strip() for p in parts if p and p.strip())
        if text:
            made.append((at // buffer, hashlib.md5(f"{k}|{seed}".encode()).hexdigest(), str(k), text))
    return [x[3] for x in sorted(made)[:n]]


def test_first_personas_of_a_windowed_shuffle(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, r.choice([None, "", " ", f" p{i} "]), r.choice([None, f"h{i}"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, persona string, hobbies string")
    df.coalesce(1).sortWithinPartitions("k").write.option("maxRecordsPerFile", 50).parquet(f"{tmp_path}/in")
    assert [g.start for g in access.groups(f"{tmp_path}/in")] == list(range(0, 2000, 50))
    for n, buffer, most in ((1, 1, 2), (20, 100, 8), (90, 40, 12), (700, 300, 40), (5000, 300, 40)):
        read = []
        got = access.streamed_personas(spark, f"{tmp_path}/in", "k", n, ["persona", "hobbies"], buffer=buffer, report=read.append)
        got = sorted((x.persona_id, x.persona) for x in got.collect())
        assert [p for _, p in got] == plain(rows, n, buffer) and [i for i, _ in got] == list(range(len(got)))
        assert read[0] <= most
    whole = access.read_groups(spark, f"{tmp_path}/in", list(access.groups(f"{tmp_path}/in")), ["hobbies"])
    assert whole.columns == ["hobbies", "__position"] and whole.agg(F.max("__position")).first()[0] == 1999
    df.limit(0).write.parquet(f"{tmp_path}/none")
    assert access.streamed_personas(spark, f"{tmp_path}/none", "k", 3, ["persona"]).count() == 0
    with pytest.raises(ValueError):
        access.streamed_personas(spark, f"{tmp_path}/in", "k", 0, ["persona"])


def test_a_row_by_ordinal_reads_one_row_group(spark, tmp_path):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS v", "id AS label").repartition(5)
    access.write_indexed(df, [F.col("v")], f"{tmp_path}/x", 64)
    items = access.Indexed(spark, f"{tmp_path}/x")
    assert len(items) == 1000 and all(items[i].v == i % 1000 for i in (0, 63, 64, 500, 999, -1, -1000))
    for i in (1000, -1001):
        with pytest.raises(IndexError):
            items[i]
    one = items.at(700)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ord), EqualTo(ord,700)]" in plan and len(one.inputFiles()) == 1
    (row,) = one.collect()
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert row.v == 700 and scan.metrics().apply("numOutputRows").value() <= 64
    got = items.many(spark.createDataFrame([(3,), (3,), (990,), (5000,)], "ord long")).collect()
    assert sorted(r.v for r in got) == [3, 990]
    access.write_indexed(df.limit(0), [F.col("v")], f"{tmp_path}/none")
    assert len(access.Indexed(spark, f"{tmp_path}/none")) == 0
