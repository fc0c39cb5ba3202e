import datetime
from itertools import islice

import pyarrow as pa
from pyspark.sql import functions as F

from ratingmill.llm import blocks


def test_numbers_fall_into_few_buckets(spark):
    for task, buckets in ((0, 1), (3, 4), (100, 51), (7, 200)):
        own = list(islice(blocks.numbers(task, buckets), 40))
        assert len(set(own)) == 40 and all(n >> blocks.OWN_BITS == task for n in own)
        rows = spark.createDataFrame([(n,) for n in own], "n long").select("n", F.pmod(F.hash("n"), F.lit(buckets)).alias("b")).collect()
        assert [r.b for r in rows] == blocks.bucket_of([r.n for r in rows], buckets).tolist()
        assert len({r.b for r in rows}) <= blocks.SPREAD


def test_rows_come_back_as_they_were(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 300)
    rows = [(i, None if i % 7 == 0 else "x" * i, [i, None], datetime.datetime(2020, 1, 1), {"a": i}, 1.5) for i in range(60)]
    df = spark.createDataFrame(rows, "block long, body string, row array<long>, t timestamp, m map<string,long>, `a.b` double").repartition(3)
    b = blocks.Blocks(df)
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64())])
    named = b.map(lambda k, t: pa.Table.from_arrays([pa.array(blocks.rows_of(k, t)), t.column("block")], schema=schema), schema)
    names = {r.id: r.row for r in named.collect()}
    assert len(set(names.values())) == 60
    gone = spark.createDataFrame([(names[i],) for i in (0, 5, 59)], "row long")
    left = b.without(gone)
    assert left.schema == df.schema
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in df.collect() if r[0] not in (0, 5, 59))
    asked = b.join(gone.select(blocks.block_of("row").alias("block"), "row"), lambda k, t, m: pa.Table.from_arrays([m.column("row"), t.column("block").take(pa.array(blocks.places(m.column("row").to_numpy())))], schema=schema), schema)
    assert {(r.id, r.row) for r in asked.collect()} == {(i, names[i]) for i in (0, 5, 59)}
    assert blocks.Blocks(df.limit(0)).without(gone).count() == 0
