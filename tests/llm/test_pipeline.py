import random

import corpus_pipeline
from ratingmill.llm import simhash


def jaccard(a, b):
    sh = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    a, b = sh(a), sh(b)
    return len(a & b) / len(a | b)


def test_near_copies_leave_one(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, group = [], {}
    for g in range(40):
        base = [word() for _ in range(r.randint(30, 300))]
        for k in range(r.choice([1, 1, 3, 12])):
            w = list(base)
            for _ in range(0 if k < 2 else r.randint(0, len(w) // 60)):
                w[r.randrange(len(w))] = word()
            i = len(rows)
            rows.append((5000 - i, " ".join(w), "de", 1))
            group[5000 - i] = g
    near = {d: g for d, g in group.items()}
    rows += [(1, None, "x", 1), (2, "", "x", 1), (3, " ", "x", 1), (4, "one two", "x", 1), (4, "one two", "x", 1), (None, "ONE  two", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, content string, `k.ey` long")
    got = simhash.unique(df)
    assert got.columns == df.columns
    kept = [x.doc_id for x in got.collect()]
    assert len(kept) == len(set(kept)) and {1, 4} <= set(kept) and not {2, 3, None} & set(kept)
    text = {d: t for d, t, *_ in rows}
    for g in range(40):
        own = [d for d, x in near.items() if x == g]
        left = [d for d in own if d in kept]
        assert min(own) in left
        for d in left:  # what stays beside another is not similar to the first text of its group
            if d != min(own):
                assert max(jaccard(text[d], text[x]) for x in own if x != d) < 0.82
    assert simhash.unique(df.limit(0)).count() == 0


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert sorted(docs.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars"])
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and max(r.length for r in got) <= 2048


def test_recall_by_similarity(spark):
    """All pairs of 0.8 and more are caught, whatever else is like them; what is less alike stays."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, pairs = [], []
    for i in range(120):
        base = [word() for _ in range(200)]
        w = list(base)
        for k in sorted(r.sample(range(2, 195), r.randint(1, 8))):
            w[k] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(w))]
        pairs.append(jaccard(" ".join(base), " ".join(w)))
    kept = {x.doc_id for x in simhash.unique(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(120))
    alike = [i for i, j in enumerate(pairs) if j >= 0.8]
    assert len(alike) > 30 and not any(2 * i + 1 in kept for i in alike)
    assert all(2 * i + 1 in kept for i, j in enumerate(pairs) if j < 0.7)


def test_stages_with_nulls_and_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as row", "'x' as `a.b`")
    odd = docs.selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "lang", "source", "cast(null as long) as n_chars", "row", "`a.b`").limit(3)
    for start in (docs.unionByName(odd).unionByName(docs.limit(5)), docs.limit(0)):
        left = start
        for _, stage in corpus_pipeline.STAGES[:4]:
            left = stage(spark, left, sf)
            assert left.columns == start.columns
        assert (left.count() > 0) == (start.count() > 0)
        assert (corpus_pipeline.STAGES[4][1](spark, left, sf).count() > 0) == (start.count() > 0)
