import random

import numpy as np

from ratingmill.llm import decontaminate, quality

WORDS = [a + b + c + d for a in ("ta", "re", "on", "ver", "é") for b in ("li", "mon", "st", "a") for c in ("", "ent", "ia", "or") for d in ("", "la", "ki", "s", "n", "ru", "be", "zo")]


def prose(r, n):
    return " ".join(r.choice(WORDS + ["the", "of"] * 30) for _ in range(n)).capitalize() + "."


def test_em_tells_kinds_of_bad_and_false_alarms():
    r = np.random.default_rng(0)
    kind = r.choice(4, 20000, p=[0.8, 0.1, 0.06, 0.04])
    said = []
    for k in kind:
        v = [r.random() < (0.9 if k == j else 0.01) for j in (1, 1, 2, 2, 3, 3)]
        said.append("".join("-" if r.random() < 0.1 else "gb"[int(x)] for x in v))
    names, inverse, counts = np.unique(said, return_inverse=True, return_counts=True)
    p, table, share = quality.expectation_maximisation(list(names), counts.astype(float))
    bad = p[inverse] >= 0.5
    both = np.array([max(x[:2].count("b"), x[2:4].count("b"), x[4:].count("b")) for x in said])
    assert (bad[both == 2]).all() and not bad[both == 0].any() and (bad == (kind > 0)).mean() > 0.9
    assert table[0, :, 1].max() < 0.05 and abs(share.sum() - 1) < 1e-6


def test_classifier_on_held_out_documents(spark):
    r = random.Random(5)
    rows = []
    for i in range(900):
        kind = r.choice(["good"] * 6 + ["shout", "repeat", "symbols", "abuse"])
        text = prose(r, r.randint(8, 300))
        w = text.split()
        if kind == "shout":
            text = " ".join(x.upper() + "!!" for x in w)
        elif kind == "repeat":
            text = " ".join(x for x in w for _ in range(6))
        elif kind == "symbols":
            text = " ".join(x + r.choice(["###", "$$$"]) for x in w)
        elif kind == "abuse":
            for x in r.sample(["idiot", "scum", "stupid", "trash", "loser"], 3):
                w.insert(r.randrange(len(w)), x)
            text = " ".join(w)
        rows.append((i, text, kind))
    df = spark.createDataFrame([(i, t, 7) for i, t, _ in rows] + [(-1, None, 7), (-2, "", 7), (-2, "", 7), (None, "Ta re.", 7)], "doc_id long, text string, keep long")
    got = quality.classify(df, fit_rows=800).collect()
    assert len(got) == 904
    keep = {x.doc_id: x.keep for x in got}
    wrong = [i for i, t, k in rows if keep[i] != (k == "good") and len(t.split()) > 25]
    assert len(wrong) <= 60
    labels = spark.createDataFrame([(i, int(k in ("good", "abuse")), int(k == "abuse")) for i, _, k in rows[:300]], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(df, labels, 800)
    assert kept.columns == df.columns and 450 < kept.count() < 680
    assert quality.classify(df.limit(0)).count() == 0


def brute(item, text):
    best = 0
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item):
        for j, b in enumerate(text):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a == b else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_alignment_against_brute_force():
    r = np.random.default_rng(1)
    for _ in range(80):
        a, b = r.integers(0, 4, r.integers(1, 12)), r.integers(0, 4, r.integers(1, 25))
        assert decontaminate.align(a, b)[0] == brute(list(a), list(b))


def test_edited_passages_are_found(spark):
    r = random.Random(2)
    items = [(i, prose(r, r.randint(15, 50)) + f" q{i}x z{i}") for i in range(30)] + [(90, None), (91, ""), (92, "ta re")]
    docs, want = [], set()
    for d in range(200):
        w = prose(r, r.randint(0, 200)).split()
        if d % 4 == 0:
            i, text = items[d % 30]
            p = text.encode().upper().decode().split() if d % 8 else text.split()
            for _ in range(len(p) // 10):
                p[r.randrange(len(p))] = "edit"
            w[3:3] = p
            want.add((d, i))
        docs.append((d, " ".join(w), 1))
    docs += [(300, None, 1), (301, "", 1), (0, docs[0][1], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 300):
        got = decontaminate.contaminated(df, bench, block_words=block).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want) + 1
    x = next(x for x in got if x.doc_id == 0)
    assert x.start_word == 3 and x.end_word == 3 + len(items[0][1].split())
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted({d for d, *_ in docs} - {d for d, _ in want})
    assert decontaminate.clean(df.limit(0), bench).count() == 0 and decontaminate.clean(df, bench.limit(0)).count() == len(docs)


def best(item, text):
    """The score of the best local alignment, cell by cell."""
    row, top = [0] * (len(text) + 1), 0
    for a in item:
        new = [0]
        for j, b in enumerate(text):
            new.append(max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 1))
        row, top = new, max(top, *new)
    return top


def test_nothing_above_the_limit_is_lost(spark):
    """All pairs of made texts against Smith-Waterman over whole texts: few words, so that all items are of common ones."""
    r = random.Random(7)
    few = [f"w{i}" for i in range(25)]
    items = [(i, [r.choice(few) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 20, 33]))]) for i in range(60)]
    docs = []
    for d in range(150):
        w = [r.choice(few) for _ in range(r.randint(0, 60))]
        if d % 3:
            p = list(r.choice(items)[1])
            kind = d % 5
            if kind == 0:  # a word after each second one
                p = [x for i, v in enumerate(p) for x in ([v, f"x{i}"] if i % 2 else [v])]
            elif kind == 1:
                p = [v for v in p if r.random() > 0.15]
            elif kind == 2:
                p = [r.choice(few) if r.random() < 0.2 else v for v in p]
            elif kind == 3:
                p = p[: len(p) // 2] + ["y"] * r.randint(0, 4) + p[len(p) // 2 :]
            k = r.randint(0, len(w))
            w[k:k] = p
        docs.append((d, w))
    docs += [(900, []), (901, docs[4][1])]
    limit = lambda ws: 0.6 if len(ws) >= 5 else 1.0
    want = {(d, i, round(s / (2 * len(ws)), 9)) for d, w in docs for i, ws in items if (s := best(ws, w)) >= limit(ws) * 2 * len(ws) - 1e-9}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(ws).upper()) for i, ws in items] + [(77, None), (78, " ")], "item_id long, text string")
    assert len({(d, i) for d, i, _ in want}) > 300
    for block in (decontaminate.BLOCK_WORDS, 100):
        got = decontaminate.contaminated(df, bench, block_words=block).collect()
        assert {(x.doc_id, x.item_id, round(x.similarity, 9)) for x in got} == want and len(got) == len(want)
        kept = decontaminate.clean(df, bench, block_words=block)
        assert {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - {d for d, _, _ in want}


def test_inserted_words_ties_and_long_texts(spark):
    item = [f"t{i}" for i in range(20)]
    broken = [x for i, v in enumerate(item) for x in ([v, f"q{i}"] if i % 2 else [v])]
    rows = [(1, " ".join(broken)), (2, " ".join([*item, "z", *item])), (3, " ".join(["u v"] * 60000 + item))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item)), (5, " ".join(item))], "item_id long, text string")
    got = sorted(tuple(x) for x in decontaminate.contaminated(df, bench).collect())
    assert [x for x in got if x[0] == 1] == [(1, 5, 0.775, 0, 29)] * 2
    assert [x for x in got if x[0] == 2] == [(2, 5, 1.0, 0, 20)] * 2 and [x for x in got if x[0] == 3] == [(3, 5, 1.0, 120000, 120020)] * 2


def test_filters_keep_odd_columns_and_decide_each_row(spark):
    bad = "idiot scum stupid trash loser " * 30
    r = random.Random(3)
    rows = [(i, prose(r, 60) + " The house of the river is in the valley and it is old. " + (bad if i % 4 == 0 else ""), i, 1.5) for i in range(200)]
    rows += [(900, None, 1, None), (901, "", 1, None), (901, "", 1, None), (None, "The house is old.", 2, 0.0), (902, "The house of it " * 20000, 3, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep long, `a.b` double")
    kept = quality.keep_good(df, None, 400)
    assert kept.schema.names == df.schema.names
    keep = {x.doc_id: x.keep for x in quality.classify(df, None, 400).collect()}
    assert sorted(str(x.doc_id) for x in kept.select("doc_id").collect()) == sorted(str(r[0]) for r in rows if keep[r[0]])
    assert not any(keep[i] for i in range(0, 200, 4)) and all(keep[i] for i in range(200) if i % 4)
    bench = spark.createDataFrame([(1, "house of the river is in")], "item_id long, text string")
    left = decontaminate.clean(df, bench)
    assert left.schema.names == df.schema.names and left.count() == 5


def test_scorer_on_documents_kept_out_of_the_fit(spark):
    """Fitted on half of the labelled documents, right on most of the others (0.95; what it misses are toxic texts in languages that the heuristic labellers do not know)."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    own = docs.join(labels, "doc_id")
    model = quality.train(docs.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 0"))
    rest = own.where("doc_id % 2 = 1").select("text", "quality", "toxic").collect()
    right = [(float(model.score(r.text).max()) < 0.5) == (r.quality == 1 and r.toxic == 0) for r in rest]
    assert len(right) > 150 and sum(right) / len(right) >= 0.94


def test_one_id_of_many_rows_stays_within_the_sample(spark, monkeypatch):
    r, seen = random.Random(9), []
    rows = [(7, prose(r, 40)) for _ in range(400)] + [(i, prose(r, 40)) for i in range(20)] + [(8, "The of. " * 30)] * 300
    whole = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, *more: seen.append(len(x)) or whole(x, y, *more))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(df, labels, fit_rows=300).count() == 720
    assert len(seen) == 2 and 100 < max(seen) <= 300
