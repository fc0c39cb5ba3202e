import hashlib
import math
import random

import numpy as np
import pytest

from ratingmill.operators.training import EpochClassifier, EpochOptions, features, hashed_words
from pyspark.sql import functions as F


def plain(rows, o, classes, order_of=None):
    """AdamW in plain numpy: rows (text, label, hashes)."""
    w, m, v, t, out = (np.zeros((o.width + 1, classes)), np.zeros((o.width + 1, classes)), np.zeros((o.width + 1, classes)), 0, [])
    x = np.zeros((len(rows), o.width + 1))
    for i, (_, _, h) in enumerate(rows):
        at, value = features(h, o.width)
        x[i, at] = value
    y = np.array([r[1] for r in rows])
    for epoch in range(o.epochs):
        order = order_of(epoch) if order_of else sorted(range(len(rows)), key=lambda i: (hashlib.md5(f"{rows[i][0]}|{rows[i][1]}|{epoch}|{o.seed}".encode()).hexdigest(), rows[i][0]))
        total, g, steps = 0.0, np.zeros_like(w), math.ceil(len(rows) / o.batch_size)
        for step in range(steps):
            batch = order[step * o.batch_size : (step + 1) * o.batch_size]
            z = x[batch] @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            total += -np.log(p[np.arange(len(batch)), y[batch]]).mean()
            p[np.arange(len(batch)), y[batch]] -= 1
            g += x[batch].T @ p / len(batch) / o.accumulate
            if (step + 1) % o.accumulate == 0 or step + 1 == steps:
                t += 1
                m, v = o.beta1 * m + (1 - o.beta1) * g, o.beta2 * v + (1 - o.beta2) * g * g
                w = w - o.rate * (m / (1 - o.beta1**t) / (np.sqrt(v / (1 - o.beta2**t)) + o.epsilon) + o.decay * w)
                g = np.zeros_like(w)
        out.append(total / (len(rows) / o.batch_size))
    return w, out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    words = {0: ["warm", "kind", "soft"], 1: ["terse", "short", "cold"], 2: ["formal", "sir", "dear"]}
    return [(" ".join(r.choices(words[i % 3] + ["and", "the", "Of"], k=r.randint(0, 12))) + f" {i}", i % 3) for i in range(75)]


def test_losses_are_those_of_plain_numpy_for_any_number_of_tasks(spark, texts, tmp_path):
    df = spark.createDataFrame(texts, "text string, label int")
    base = dict(width=128, epochs=3, batch_size=4, accumulate=3, rate=0.05)
    o = EpochOptions(**base)
    hashes = {r.text: r.h for r in df.select("text", hashed_words(F.col("text"), o).alias("h")).collect()}
    w, want = plain([(t, y, hashes[t]) for t, y in texts], o, 3)
    made = {}
    for tasks, parts in ((1, 5), (3, 2), (4, 7)):
        c = EpochClassifier(EpochOptions(**base, tasks=tasks)).train(df.repartition(parts), df)
        made[tasks] = c
        assert np.allclose([h[1] for h in c.history], want, rtol=0, atol=1e-9) and np.allclose(c.weights, w, rtol=0, atol=1e-9)
    assert all((made[k].weights == made[1].weights).all() and made[k].history == made[1].history for k in made)
    assert want[0] > want[1] > want[2]
    logs = [h[2] for h in made[1].history]
    assert logs == sorted(logs, reverse=True) and made[1].history[-1][3] > 0.9
    told = made[1].loss(df).first()
    assert told.n == 75 and abs(told.loss - logs[-1]) < 1e-12
    made[3].save(spark, f"{tmp_path}/c")
    again = EpochClassifier.load(spark, f"{tmp_path}/c")
    assert (again.weights == made[3].weights).all() and again.history == made[3].history and again.options == made[3].options
    assert again.predict(df).columns == ["text", "label", "prediction"]
    assert again.losses(spark).count() == 3


def test_odd_rows(spark):
    schema = "text string, label int"
    df = spark.createDataFrame([(None, 0), ("", 1), ("a b", 1), ("a b", 1), ("long " * 50_000, 0)], schema)
    c = EpochClassifier(EpochOptions(width=16, epochs=2, batch_size=2, accumulate=1, tasks=2)).train(df)
    assert c.history[0][2:] == (None, None) and c.predict(df).count() == 5
    cut = EpochOptions(max_length=3)
    assert df.select(F.max(F.size(hashed_words(F.col("text"), cut))).alias("n")).first().n == 3
    with pytest.raises(ValueError, match="no label"):
        EpochClassifier().train(spark.createDataFrame([("a", None)], schema))
    assert EpochClassifier(EpochOptions(width=4)).train(df.limit(0)).history == []
    assert c.loss(spark.createDataFrame([("a", 7)], schema)).first().loss > 100


def test_query_equals_plain_numpy(spark, tmp_path):
    from ratingmill.plans import learning

    r = random.Random(3)
    docs = [(i, " ".join(r.choices("the of and house tree".split() if i % 2 else "der und das Haus Baum".split(), k=r.randint(0, 30))), "en" if i % 2 else "de") for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    o = EpochOptions()
    hashes = {x.doc_id: x.h for x in df.select("doc_id", hashed_words(F.col("text"), o).alias("h")).collect()}
    rows = [(i, int(lang == "en"), hashes[i]) for i, _, lang in docs if i % 5]
    # the query's key is doc_id alone
    order = lambda epoch: sorted(range(len(rows)), key=lambda i: hashlib.md5(f"{rows[i][0]}|{epoch}|{o.seed}".encode()).hexdigest())
    w, want = plain(rows, o, 2, order)
    got = learning.classifier_epochs(spark, str(tmp_path)).orderBy("epoch").collect()
    assert np.allclose([g.train_loss for g in got], want, rtol=0, atol=1e-9)
    held = [(features(hashes[i], o.width), int(lang == "en")) for i, _, lang in docs if i % 5 == 0]
    logs = [(x @ w[at] - np.log(np.exp(x @ w[at]).sum()), y) for (at, x), y in held]
    assert abs(got[-1].val_loss + np.mean([z[y] for z, y in logs])) < 1e-9 and abs(got[-1].val_accuracy - np.mean([z.argmax() == y for z, y in logs])) < 1e-9
