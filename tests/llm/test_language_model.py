import math
import random
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np

from ratingmill.llm import language_model as lm


def words(t):
    return (t or "").encode().lower().split()


def brute(rows):
    held = [zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, _ in rows]
    c = Counter()
    for (d, t), h in zip(rows, held):
        if not h:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for (d, t), h in zip(rows, held):
        w = [*words(t), None]
        out.append((str(d), h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    return sorted(out)


def corpus(n=400, seed=0):
    r = random.Random(seed)
    langs = [[f"{a}{b}{s}" for a in "abcdefgh" for b in ("o", "e", "il")] + [s] * 5 for s in ("tion", "ung", "ción")]
    return [(i, " ".join(r.choice(langs[i % 3]) for _ in range(r.randint(0, 120)))) for i in range(n)]


def test_base_counts_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 900)
    rows = corpus() + [(1000, None), (1001, ""), (1002, " \n "), (1003, "Tion TION tion"), (1003, "Tion TION tion"), (None, "new words"), (1004, "x " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as word")
    got = lm.score(df).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute(rows)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)  # the context tells the language
    assert lm.score(df.limit(0)).count() == 0


def test_only_held_out_documents(spark):
    d = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm.score(spark.createDataFrame([(d, "a b")], "doc_id long, text string")).collect()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and math.isfinite(r.score)


def test_scores_against_brute_force(spark, monkeypatch):
    """Each text's score, word by word from the parameters: two softmaxes over all classes and all words of a class."""
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 900)
    monkeypatch.setattr(lm, "EVENTS", 20_000)
    rows = corpus(150, 3) + [(1000, None), (1001, "new words tion"), (1002, "x"), (None, "Tion tion")]
    blocks = lm.coded(spark.createDataFrame(rows, "doc_id long, text string"))
    totals, m = lm.learn(blocks)
    context, cls, cls_bias, word, word_bias, r = (x.astype(np.float64) for x in m.parts(m.params))
    assert m.words > 20 and len(m.first) > 4 and np.abs(cls).max() > 0.01 and np.abs(word).max() > 0.001
    counts = Counter(w for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2 for w in words(t))
    mass, seen = Counter(), Counter()
    for w, n in counts.items():
        if w not in m.unit:
            mass[lm.ending(w)] += n
            seen[lm.ending(w)] += 1
    assert all((w in m.unit) == (n >= lm.LEAST_COUNT) for w, n in counts.items())
    soft = lambda z: np.exp(z) / np.exp(z).sum()
    last = len(m.first) - 1

    def given(one, two):
        h = r[0] * context[one] + r[1] * context[two]
        p = soft(cls @ h + cls_bias)
        own = np.concatenate([p[c] * soft(word[a:b] @ h + word_bias[a:b]) for c, (a, b) in enumerate(zip(m.first, m.first[1:]))])
        return np.concatenate([own, p[last:]])

    r_ = random.Random(0)
    for _ in range(20):
        assert abs(given(r_.randrange(m.start + 1), r_.randrange(m.start + 1)).sum() - 1) < 1e-9
    number = lambda w: m.unit.get(w, m.words + lm.ending(w))
    want = []
    for d, t in rows:
        u, total = [m.start, m.start, *map(number, words(t)), m.words + lm.RARE], 0.0
        for i, w in enumerate([*words(t), None]):
            total += math.log10(given(u[i + 1], u[i])[u[i + 2]])
            if w is not None and w not in m.unit:
                k = lm.ending(w)
                total += math.log10((counts[w] + 1) / (mass[k] + seen[k] + 1))
        want.append((str(d), total))
    got = sorted((str(x.doc_id), x.score) for x in lm.scored(blocks, totals, m).collect())
    for (a, x), (b, y) in zip(got, sorted(want)):
        assert a == b and abs(x - y) < 1e-4 * max(1, abs(y)), (a, x, y)
    held = [x for x in lm.scored(blocks, totals, m).collect() if x.held_out and x.doc_id < 1000]
    assert sum(x.score for x in held) > 0.9 * sum(x.base_score for x in held)


def test_hot_words_are_counted_alike(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(lm, "EVENTS", 1000)
    df = spark.createDataFrame(corpus(200, 1), "doc_id long, text string")
    some = {x.doc_id: (x.base_score, x.n_known) for x in lm.score(df).collect()}
    monkeypatch.setattr(lm, "MANY", 1e9)
    none = {x.doc_id: (x.base_score, x.n_known) for x in lm.score(df).collect()}
    assert some.keys() == none.keys() and all(abs(some[d][0] - none[d][0]) < 1e-9 and some[d][1] == none[d][1] for d in some)


def test_every_training_token_is_trained_on(spark, monkeypatch, tmp_path):
    """Also of a corpus that is large beside EVENTS."""
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 900)
    monkeypatch.setattr(lm, "EVENTS", 100)
    blocks = lm.coded(spark.createDataFrame(corpus(120, 5), "doc_id long, text string"))
    model = lm.learn(blocks)[1]
    real, at = lm.Trainer.batch, str(tmp_path)

    def batch(self, one, two, unit):
        with open(f"{at}/n", "a") as f:
            f.write(f"{len(unit)}\n")
        real(self, one, two, unit)

    rows = blocks.select("block", "words", "kinds", "codes", "held", "lengths").collect()
    monkeypatch.setattr(lm.Trainer, "batch", batch)
    import pyarrow as pa

    kinds = ("block", "words", "kinds", "codes", "held", "lengths")
    for half in range(2):
        list(lm._train(model, half, 2)([pa.RecordBatch.from_pydict({k: [bytes(r[k]) if k != "block" else r[k]] for k in kinds}) for r in rows]))
    assert sum(int(x) for f in tmp_path.iterdir() for x in f.read_text().split()) == model.tokens > 1000


def test_a_context_has_one_sum_over_classes_however_often_it_occurs(monkeypatch):
    often = {b"w%d" % i: 100 - i for i in range(40)}
    model = lm._untrained({}, often, np.zeros(lm.RARE, np.int64), np.ones(lm.RARE, np.int64), 5, 4000)
    r = np.random.default_rng(1)
    model = replace(model, params=model.params + r.normal(0, 0.2, model.params.shape))
    one, two, unit = r.integers(0, 3, 9000), r.integers(0, 2, 9000), r.integers(0, model.start, 9000)
    summed = []
    plain = lm._log_total
    monkeypatch.setattr(lm, "_log_total", lambda z: summed.append(z.shape) or plain(z))
    got = model.log10(one, two, unit)
    assert sum(n for n, k in summed if k == model.classes) <= 6
    context, cls, cls_bias, word, word_bias, pos = model.parts(model.params)
    soft = lambda z: z - np.log(np.exp(z).sum(1, keepdims=True))
    h, own = pos[0] * context[one] + pos[1] * context[two], model.class_of(unit)
    want = soft(h @ cls.T + cls_bias)[np.arange(9000), own]
    for c, (a, b) in enumerate(zip(model.first, model.first[1:])):
        at = np.flatnonzero(own == c)
        want[at] += soft(h[at] @ word[a:b].T + word_bias[a:b])[np.arange(len(at)), unit[at] - a]
    assert np.allclose(got, want / np.log(10), atol=1e-5)
