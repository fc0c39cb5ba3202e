import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ratingmill.llm import collocations

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, most=3, least=10, percent=50, top=2000):
    f = {}
    for lang, text in rows:
        c = f.setdefault("und" if lang is None else lang, Counter())
        for p in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", p)
            for k in range(1, most + 1):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in some.items():
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            longer = [v for q, v in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * v >= percent * a for v in longer):
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def texts(seed, n, words="aA bB c é  zz \x01 . , \n \t x!y 日本".split(" "), most=30):
    r = random.Random(seed)
    return [(r.choice(["en", "de", None, "und"]), r.choice([" ", "  ", " \t"]).join(r.choices(words, k=r.randrange(most)))) for _ in range(n)]


def found(spark, rows, **options):
    df = spark.createDataFrame([(*x, "x") for x in rows], "lang string, text string, phrase string").repartition(3)
    return sorted(tuple(r) for r in collocations.mine(df, **options).collect())


@pytest.mark.parametrize("shard", [40, 2 << 20])
def test_against_brute_force(spark, monkeypatch, shard):
    import functools

    monkeypatch.setattr(collocations, "shards", functools.partial(collocations.shards, most=shard))
    rows = texts(1, 250) + [("en", None), ("en", ""), ("fr", " . ,"), ("en", "The cat sat " * 40), ("en", "the cat sat. " * 15), ("x", "w " * 500)] + [("de", "hot pair")] * 300
    got = found(spark, rows)
    assert got == brute(rows) and len(got) > 40
    assert ("x", 1, "w w w", 498, 500, 499, 500, 1000000 * 498 * 498 // (500 * 499)) in got or ("x", 1, "w w w", 498, 499, 500, 500, 1000000 * 498 * 498 // (500 * 499)) in got


def test_other_limits_ties_and_empty_tables(spark):
    rows = texts(2, 150, list("abcde"), 20)
    got = found(spark, rows, most_words=4, least=5, percent=80, top=7)
    assert got == brute(rows, 4, 5, 80, 7) and {r[1] for r in got} == set(range(1, 8))
    assert found(spark, [("en", "a b")] * 9) == []
    assert found(spark, [("en", "B a"), ("en", "b A")] * 5) == [("en", 1, "b a", 10, 10, 10, 20, 1000000)]
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).count() == 0
    assert found(spark, [(None, None), ("en", "...")]) == []


def test_shards_hold_every_word_once_in_bounded_parts():
    data = " ".join(f"w{i}" + "." * (i % 7 == 0) for i in range(500))
    batch = pa.record_batch({"lang": ["en", "de", "en"], "text": [data, data, "x" * 900]})
    for overlap in (1, 2):
        n = Counter()
        for s in collocations.shards(iter([batch]), overlap, 200):
            assert sum(map(len, s.words)) < 1500
            words = [s.words[i] for i in s.ids]
            new = np.flatnonzero(~s.old)
            n.update((s.lang, words[i]) for i in new if s.ids[i])
            for i in new:  # what precedes a word in its piece is there, as far as the overlap reaches
                if s.ids[i] and words[i] != b"x" * 900 and words[i] != b"w0":
                    before = int(words[i][1:]) - 1
                    assert words[i - 1] == (b"." if before % 7 == 0 else b"w%d" % before)
        assert n == Counter({(lang, b"w%d" % i): 1 for i in range(500) for lang in ("en", "de")} | {("en", b"x" * 900): 1})


def test_a_bound_is_never_too_small(spark):
    rows = texts(3, 200, list("abcdefgh"), 20)
    df = spark.createDataFrame([("en", t) for _, t in rows], "lang string, text string")
    batch = pa.record_batch({"lang": ["en"] * len(rows), "text": [t for _, t in rows]})
    exact = Counter()
    for s in collocations.shards(iter([batch]), 1):
        at = np.flatnonzero(s.pairs())
        exact.update((s.words[s.ids[i]], s.words[s.ids[i + 1]]) for i in at)
        cells = {(s.words[s.ids[i]], s.words[s.ids[i + 1]]): int(s.cells(16, 2)[1][i]) for i in at}
    bits = collocations.sketch(df, 20, 16)
    on = {p for p, c in cells.items() if bits[c >> 3] >> (c & 7) & 1}
    assert {p for p, n in exact.items() if n >= 20} <= on and len(on) < len(exact)
