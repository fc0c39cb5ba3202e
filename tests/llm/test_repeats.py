import hashlib
import random

import numpy as np

from ratingmill.llm import repeats


def brute(rows, least=50):
    texts = [(d, (t or "").encode()) for d, t in rows]
    low = {}
    for d, b in texts:
        for i in range(len(b) - least + 1):
            if d is not None:
                low[b[i : i + least]] = min(low.get(b[i : i + least], d), d)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if d is not None and low[b[i : i + least]] < d:
                gone[i : i + least] = b"\1" * least
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def documents(n=120, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(8, 40))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 3))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 20)
            parts.insert(r.randrange(len(parts) + 1), p[a : len(p) - r.randint(0, 20)])
        if r.random() < 0.2 and rows:
            parts = [r.choice(rows)[1]]
        rows.append((n - i, " ".join(parts)))
    rows += [(500, "ab" * 200), (501, "x" + "ab" * 100), (502, "a" * 49), (503, "a" * 51), (504, "a" * 50 + "b"), (505, None), (506, ""), (None, rows[0][1]), (500, "ab" * 200), (507, rows[3][1] * 40), (508, "a" * 300)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as size").repartition(3)
    want = brute(rows)
    got = sorted((str(r[0]), *r[1:]) for r in repeats.remove_repeats(df).collect())
    assert got == want
    spans = repeats.remove_repeats(df, spans=True).collect()
    assert all(len(r.kept) == r.n_bytes - r.n_removed and sum(b - a for a, b in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in spans)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_hot_anchors_and_small_shards():
    """The steps without Spark, with limits that split everything."""
    import pandas as pd

    rows = documents(60, 3)
    old = repeats.HOT, repeats.SHARD, repeats.BLOCK_BYTES
    try:
        for hot, shard, size in ((0, 7, 900), (3, 1000, 4000), (10**6, 10**6, 10**6)):
            repeats.HOT, repeats.SHARD = hot, shard
            blocks, cur, n = [], [], 0
            for d, t in rows:
                cur.append((d, (t or "").encode()))
                n += len(cur[-1][1])
                if n >= size:
                    blocks.append(cur)
                    cur, n = [], 0
            blocks.append(cur)
            coded = pd.DataFrame([
                (k, 0, repeats.zstandard.compress(b"".join(t for _, t in b)), repeats.pack(np.array([d or 0 for d, _ in b], np.int64)), repeats.pack(np.array([d is not None for d, _ in b])), repeats.pack(np.array([len(t) for _, t in b], np.int64)))
                for k, b in enumerate(blocks)
            ], columns=repeats.BLOCKS.names)
            sent = pd.concat(list(repeats._send(50, 24, 3)(iter([coded]))))
            shared = pd.concat([repeats._shared(g) for _, g in sent.groupby("bucket")])
            parts = pd.concat([repeats._segments(50, 24)(coded[coded.block == k], shared[shared.block == k]) for k in range(len(blocks))])
            solved = [x for x in repeats._order(50, 24)(iter([parts[parts.kind == 1]]))]
            ready = pd.concat([parts[parts.kind == 0], *solved])
            got = pd.concat([repeats._drop(50, 24, False)(coded[coded.block == k], ready[ready.block == k]) for k in range(len(blocks))])
            assert sorted((str(None if pd.isna(r[0]) else r[0]), *r[1:]) for r in got.itertuples(index=False)) == brute(rows)
    finally:
        repeats.HOT, repeats.SHARD, repeats.BLOCK_BYTES = old


def test_anchors_do_not_depend_on_cuts(monkeypatch):
    text = b"abab" * 30 + bytes(random.Random(1).choices(b"ab", k=400)) + b"abab" * 30

    class Row:
        docs, named, lengths = repeats.pack(np.array([1, 2])), repeats.pack(np.array([True, True])), repeats.pack(np.array([60, len(text) - 60]))

    Row.text = repeats.zstandard.compress(text)
    whole = repeats.Block(Row, 50, 24)
    whole.anchors()
    monkeypatch.setattr(repeats, "STRINGS", 37)
    x = repeats.Block(Row, 50, 24)
    x.anchors()
    assert all((getattr(x, n) == getattr(whole, n)).all() for n in ("at", "low", "high", "hash", "owner", "around"))
    of = {}
    for at, low, high in zip(x.at, x.low, x.high):
        of |= {s: at - s for s in range(low, high + 1)}
    assert sorted(of) == [*range(11), *range(60, len(text) - 49)]
    seen = {}
    for s, place in of.items():
        assert seen.setdefault(text[s : s + 50], place) == place


def test_induced_order():
    r = np.random.default_rng(0)
    rows = r.integers(1, 3, (40, 30)).astype(np.uint16)
    rows[10:20, :] = rows[5]
    rows[10:20, 3] = 9
    for j, order, same in repeats.induce(rows, 12, 19):
        tails = [tuple(rows[i, j:]) for i in order]
        assert tails == sorted(tails)
        assert [bool(x) for x in same[1:]] == [a[:12] == b[:12] for a, b in zip(tails, tails[1:])]
