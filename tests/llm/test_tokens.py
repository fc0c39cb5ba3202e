import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ratingmill.llm import packing, wordpiece


def greedy(entries, word):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in entries), 0)
        if not k:
            return -1
        word, n = word[k:], n + 1
    return n


def test_automaton_is_greedy_longest_match():
    r = random.Random(0)
    for _ in range(200):
        entries = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))}
        a = wordpiece.Automaton(entries)
        for _ in range(40):
            w = bytes(r.choice(b"abc") for _ in range(r.randint(0, 14)))
            assert a.count(w) == greedy(entries, w), (entries, w)


ROWS = [(1, "Über the ändern\tof x"), (2, None), (3, ""), (4, " \n "), (5, "word " * 3000), (5, "the  two\n\nspaces "), (None, "id"), (7, "<|endoftext|> a b 12,5!!")]


def test_counts(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as n_words")
    known = wordpiece._counter(public_tokenizers.path(wordpiece.VOCABULARY))
    with open(public_tokenizers.path(wordpiece.VOCABULARY), "rb") as f:
        import base64

        entries = {base64.b64decode(x.split()[0]) for x in f}
    want = [(d, sum(greedy(entries, b" " + w) for w in (t or "").encode().lower().split())) for d, t in ROWS]
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_tokens) for r in wordpiece.token_counts(df).collect()), key=key) == sorted(want, key=key)
    assert known[b"the"] == 1


def test_ids_are_those_of_tokenizers(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(4)
    texts = [x or "" for _, x in ROWS] + ["".join(r.choice(["a", "don't", " ", "\n", ".", "ü", " ", "7", "\x1c"]) for _ in range(60)) for _ in range(300)]
    texts += ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> <|endoftext|>\n x", "<|endoftext|", "don't<|endoftext|>"]
    for x in texts:
        got = ids(x)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_best_fit():
    at, off = packing.best_fit(np.array([5, 4, 3, 6, 2]), 10)
    assert at.max() == 1 and sorted(zip(at, off)) == [(0, 0), (0, 6), (1, 0), (1, 5), (1, 8)]


def placed(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= size
    return len(bins)


def test_pack_rounds_are_gapless_and_tight(spark):
    r = random.Random(2)
    lengths = [r.randint(1, 60) if r.random() < 0.7 else 33 for _ in range(1500)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    got = packing.pack(items, 100, group_rows=200, slack=2)
    rows = got.join(items, "item").collect()
    assert len(rows) == 1500 and placed(rows, 100) <= 1.03 * sum(lengths) / 100 + 1


def test_documents(spark):
    rows = ROWS + [(10 + i, "the of and " * i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "2 as length", "3 as item")
    got = packing.pack_documents(df, 256).collect()
    placed(got, 256)
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in rows:
        own = ids.encode(t or "", add_special_tokens=False).ids
        b = struct.pack(f"<{len(own)}I", *own) + bytes(4)
        cuts = [0, *range(len(b) // 4 % 256 or min(256, len(b) // 4), len(b) // 4, 256), len(b) // 4]
        want += [(d, k, x, y - x, zlib.crc32(b[4 * x : 4 * y])) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    assert packing.pack_documents(df.limit(0)).count() == 0
