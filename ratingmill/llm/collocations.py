"""Phrase collocation mining: sketch bounds, automata over the candidates of a shard, exact thresholds.

A few readings of the texts, none of which sends more than what it has counted:

1. Words and pairs of adjacent words are counted in a sketch of hashed cells, whose sums are upper bounds of their counts. Cells that
   reach the threshold become one bit each: a bitmap of at most 2**MOST_BITS bits, whatever the texts. Then phrases of three words are
   counted in a sketch of their own, those alone whose pairs reach it, and so on for longer ones.
2. The bound of a phrase is the least of its own cell's sum and those of the phrases inside it. In each shard of a task's texts, the
   phrases whose bound reaches the threshold are compiled into an Aho-Corasick automaton, which finds all their places, overlaps
   included. A shard's words are read as codes of a few characters, the first of an alphabet of its own, and a delimiter stands
   wherever no candidate reaches over, as between pieces; so no match begins or ends inside a word or reaches over a border. Counts
   are added by phrase in a shuffle.
3. Thresholds, cuts and drops are joins and groupings of the exact counts.

No candidate is lost: bounds are never too small; a cell or pair that is only seemingly frequent costs time alone. Shards are bounded
in bytes; a text or piece longer than a shard is cut between words, and the words before the cut are read again as context.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.llm.common import partitions, release, stash, tune

SHARD_BYTES = 2 << 20
#: Bits of a cell's number, at least and at most: a bitmap has 64 MB at most. Between them there is a cell for each eight bytes of text.
LEAST_BITS, MOST_BITS = 16, 29
#: Cells whose counts go in one row.
BUCKET = 1 << 15
#: Counts of a cell that a row can tell; larger ones are told as this.
MOST_COUNT = (1 << 16) - 1
#: Characters of each place in a word's code. A node of the automaton looks its characters up one after the other.
DIGITS = 32
#: Cells that a task holds before it adds up equal ones.
HELD = 2_000_000
BORDER = b"."
#: Groups into which a language's phrases are dealt before its first ones are ranked.
DEALT = 64

# fixed values: characters that end a piece, and those between words
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else BORDER[0] if b in _ENDS else 32 if b == 9 else b for b in range(256))


class _Numbers(dict):
    """word -> number by first occurrence; the border of pieces is 0."""

    def __init__(self):
        self[BORDER] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Shard:
    """Words of one language: ids (0: border), the words by id, and which places are context, counted before."""

    def __init__(self, lang: str, data: bytes, context: int = 0):
        numbers = _Numbers()
        self.lang = lang
        self.ids = np.fromiter(map(numbers.__getitem__, data.replace(BORDER, b" . ").split()), np.int64)
        self.words = list(numbers)
        self.old = np.zeros(len(self.ids), bool)
        self.old[:context] = True

    def pairs(self) -> np.ndarray:
        """Where an adjacent pair of words ends; context included."""
        return (self.ids[:-1] > 0) & (self.ids[1:] > 0)

    def cells(self, bits: int, most: int) -> list[np.ndarray]:
        """For each length from 1 to most the cells of phrases: of words by id, of longer phrases by the place where they start (meaningless
        over a border)."""
        h = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        seed, k = np.uint64(xxhash.xxh64_intdigest(self.lang.encode("utf-8", "surrogatepass"))), np.uint64(0x9E3779B97F4A7C15)

        def mixed(x: np.ndarray) -> np.ndarray:
            x = (x ^ (x >> np.uint64(32))) * k
            return ((x ^ (x >> np.uint64(29))) >> np.uint64(64 - bits)).astype(np.int64)

        first = (h ^ seed) * k
        out, x, step = [mixed(first)], first[self.ids], h[self.ids] >> np.uint64(1)
        for length in range(2, most + 1):
            x = (x[:-1] ^ step[length - 1 :]) * (k if length > 2 else np.uint64(1))
            out.append(mixed(x))
        return out

    def candidates(self, bitmaps: Sequence[np.ndarray], cells: Sequence[np.ndarray]) -> list[np.ndarray]:
        """For each length from 2 to one more than there are bitmaps: where phrases start whose bound is frequent."""
        out = [self.pairs() & _is_on(bitmaps[0], cells[1])]
        for bitmap, cell in zip(bitmaps[1:], cells[2:]):
            both = out[-1][:-1] & out[-1][1:]
            both[both] = _is_on(bitmap, cell[both])
            out.append(both)
        return out


def _chunks(data: bytes, most: int, words: int) -> Iterator[tuple[bytes, int]]:
    """(part, context words at its start) of data, cut between words into parts of about `most` bytes."""
    at, before = 0, b""
    while len(data) - at > most:
        end = max(data.rfind(x, at + 1, at + most) for x in (b" ", BORDER))
        if end < 0:
            end = min((x for x in (data.find(b" ", at + most), data.find(BORDER, at + most)) if x >= 0), default=-1)
        if end < 0:
            break
        part = before + data[at:end]
        context = len(before.replace(BORDER, b" . ").split())
        yield part, context
        tail = part[-4096:].replace(BORDER, b" . ").split()
        if len(tail) <= words:
            tail = part.replace(BORDER, b" . ").split()
        before, at = b" ".join(tail[-words:]) + b" " if words else b"", end
    yield before + data[at:], len(before.replace(BORDER, b" . ").split())


def shards(batches: Iterator[pa.RecordBatch], overlap: int, most: int = SHARD_BYTES) -> Iterator[Shard]:
    """The texts of batches (lang, text) as shards of about `most` bytes, each of one language."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def flush(lang: str) -> Iterator[Shard]:
        for part, context in _chunks(BORDER.join(held.pop(lang)), 2 * most, overlap):
            yield Shard(lang, part, context)
        size.pop(lang)

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_TABLE)
            held.setdefault(lang, []).append(data)
            size[lang] = size.get(lang, 0) + len(data) + 1
            if size[lang] >= most:
                yield from flush(lang)
            elif sum(size.values()) >= 4 * most:  # many languages
                for x in list(held):
                    yield from flush(x)
    for x in list(held):
        yield from flush(x)


def _added(cells: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: the places of its cells, then their counts."""
    which, n = np.unique(np.concatenate(cells), return_counts=True) if cells else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    places, n = (which % BUCKET).astype(np.uint16), np.minimum(n, MOST_COUNT).astype(np.uint16)
    buckets, starts = np.unique(which // BUCKET, return_index=True)
    ends = [*starts[1:], len(which)]
    for i in range(0, len(buckets), 512):
        parts = [places[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(starts[i : i + 512], ends[i : i + 512])]
        yield pa.RecordBatch.from_arrays([pa.array(buckets[i : i + 512], pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "cells"])


def sketch(texts: DataFrame, least: int, bits: int, known: Sequence[np.ndarray] = ()) -> np.ndarray:
    """The bitmap of cells whose phrases occur at least `least` times together; texts: (lang, text). Without known bitmaps the phrases are
    words and pairs; with those of all shorter phrases, they are the next longer ones that have frequent bounds by them."""
    if not 1 <= least <= MOST_COUNT:
        raise ValueError(f"least must be from 1 to {MOST_COUNT}")
    length = len(known) + 2
    sent = texts.sparkSession.sparkContext.broadcast(list(known)) if known else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for s in shards(batches, length - 1):
            cells = s.cells(bits, length)
            if sent is None:
                new = [cells[0][s.ids[~s.old & (s.ids > 0)]], cells[1][s.pairs() & ~s.old[1:]]]
            else:
                shorter = s.candidates(sent.value, cells)[-1]
                new = [cells[-1][shorter[:-1] & shorter[1:] & ~s.old[length - 1 :]]]
            held += new
            n += sum(map(len, new))
            if n >= HELD:
                yield from _added(held)
                held, n = [], 0
        yield from _added(held)
        release()

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by bucket: one bucket's counts are held at a time."""
        now, total = None, np.zeros(BUCKET, np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["bucket", "bits"])

        for b in batches:
            for bucket, row in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != now:
                    if now is not None:
                        yield told()
                    now = bucket
                    total[:] = 0
                places, n = np.frombuffer(row.as_py(), np.uint16).reshape(2, -1)
                total[places] += n  # a row has a place once
        if now is not None:
            yield told()

    cells = texts.mapInArrow(each, "bucket int, cells binary")
    dealt = cells.repartition(partitions(texts.sparkSession), "bucket").sortWithinPartitions("bucket")
    out = np.zeros((max(1, (1 << bits) // BUCKET), BUCKET // 8), np.uint8)
    for r in dealt.mapInArrow(often, "bucket int, bits binary").collect():  # 2**MOST_BITS / 8 bytes at most
        out[r.bucket] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel()


def _is_on(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return ((bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).astype(bool)


class _Codes:
    """Words (ids) as codes of a few characters, all of the same length; the first character is of an alphabet of its own."""

    FIRST, LATER, BORDER = 0x100, 0x40, "\n"

    def __init__(self, ids: np.ndarray, n_words: int):
        known = np.unique(ids)
        self.number = np.zeros(n_words, np.int64)
        self.number[known] = np.arange(len(known))
        self.length = max(1, math.ceil(math.log(max(len(known), 2), DIGITS) - 1e-9))

    def of(self, ids: np.ndarray) -> np.ndarray:
        """A row of characters for each id."""
        number, out = self.number[ids], np.empty((len(ids), self.length), np.uint32)
        for j in range(self.length - 1, -1, -1):
            out[:, j] = number % DIGITS + (self.LATER if j else self.FIRST)
            number = number // DIGITS
        return out


def _text(characters: np.ndarray) -> str:
    return characters.astype("<u4").tobytes().decode("utf-32-le")


def _distinct(rows: np.ndarray, n: int) -> np.ndarray:
    """The different rows; all numbers are below n."""
    length = rows.shape[1]
    if n**length >= 1 << 62:
        return np.unique(rows, axis=0)
    code = np.unique(rows @ (n ** np.arange(length - 1, -1, -1, dtype=np.int64)))
    return np.stack([code // n**j % n for j in range(length - 1, -1, -1)], 1)


def counted(s: Shard, frequent: Sequence[np.ndarray], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids of phrases, a row each; counts) for each length from 1 on, of words and phrases whose bound is frequent."""
    n_words = len(s.words)
    cells = s.cells(bits, len(frequent) + 1)
    words = np.flatnonzero(_is_on(frequent[0], cells[0]))
    words = words[words > 0]
    yield words[:, None], np.bincount(s.ids[~s.old], minlength=n_words)[words]
    runs = s.candidates(frequent, cells)
    pair = runs[0]
    if not pair.any():
        return
    keys = []
    for length, run in enumerate(runs, 2):
        at = np.flatnonzero(run)
        keys.append(_distinct(np.stack([s.ids[at + j] for j in range(length)], 1), n_words))
    # what the automaton reads: words of candidate pairs, with a border before each that no candidate joins to the word before it
    joined = np.concatenate([[False], pair])
    read = np.flatnonzero(joined | np.concatenate([pair, [False]]))
    codes = _Codes(s.ids[read], n_words)
    machine, k = ahocorasick.Automaton(), 0
    for rows in keys:
        flat, length = _text(codes.of(rows.ravel())), rows.shape[1] * codes.length
        for i in range(0, len(flat), length):
            machine.add_word(flat[i : i + length], k)
            k += 1
    machine.make_automaton()
    text = np.concatenate([np.full((len(read), 1), ord(codes.BORDER), np.uint32), codes.of(s.ids[read])], 1)
    there = np.ones(text.shape, bool)
    there[:, 0] = ~joined[read]
    met = machine.iter(_text(text[there]))
    if s.old.any():
        old = np.broadcast_to(s.old[read][:, None], there.shape)[there]
        ends = (x for at, x in met if not old[at])
    else:
        ends = (x for _, x in met)
    counts = np.bincount(np.fromiter(ends, np.int64), minlength=k)
    k = 0
    for rows in keys:
        yield rows, counts[k : k + len(rows)]
        k += len(rows)


def counts(texts: DataFrame, frequent: Sequence[np.ndarray], bits: int) -> DataFrame:
    """(key, f): exact counts of words and longer phrases whose bound is frequent, and of each language's words together (an empty phrase).
    key: the language, a line end (no word has one), the phrase."""
    sent = texts.sparkSession.sparkContext.broadcast(list(frequent))  # at most 2**MOST_BITS bits each

    def batch(keys: list[str], n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64())], names=["key", "f"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shards(batches, len(frequent)):
            yield batch([f"{s.lang}\n"], [np.count_nonzero(s.ids[~s.old])])
            names = [w.decode("utf-8", "surrogatepass") for w in s.words]
            for rows, n in counted(s, sent.value, bits):
                at = np.flatnonzero(n)
                for i in range(0, len(at), 1 << 15):
                    part = at[i : i + (1 << 15)]
                    yield batch([f"{s.lang}\n{' '.join([names[x] for x in r])}" for r in rows[part].tolist()], n[part])
            release()

    return texts.mapInArrow(each, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))


def mine(docs: DataFrame, most_words: int = 3, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language by score, a and phrase (UTF-8 bytes).

    Words are `[^\\x20\\x09]+` of pieces between `[.,;:!?\\x0A-\\x0D]`, A-Z in lower case. a is a phrase's count of contiguous
    occurrences, l and r those of the parts of its lowest-scoring cut (ties: the earliest), n all words of the language, and score
    floor(1000000 * a * a / (l * r)). A phrase goes if a longer candidate that holds it has at least `percent` hundredths of its count.

    Null texts are empty, a null lang is `und`; equal rows count each; empty texts, pieces and tables have no word. Languages without
    a candidate give no row; other columns are not looked at. Texts are counted whole, whatever their length.
    """
    if most_words < 2:
        raise ValueError("phrases have two words or more")
    tune(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(max(math.ceil(math.log2(max(size, 8) / 8)), LEAST_BITS), MOST_BITS)
    frequent: list[np.ndarray] = []
    for _ in range(most_words - 1):
        frequent.append(sketch(texts, least, bits, frequent))
    every = counts(texts, frequent, bits)
    # parts of a candidate are as frequent as it is at least
    every = every.where((F.col("f") >= least) | F.endswith("key", F.lit("\n"))).withColumn("phrase", F.substring_index("key", "\n", -1))
    lang = F.left("key", F.length("key") - F.length("phrase") - 1)
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    found = stash(every.select(lang.alias("lang"), words.alias("words"), "phrase", "f"))
    f = found.where("words > 0").select("lang", "phrase", "f")
    candidates = found.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")

    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    long = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", long("a").alias("da"), long("l").alias("dl"), long("r").alias("dr"))
    cuts = cuts.withColumn("score", F.expr("(1000000BD * da * da) div (dl * dr)"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = candidates.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    inner = inner.groupBy("lang", part(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))

    best = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = left.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "dealt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    n = found.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
