"""Benchmark decontamination: rare n-grams seed passages, Smith-Waterman alignment scores them.

The seeds are complete: no alignment that reaches the limit is without one. With a match worth 2 and an edit -1, an alignment of
score s with M matched words has 2 M - s edits at most, and these cut its matches into runs that hold M - (2 M - s) - 1 = s - M - 1
whole pairs of neighbouring words at least. M is at most the item's m words, so an alignment with s >= least * 2 m has
B = (2 least - 1) m - 1 matched pairs at least, within 3 m - s words of the document. Hence of the m - 1 pairs of an item, those
but the B - 1 that most items have are seeds: one of them is in the document. An item whose seeds are hit is counted by all its pairs;
places where B of them lie near enough to each other make a passage, which is aligned word by word. Where B is less than one (short
items) the same is done with single words, of which M >= s / 2 are matched. Items of fewer than `least_words` words can't be told
from chance by a part of them, so they must match whole.

Items go to the workers in blocks of at most `block_words` words, so what is broadcast has a bound; each block is a pass over all
documents. Which items share a block changes the order of seeds, never what is found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.common import arrow_rows, cut, filtered, stash, tune

#: Shorter items must match whole.
LEAST_WORDS = 5
#: Of an alignment's score, by that of the whole item's with itself.
LEAST = 0.6
BLOCK_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(score, end) of the best local alignment of two sequences of numbers; end: after the passage's last aligned word."""
    n = len(passage)
    ramp = np.arange(n + 1) * -GAP
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        up = row + GAP
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(passage == w, MATCH, MISMATCH))
        np.maximum(up, 0, out=up)
        row = np.maximum.accumulate(up + ramp) - ramp  # gaps within the row
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers end to end, and where each starts."""
    return np.array([x for own in lists for x in own], np.int64), np.cumsum([0, *map(len, lists)])


def _of(lists: tuple[np.ndarray, np.ndarray], which: np.ndarray) -> np.ndarray:
    """The numbers of some of the lists."""
    flat, start = lists
    n = start[which + 1] - start[which]
    return flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class Index:
    """Seeds of a block of items (item_id, words)."""

    def __init__(self, items: list[tuple[int, list[bytes]]], least: float = LEAST, least_words: int = LEAST_WORDS):
        if not 0.5 < least <= 1:
            raise ValueError("least must lie above one half: below it a passage need not have a word of the item")
        self.items = items
        self.least = [least if len(ws) >= least_words else 1.0 for _, ws in items]
        pairs = [list(zip(ws, ws[1:])) for _, ws in items]
        # matched pairs that an item needs; below one, matched words are counted
        need = [int(np.ceil((2 * x - 1) * len(ws) - 1 - 1e-9)) for x, (_, ws) in zip(self.least, items)]
        self.by_pair = [n >= 1 for n in need]
        self.need = [n if n >= 1 else max(1, int(np.ceil(x * len(ws) - 1e-9))) for n, x, (_, ws) in zip(need, self.least, items)]
        # an alignment spans so many words of a document at most: those matched, and the edits that its score allows
        self.span = [int(2 * len(ws) - x * len(ws) + len(ws) * (1 - x) + 1e-9) + 1 for x, (_, ws) in zip(self.least, items)]
        self.grams = [set(p if two else ws) for p, two, (_, ws) in zip(pairs, self.by_pair, items)]
        grams = [p if two else ws for p, two, (_, ws) in zip(pairs, self.by_pair, items)]
        have = Counter(g for own in self.grams for g in own)
        self.code = {g: i for i, g in enumerate(have)}
        # items by gram: with each of its places, and as a seed
        every, seeds = [[] for _ in have], [[] for _ in have]
        for k, own in enumerate(grams):
            for g in own:
                every[self.code[g]].append(k)
            rare = sorted(own, key=lambda g: (have[g], g))
            for g in set(rare[: len(rare) - self.need[k] + 1]):
                seeds[self.code[g]].append(k)
        self.every, self.seeds = _lists(every), _lists(seeds)
        self.least_hits = np.array(self.need, np.int64)
        self.known = [{g for g in have if isinstance(g, kind)} for kind in (tuple, bytes)]

    def passages(self, words: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(item, places [low, high) where it may lie) for each item that a document of these words may hold."""
        rows = [list(zip(words, words[1:])), words]
        there = np.array([self.code[g] for known, row in zip(self.known, rows) if known for g in known.intersection(row)], np.int64)
        seeded = _of(self.seeds, there)
        if not len(seeded):
            return
        enough = np.bincount(_of(self.every, there), minlength=len(self.items)) >= self.least_hits
        seen = np.zeros(len(self.items), bool)
        seen[seeded] = True
        hits = {k: [i for i, g in enumerate(rows[0 if self.by_pair[k] else 1]) if g in self.grams[k]] for k in np.flatnonzero(seen & enough).tolist()}
        for k, at in hits.items():
            need, span = self.need[k], self.span[k]
            at = np.array(at)
            if len(at) < need:
                continue
            near = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= span)
            if not len(near):
                continue
            low, high = at[near] - span, at[near + need - 1] + span + 2
            new = np.r_[True, low[1:] > np.maximum.accumulate(high)[:-1]]
            first = np.flatnonzero(new)
            yield k, list(zip(np.maximum(low[first], 0).tolist(), np.maximum.reduceat(high, first).tolist()))

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, float, int, int]]:
        """(item_id, similarity, start, end) of each item's best passage of a document's words, if it is similar enough; the first of equals."""
        codes: dict[bytes, int] = {}
        number = lambda ws: np.array([codes.setdefault(w, len(codes)) for w in ws])
        text = None
        for k, places in self.passages(words):
            text = number(words) if text is None else text
            item_id, ws = self.items[k]
            item, m, found = number(ws), len(ws), (0, 0, 0)
            for low, high in places:
                score, end = align(item, text[low:high])
                if score > found[0]:
                    found = (score, low, low + end)
            score, low, end = found
            if score >= self.least[k] * MATCH * m - 1e-9:
                _, back = align(item[::-1], text[low:end][::-1])
                yield item_id, score / (MATCH * m), end - back, end


def _indexes(spark, benchmark: DataFrame, least: float, least_words: int, block_words: int) -> Iterator:
    """The items' indexes, block by block, as broadcasts; at least one."""
    size = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", size.alias("n"))
    blocks = max(1, -(-int(items.agg(F.sum("n")).first()[0] or 0) // max(1, block_words)))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        block = items.where(F.col("block") == b).orderBy("item_id", "text").toLocalIterator()
        known = [(r.item_id, w) for r in block if (w := words_of(r.text))]
        yield spark.sparkContext.broadcast(Index(known, least, least_words))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, least_words: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, end_word) of every document and item whose best alignment reaches `least`.

    Words are lower case, between white space. The similarity is the alignment's score by that of the item with itself; of passages of
    equal score the first is given. Items of fewer than `least_words` words must match whole. Null, empty and blank items and
    documents match nothing; repeated items and documents match each. Rows without doc_id or item_id are compared too. An empty
    table on either side gives no row; other columns are not looked at.
    """
    spark = tune(docs.sparkSession)
    names = ["doc_id", "item_id", "similarity", "start_word", "end_word"]
    schema = pa.schema([(n, pa.float64() if n == "similarity" else pa.int64()) for n in names])
    ddl = ", ".join(f"{n} {'double' if n == 'similarity' else 'long'}" for n in names)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def compare(index) -> object:
        def each(c: dict) -> dict:
            out = {n: [] for n in names}
            for doc, text in zip(c["doc_id"], c["text"]):
                for found in index.value.matches(words_of(text)):
                    for n, v in zip(names, (doc, *found)):
                        out[n].append(v)
            return out

        return arrow_rows(each, schema)

    out = None
    for index in _indexes(spark, benchmark, least, least_words, block_words):
        part = rows.mapInArrow(compare(index), ddl)
        out = part if out is None else out.unionAll(cut(part))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, least_words: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, with all columns, whose text holds no benchmark item.

    Each row is decided where it lies, by its own text, whatever its doc_id and other columns; nothing is shuffled. Null, empty and
    blank texts stay, as do all rows if there is no item. Items in more than one block make a pass each over what is left.
    """

    spark, left = tune(docs.sparkSession), None
    for index in _indexes(spark, benchmark, least, least_words, block_words):
        free = lambda texts, x=index: [next(x.value.matches(words_of(t)), None) is None for t in texts]
        left = filtered(docs if left is None else stash(left), free)
    return left
