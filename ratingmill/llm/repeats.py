"""Repeated passages: suffix order with common-prefix lengths, by induction, over shards that hold all that can repeat.

A byte goes if a string of `least` bytes that covers it also starts in a document with a smaller doc_id. Every string of `least`
bytes has an anchor, the k-gram in it with the smallest hash (the leftmost of equals); equal strings have equal anchors at equal
places. So strings are compared among the occurrences of an anchor only:

1. Documents are coded in blocks, a table bucketed by block. Each block gives its anchors' hashes, with a hash of the surroundings
   and the smallest doc_id that has them, packed and split by hash.
2. A task that has all occurrences of a hash drops anchors of one document, and settles those whose surroundings are all equal.
3. The surroundings of the others are the shards' segments, distinct ones once. An anchor with very many kinds of surroundings is
   split further, by the whole string, so that no task gets an unbounded group.
4. In a shard the order of suffixes is induced from right to left: a stable pass over the order of the suffixes one byte further
   on, by the byte before them, is the next order; the common prefix of two neighbours is one more than the least of those between
   their successors. Runs with a common prefix of `least` bytes are the equal strings, and have one smallest doc_id.
5. Blocks get the smallest doc_ids back, and drop what a smaller one covers.

Text is written once and not shuffled; steps 2 to 5 move packed hashes and the segments. Surroundings count as equal by 64 bits of hash
besides the anchor's 40. The queue of segments is Spark's shuffle and its external sorter, which are on disk: a task takes segments
from it in the order of their anchors, about SHARD at once, and only these are arrays in memory, however large a shard of keys is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.blocks import bucketed, numbers
from ratingmill.llm.common import pack, partitions, stash, tune, unpack

LEAST, GRAM = 50, 24
BLOCK_BYTES = 2 << 20
#: Strings whose anchors are found at once; places within must fit PLACE bits.
STRINGS = 1 << 18
#: Kinds of surroundings above which an anchor is split by the whole string.
HOT = 5000
#: Segments that are put in order at once.
SHARD = 60_000
BITS, PLACE = np.uint64(40), np.uint64(24)
ONE, KINDS, SPLIT = 0, 1, 2


def _steps(a: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences, modulo 2 ** 64."""
    return np.diff(a, prepend=a.dtype.type(0))


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of each substring of `size` bytes; empty if there is none."""
    if len(text) < size:
        return np.zeros(0, np.uint64)
    power, run, length = np.array([0x9E3779B97F4A7C15], np.uint64), text.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    while True:
        if size & length:
            n = len(text) - done - length + 1
            out, done = (run if out is None else out[:n] * power + run[done : done + n]), done + length
        if done == size:
            return out
        run, power, length = run[: len(text) - 2 * length + 1] * power + run[length : len(text) - length + 1], power * power, 2 * length


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` numbers in a row."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    n = len(x) + size - width
    return np.minimum(x[:n], x[width - size : width - size + n])


class Block:
    """Texts end to end: doc (of each text), start, end."""

    def __init__(self, row, least: int, gram: int):
        self.least, self.gram = least, gram
        self.text = zstandard.decompress(row.text)
        self.docs, self.named = unpack(row.docs, np.int64), unpack(row.named, np.bool_)
        self.end = np.cumsum(unpack(row.lengths, np.int64))
        self.start = np.r_[0, self.end[:-1]]

    def anchors(self) -> None:
        """at: places of anchors; hash: of their k-gram; low, high: the first and last string whose anchor it is; owner: the text;
        around: a hash of what lies from the first string to the end of the last, and of the anchor's place in it.

        Strings are looked at STRINGS at a time, so that working arrays are small however long the texts are."""
        edge = np.zeros(len(self.text) + 1, np.int8)  # strings within one text that takes part
        there = (self.end - self.start >= self.least) & self.named
        edge[self.start[there]] += 1
        edge[self.end[there] - self.least + 1] -= 1
        whole = np.cumsum(edge, dtype=np.int8).astype(bool)
        parts = [self._part(i, whole) for i in range(0, max(len(self.text) - self.least + 1, 0), STRINGS)]
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3
        at, low, high, h, s, t = (np.concatenate(x) for x in zip(none, *parts))
        if len(at):  # an anchor may have strings on both sides of a cut
            new = np.r_[True, at[1:] != at[:-1]]
            last = np.r_[new[1:], True]
            at, low, high, h, s, t = at[new], low[new], high[last], h[new], s[new], t[last]
        self.at, self.low, self.high, self.hash = at, low, high, h
        self.owner = np.searchsorted(self.end, at, "right")
        # the first and last string share the anchor: together they fix all between
        x = _mix(s, 1) + _mix(t, 2) * np.uint64(3)
        self.around = _mix(x + ((at - low) * 64 + high - low).astype(np.uint64), 3)

    def _part(self, first: int, whole: np.ndarray) -> tuple[np.ndarray, ...]:
        raw = np.frombuffer(self.text, np.uint8, min(STRINGS + self.least - 1, len(self.text) - first), first)
        # a hash of 40 bits, then the place: the least is the leftmost of the smallest hashes
        h = _mix(_hashes(raw, self.gram), 0) >> PLACE
        found = _slide((h << PLACE) | np.arange(len(h), dtype=np.uint64), self.least - self.gram + 1)
        starts = np.flatnonzero(whole[first : first + len(found)])
        anchor = (found[starts] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
        new = np.r_[True, anchor[1:] != anchor[:-1]] if len(starts) else np.zeros(0, bool)
        last = np.r_[new[1:], True] if len(starts) else new
        at, low, high = anchor[new], starts[new], starts[last]
        strings = _hashes(raw, self.least)
        return at + first, low + first, high + first, h[at], strings[low], strings[high]


BLOCKS = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("text", pa.binary()), ("docs", pa.binary()), ("named", pa.binary()), ("lengths", pa.binary())])
BLOCKS_DDL = "block long, size long, text binary, docs binary, named binary, lengths binary"


def _code(buckets: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, docs, texts, size = numbers(TaskContext.get().partitionId(), buckets), [], [], 0

        def flush() -> pa.RecordBatch:
            row = [next(own), size, zstandard.compress(b"".join(texts), 3), pack(np.array([d or 0 for d in docs], np.int64)), pack(np.array([d is not None for d in docs], np.bool_)), pack(np.array([len(t) for t in texts], np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCKS)], schema=BLOCKS)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = (text or "").encode("utf-8", "surrogatepass")
                docs.append(doc)
                texts.append(t)
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield flush()
                    docs, texts, size = [], [], 0
        if docs:
            yield flush()

    return each


HASHES_DDL = "bucket long, block long, hashes binary, around binary, doc binary, many binary"


def _send(least: int, gram: int, buckets: int):
    """Packed (hash, surroundings, smallest doc_id, whether more documents of the block have them), split by hash."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                x = Block(row, least, gram)
                x.anchors()
                if not len(x.at):
                    continue
                h, s, d = x.hash, x.around, x.docs[x.owner]
                order = np.lexsort((d, s, h))
                h, s, d = h[order], s[order], d[order]
                cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
                many = np.maximum.reduceat(d, cut) != d[cut]
                h, s, d = h[cut], s[cut], d[cut]
                # least hashes are small, so they are mixed again to be dealt out evenly
                bucket = ((_mix(h, 4) >> PLACE) * np.uint64(buckets) >> BITS).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                h, s, d, many = h[order], s[order], d[order], many[order]
                at = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = [
                    (k, row.block, pack(_steps(h[i:j])), pack(s[i:j]), pack(d[i:j]), pack(many[i:j]))
                    for k, (i, j) in enumerate(zip(at, at[1:])) if j > i
                ]
                yield pd.DataFrame(out, columns=["bucket", "block", "hashes", "around", "doc", "many"])

    return each


SHARED_DDL = "block long, hashes binary, mode binary, lowest binary"


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block, its hashes that more than one document has: how they go on, and the smallest doc_id that has them."""
    h = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in pdf["hashes"]]
    n = [len(x) for x in h]
    block = np.repeat(np.arange(len(pdf)), n)
    h = np.concatenate(h)
    s, d, many = (np.concatenate([unpack(x, kind) for x in pdf[c]]) for c, kind in (("around", np.uint64), ("doc", np.int64), ("many", np.bool_)))
    order = np.argsort(h, kind="stable")
    h, s, d, many, block = h[order], s[order], d[order], many[order], block[order]
    cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    lowest = np.minimum.reduceat(d, cut)
    shared = np.maximum.reduceat(many, cut) | (np.maximum.reduceat(d, cut) != lowest)
    size = np.diff(np.r_[cut, len(h)])
    mode = np.where(np.minimum.reduceat(s, cut) == np.maximum.reduceat(s, cut), ONE, np.where(size > HOT, SPLIT, KINDS)).astype(np.uint8)
    group = np.repeat(np.arange(len(cut)), size)
    keep = shared[group]
    h, group, block = h[keep], group[keep], block[keep]
    order = np.argsort(block, kind="stable")
    h, group, block = h[order], group[order], block[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (block[1:] != block[:-1])] if len(h) else np.zeros(0, bool)
    h, group, block = h[new], group[new], block[new]
    at = np.searchsorted(block, np.arange(len(pdf) + 1))
    out = [
        (int(b), pack(_steps(h[i:j])), pack(mode[group[i:j]]), pack(lowest[group[i:j]]))
        for b, i, j in zip(pdf["block"], at, at[1:]) if j > i
    ]
    return pd.DataFrame(out, columns=["block", "hashes", "mode", "lowest"])


#: kind 0: what a block keeps for the end (a: places covered already; b, c: text, first string, last string of each open anchor and
#: its segment). kind 1: a segment (a: its bytes; key: shard; place: of the anchor in it; doc: the smallest doc_id; number: in the block).
PARTS_DDL = "kind int, block long, key long, number int, place int, doc long, a binary, b binary"


def _segments(least: int, gram: int):
    def each(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in left.itertuples():
            if not len(right):
                continue
            h = np.concatenate([np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in right["hashes"]])
            mode = np.concatenate([unpack(x, np.uint8) for x in right["mode"]])
            lowest = np.concatenate([unpack(x, np.int64) for x in right["lowest"]])
            order = np.argsort(h)
            h, mode, lowest = h[order], mode[order], lowest[order]
            x = Block(row, least, gram)
            x.anchors()
            mine = x.hash
            k = np.minimum(np.searchsorted(h, mine), len(h) - 1)
            there = h[k] == mine
            doc = x.docs[x.owner]
            closed = there & (mode[k] == ONE) & (lowest[k] < doc)
            covered = np.stack([x.low[closed], x.high[closed]])
            known: dict[tuple, int] = {}
            segs, where = [], []
            for i in np.flatnonzero(there & (mode[k] != ONE)):
                a, low, high, d = int(x.at[i]), int(x.low[i]), int(x.high[i]), int(doc[i])
                spans = [(low, high)] if mode[k[i]] == KINDS else [(s, s) for s in range(low, high + 1)]
                for lo, hi in spans:
                    body, place = x.text[lo : hi + least], a - lo
                    key = int(mine[i])
                    if mode[k[i]] == SPLIT:  # a shard of its own for each string
                        key = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)
                    n = known.setdefault((key, place, body), len(segs))
                    if n == len(segs):
                        segs.append([key, place, d, body])
                    elif d < segs[n][2]:
                        segs[n][2] = d
                    where.append((x.owner[i], lo, hi, n))
            where = np.array(where, np.int64).reshape(-1, 4)
            rows.append((0, row.block, None, None, None, None, pack(covered.ravel()), pack(where.ravel())))
            rows += [(1, row.block, key, n, place, d, body, None) for n, (key, place, d, body) in enumerate(segs)]
        return pd.DataFrame(rows, columns=["kind", "block", "key", "number", "place", "doc", "a", "b"]).astype({"key": "Int64", "number": "Int32", "place": "Int32", "doc": "Int64"})

    return each


def induce(rows: np.ndarray, least: int, columns: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, order, same) for each of the first `columns` columns, right to left: rows in the order of their suffixes from the
    column on, and whether a row has `least` bytes in common with the one before it. rows: bytes + 1, 0 where there is none."""
    n, wide = rows.shape
    order, common = np.arange(n), np.zeros(n, np.int32)
    for j in range(wide - 1, -1, -1):
        byte = rows[order, j]
        move = np.argsort(byte, kind="stable")
        levels, size = [common], 1  # least common prefix of 1, 2, 4 ... neighbours from here on
        while 2 * size <= n:
            levels.append(np.minimum(levels[-1][:-size], levels[-1][size:]))
            size *= 2
        lo, hi = move[:-1] + 1, move[1:] + 1  # the successors' neighbours that lie between
        same = byte[move[1:]] == byte[move[:-1]]
        lo, hi = lo[same], hi[same]
        depth = np.frexp((hi - lo).astype(np.float64))[1] - 1
        least_of = np.zeros(len(lo), np.int32)
        for d in np.unique(depth):
            at = depth == d
            least_of[at] = np.minimum(levels[d][lo[at]], levels[d][hi[at] - (1 << int(d))])
        common = np.zeros(n, np.int32)
        common[1:][same] = least_of + 1
        order = order[move]
        if j < columns:
            yield j, order, common >= least


RESULT_DDL = "kind int, block long, key long, number int, place int, doc long, a binary, b binary"


def _order(least: int, gram: int):
    """The smallest doc_id of each string of each segment, for the blocks."""
    width = least - gram + 1

    def solve(key, place, body, doc) -> list[np.ndarray]:
        code: dict[tuple, int] = {}
        mine = [code.setdefault((k, p, b), len(code)) for k, p, b in zip(key, place, body)]
        low = np.full(len(code), np.iinfo(np.int64).max)
        np.minimum.at(low, mine, doc)
        rows = np.zeros((len(code), least + width - 1), np.uint16)
        first = np.zeros(len(code), np.int64)
        strings = np.zeros(len(code), np.int64)
        for (_, p, b), i in code.items():
            first[i], strings[i] = width - 1 - p, len(b) - least + 1
            rows[i, first[i] : first[i] + len(b)] = np.frombuffer(b, np.uint8).astype(np.uint16) + 1
        best = np.zeros((len(code), width), np.int64)
        for j, order, same in induce(rows, least, width):
            has = (j >= first[order]) & (j < first[order] + strings[order])
            cut = np.flatnonzero(~same)
            value = np.where(has, low[order], np.iinfo(np.int64).max)
            best[order, j] = np.repeat(np.minimum.reduceat(value, cut), np.diff(np.r_[cut, len(order)]))
        return [best[i, first[i] : first[i] + strings[i]] for i in mine]

    def answer(t: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, tuple[list, list]] = {}
        lows = solve(t["key"], t["place"], t["a"], t["doc"].to_numpy(np.int64))
        for block, number, low in zip(t["block"], t["number"], lows):
            ns, values = out.setdefault(block, ([], []))
            ns.append((number, len(low)))
            values.append(low)
        rows = [(2, b, None, None, None, None, pack(np.array(n, np.int64).ravel()), pack(np.concatenate(v))) for b, (n, v) in out.items()]
        return pd.DataFrame(rows, columns=["kind", "block", "key", "number", "place", "doc", "a", "b"]).astype({"key": "Int64", "number": "Int32", "place": "Int32", "doc": "Int64"})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:  # by key: whole groups, about SHARD segments at once
            held.append(b)
            n += len(b)
            if n >= SHARD:
                t = pd.concat(held)
                last = t["key"] == t["key"].iloc[-1]
                if not last.all():
                    yield answer(t[~last])
                held, n = [t[last]], int(last.sum())
        if n:
            yield answer(pd.concat(held))

    return each


FOUND_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _drop(least: int, gram: int, spans: bool):
    def each(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            x = Block(row, least, gram)
            cover = np.zeros(len(x.text) + 1, np.int32)
            for state in right[right["kind"] == 0].itertuples():
                low, high = unpack(state.a, np.int64).reshape(2, -1)
                np.add.at(cover, low, 1)
                np.add.at(cover, high + least, -1)
                where = unpack(state.b, np.int64).reshape(-1, 4)
                if not len(where):
                    continue
                size = int(where[:, 3].max()) + 1
                begin, values, base = np.zeros(size, np.int64), [], 0
                for found in right[right["kind"] == 2].itertuples():
                    n = unpack(found.a, np.int64).reshape(-1, 2)
                    begin[n[:, 0]] = base + np.cumsum(n[:, 1]) - n[:, 1]
                    values.append(unpack(found.b, np.int64))
                    base += int(n[:, 1].sum())
                values = np.concatenate(values)
                owner, low, high, number = where.T
                many = high - low + 1
                which = np.repeat(np.arange(len(where)), many)
                step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                gone = values[begin[number[which]] + step] < x.docs[owner[which]]
                at = (low[which] + step)[gone]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + least, -1)
            covered = np.cumsum(cover[:-1], dtype=np.int32) > 0
            raw = np.frombuffer(x.text, np.uint8)
            total = np.r_[np.int32(0), np.cumsum(covered, dtype=np.int32)]
            for i, (a, b) in enumerate(zip(x.start.tolist(), x.end.tolist())):
                doc = int(x.docs[i]) if x.named[i] else None
                if total[a] == total[b]:
                    runs, kept = [], x.text[a:b]
                else:
                    part = covered[a:b]
                    edge = np.flatnonzero(np.diff(np.r_[False, part, False]))
                    runs, kept = edge.reshape(-1, 2).tolist(), raw[a:b][~part].tobytes()
                base = (doc, b - a, int(total[b] - total[a]), len(runs), hashlib.sha256(kept).hexdigest())
                out.append((*base, runs, kept) if spans else base)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 7 if spans else 5]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return each


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, spans: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document; with spans also the removed [start, end) and the bytes
    that are kept.

    Strings are bytes of UTF-8 and never cross documents; null is empty; texts under `least` bytes lose nothing. Documents with
    the same doc_id remove nothing from each other, and one without doc_id neither removes nor loses. Equal rows are kept each;
    an empty table gives no row; other columns are not looked at.
    """
    spark = tune(docs.sparkSession)
    n = partitions(spark)
    blocks = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_code(n), BLOCKS_DDL), n)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(n, -(-int(size) // (4 * BLOCK_BYTES)))
    sent = blocks.mapInPandas(_send(least, gram, buckets), HASHES_DDL).repartition(buckets, "bucket")
    shared = stash(sent.groupBy("bucket").applyInPandas(_shared, SHARED_DDL))
    parts = stash(blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(_segments(least, gram), PARTS_DDL))
    solved = parts.where("kind = 1").repartition(buckets, "key").sortWithinPartitions("key").mapInPandas(_order(least, gram), RESULT_DDL)
    ready = parts.where("kind = 0").unionAll(stash(solved))
    ddl = FOUND_DDL + (", spans array<array<long>>, kept binary" if spans else "")
    return blocks.groupBy("block").cogroup(ready.groupBy("block")).applyInPandas(_drop(least, gram, spans), ddl)
