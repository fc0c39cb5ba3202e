"""Language-model scores: add-one word counts and a log-bilinear model trained with noise-contrastive estimation.

The model predicts a word from the two words before it. Every word that makes up a share of SHARE of the training tokens, and occurs
LEAST_COUNT times, is in its vocabulary; a rarer word is one of RARE kinds, by a hash of its last two bytes, and takes its place in
its kind by its count. Each word or kind has a vector as a context and one as a target: a context gives the vector
h = r1 * E[one before] + r2 * E[two before], a target the score T . h + bias. So that scores are normalised exactly over a large
vocabulary, it is factored: words in the order of their reversed spelling are cut into about the square root of their number of
classes, the kinds and the end of a text are classes of their own, and log p(word) = log p(class) + log p(word in its class), each a
softmax over all classes, or all words of the class, by one matrix product for many tokens.

Training is stochastic gradient descent in numpy on noise-contrastive estimation: an observed class, or word of a class, is told
from ones drawn from their frequencies, which the events of a step, or those of a class in it, share. A pass goes over all blocks of the corpus, each task training on its own from the same
parameters, on every training token in an order drawn anew; what the tasks change is averaged row by row, by how often a row was
trained. A large corpus is gone through once, every other token first, then the others; a small one several times. No word's counts or vectors depend on how blocks are dealt out, but for that averaging.

Documents are coded in blocks of about BLOCK_TOKENS tokens: a block holds its distinct words once and its texts as numbers, and stays
where it was written. Words that many blocks have (by a sample of blocks) are counted in arrays that each task adds up before they
are shuffled; the others are shuffled with their counts by block, and totals go back packed. So no word makes a task large.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.blocks import bucketed, numbers
from ratingmill.llm.common import pack, partitions, release, stash, tune, unpack

#: The least share of training tokens, and number of them, of a word in the vocabulary: it has 1 / SHARE words at most.
SHARE, LEAST_COUNT = 1e-5, 5
#: Kinds of rarer words.
RARE = 32
DIM = 20
BLOCK_TOKENS = 1_000_000
#: Rows of distinct words that a task adds up.
TASK_ROWS = 250_000
#: Blocks that tell which words many blocks have, and the share of them that has such a word.
SAMPLE_BLOCKS, MANY = 64, 0.1
#: Training: events that all passes have at least, if the corpus is small; passes, each over every training token.
EVENTS, PASSES = 2_000_000, (1, 6)
#: Events of a step, in large blocks and in small ones.
BATCH, NOISE, WORD_NOISE, RATE = (16384, 2048), 32, 16, 0.1
#: Rows of parameters, or counts, that are added up together.
CHUNK = 1024


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % RARE


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; one without id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


PACKED = ("words", "kinds", "trained", "codes", "docs", "named", "held", "lengths")
BLOCK = pa.schema([("block", pa.int64()), ("tokens", pa.int64()), ("ends", pa.int64()), *[(k, pa.binary()) for k in PACKED]])
BLOCK_DDL = "block long, tokens long, ends long, " + ", ".join(f"{k} binary" for k in PACKED)


def _blocks(buckets: int):
    """Codes documents. words: the block's distinct words, space-joined (the end is the number after them); kinds: which kind each would
    be if it is rare; trained: how often each occurs in training documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = numbers(TaskContext.get().partitionId(), buckets)

        def flush() -> pa.RecordBatch:
            lens, out = np.array(lengths, np.int64), np.array(held, bool)
            flat = np.array(codes, np.int32)
            flat[np.cumsum(lens) - 1] = len(known)
            trained = np.bincount(flat[np.repeat(~out, lens)], minlength=len(known) + 1)
            packed = [zstandard.compress(b" ".join(known), 1), pack(np.fromiter(map(ending, known), np.uint8, len(known))), pack(trained.astype(np.int64)), pack(flat), pack(np.array([d or 0 for d in docs], np.int64)), pack(np.array([d is not None for d in docs], bool)), pack(out), pack(lens)]
            row = [next(own), int(trained.sum()), int(trained[-1]), *packed]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCK)], schema=BLOCK)

        def fresh():
            words: defaultdict = defaultdict()
            words.default_factory = words.__len__
            return words, [], [], [], []

        known, codes, docs, held, lengths = fresh()
        for b in batches:
            for doc, text, out in zip(*(b.column(i).to_pylist() for i in range(3))):
                w = (text or "").encode("utf-8", "surrogatepass").lower().split()
                codes += map(known.__getitem__, w)
                codes.append(-1)
                docs.append(doc)
                held.append(out)
                lengths.append(len(w) + 1)
                if len(codes) >= BLOCK_TOKENS:
                    yield flush()
                    known, codes, docs, held, lengths = fresh()
        if docs:
            yield flush()

    return each


def _words_of(packed: bytes) -> list[bytes]:
    b = zstandard.decompress(packed)
    return b.split(b" ") if b else []


WORDS = pa.schema([("word", pa.binary()), ("block", pa.int64()), ("place", pa.int32()), ("n", pa.int64())])
STEP = 50_000


def _spread(hot: frozenset | set):
    """A row for each distinct word of a block, but for the hot ones."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words, trained in zip(*(b.column(i).to_pylist() for i in range(3))):
                words, n = _words_of(words), unpack(trained, np.int64)
                at = np.array([i for i, w in enumerate(words) if w not in hot], np.int32)
                for i in range(0, len(at), STEP):
                    some = at[i : i + STEP]
                    yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in some], pa.binary()), pa.array(np.full(len(some), block)), pa.array(some), pa.array(n[some])], schema=WORDS)

    return each


MERGED = pa.schema([("chunk", pa.int32()), ("sums", pa.binary())])
MERGED_DDL = "chunk int, sums binary"


def _chunks(a: np.ndarray) -> pa.RecordBatch:
    """The rows of an array, CHUNK at once; those of zeros are left out."""
    parts = [(i // CHUNK, a[i : i + CHUNK]) for i in range(0, len(a), CHUNK)]
    parts = [(k, x) for k, x in parts if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([_pack(x) for _, x in parts], pa.binary())], schema=MERGED)


def _merged(rows: DataFrame, shape: tuple[int, ...], kind: type, wide: type) -> np.ndarray:
    """The sum of the arrays that tasks gave by chunk: added up by chunk in tasks, so that the driver gets one array."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = _unpack(x, kind).astype(wide)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_pack(x) for x in total.values()], pa.binary())], schema=MERGED)

    out = np.zeros(shape, wide)
    for r in rows.repartition(partitions(rows.sparkSession), "chunk").mapInArrow(add, MERGED_DDL).collect():
        part = _unpack(r.sums, wide).reshape(-1, *shape[1:])
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(part)] = part
    return out


TOTALS = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("often", pa.list_(pa.binary())), ("often_counts", pa.list_(pa.int64())), ("seen", pa.list_(pa.int64())), ("mass", pa.list_(pa.int64()))])
TOTALS_DDL = "block long, places binary, counts binary, often array<binary>, often_counts array<long>, seen array<long>, mass array<long>"


def _kinds(words: list[bytes], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rare words by kind: how many were trained, and how often."""
    kind = np.array([ending(w) for w in words], np.int64)
    return tuple(np.bincount(kind, weights=x, minlength=RARE).astype(np.int64) for x in (count > 0, count))


def _add(least: int):
    """Adds up the words of a task, which has all rows of each; gives blocks their words' totals, and one row (block null) with the
    words of the vocabulary and what there is of the others by kind."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        word = t["word"].combine_chunks().dictionary_encode()
        code, names = word.indices.to_numpy(), word.dictionary.to_pylist()
        total = np.bincount(code, weights=t["n"].to_numpy(), minlength=len(names)).astype(np.int64)
        block, place = t["block"].to_numpy(), t["place"].to_numpy()
        order = np.argsort(block, kind="stable")
        block, place, mine = block[order], place[order], total[code[order]]
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(cuts, [*cuts[1:], len(block)]):
            row = [int(block[a]), pack(place[a:b]), pack(mine[a:b]), None, None, None, None]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, TOTALS)], schema=TOTALS)
        often = np.flatnonzero(total >= least)
        rare = np.flatnonzero(total < least)
        seen, mass = _kinds([names[i] for i in rare], total[rare])
        row = [None, None, None, [names[i] for i in often], total[often].tolist(), seen.tolist(), mass.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, TOTALS)], schema=TOTALS)

    return each


def _found(numbers_: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    """The number of each word, -1 where it has none."""
    return np.fromiter(map(numbers_.get, words, repeat(-1)), np.int64, len(words))


@dataclass(frozen=True)
class Model:
    """What scoring needs: its size is bounded by 1 / SHARE and the sample of blocks, not by the corpus.

    Units are numbers: words of the vocabulary in the order of their classes, then RARE kinds, the end, and (as a context only) the
    start of a text. params has a row for each unit as a context, then for each class, then for each word of the vocabulary, then
    the two rows r1 and r2; the last column is the bias.
    """

    hot: dict[bytes, int]  # words that many blocks have, with their counts
    unit: dict[bytes, int]  # the vocabulary
    first: np.ndarray  # of each class of words, its first word; then the number of words
    seen: np.ndarray
    mass: np.ndarray
    ends: int  # training documents
    tokens: int  # N
    types: int  # V
    frequency: tuple[np.ndarray, np.ndarray]  # of classes, and of words in their class
    params: np.ndarray

    @property
    def words(self) -> int:
        return len(self.unit)

    @property
    def classes(self) -> int:
        return len(self.first) - 1 + RARE + 1

    @property
    def start(self) -> int:
        return self.words + RARE + 1

    def units(self, words: list[bytes], kinds: np.ndarray) -> np.ndarray:
        """The unit of each word, and of the end after them."""
        own = _found(self.unit, words)
        return np.append(np.where(own >= 0, own, self.words + kinds.astype(np.int64)), self.words + RARE)

    def class_of(self, unit: np.ndarray) -> np.ndarray:
        k = len(self.first) - 1
        table = np.append(np.repeat(np.arange(k), np.diff(self.first)), np.arange(k, k + RARE + 1))
        return table.astype(np.int16)[unit]

    def parts(self, params: np.ndarray) -> tuple[np.ndarray, ...]:
        """Views of params: contexts, classes and their biases, words and theirs, the two position rows."""
        a, b = self.start + 1, self.start + 1 + self.classes
        return params[:a, :-1], params[a:b, :-1], params[a:b, -1], params[b : b + self.words, :-1], params[b : b + self.words, -1], params[b + self.words :, :-1]

    def log10(self, one: np.ndarray, two: np.ndarray, unit: np.ndarray, at_once: int = 4096) -> np.ndarray:
        """log10 of the probability of each unit after its two units before: of its class, and of a word in its class.

        A context has one sum over all classes, however often it occurs."""
        params = self.params.astype(np.float32)
        a, b = self.start + 1, self.start + 1 + self.classes
        context, cls, word, r = params[:a, :-1], params[a:b], params[b : b + self.words], params[b + self.words :, :-1]
        before = np.concatenate([r[0] * context, np.ones((a, 1), np.float32)], 1)  # the last column takes the bias
        further = np.concatenate([r[1] * context, np.zeros((a, 1), np.float32)], 1)
        own, out = self.class_of(unit), np.empty(len(unit), np.float64)
        both = pa.array(one.astype(np.int64) * a + two).dictionary_encode()
        place, both = both.indices.to_numpy(), both.dictionary.to_numpy()
        h = before.take(both // a, 0) + further.take(both % a, 0)
        total = np.concatenate([np.zeros(0), *(_log_total(h[i : i + at_once] @ cls.T) for i in range(0, len(h), at_once))])
        for i in range(0, len(unit), at_once):
            at = slice(i, i + at_once)
            out[at] = np.einsum("nd,nd->n", h.take(place[at], 0), cls.take(own[at], 0)) - total[place[at]]
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(len(self.first)))
        for c, (i, j) in enumerate(zip(cuts, cuts[1:])):
            a, b = self.first[c], self.first[c + 1]
            if b - a > 1:
                rows = np.ascontiguousarray(word[a:b].T)
                for k in range(i, j, at_once):
                    at = order[k : min(k + at_once, j)]
                    z = h.take(place[at], 0) @ rows
                    out[at] += z[np.arange(len(at)), unit[at] - a]
                    out[at] -= _log_total(z)
        return out / np.log(10)


def _log_total(z: np.ndarray) -> np.ndarray:
    """By row, the logarithm of the sum of exp(z)."""
    ones = np.ones(z.shape[1], np.float32)
    with np.errstate(over="ignore"):
        total = np.exp(z) @ ones
    if np.isfinite(total).all() and total.min() > 1e-30:
        return np.log(total.astype(np.float64))
    top = z.max(1, keepdims=True)  # scores beyond what a float holds
    return top[:, 0] + np.log((np.exp(z - top) @ ones).astype(np.float64))


def _contexts(u: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The units one and two before each token; start before a document."""
    first = np.cumsum(lengths) - lengths
    one, two = np.r_[start, u[:-1]], np.r_[start, start, u[:-2]] if len(u) > 1 else np.array([start])
    one[first], two[first] = start, start
    two[first[lengths > 1] + 1] = start
    return one, two


def _starts(ids: np.ndarray) -> np.ndarray:
    """Where each of sorted ids begins."""
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])


def _order(ids: np.ndarray) -> np.ndarray:
    """What sorts ids; small numbers are sorted by their digits."""
    return np.argsort(ids.astype(np.uint16) if ids.max() < 1 << 16 else ids, kind="stable")


def _sums(ids: np.ndarray, rows: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows added up by id: (ids, sums, how many)."""
    order = _order(ids)
    ids = ids[order]
    first = _starts(ids)
    return ids[first], np.add.reduceat(rows.take(order, 0), first, axis=0), np.add.reduceat(many[order], first)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30, out=z)))


class Trainer:
    """Noise-contrastive estimation on events (one before, two before, unit), from given parameters."""

    def __init__(self, model: Model, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.params = model.params.astype(np.float32)
        self.past = np.full(self.params.shape, 1e-4, np.float32)
        self.trained = np.zeros(len(self.params), np.float32)
        # what noise is drawn from: classes' frequencies, and words' in their class, end to end
        self.p_class, self.p_word = model.frequency
        self.class_cdf, self.word_cdf = np.cumsum(self.p_class), np.cumsum(self.p_word)
        self.class_log, self.word_log = np.log(NOISE * self.p_class).astype(np.float32), np.log(WORD_NOISE * self.p_word).astype(np.float32)

    def step(self, ids: np.ndarray, grad: np.ndarray, many: np.ndarray) -> None:
        at, g, n = _sums(ids, grad, many)
        self.past[at] += g * g
        self.params[at] -= RATE * g / np.sqrt(self.past[at])
        self.trained[at] += n

    def batch(self, one: np.ndarray, two: np.ndarray, unit: np.ndarray) -> None:
        m, n = self.model, len(unit)
        order = _order(unit)  # so that what belongs to a class, and to a word, lies together
        one, two, unit = one[order], two[order], unit[order]
        context, cls, cls_bias, word, word_bias, r = m.parts(self.params)
        base = m.start + 1
        own = m.class_of(unit).astype(np.int64)
        e1, e2 = context.take(one, 0), context.take(two, 0)
        h = r[0] * e1 + r[1] * e2
        h1 = np.concatenate([h, np.ones((n, 1), np.float32)], 1)
        # classes: the observed one against NOISE drawn ones, the same for the batch
        drawn = np.minimum(np.searchsorted(self.class_cdf, self.rng.random(NOISE)), m.classes - 1)
        seen = cls.take(own, 0)
        g = _sigmoid(np.einsum("nd,nd->n", h, seen) + cls_bias[own] - self.class_log[own]) - 1
        gn = _sigmoid(h @ cls[drawn].T + (cls_bias[drawn] - self.class_log[drawn]))
        dh = g[:, None] * seen + gn @ cls[drawn]
        at = _starts(own)
        ids, rows, many = [base + own[at], base + drawn], [np.add.reduceat(g[:, None] * h1, at, axis=0), gn.T @ h1], [np.diff(np.r_[at, n]), np.ones(NOISE)]
        # words: the observed one against WORD_NOISE drawn ones of its class, the same for the class
        k = int(np.searchsorted(unit, m.words))
        if k:
            at = at[at < k]
            ends = np.r_[at[1:], k]
            size = ends - at
            a, b = m.first[own[at]], m.first[own[at] + 1]
            low = np.where(a > 0, self.word_cdf[a - 1], 0.0)
            x = low[:, None] + self.rng.random((len(at), WORD_NOISE)) * (self.word_cdf[b - 1] - low)[:, None]
            w = np.clip(np.searchsorted(self.word_cdf, x), a[:, None], b[:, None] - 1)
            t, off = word.take(w, 0), word_bias[w] - self.word_log[w]
            gn = np.empty((k, WORD_NOISE), np.float32)
            for i, j, v, o in zip(at, ends, t, off):
                gn[i:j] = h[i:j] @ v.T + o
            gn = _sigmoid(gn)
            seen, u = word.take(unit[:k], 0), unit[:k]
            g = _sigmoid(np.einsum("nd,nd->n", h[:k], seen) + word_bias[u] - self.word_log[u]) - 1
            alone = np.repeat(b - a == 1, size)
            g[alone], gn[alone] = 0, 0
            dh[:k] += g[:, None] * seen
            noise = np.empty((len(at), WORD_NOISE, h1.shape[1]), np.float32)
            for i, j, v, o in zip(at, ends, t, noise):
                dh[i:j] += gn[i:j] @ v
                o[:] = gn[i:j].T @ h1[i:j]
            at = _starts(u)
            ids += [base + m.classes + u[at], base + m.classes + w.ravel()]
            rows += [np.add.reduceat(g[:, None] * h1[:k], at, axis=0), noise.reshape(-1, h1.shape[1])]
            many += [np.diff(np.r_[at, k]), np.ones(w.size)]
        none = np.zeros((n, 1), np.float32)
        ids += [one, two, np.array([len(self.params) - 2, len(self.params) - 1])]
        both = np.stack([(dh * e1).sum(0), (dh * e2).sum(0)]) / n
        rows += [np.concatenate([dh * r[0], none], 1), np.concatenate([dh * r[1], none], 1), np.concatenate([both, np.zeros((2, 1))], 1).astype(np.float32)]
        many.append(np.ones(2 * n + 2))
        self.step(np.concatenate(ids), np.concatenate(rows), np.concatenate(many))


def _train(model: Model, pass_: int, parts: int = 1):
    """What a task changes of the parameters, times how often each row was trained, and that number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = None
        for b in batches:
            for block, words, kinds, codes, held, lengths in zip(*(b.column(i).to_pylist() for i in range(6))):
                trainer = trainer or Trainer(model, block * 31 + pass_)
                lens = unpack(lengths, np.int64)
                u = model.units(_words_of(words), unpack(kinds, np.uint8))[unpack(codes, np.int32)]
                one, two = _contexts(u, lens, model.start)
                at = np.flatnonzero(np.repeat(~unpack(held, bool), lens))
                at = trainer.rng.permutation(at[pass_ % parts :: parts])
                size = BATCH[0] if len(at) > 20 * BATCH[0] else BATCH[1]
                for i in range(0, len(at), size):
                    k = at[i : i + size]
                    trainer.batch(one[k], two[k], u[k])
                del u, one, two, at
                release()
        if trainer is not None:
            change = (trainer.params - model.params.astype(np.float32)) * trainer.trained[:, None]
            yield _chunks(np.concatenate([change, trainer.trained[:, None]], 1).astype(np.float32))

    return each


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(model: Model):
    def each(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in left.itertuples():
            words = _words_of(x.words)
            count = np.append(np.maximum(_found(model.hot, words), 0), model.ends)
            for y in right.itertuples():
                count[unpack(y.places, np.int32)] = unpack(y.counts, np.int64)
            unit = model.units(words, unpack(x.kinds, np.uint8))
            base = np.log10((count + 1) / (model.tokens + model.types + 1))
            kind = np.clip(unit - model.words, 0, RARE - 1)
            within = np.where((unit >= model.words) & (unit < model.words + RARE), np.log10((count + 1) / (model.mass[kind] + model.seen[kind] + 1)), 0.0)
            codes, lens = unpack(x.codes, np.int32), unpack(x.lengths, np.int64)
            u = unit[codes]
            score = model.log10(*_contexts(u, lens, model.start), u) + within[codes]
            at = np.cumsum(lens) - lens
            docs = pd.array(unpack(x.docs, np.int64), "Int64")
            docs[~unpack(x.named, bool)] = pd.NA
            out.append(pd.DataFrame({
                "doc_id": docs, "held_out": unpack(x.held, bool), "n_tokens": lens, "n_known": np.add.reduceat((count > 0)[codes].astype(np.int64), at),
                "train_tokens": model.tokens, "base_score": np.add.reduceat(base[codes], at), "score": np.add.reduceat(score, at),
            }))
        release()
        return pd.concat(out) if out else pd.DataFrame(columns=[f.split()[0] for f in RESULT.split(", ")])

    return each


def _untrained(hot: dict[bytes, int], often: dict[bytes, int], seen: np.ndarray, mass: np.ndarray, ends: int, tokens: int, seed: int = 7) -> Model:
    """The model that predicts by frequency alone."""
    names = sorted(often, key=lambda w: w[::-1])
    step = max(1, int(np.ceil(np.sqrt(len(names)))))
    first = np.array([*range(0, len(names), step), len(names)], np.int64)
    count = np.array([often[w] for w in names], np.float64)
    by_class = np.concatenate([np.add.reduceat(count, first[:-1]) if len(names) else np.zeros(0), mass, [ends]]) + 1.0
    by_class /= by_class.sum()
    in_class = count / np.repeat(np.add.reduceat(count, first[:-1]), np.diff(first)) if len(names) else count
    types = int(seen.sum()) + len(names) + (ends > 0)
    model = Model(hot, {w: i for i, w in enumerate(names)}, first, seen, mass, ends, tokens, types, (by_class, in_class), np.zeros(0))
    params = np.zeros((model.start + 1 + model.classes + len(names) + 2, DIM + 1))
    context, _, bias, _, word_bias, r = model.parts(params)
    context[:] = np.random.default_rng(seed).normal(0, 0.3, context.shape)
    bias[:], word_bias[:] = np.log(by_class), np.log(in_class)
    r[0], r[1] = 1.0, 0.5
    return replace(model, params=params)


def learn(blocks: DataFrame) -> tuple[DataFrame, Model]:
    """(totals of the words that few blocks have, packed by block; the trained model)."""
    spark = blocks.sparkSession
    size = blocks.agg(F.sum("tokens").alias("n"), F.sum("ends").alias("ends"), F.count("*").alias("blocks"), F.sum(F.length("words")).alias("bytes")).first()
    tokens, ends = int(size.n or 0), int(size.ends or 0)
    least = max(LEAST_COUNT, int(np.ceil(SHARE * tokens)))
    chosen = [r.block for r in blocks.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS).collect()]
    some = blocks.where(F.col("block").isin(chosen)).select("block", "words", "trained")
    many = max(4, int(np.ceil(MANY * min(size.blocks, SAMPLE_BLOCKS))))
    found = some.mapInArrow(_spread(frozenset()), "word binary, block long, place int, n long").groupBy("word").count().where(F.col("count") >= many)
    names = sorted(bytes(r.word) for r in found.select("word").collect())  # words of at least `many` of at most SAMPLE_BLOCKS blocks
    place = {w: i for i, w in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for b in batches:
            for words, trained in zip(*(b.column(i).to_pylist() for i in range(2))):
                at, n = _found(place, _words_of(words)), unpack(trained, np.int64)[:-1]
                total[at[at >= 0]] += n[at >= 0]  # a block has each word once
        yield _chunks(total)

    counts = _merged(blocks.select("words", "trained").mapInArrow(count, MERGED_DDL), (len(names),), np.int64, np.int64) if names else np.zeros(0, np.int64)
    hot = dict(zip(names, counts.tolist()))
    words = blocks.select("block", "words", "trained").mapInArrow(_spread(set(names)), "word binary, block long, place int, n long")
    tasks = max(partitions(spark), -(-int(size.bytes or 0) // (2 * TASK_ROWS)))  # a compressed word takes two bytes or so
    totals = stash(words.repartition(tasks, "word").mapInArrow(_add(least), TOTALS_DDL))
    sums = totals.where("block is null")
    often = {bytes(r.w): r.n for r in sums.select(F.explode(F.arrays_zip("often", "often_counts")).alias("t")).select(F.col("t.often").alias("w"), F.col("t.often_counts").alias("n")).collect()}
    by = sums.select(F.posexplode(F.arrays_zip("seen", "mass")).alias("k", "s")).groupBy("k").agg(F.sum("s.seen").alias("seen"), F.sum("s.mass").alias("mass")).collect()
    rare = [w for w in names if hot[w] < least]
    seen, mass = _kinds(rare, np.array([hot[w] for w in rare], np.int64))
    for r in by:
        seen[r.k] += r.seen
        mass[r.k] += r.mass
    often |= {w: n for w, n in hot.items() if n >= least}
    model = _untrained(hot, often, seen, mass, ends, tokens)
    passes = max(PASSES[0], min(PASSES[1], -(-EVENTS // max(tokens, 1)))) if tokens else 0
    parts = 2 if passes == 1 else 1  # one pass over all is made in two halves, so that tasks meet in between
    for pass_ in range(passes * parts):
        rows = blocks.select("block", "words", "kinds", "codes", "held", "lengths").mapInArrow(_train(replace(model, hot={}), pass_, parts), MERGED_DDL)
        change = _merged(rows, (len(model.params), DIM + 2), np.float32, np.float64)
        params = model.params + change[:, :-1] / np.maximum(change[:, -1:], 1)
        model = replace(model, params=params)
    return totals.where("block is not null").select("block", "places", "counts"), model


def coded(docs: DataFrame) -> DataFrame:
    """docs as blocks, in the shared folder."""
    n = partitions(tune(docs.sparkSession))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held"))
    return bucketed(rows.mapInArrow(_blocks(n), BLOCK_DDL), n)


def scored(blocks: DataFrame, totals: DataFrame, model: Model) -> DataFrame:
    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(_scores(model), RESULT)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    base_score: add-one word counts of the training documents; score: the model's, both log10 of the whole text with its end. Null,
    empty and blank texts have the end only. Equal rows count and are scored each; a row without doc_id is trained on. An empty
    table gives no row; other columns are not looked at.
    """
    blocks = coded(docs)
    return scored(blocks, *learn(blocks))
