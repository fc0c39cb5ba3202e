"""SimHash near-duplicates: fingerprints, BK-trees over shards, connected components.

Two fingerprints at most `radius` bits apart agree wholly in `blocks - radius` of `blocks` bit blocks at least. Every choice of
that many blocks makes a table; a shard holds the distinct fingerprints that agree in the blocks of one table, so that each link
is found in one shard at least, none is lost, and a shard stays small however large the corpus is. In a shard a BK-tree is
grown, its children keyed by their integer Hamming distance to the parent; a search follows only the edges within the radius of
its own distance. Trees grow and are searched level by level in numpy.

Trees of shards with more than one fingerprint are broadcast, at most TREE_NODES nodes a round, and all fingerprints search those of
their own shards where they lie. Trees for more than ROUNDS rounds, or a shard too large for one, are not broadcast: shards go to
tasks that grow and search them, and a shard above `shard_rows` is cut into parts that are searched pair by pair in tasks of their
own. Either way a task gives a spanning star of what it links, never all pairs, and no shard is capped or held by one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.blocks import MOST_ROWS, Blocks, block_of, places, rows_of
from ratingmill.llm.common import arrow_rows, components, cut, local_roots, pack, partitions, release, stash, tune, unpack

BITS = 64
#: Pairs of query and tree node that a search holds at once.
FRONTIER = 100_000
#: Nodes of the trees that are broadcast at once, of 32 bytes each; rounds of broadcasts; fingerprints that search together.
TREE_NODES, ROUNDS, ASKING = 1_000_000, 8, 50_000


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The unsigned SimHash of a text: ASCII lower case, words between white space, shingles with repeats.

    Fewer words than a shingle has: the whole sequence is the only one; no word (null, empty, blank): 0.
    """
    return of_hashes(_shingles((text or "").encode("utf-8", "surrogatepass").lower().split(), words, seed))


def of_hashes(h: np.ndarray) -> int:
    """The SimHash of shingles' hashes; 0 if there are none."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    tune(docs.sparkSession)

    def each(c: dict) -> dict:
        fp = np.array([fingerprint(t, words, seed) for t in c["text"]], np.uint64).view(np.int64)
        return {"doc_id": c["doc_id"], "fp": fp}

    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(arrow_rows(each, schema), "doc_id long, fp long")


def tables(radius: int, spare: int = 2) -> list[int]:
    """Bit masks, one a table: each choice of `spare` of radius + spare blocks."""
    cuts = np.linspace(0, BITS, radius + spare + 1).astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, spare)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """BK-trees of many shards. fps: unsigned (bits of a negative number are those of its absolute value), sorted by shard; shard: each one's."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        n = len(fps)
        self.fps, first = fps, np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.roots = np.flatnonzero(first)
        at = self.roots[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        open_ = np.flatnonzero(~first)
        at = at[open_]
        keys, kids = [], []
        while len(open_):
            key = at * (BITS + 1) + np.bitwise_count(fps[open_] ^ fps[at])
            order = np.argsort(key, kind="stable")
            key, who = key[order], open_[order]
            new = np.r_[True, key[1:] != key[:-1]]
            child = who[new][np.cumsum(new) - 1]
            keys.append(key[new])
            kids.append(who[new])
            open_, at = who[~new], child[~new]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.kids = np.concatenate(kids) if kids else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.kids = self.keys[order], self.kids[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, node) of each pair within the radius, in pieces. roots: the root at which each query starts."""
        todo = [(np.arange(i, min(i + FRONTIER, len(queries))), roots[i : i + FRONTIER]) for i in range(0, len(queries), FRONTIER)]
        while todo:
            q, at = todo.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                todo += [(q[:half], at[:half]), (q[half:], at[half:])]
                continue
            d = np.bitwise_count(queries[q] ^ self.fps[at]).astype(np.int64)
            hit = d <= radius
            yield q[hit], at[hit]
            low = np.searchsorted(self.keys, at * (BITS + 1) + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.keys, at * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            n = high - low
            some = n > 0
            q, low, n = q[some], low[some], n[some]
            if len(q):
                ends = np.cumsum(n)
                todo.append((np.repeat(q, n), self.kids[np.repeat(low - (ends - n), n) + np.arange(ends[-1])]))


def _stars(fps: np.ndarray, shard: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, smallest fp) that link what lies within the radius. side: 0 tree only, 1 query only, 2 both."""
    own = side != 1
    tree_fps, tree_shard = fps[own], shard[own]
    forest = Forest(tree_fps, tree_shard)
    ask = np.flatnonzero(side != 0)
    place = np.searchsorted(tree_shard[forest.roots], shard[ask])
    names, code = np.unique(fps, return_inverse=True)
    tree_code = code[own]
    root = np.arange(len(names))
    a, b, held = [], [], 0

    def fold() -> np.ndarray:
        """Links found so far and the roots before them, as roots."""
        x, y = np.concatenate([*a, root]), np.concatenate([*b, np.arange(len(names))])
        return local_roots(x, y, len(names))

    for q, at in forest.search(fps[ask], forest.roots[place], radius):
        x, y = code[ask[q]], tree_code[at]
        off = x != y
        a.append(x[off])
        b.append(y[off])
        held += len(a[-1])
        if held > 4 * FRONTIER:
            root, held = fold(), 0
            a.clear()
            b.clear()
    root = fold()
    off = root != np.arange(len(names))
    return names[off], names[root[off]]


def _grown(pdf: pd.DataFrame) -> pd.DataFrame:
    """The trees of a table's shards (t, k), one row: nodes in the order of their shards, and the shards."""
    order = np.lexsort((pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["k"].to_numpy(np.int64)))
    fps, k = pdf["fp"].to_numpy(np.int64).view(np.uint64)[order], pdf["k"].to_numpy(np.int64)[order]
    f = Forest(fps, k)
    return pd.DataFrame({"t": [int(pdf["t"].iloc[0])], "trees": [[x.tobytes() for x in (f.fps, f.keys, f.kids, f.roots, k[f.roots])]]})


def _searched(trees, masks: list[int], radius: int):
    """Edges (a, b) that link the fingerprints of a task with what they find in the broadcast trees of their shards."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = []
        for t, parts in trees.value:
            f = Forest.__new__(Forest)
            f.fps = np.frombuffer(parts[0], np.uint64)
            f.keys, f.kids, f.roots, names = (np.frombuffer(x, np.int64) for x in parts[1:])
            forests.append((np.uint64(masks[t]), f, names))

        def ask(fps: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            for mask, f, names in forests:
                k = (fps & mask).view(np.int64)
                at = np.minimum(np.searchsorted(names, k), len(names) - 1)
                own = np.flatnonzero(names[at] == k)
                for q, node in f.search(fps[own], f.roots[at[own]], radius):
                    x, y = fps[own[q]], f.fps[node]
                    a.append(x[x != y])
                    b.append(y[x != y])
                    if sum(map(len, a)) > 4 * FRONTIER:
                        x, y = _star(np.concatenate(a), np.concatenate(b))
                        a, b = [x], [y]
            x, y = _star(np.concatenate([np.zeros(0, np.uint64), *a]), np.concatenate([np.zeros(0, np.uint64), *b]))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= ASKING:
                yield ask(np.concatenate(held))
                held, n = [], 0
        if held:
            yield ask(np.concatenate(held))

    return each


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest that it is linked to) with the components of the edges (a, b)."""
    names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_roots(code[: len(a)], code[len(a) :], len(names))
    off = root != np.arange(len(names))
    return names[off], names[root[off]]


def links(fps: DataFrame, radius: int = 4, shard_rows: int = 20_000, tree_nodes: int = TREE_NODES, rounds: int = ROUNDS) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints fps (column fp) just as all pairs within the radius would."""
    spark = fps.sparkSession
    masks = tables(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(keys).alias("s")).select("fp", "s.t", "s.k")
    size = cut(rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"))
    nodes = size.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    need = -(-2 * int(nodes["all"] or 0) // tree_nodes)  # rounds are dealt by hash, so that each is half full
    if need <= rounds and int(nodes["most"] or 0) <= tree_nodes // 2:
        shards = stash(rows.join(size.select("t", "k"), ["t", "k"]).withColumn("round", F.pmod(F.xxhash64("t", "k"), F.lit(max(need, 1)))))
        found = spark.createDataFrame([], "a long, b long")
        for r in range(need):
            trees = shards.where(F.col("round") == r).groupBy("t").applyInPandas(_grown, "t int, trees array<binary>").collect()
            sent = spark.sparkContext.broadcast([(x.t, [bytes(v) for v in x.trees]) for x in trees])
            found = found.unionAll(fps.select("fp").mapInArrow(_searched(sent, masks, radius), "a long, b long"))
        return found
    parts = F.ceil(F.col("n") / F.lit(shard_rows)).cast("int")
    rows = rows.join(size.select("t", "k", parts.alias("parts")), ["t", "k"])
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).select("fp", "t", "k", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select(
        "fp", F.xxhash64("t", "k", F.least("own", "other"), F.greatest("own", "other")).alias("shard"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [(b["fp"].to_numpy(np.int64), b["shard"].to_numpy(np.int64), b["side"].to_numpy(np.int8)) for b in batches]
        if got:
            fp, shard, side = (np.concatenate(x) for x in zip(*got))
            got.clear()
            order = np.lexsort((fp, shard))
            a, b = _stars(fp[order].view(np.uint64), shard[order], side[order], radius)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    tasks = max(partitions(spark), -(-int(nodes["all"]) // tree_nodes))
    return rows.repartition(tasks, "shard").mapInPandas(each, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id that links of at most `radius` differing bits reach,
    the document itself included. Null, empty and blank texts have fingerprint zero and link like any other; equal rows are each
    kept; a null doc_id keeps its row and never names a component that has another id. Other columns of docs are not looked at.
    """
    found = stash(fingerprints(docs, words, seed))
    # the smallest id of each fingerprint stands for its exact copies
    nodes = stash(found.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = components(links(nodes.select("fp"), radius))
    named = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = stash(named)
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = stash(named.join(low, "root").select("fp", "component_id"))
    return found.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Samples of a document's shingles, and shingles in each: two texts of similarity 0.8 share a whole sample with 0.997.
SAMPLES, SAMPLE = 8, 3
#: Documents whose shingles are counted for the order of shingles, at least, and the share of all that is; frequent shingles ranked at most.
ORDER_ROWS, ORDER_SHARE, ORDER_MOST = 8000, 32, 200_000
#: Documents whose prefixes a task of the search for pairs has, about.
BUCKET_ROWS = 2000
#: Pairs that a task makes at once; members of a part of a shingle that many texts have, and their shingles in all.
PAIRS, PART, PART_SHINGLES = 100_000, 2000, 1 << 20
#: Members up to which all pairs of a shingle's members are given, and pairs a member above that.
FEW, FEW_PAIRS = 16, 4
#: Bytes of parities that are compared before whole sets are.
SKETCH = 128


def _shingles(w: list[bytes], words: int, seed: int) -> np.ndarray:
    shingles = [] if not w else [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Sets:
    """The distinct shingles of texts, in numpy, for the steps that run beside the blocks."""

    def __init__(self, words: int, seed: int, similarity: float):
        self.words, self.seed, self.similarity = words, seed, similarity

    def of(self, text: str | None) -> np.ndarray:
        return np.unique(_shingles(_words(text), self.words, self.seed))

    def least(self, n, share: float):
        """The smallest whole number that is at least share * n, or one less where rounding is in doubt."""
        return np.ceil(np.asarray(n) * share - 1e-6).astype(np.int64)

    def alike(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= self.similarity * (len(x) + len(y) - both) - 1e-9

    def maybe(self, x: tuple, y: tuple) -> np.ndarray:
        """Which pairs of members (node, root, n, at) may be similar: x the one with fewer shingles, by its shorter prefix."""
        (_, rx, nx, ix), (_, ry, ny, iy) = x, y
        share = self.similarity / (1 + self.similarity)
        ok = (rx != ry) & (nx <= ny) & (nx >= self.least(ny, self.similarity)) & (ix <= nx - self.least(nx, 2 * share))
        # the first shingle that both have: what comes after it bounds what they share
        return ok & (np.minimum(nx - ix, ny - iy) >= self.least(nx + ny, share))


SIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("samples", pa.list_(pa.int64()))])


def _signed_rows(sets: Sets):
    """For each row its content (128 bits of a hash of its words), fingerprint, number of distinct shingles, and samples of them."""
    odd = np.random.default_rng(sets.seed).integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def each(block: int, t: pa.Table) -> pa.Table:
        out = {"c1": [], "c2": [], "fp": [], "n": [], "samples": []}
        for text in t.column("text").to_pylist():
            w = _words(text)
            every = _shingles(w, sets.words, sets.seed)
            h = np.unique(every)
            samples = [0] * SAMPLES
            if len(h):
                for k in range(SAMPLES):
                    x = h * odd[k]
                    x ^= x >> np.uint64(32)
                    low = h[np.argpartition(x, SAMPLE - 1)[:SAMPLE]] if len(h) > SAMPLE else h
                    # the fingerprint of three shingles: the bits that most of them have
                    samples[k] = int((low[0] & low[1]) | (low[0] & low[2]) | (low[1] & low[2])) if len(low) == 3 else int(np.bitwise_xor.reduce(low))
            content = xxhash.xxh3_128_intdigest(b" ".join(w), sets.seed)
            out["c1"].append(_signed(content >> 64))
            out["c2"].append(_signed(content & ((1 << 64) - 1)))
            out["fp"].append(_signed(of_hashes(every)))
            out["n"].append(len(h))
            out["samples"].append(sorted({_signed(s) for s in samples}))
        ids = t.column("doc_id").cast(pa.int64())
        return pa.Table.from_arrays([pa.array(rows_of(block, t)), ids, *[pa.array(v, SIGNED.field(k).type) for k, v in out.items()]], schema=SIGNED)

    return each


def _told(blocks: Blocks, pairs: DataFrame, give, alike, sets: Sets) -> DataFrame:
    """The pairs (a, b) of rows for which alike(shingles of a, what b gives of its own). What b gives goes once to each block that
    asks for it; the shingles of a are made where its text lies."""
    schema = pa.schema([("row", pa.int64()), ("given", pa.binary())])

    def answer(block: int, t: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = np.unique(wanted.column("row").to_numpy())
        found = [give(sets.of(x)) for x in t.column("text").take(pa.array(places(rows))).to_pylist()]
        return pa.Table.from_arrays([pa.array(rows), pa.array(found, pa.binary())], schema=schema)

    wanted = pairs.select(F.col("b").alias("row")).distinct()
    given = stash(blocks.join(wanted.select(block_of("row").alias("block"), "row"), answer, schema))
    asked = pairs.select(block_of("a").alias("block"), F.col("b").alias("row")).distinct().join(given, "row")
    told = asked.select("block", F.lit(None).cast("long").alias("a"), F.col("row").alias("b"), "given")
    messages = pairs.select(block_of("a").alias("block"), "a", "b", F.lit(None).cast("binary").alias("given")).unionAll(told)

    def compare(block: int, t: pa.Table, m: pa.Table) -> pa.Table:
        sent, text, todo, out = {}, t.column("text"), defaultdict(list), []
        for a, b, s in zip(*(m.column(c).to_pylist() for c in ("a", "b", "given"))):
            if a is None:
                sent[b] = s
            else:
                todo[a].append(b)
        for a, others in todo.items():
            own = sets.of(text[a & (MOST_ROWS - 1)].as_py())
            out += [(a, b) for b in others if alike(own, sent[b])]
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=EDGES)

    return blocks.join(messages, compare, EDGES)


def _parities(h: np.ndarray) -> np.ndarray:
    """A bit for each of about as many classes of shingles as there are shingles: whether their number is odd."""
    size = max(64, 1 << (len(h) - 1).bit_length() if len(h) else 64)
    return (np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)


def _verified(blocks: Blocks, pairs: DataFrame, sets: Sets) -> DataFrame:
    """The pairs (a, b) of rows whose shingles have the similarity.

    Two sets differ by as many shingles at least as their parities differ in classes, so a bit for each shingle rules out most pairs
    that are not similar; whole sets are sent for the others only."""

    def sketch(h: np.ndarray) -> bytes:
        return len(h).to_bytes(8, "little") + np.packbits(_parities(h)).tobytes()

    def maybe(own: np.ndarray, given: bytes) -> bool:
        x, y = _parities(own), np.unpackbits(np.frombuffer(given, np.uint8, offset=8))
        size = min(len(x), len(y))
        apart = np.bitwise_xor.reduce(x.reshape(-1, size)) ^ np.bitwise_xor.reduce(y.reshape(-1, size))
        most = (1 - sets.similarity) / (1 + sets.similarity) * (len(own) + int.from_bytes(given[:8], "little"))
        return int(apart.sum()) <= most + 1e-6

    left = stash(_told(blocks, pairs, sketch, maybe, sets))
    whole = lambda h: pack(np.diff(h, prepend=np.uint64(0)))
    return _told(blocks, left, whole, lambda own, given: sets.alike(own, np.cumsum(unpack(given, np.uint64), dtype=np.uint64)), sets)


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _frequent(blocks: Blocks, rows: int, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that occur in three or more of a sample of texts, and in how many. They only order shingles: any order loses no pair."""
    share = min(ORDER_SHARE, max(1, rows // ORDER_ROWS))
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def each(block: int, t: pa.Table) -> pa.Table:
        x = rows_of(block, t).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        some = np.flatnonzero((x >> np.uint64(33)) % np.uint64(share) == 0)
        h = [sets.of(v) for v in t.column("text").take(pa.array(some)).to_pylist()]
        token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *h]), return_counts=True)
        return pa.Table.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], schema=schema)

    count = blocks.map(each, schema).groupBy("token").agg(F.sum("n").alias("n")).where("n > 2")
    most = count.orderBy(F.desc("n"), "token").limit(ORDER_MOST).toPandas()
    token = most["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], most["n"].to_numpy(np.int32)[order]


MEMBERS = {"token": np.uint64, "node": np.int64, "root": np.int64, "n": np.int64, "at": np.int64}
DEALT = pa.schema([("bucket", pa.int32()), *[(m, pa.binary()) for m in MEMBERS]])


def _dealt(buckets: int, sets: Sets, token: np.ndarray, often: np.ndarray):
    """Prefixes of the sets of contents, dealt out by shingle: a row for each bucket, its members packed (root as its difference from
    node). A shingle goes as 40 bits of it: one more that is taken for it is one more pair to verify."""

    def each(block: int, t: pa.Table, m: pa.Table) -> pa.Table:
        node, root = m.column("row").to_numpy(), m.column("root").to_numpy()
        prefix, size = [np.zeros(0, np.uint64)], []
        for text in t.column("text").take(pa.array(places(node))).to_pylist():
            h = sets.of(text)
            rank = np.zeros(len(h), np.int32)
            if len(token):
                at = np.minimum(np.searchsorted(token, h), len(token) - 1)
                rank = np.where(token[at] == h, often[at], 0)
            rarest = h[np.argsort(rank, kind="stable")]
            size.append(len(h))
            prefix.append(rarest[: len(h) - int(sets.least(len(h), sets.similarity)) + 1] & np.uint64((1 << 40) - 1))
        taken = np.array([len(x) for x in prefix[1:]], np.int64)
        token_ = np.concatenate(prefix)
        at = np.arange(len(token_)) - np.repeat(np.cumsum(taken) - taken, taken)
        bucket = (token_ % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((token_, bucket))
        token_ = token_[order]
        columns = [np.repeat(x, taken)[order] for x in (node, root ^ node, np.array(size, np.int64))]
        names, first = np.unique(bucket[order], return_index=True)
        ends = [*first[1:], len(order)]
        steps = [np.diff(token_[a:b], prepend=np.uint64(0)) for a, b in zip(first, ends)]
        packed = [[pack(x) for x in steps], *[[pack(x[a:b].astype(k)) for a, b in zip(first, ends)] for x, k in zip((*columns, at[order]), (np.int64,) * 4)]]
        return pa.Table.from_arrays([pa.array(names), *[pa.array(x, pa.binary()) for x in packed]], schema=DEALT)

    return each


def _unique_pairs(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    both = np.stack([np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])], 1)
    both = np.unique(np.sort(both, axis=1), axis=0)
    return both[:, 0], both[:, 1]


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("unit", pa.int64()), ("members", pa.binary())])


def _parts(own: np.ndarray, part: int) -> list[np.ndarray]:
    """Members (node, root, n, at) in parts of at most `part` of them, and about PART_SHINGLES shingles."""
    step = np.maximum(np.arange(own.shape[1]) // part, np.cumsum(own[2]) // PART_SHINGLES)
    return np.split(own, np.flatnonzero(np.diff(step)) + 1, axis=1)


def _cells(sets: Sets, own: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the members that may be similar, in pieces; of different sides only, if there are sides."""
    for i in range(0, own.shape[1], 200):
        ok = sets.maybe(tuple(own[:, i : i + 200, None]), tuple(own[:, None, :]))
        if side is not None:
            ok &= side[i : i + 200, None] != side
        k, j = np.nonzero(ok)
        yield k + i, j


def _pairs_of(sets: Sets):
    """Pairs of contents that share a shingle of their prefixes and are not linked yet, of shingles that leave a member with a few pairs.

    Of another shingle all members are given that have a pair, not their pairs: many shingles' members are a unit, which _linked
    compares, as long as they are no more than a part; a shingle with more makes a unit of each two parts, but for those whose
    members are all linked, or differ too much in size."""
    part = PART

    def row(a, b, unit=None, members=None) -> pa.RecordBatch:
        none = [None] * len(a)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((a, b, none if unit is None else [unit], none if unit is None else [members]), FOUND)], schema=FOUND)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        columns = [np.concatenate([unpack(x, k) if m != "token" else np.cumsum(unpack(x, k), dtype=k) for b in got for x in b.column(m).to_pylist()]) for m, k in MEMBERS.items()]
        got.clear()
        release()
        units = count(TaskContext.get().partitionId() << 32)

        def unit(groups: list[np.ndarray]) -> pa.RecordBatch:
            """groups: a row each for label, side, node, root, n, at."""
            return row([None], [None], next(units), zstandard.compress(np.concatenate(groups, axis=1).tobytes(), 1))

        order = np.argsort(columns[0], kind="stable")
        token, node, root, n, at = (x[order] for x in columns)
        members = (node, root ^ node, n, at)
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[first, len(token)])
        apart = np.minimum.reduceat(members[1], first) != np.maximum.reduceat(members[1], first)
        a, b, held, nodes, shingles = [], [], [], set(), 0
        for f, m in zip(first[apart & (size > FEW)], size[apart & (size > FEW)]):
            own = np.stack([v[f : f + m] for v in members])
            if m <= part:
                pairs, some = 0, np.zeros(m, bool)
                for i, j in _cells(sets, own):
                    pairs += len(i)
                    some[i] = some[j] = True
                own = own[:, some]
                if pairs <= FEW_PAIRS * own.shape[1]:
                    for i, j in _cells(sets, own):
                        p, q = _unique_pairs([own[0, i]], [own[0, j]])
                        a.append(p)
                        b.append(q)
                    continue
            names, many = np.unique(own[1], return_counts=True)
            own = own[:, np.lexsort((own[2], own[1] == names[many.argmax()]))]
            parts = _parts(own, part)
            label = lambda x, k, side: np.concatenate([np.full((1, x.shape[1]), k), np.full((1, x.shape[1]), side), x])
            if len(parts) == 1:
                held.append(label(own, len(held), 0))
                new = ~np.isin(own[0], list(nodes))
                nodes.update(own[0].tolist())
                shingles += int(own[2, new].sum())
                if len(nodes) >= part or shingles >= PART_SHINGLES or sum(x.shape[1] for x in held) >= 100 * part:
                    yield unit(held)
                    held, nodes, shingles = [], set(), 0
                continue
            for i, x in enumerate(parts):
                for j, y in enumerate(parts[i:], i):
                    linked = (x[1] == x[1][0]).all() and (y[1] == x[1][0]).all()
                    if not linked and sets.least(max(x[2].min(), y[2].min()), sets.similarity) <= min(x[2].max(), y[2].max()):
                        yield unit([label(x, 0, 0)] if i == j else [label(x, 0, 0), label(y, 0, 1)])
        if held:
            yield unit(held)
        few = apart & (size > 1) & (size <= FEW)
        first, size = first[few], size[few]
        # each member against all of its shingle's
        who = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        low, m = np.repeat(first, size), np.repeat(size, size)
        own = at[who] <= n[who] - sets.least(n[who], 2 * sets.similarity / (1 + sets.similarity))
        who, low, m = who[own], low[own], m[own]
        step = np.cumsum(m) // PAIRS
        cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]) if len(step) else np.zeros(0, np.int64)
        for i, j in zip(cuts, [*cuts[1:], len(step)]):
            w, lo, mm = who[i:j], low[i:j], m[i:j]
            x, y = np.repeat(w, mm), np.arange(mm.sum()) - np.repeat(np.cumsum(mm) - mm - lo, mm)
            ok = sets.maybe(tuple(v[x] for v in members), tuple(v[y] for v in members))
            p, q = _unique_pairs([node[x[ok]]], [node[y[ok]]])
            a.append(p)
            b.append(q)
        p, q = _unique_pairs(a, b)
        for i in range(0, len(p), PAIRS):
            yield row(p[i : i + PAIRS], q[i : i + PAIRS])

    return each


def _members(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), np.int64).reshape(6, -1)


GIVEN = pa.schema([("row", pa.int64()), ("given", pa.binary())])


def _linked(blocks: Blocks, units: DataFrame, sets: Sets) -> DataFrame:
    """Edges (a, b) of the similarity that link the members of each unit just as all its similar pairs would: fewer than it has members.

    The sets of its members go to a unit once. Parities rule out most pairs, as in _verified; what is left is compared, but for pairs
    that are linked by then."""

    def named(c: dict) -> dict:
        rows = [np.unique(_members(x)[2]) for x in c["members"]]
        return {"unit": np.repeat(np.array(c["unit"], np.int64), [len(x) for x in rows]), "row": np.concatenate([np.zeros(0, np.int64), *rows])}

    def answer(block: int, t: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = wanted.column("row").to_numpy()
        found = [pack(np.diff(sets.of(x), prepend=np.uint64(0))) for x in t.column("text").take(pa.array(places(rows))).to_pylist()]
        return pa.Table.from_arrays([pa.array(rows), pa.array(found, pa.binary())], schema=GIVEN)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return EDGES.empty_table()
        label, side, node, root, *_ = every = _members(left.column("members")[0].as_py())
        names, code = np.unique(node, return_inverse=True)
        own = dict(zip(right.column("row").to_pylist(), right.column("given").to_pylist()))
        whole = [np.cumsum(unpack(own.pop(x), np.uint64), dtype=np.uint64) for x in names.tolist()]
        size = np.array([len(h) for h in whole], np.int64)
        bits = np.array([np.packbits(np.bincount((h & np.uint64(8 * SKETCH - 1)).astype(np.int64), minlength=8 * SKETCH) & 1) for h in whole], np.uint8).view(np.uint64)
        up = np.zeros(len(names), np.int64)
        up[code] = np.unique(root, return_inverse=True)[1]
        up, of = list(range(int(up.max()) + 1)), up.tolist()

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        most, tried, out = (1 - sets.similarity) / (1 + sets.similarity), set(), []
        ends = np.flatnonzero(np.diff(label)) + 1
        for f, e in zip([0, *ends], [*ends, len(label)]):
            two = side[f:e].any()
            for i, j in _cells(sets, every[2:, f:e], side[f:e] if two else None):
                for k in range(0, len(i), PAIRS):
                    p, q = code[f:e][i[k : k + PAIRS]], code[f:e][j[k : k + PAIRS]]
                    ok = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64) <= most * (size[p] + size[q]) + 1e-6
                    for x, y in zip(np.minimum(p[ok], q[ok]).tolist(), np.maximum(p[ok], q[ok]).tolist()):
                        s, t = top(of[x]), top(of[y])
                        if s == t or (x, y) in tried:
                            continue
                        if sets.alike(whole[x], whole[y]):
                            up[max(s, t)] = min(s, t)
                            out.append((names[x], names[y]))
                        elif len(tried) < 10 * PAIRS:  # not to be compared again for another shingle
                            tried.add((x, y))
        release()
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=EDGES)

    schema = pa.schema([("unit", pa.int64()), ("row", pa.int64())])
    members = stash(units.mapInArrow(arrow_rows(named, schema), "unit long, row long"))
    wanted = members.select(block_of("row").alias("block"), "row").distinct()
    sent = members.join(stash(blocks.join(wanted, answer, GIVEN)), "row").select("unit", "row", "given")
    return units.groupBy("unit").cogroup(sent.groupBy("unit")).applyInArrow(compare, "a long, b long")


def _pairs_left(blocks: Blocks, contents: DataFrame, rows: int, sets: Sets) -> tuple[DataFrame, DataFrame]:
    """Of contents (row, root) of different roots, by prefix filter: (pairs (a, b) that may have the similarity; edges that have it).
    Every pair of the similarity is among the pairs or linked by the edges.

    In one order of all shingles, rare ones first, two sets of that similarity share a shingle of the first 1 - similarity of the
    larger and the first (1 - similarity) / (1 + similarity) of the smaller. Rows grow with prefixes, however many texts share a shingle."""
    tasks = max(partitions(blocks.spark), -(-rows // BUCKET_ROWS))
    sent = blocks.join(contents.select(block_of("row").alias("block"), "row", "root"), _dealt(tasks, sets, *_frequent(blocks, rows, sets)), DEALT)
    found = stash(sent.repartition(tasks, "bucket").mapInArrow(_pairs_of(sets), "a long, b long, unit long, members binary"))
    pairs, units = found.where("unit is null").select("a", "b").distinct(), found.where("unit is not null").select("unit", "members")
    return pairs, blocks.spark.createDataFrame([], "a long, b long") if units.isEmpty() else _linked(blocks, units, sets)


def unique(docs: DataFrame, similarity: float = 0.8, words: int = 5, radius: int = 4, seed: int = 42) -> DataFrame:
    """docs, with all columns, one row of each group of near copies: that with the smallest doc_id (any with an id before none).

    Texts of the same words are one content. Contents link when their SimHash fingerprints differ in `radius` bits at most (BK-trees,
    links), or when their word shingles have a Jaccard similarity of `similarity` or more. Most of the second kind are found first,
    and cheaply: a document has SAMPLES more fingerprints, each of SAMPLE shingles that are smallest by another hash; contents that
    share one are compared with the content among them whose fingerprints are shared most. All pairs that are not linked by then are
    searched by their rarest shingles (_pairs_left), so that none of the similarity is lost.

    Texts are written once, in blocks; what is shuffled are row numbers, hashes, and the shingles of some texts. Null, empty and blank
    texts are one content. Rows that are equal are told apart by their place. An empty table gives no row; other columns are kept as
    they are, whatever their names.
    """
    sets = Sets(words, seed, similarity)
    blocks = Blocks(docs)
    found = stash(blocks.map(_signed_rows(sets), SIGNED))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    contents = found.groupBy("c1", "c2").agg(first, F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("samples").alias("samples"))
    contents = stash(contents.select(F.col("first.row").alias("row"), "first", "fp", "n", "samples"))
    # fingerprints within the radius, by the content that stands for each
    named = contents.groupBy("fp").agg(F.min("row").alias("row"))
    near = links(contents.select("fp").distinct(), radius)
    to = lambda x: named.select(F.col("fp").alias(x), F.col("row").alias(f"c{x}"))
    edges = near.join(to("a"), "a").join(to("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    same = contents.select("fp", "row").join(named.withColumnRenamed("row", "other"), "fp").where("row <> other")
    edges = edges.unionAll(same.select(F.col("row").alias("a"), F.col("other").alias("b")))
    # contents that share a sample, with the most central of them
    shared = contents.select("row", "n", F.explode("samples").alias("sample"))
    size = stash(shared.groupBy("sample").agg(F.count("*").alias("m")).where("m > 1"))
    shared = stash(shared.join(size, "sample"))
    central = shared.groupBy("row").agg(F.sum("m").alias("weight"))
    shared = stash(shared.join(central, "row").select("row", "n", "sample", "weight"))
    lead = shared.groupBy("sample").agg(F.max(F.struct("weight", "row", "n")).alias("lead")).select("sample", F.col("lead.row").alias("lead"), F.col("lead.n").alias("leads"))
    pairs = shared.join(lead, "sample").where((F.col("row") != F.col("lead")) & (F.least("n", "leads") >= similarity * F.greatest("n", "leads") - 1e-6))
    pairs = stash(pairs.select(F.col("row").alias("a"), F.col("lead").alias("b")).distinct())
    linked = components(edges.unionAll(_verified(blocks, pairs, sets)))
    groups = contents.select("row", "first").join(linked.withColumnRenamed("node", "row"), "row", "left")
    groups = stash(groups.select("row", "first", F.coalesce("root", "row").alias("root")))
    # pairs that neither way has linked
    pairs, near = _pairs_left(blocks, groups, found.count(), sets)
    more = _verified(blocks, stash(pairs), sets).unionAll(near)
    of = lambda x: groups.select(F.col("row").alias(x), F.col("root").alias(f"r{x}"))
    more = more.join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    last = components(more).select(F.col("node").alias("root"), F.col("root").alias("to"))
    groups = groups.join(last, "root", "left").select("first", F.coalesce("to", "root").alias("root"))
    keep = groups.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return blocks.without(stash(found.select("row").join(keep, "row", "left_anti")))
