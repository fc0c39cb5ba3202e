import random

import numpy as np
import xxhash

from ratingmill.llm import simhash
from ratingmill.llm.common import components


def brute(rows, radius=4):
    fps = {}
    for i, (d, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        ones = [0] * 64
        for s in sh:
            h = xxhash.xxh64_intdigest(s, 42)
            for j in range(64):
                ones[j] += h >> j & 1
        fps[i] = sum(1 << j for j in range(64) if sh and 2 * ones[j] > len(sh))
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= radius and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    low = {}
    for i, (d, _) in enumerate(rows):
        low[group[i]] = min(low.get(group[i], d), d)
    return sorted((rows[i][0], f"{fps[i]:016x}", low[group[i]]) for i in fps)


def texts(n=60, seed=1):
    r = random.Random(seed)
    words = ["Éa", "the", "of", "Tion", "and", "ing", "re", "st", "wh", "ou", "ble", "x\x0by"]
    out = []
    for i in range(n):
        if i and r.random() < 0.5:
            w = list(r.choice(out))
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = [r.choice(words) + str(r.randint(0, 40)) for _ in range(r.randint(1, 120))]
        out.append(w)
    return [(1000 - i, " ".join(w)) for i, w in enumerate(out)]


def test_against_brute_force(spark):
    rows = texts() + [(5, None), (6, ""), (7, " \n\t"), (8, "One two"), (9, "one  TWO"), (10, "a b c d"), (10, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fp", "'x' as root")
    got = sorted(tuple(r) for r in simhash.near_duplicates(df).collect())
    assert got == brute(rows)


def test_ways_of_search_give_the_same(spark):
    """Broadcast trees, one round and many, and shards sent to tasks."""
    r = random.Random(9)
    fps = [r.getrandbits(64) for _ in range(1500)]
    fps += [x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in fps[:500]]
    signed = [int(x) for x in np.array(sorted(set(fps)), np.uint64).view(np.int64)]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    near = {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[:i] if 0 < (a ^ b).bit_count() <= 4}
    whole = lambda df: {frozenset((int(x.a) % 2**64, int(x.b) % 2**64)) for x in df.collect()}
    for kw in ({}, {"tree_nodes": 500, "rounds": 1000}, {"rounds": 0}):
        assert whole(simhash.links(nodes, **kw)) == near


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_shards_are_cut_without_losing_links(spark):
    r = random.Random(3)
    base = r.getrandbits(64)
    fps = {base} | {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)} | {r.getrandbits(64) for _ in range(300)}
    signed = [int(x) for x in np.array(sorted(fps), np.uint64).view(np.int64)]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    whole = {(r.node, r.root) for r in components(simhash.links(nodes)).collect()}
    cut = {(r.node, r.root) for r in components(simhash.links(nodes, shard_rows=40, rounds=0)).collect()}
    many = {(r.node, r.root) for r in components(simhash.links(nodes, tree_nodes=3000, rounds=100)).collect()}
    groups = lambda pairs: {frozenset(n for n, y in pairs if y == x) for _, x in pairs}
    assert groups(whole) == groups(cut) == groups(many)
    near = {a for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 4}
    assert {n for n, _ in whole} == {int(x) for x in np.array(sorted(near), np.uint64).view(np.int64)}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = components(edges).collect()
    assert len({r.root for r in got if r.node <= 40}) == 1 and len({r.root for r in got}) == 2 and len(got) == 43


def test_components_have_few_rounds(spark):
    """The driver keeps account of every stage, so rounds that have little to do are not run."""
    order = random.Random(4).sample(range(100), 100)
    edges = spark.createDataFrame(list(zip(order, order[1:60])) + [(order[60], x) for x in order[61:]] + [(7, 7)], "a long, b long")
    spark.sparkContext.setJobGroup("few", "")
    got = components(edges).collect()
    spark.sparkContext._jsc.clearJobGroup()
    groups = {}
    for x in got:
        groups.setdefault(x.root, set()).add(x.node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, (order[:60], order[60:]))) and all(k in v for k, v in groups.items())
    whole = {(x.node, x.root) for x in components(edges, 0).collect()}
    assert len({x[1] for x in whole}) == 2 and len(whole) == 100
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 30


def test_links_across_the_highest_bit():
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(200)]
    fps = np.array(sorted({*base, *[b ^ (1 << 63) ^ (1 << r.randrange(63)) for b in base]}), np.uint64)
    a, b = simhash._stars(fps, np.zeros(len(fps), np.int64), np.full(len(fps), 2), 4)
    assert len(a) == 200 and set((a ^ b).tolist()) and all(int(x).bit_count() == 2 for x in a ^ b)


def test_no_similar_pair_is_lost_among_pages_of_one_template(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 50)
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**9)}"
    template = [word() for _ in range(164)]
    pages = [template + [word() for _ in range(40)] for _ in range(500)]
    pages += [template[:4] + [word() for _ in range(2)] + template for _ in range(120)]  # many texts by one rare shingle
    pages += [p[:-22] + [word() for _ in range(22)] for p in pages[:100]]
    rows = [(i, " ".join(p)) for i, p in enumerate(pages)]
    sets = [{tuple(p[i : i + 5]) for i in range(len(p) - 4)} for p in pages]
    fps = [simhash.fingerprint(t, 5) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    similar = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
            similar += alike
            if alike or (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert similar >= 100
    got = simhash.unique(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x.doc_id for x in got) == [i for i in range(len(rows)) if find(i) == i]


def test_pages_that_share_prefixes_do_not_make_rows_of_all_pairs(spark):
    """Pages below the similarity to each other, and near copies of some: rows grow with the pages, and each near copy is found."""
    r = random.Random(6)
    word = lambda: f"w{r.randrange(10**9)}"
    template = [word() for _ in range(160)]
    pages = [template + [word() for _ in range(22)] for _ in range(300)]
    pages += [p[:-3] + [word() for _ in range(3)] for p in pages[:20]]
    blocks = simhash.Blocks(spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(pages)], "doc_id long, text string"))
    sets = simhash.Sets(5, 42, 0.8)
    rows = blocks.map(simhash._signed_rows(sets), simhash.SIGNED).select("row", "doc_id").collect()
    named = {x.row: x.doc_id for x in rows}
    own = [{tuple(p[i : i + 5]) for i in range(len(p) - 4)} for p in pages]
    alike = lambda i, j: len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])
    want = {(i, j) for j in range(len(pages)) for i in range(j) if alike(i, j)}
    assert len(want) == 20
    contents = spark.createDataFrame([(x, x) for x in named], "row long, root long")
    pairs, near = simhash._pairs_left(blocks, contents, len(rows), sets)
    got = [tuple(sorted((named[x.a], named[x.b]))) for x in pairs.collect() + near.collect()]
    assert want <= set(got) and len(got) < 8 * len(pages)
