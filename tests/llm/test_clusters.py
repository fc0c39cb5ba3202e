import hashlib
import math

import numpy as np
import pytest

from ratingmill.llm import clusters


def brute(rows, k=8, rounds=10, dims=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * x) if abs(x) < 1e15 else int(x) * 1024 for x in v]) for i, v in kept]
    centres = [v for _, v in sorted(whole, key=lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in whole]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, x) in zip(whole, at) if x == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own)]
    at = assign()
    long = lambda x: x if x < 1 << 63 else None
    of = [sum(d for d, x in at if x == j) for j in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, j, long(d), long(of[j]), long(sum(of)), sha[j]) for (i, _), (d, j) in zip(whole, at)], key=str)


def test_nearest_is_exact_with_ties():
    r = np.random.default_rng(1)
    for high in (2, 5, 4000):
        v, c = r.integers(-high, high, (300, 64)), r.integers(-high, high, (9, 64))
        c[5], c[7] = c[2], c[0]
        d = ((v[:, None, :] - c[None]) ** 2).sum(2)
        for block in (1, 8, 64):
            number, best = clusters.nearest(v, c, r.permutation(64), block)
            assert (number == d.argmin(1)).all() and (best == d.min(1)).all()
        wide, far = clusters.nearest(v.astype(object) * 10**30, c, np.arange(64))
        assert far.dtype == object and wide.tolist() == [min((sum((10**30 * a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c.tolist()))[1] for x in v.tolist()]


@pytest.mark.parametrize("parts", [1, 7])
def test_against_brute_force(spark, parts):
    r = np.random.default_rng(2)
    middle = r.normal(0, 1, (5, 64))
    rows = [(int(i), (middle[i % 5] + r.normal(0, 0.3, 64)).astype(np.float32).tolist()) for i in range(150)]
    rows += [rows[3]] * 20 + [(3, rows[4][1]), (None, rows[9][1]), (200, [0.0] * 64), (201, [-0.0004] * 64)]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [math.nan] * 64), (306, [math.inf] + [0.0] * 63)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, cluster int").repartition(parts)
    got = sorted((tuple(x) for x in clusters.cluster(df).collect()), key=str)
    assert got == brute(rows)
    assert len({x[1] for x in got}) > 3


def test_few_rows_and_any_size(spark):
    schema = "vec_id string, embedding array<double>"
    rows = [("b", [float(i) for i in range(64)]), ("a", [1e300, -1e300, 2.0**62] + [0.5] * 61), ("c", [200_000.0] * 64), ("c", [200_000.0] * 64)]
    got = sorted((tuple(x) for x in clusters.cluster(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == brute(rows) and len(got) == 4
    same = [(str(i), [0.25] * 64) for i in range(30)]  # ties of all centroids: seven of them stay empty
    got = sorted((tuple(x) for x in clusters.cluster(spark.createDataFrame(same, schema)).collect()), key=str)
    assert got == brute(same) and {x[1] for x in got} == {0}
    assert clusters.cluster(spark.createDataFrame([], schema)).count() == 0
    assert clusters.cluster(spark.createDataFrame([("x", [1.0])], schema)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
