import math

import numpy as np

from ratingmill.llm import vectors


def brute(rows, cosine=0.98):
    def sound(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, group = [0] * n, list(range(n))
    x = [np.array(v, float) / np.abs(v).max() if sound(v, lab) else None for _, v, lab in rows]
    pairs = []
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    pairs.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    low = {}
    for i, r in enumerate(rows):
        low[group[i]] = min(low.get(group[i], r[0]), r[0])
    return sorted((r[0], links[i], low[group[i]], r[0] == low[group[i]]) for i, r in enumerate(rows))


def test_against_brute_force(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(400):
        if i > 20 and r.random() < 0.5:
            _, v, lab = rows[r.integers(len(rows))]
            v = (np.array(v) * r.uniform(0.5, 2) + r.normal(0, r.choice([0, 0.02, 0.06]), 8)).tolist()
        else:
            v, lab = r.normal(0, 1, 8).tolist(), int(r.integers(3))
        rows.append((int(10_000 - i), v, lab))
    v = rows[0][1]
    rows += [(1, None, 1), (2, [], 1), (3, [0.0] * 8, 1), (4, [float("nan")] * 8, 1), (5, [None, 1.0], 1), (6, v, None), (7, [float("inf")] * 8, 0), (8, v[:7], rows[0][2]), (9, v[:7], rows[0][2])]
    big = np.array(rows[1][1])
    rows += [(20, (big * 1e200).tolist(), 9), (21, (big * 1.001 * 1e200).tolist(), 9), (22, (big * 1e-200).tolist(), 9)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, label int, n long")
    want = brute(rows)
    for cell in (2000, 40):
        got = sorted(tuple(x) for x in vectors.near_duplicates(df, cell_rows=cell).collect())
        assert got == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_labels_that_are_text_and_one_label_of_many(spark):
    r = np.random.default_rng(4)
    centres = r.normal(0, 1, (12, 6))
    rows = [(i, (centres[r.integers(12)] + r.normal(0, 0.08, 6)).tolist(), "hot" if i % 3 else f"label {i % 7}") for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for cell in (8000, 60, 15):
        assert sorted(tuple(x) for x in vectors.near_duplicates(df, cell_rows=cell).collect()) == brute(rows)


def cells_of(spark, x, cell_rows, cosine=0.98):
    rows = [(i, "a", x.shape[1], 1, v.tolist(), 1, True) for i, v in enumerate(x)]
    members = spark.createDataFrame(rows, "rid long, label string, dim int, n long, vec array<double>, cell long, home boolean")
    return vectors.divided(members, float(np.sqrt(2 - 2 * cosine)), cell_rows).select("rid", "cell", "home").toPandas()


def test_vectors_in_groups_are_divided_and_copies_stay_few(spark):
    r = np.random.default_rng(6)
    centres = r.normal(0, 1, (40, 64))
    x = centres[r.integers(0, 40, 4000)] + r.normal(0, 0.05, (4000, 64))
    got = cells_of(spark, x, 400)
    assert (got[got.home].groupby("rid").size() == 1).all() and got[got.home].rid.nunique() == 4000
    cost = (got.groupby("cell").size().astype(float) ** 2).sum()  # copies times cell size
    assert cost < 0.25 * 4000**2


def test_vectors_that_no_pivot_divides_are_not_copied(spark):
    x = np.random.default_rng(7).normal(0, 1, (3000, 64))
    got = cells_of(spark, x, 300)
    assert len(got) == 3000 and got.cell.nunique() == 1


def test_blocks_of_undivided_vectors_against_brute_force(spark):
    r = np.random.default_rng(8)
    x = r.normal(0, 1, (300, 24))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, (x[i % 50] + r.normal(0, 0.1, 24)).tolist(), 0) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(x) for x in vectors.near_duplicates(df, cell_rows=30).collect()) == brute(rows)
