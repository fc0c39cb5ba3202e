import math
import random

import numpy as np
import pytest

from ratingmill import schema
from ratingmill.sources import arrays

NAMES = ["warm", "terse", "formal"]


def same(a, b):
    return (a is None and (b is None or math.isnan(b))) or a == b


def test_matrices_by_byte_ranges(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.integers(1, 11, (500, 3)).astype(float)
    x[r.random((500, 3)) < 0.1] = np.nan
    np.save(f"{tmp_path}/m.npy", x)
    df = arrays.read_arrays(spark, f"{tmp_path}/m.npy", range_bytes=1000, chunk_bytes=300)
    rows = sorted(df.collect(), key=lambda q: q.row)
    assert df.rdd.getNumPartitions() > 1 and [q.row for q in rows] == list(range(500)) and all(q.source == "m" and q["shape"] == [500, 3] for q in rows)
    assert all(same(a, b) for q in rows for a, b in zip(q["values"], x[q.row].tolist()))
    long = arrays.read_ratings_npy(spark, f"{tmp_path}/m.npy", NAMES)
    assert long.dtypes == [("conv_ord", "bigint"), ("attr_ord", "int"), ("attribute", "string"), ("score", "double")] and long.count() == 1500
    arrays.ratings_npy(long.repartition(7), f"{tmp_path}/again.npy")
    assert np.array_equal(np.load(f"{tmp_path}/again.npy"), x, equal_nan=True)
    with pytest.raises(Exception, match="2 attributes listed, rated: 3"):
        arrays.read_ratings_npy(spark, f"{tmp_path}/m.npy", NAMES[:2]).collect()


def test_odd_arrays(spark, tmp_path):
    np.save(f"{tmp_path}/line.npy", np.arange(5, dtype=np.int32))
    np.save(f"{tmp_path}/cube.npy", np.arange(24, dtype=np.float32).reshape(2, 3, 4))
    np.save(f"{tmp_path}/none.npy", np.zeros((0, 3)))
    rows = arrays.read_arrays(spark, str(tmp_path)).collect()
    assert sorted((q.row, q["values"]) for q in rows if q.source == "line") == [(i, [float(i)]) for i in range(5)]
    assert sorted((q.row, q["values"]) for q in rows if q.source == "cube") == [(i, [4.0 * i + j for j in range(4)]) for i in range(6)]
    assert not [q for q in rows if q.source == "none"]
    for name, a in (("f", np.asfortranarray(np.ones((3, 2)))), ("o", np.array([{}], object))):
        np.save(f"{tmp_path}/{name}.npy", a)
        with pytest.raises(Exception, match="not in row order|are not read"):
            arrays.read_arrays(spark, f"{tmp_path}/{name}.npy").collect()
    whole = spark.createDataFrame([(0, [1.0, None]), (1, [2.0, 3.0])], "row long, values array<double>")
    arrays.write_matrix(whole, 2, 2, f"{tmp_path}/w.npy")
    for df, n in ((whole, 3), (whole.selectExpr("row + 1 AS row", "values"), 2), (whole.selectExpr("row", "slice(values, 1, 1) AS values"), 2)):
        with pytest.raises(Exception, match="rows for a matrix|is not of a matrix"):
            arrays.write_matrix(df, n, 2, f"{tmp_path}/w.npy")
    assert np.array_equal(np.load(f"{tmp_path}/w.npy"), [[1, np.nan], [2, 3]], equal_nan=True) and not list(tmp_path.glob("*.part"))


def test_archives_of_all_judges(spark, tmp_path):
    r = random.Random(1)
    rows = [(j, p, f"{a}/{b}", k, s, float(r.randint(1, 10)) if r.random() < 0.9 else None) for j in ("j1", "j/2", "j3") for p, (a, b) in enumerate(schema.ANTONYMS) for k in range(50) for s in (0, 1)]
    df = spark.createDataFrame(rows, schema.PAIR_SCORES).repartition(6)
    arrays.cubes_npz(df, f"{tmp_path}/out")
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["j1.npz", "j3.npz", "j_2.npz"]
    cube = np.load(f"{tmp_path}/out/j1.npz")
    assert cube["scores"].shape == (6, 2, 50) and [tuple(p) for p in cube["pairs"]] == list(schema.ANTONYMS)
    assert all(same(v, cube["scores"][p, s, k]) for j, p, _, k, s, v in rows if j == "j1")
    got = arrays.read_cubes_npz(spark, f"{tmp_path}/out")
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(j.replace("/", "_"), *x) for j, *x in rows], key=key)
    np.savez_compressed(f"{tmp_path}/out/j1.npz", **cube)  # members may be compressed
    assert arrays.read_cubes_npz(spark, f"{tmp_path}/out").where("judge = 'j1' and score is not null").count() == sum(x[0] == "j1" and x[5] is not None for x in rows)
    with pytest.raises(ValueError, match="not whole"):
        arrays.cubes_npz(df.where("not (judge = 'j1' and rep = 49)").unionAll(df.limit(1)), f"{tmp_path}/bad")
    (tmp_path / "none").mkdir()
    assert arrays.read_cubes_npz(spark, f"{tmp_path}/none") is None
