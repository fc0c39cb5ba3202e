"""Embedding near-duplicates: an exact metric range join over pivots' cells.

Vectors of a label are points on the unit sphere, where cosine c is the distance sqrt(2 - 2c). A label's pivots, as many as its size
asks for, are the vectors with the smallest hashes; they partition its vectors: a vector's home cell is its nearest pivot's, or that of
the rest if the pivot is farther away than a reach R. If u with home j lies within r of v, whose nearest pivot is i, the triangle
inequality gives d(v, j) - r <= d(u, j) <= d(u, i) <= d(v, i) + r and d(v, j) <= R + r, so v is also sent to each cell j with
d(v, j) <= d(v, i) + 2r and <= R + r, unless the bisector of i and j is farther than r from v; if u is of the rest, d(v, i) > R - r, so
only such v are sent there. Each vector then
finds all that it links to in its home cell, and cells join independently. Cells that are still too large are partitioned again by
pivots of their own, LEVELS times at most. A sample of each cell's vectors tells beforehand what every number of pivots would cost, as
copies times cell size, with each reach; a cell takes the cheapest, and none at all where that saves less than a quarter, as with vectors
of many dimensions that lie alike in all directions. What no pivot divides is cut into blocks, and each pair of blocks is a task.

Equal vectors are one class with a count, so copies cost one row. A task gives each vector's number of links and a spanning star
of what is linked; pairs are never written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.common import components, local_roots, partitions, stash, tune

#: Pivots of all cells that are divided at one level, which is what is broadcast; levels.
MOST_PIVOTS, LEVELS = 4096, 4
#: Vectors of a cell whose copies are counted before it is divided; the share of its cost that a division may leave.
SAMPLE, WORTH = 500, 0.75
#: Reaches of pivots; no distance is beyond the first one.
REACHES = (3.0, 0.9, 0.6, 0.35)
SLACK = 1e-9


def _unit(vectors) -> np.ndarray:
    """Rows divided by their length; scaled by a power of two first, so that no square is too large or small for a double."""
    x = np.stack(vectors).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _reach(square: np.ndarray, apart: np.ndarray, radius: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, sent) of rows by their squared distances to pivots and the pivots' distances: the cell of the nearest pivot or of the rest,
    which comes last, and the cells that a row is sent to."""
    d, home, rows = np.sqrt(square), square.argmin(1), np.arange(len(square))
    nearest = d[rows, home]
    near = d - nearest[:, None] <= 2 * radius + SLACK
    near &= square - square[rows, home][:, None] <= 2 * (radius + SLACK) * apart[home] + SLACK
    near &= d <= most + radius + SLACK
    sent = np.column_stack([near, nearest > most - radius - SLACK])
    home = np.where(nearest > most, square.shape[1], home)
    sent[rows, home] = True
    return home, sent


def _reached(pivots: dict[tuple, list], radius: float):
    """How many rows would be sent to each cell by the first 2, 4, 8, ... pivots of a cell, and by all of them, with each reach."""
    unit = {cell: _unit(v) for cell, v in pivots.items()}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (label, dim, cell), part in b.groupby(["label", "dim", "cell"], sort=False):
                own = unit.get((label, dim, cell))
                if own is None:
                    continue
                apart = np.sqrt(np.maximum(2 - 2 * own @ own.T, 0))
                square = np.maximum(2 - 2 * _unit(part["vec"].to_numpy()) @ own.T, 0)
                for p in _numbers(len(own)):
                    for most in REACHES:
                        n = _reach(square[:, :p], apart[:p, :p], radius, most)[1].sum(0)
                        yield pd.DataFrame({"label": label, "dim": dim, "cell": cell, "p": p, "most": most, "sub": np.arange(p + 1), "n": n})

    return each


def _numbers(pivots: int) -> list[int]:
    return [1 << k for k in range(1, pivots.bit_length()) if 1 << k < pivots] + [pivots]


def _cells(pivots: dict[tuple, tuple[list, float]], radius: float):
    """Sends each row of a cell with pivots to its home among them and to those within reach. home: whether its row asks there."""
    unit = {cell: (_unit(v), most) for cell, (v, most) in pivots.items()}
    names = ["rid", "label", "dim", "n", "vec", "cell", "sub", "home"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apart: dict[tuple, np.ndarray] = {}
        for b in batches:
            out = []
            for cell, part in b.groupby(["label", "dim", "cell"], sort=False):
                if cell not in unit:
                    out.append(part.assign(sub=-1))
                    continue
                own, most = unit[cell]
                if cell not in apart:
                    apart[cell] = np.sqrt(np.maximum(2 - 2 * own @ own.T, 0))
                home, reach = _reach(np.maximum(2 - 2 * _unit(part["vec"].to_numpy()) @ own.T, 0), apart[cell], radius, most)
                at, sub = np.nonzero(reach)
                sent = part.iloc[at]
                out.append(sent.assign(sub=sub, home=sent["home"].to_numpy() & (sub == home[at])))
            if out:
                yield pd.concat(out)[names]

    return each


def _join(cosine: float, rows_at_once: int = 512):
    """(rid, links, root) of what a task's home rows link to."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
        norm = np.linalg.norm(x, axis=1)
        asks, has = np.flatnonzero(pdf["asks"].to_numpy()), np.flatnonzero(pdf["has"].to_numpy())
        weight, y, ny = pdf["n"].to_numpy(np.int64)[has], x[has], norm[has]
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))
        for i in range(0, len(asks), rows_at_once):
            mine = asks[i : i + rows_at_once]
            hit = (x[mine] @ y.T) / (norm[mine][:, None] * ny) >= cosine
            hit &= mine[:, None] != has
            links[mine] = hit @ weight
            a, b = np.nonzero(hit)
            if len(a):
                root = local_roots(np.concatenate([mine[a], np.arange(len(x))]), np.concatenate([has[b], root]), len(x))
        rid = pdf["rid"].to_numpy(np.int64)
        keep = (links > 0) | (root != np.arange(len(x)))
        return pd.DataFrame({"rid": rid[keep], "links": links[keep], "root": rid[root[keep]]})

    return each


def divided(members: DataFrame, radius: float, cell_rows: int) -> DataFrame:
    """members (rid, label, dim, n, vec, cell, home) with cells of more than cell_rows rows divided by pivots where that pays: a row for
    each cell that a vector is sent to; home tells the one in which it asks."""
    cell, settled = ["label", "dim", "cell"], []
    hashed = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 40))
    for level in range(LEVELS):
        size = members.groupBy(*cell).agg(F.count("*").alias("m")).where(F.col("m") > cell_rows)
        size = stash(size.where(~F.col("cell").isin(settled)) if settled else size)
        total = size.agg(F.sum("m")).first()[0]
        if total is None:
            break
        share = min(-(-8 * int(total) // cell_rows), MOST_PIVOTS) / total
        large = members.join(size, cell)
        order = hashed("rid", F.lit(level))
        found: dict[tuple, list] = {}
        for r in sorted(large.where(order < int(share * (1 << 40))).select(*cell, "vec", "rid", order.alias("o")).collect(), key=lambda r: (r.o, r.rid)):
            found.setdefault((r.label, r.dim, r.cell), []).append(r.vec)
        found = {k: v for k, v in found.items() if len(v) > 1}
        if not found:
            break
        rate = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("m"))
        sample = large.where(hashed("rid", F.lit(level), F.lit("sample")) < rate * (1 << 40)).select(*cell, "vec")
        sent = sample.mapInPandas(_reached(found, radius), "label string, dim int, cell long, p int, most double, sub int, n long")
        sent = sent.groupBy(*cell, "p", "most", "sub").agg(F.sum("n").cast("double").alias("n")).groupBy(*cell, "p", "most").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
        cost: dict[tuple, tuple] = {}
        for r in sent.join(size, cell).select(*cell, "p", "most", (F.col("pairs") / rate**2 / F.col("m") ** 2).alias("cost")).collect():
            key = (r.label, r.dim, r.cell)
            cost[key] = min(cost.get(key, (WORTH, 0, 0.0)), (r.cost, r.p, r.most))
        pivots = {k: (found[k][:p], most) for k, (_, p, most) in cost.items() if p}
        settled += [k[2] for k, (_, p, _) in cost.items() if not p]
        if not pivots:
            continue
        ddl = "rid long, label string, dim int, n long, vec array<double>, cell long, sub long, home boolean"
        out = members.select("rid", *cell, "n", "vec", "home").mapInPandas(_cells(pivots, radius), ddl)
        members = stash(out.withColumn("cell", F.when(F.col("sub") >= 0, F.xxhash64("cell", "sub")).otherwise(F.col("cell"))).drop("sub"))
    return members


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, cell_rows: int = 8000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their embeddings have one length and their cosine in double precision is
    `cosine` or more. Null, empty and zero vectors and those with null or non-finite components link with nothing. Rows with equal
    vec_id are vectors of their own; a component without any vec_id has a null component_id. Labels are of any atomic type. An empty
    table gives no row; other columns are not looked at.
    """
    spark = tune(vectors.sparkSession)
    radius = float(np.sqrt(2 - 2 * cosine))
    vec = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    sound = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound & F.col("label").isNotNull())
    rows = rows.withColumns({"h1": F.xxhash64(F.lit(1), "embedding"), "h2": F.xxhash64(F.lit("b"), "embedding", F.size("embedding"))})
    rows = stash(rows.withColumn("rid", F.monotonically_increasing_id()))
    key = ["label", "h1", "h2"]
    classes = rows.where("sound").groupBy(*key).agg(
        F.min("rid").alias("rid"), F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("embedding").alias("vec")
    )
    classes = stash(classes.withColumn("dim", F.size("vec")))
    label = F.col("label").cast("string")
    members = classes.select("rid", label.alias("label"), "dim", "n", "vec", F.xxhash64(label, "dim").alias("cell"), F.lit(True).alias("home"))
    cell = ["label", "dim", "cell"]
    members = stash(members)
    members = divided(members, radius, cell_rows)
    size = members.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(2 * cell_rows)).cast("int").alias("parts"))
    cut = members.join(stash(size), cell).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    # as a home a row asks in its own block's tasks, as a member it answers in every block's
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    own = F.col("part")
    tasks = F.concat(
        F.transform(F.filter(every, lambda b: F.col("home") & (b != own)), lambda b: F.struct(own.alias("a"), b.alias("b"), F.lit(True).alias("asks"), F.lit(False).alias("has"))),
        F.transform(F.filter(every, lambda a: a != own), lambda a: F.struct(a.alias("a"), own.alias("b"), F.lit(False).alias("asks"), F.lit(True).alias("has"))),
        F.array(F.struct(own.alias("a"), own.alias("b"), F.col("home").alias("asks"), F.lit(True).alias("has"))),
    )
    work = cut.select(*cell, "rid", "n", "vec", F.explode(tasks).alias("t")).select(*cell, "rid", "n", "vec", "t.a", "t.b", "t.asks", "t.has")
    work = work.repartition(partitions(spark), *cell, "a", "b")
    linked = stash(work.groupBy(*cell, "a", "b").applyInPandas(_join(cosine), "rid long, links long, root long"))
    roots = components(linked.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("rid").agg(F.sum("links").alias("links"))
    named = classes.select(*key, "rid", "n", "low").join(counts, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    named = stash(named.select(*key, "n", "low", "links", F.coalesce("root", "rid").alias("root")))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = stash(named.join(lows, "root").select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    good = rows.where("sound").join(labels, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
