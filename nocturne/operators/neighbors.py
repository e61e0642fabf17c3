"""Exact nearest neighbours by pivot cells.

Points are assigned to the nearest of a set of sampled pivots.  A query is first
answered inside its own cell; the distance found bounds the answer, and only
cells that the triangle inequality cannot rule out are searched afterwards.
Equal vectors are merged into one point with a multiplicity beforehand.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.functions.arrays import let
from nocturne.session import keep

CELL_POINTS = 512
MAX_PIVOTS = 1024
CHUNK = 512
AT_ONCE = 500_000  # distances that a task holds


def merged_points(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct vectors per key with how often each occurs."""
    return df.groupBy(F.col(key), F.col(vector)).agg(F.count("*").alias("times"))


def pick_pivots(points: DataFrame, key: str, vector: str, cell_points: int, seed: int) -> dict[str, np.ndarray]:
    """Sampled vectors per key, enough for cells of about ``cell_points``; at most MAX_PIVOTS each."""
    sizes = points.groupBy(key).count().collect()
    out = {}
    for row in sizes:
        n = min(MAX_PIVOTS, max(1, math.ceil(row["count"] / cell_points)))
        draw = points.filter(F.col(key).eqNullSafe(F.lit(row[key]))).orderBy(F.xxhash64(F.lit(seed), F.col(vector)), vector).limit(n)
        out[str(row[key])] = np.array([r[0] for r in draw.select(vector).collect()], dtype=float)
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, one coordinate at a time so no three-dimensional array is made."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        step = a[:, j, None] - b[None, :, j]
        total += step * step
    return np.sqrt(total)


def assign_cells(df: DataFrame, key: str, vector: str, pivots: dict[str, np.ndarray]) -> DataFrame:
    """Add ``cell`` and the distance ``reach`` to its pivot."""

    @F.pandas_udf("cell int, reach double")
    def closest(keys: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        cell, reach = np.zeros(len(keys), dtype=np.int32), np.zeros(len(keys))
        for name, at in keys.groupby(keys).indices.items():
            for lo in range(0, len(at), CHUNK):
                rows = at[lo : lo + CHUNK]
                d = _distances(np.stack(vectors.iloc[rows].to_numpy()).astype(float), pivots[str(name)])
                cell[rows], reach[rows] = d.argmin(axis=1), d.min(axis=1)
        return pd.DataFrame({"cell": cell, "reach": reach})

    return df.withColumn("_c", closest(F.col(key).cast("string"), F.col(vector))).select(*df.columns, "_c.cell", "_c.reach")


FOUND = "cls string, v array<double>, cell int, d array<double>, times array<bigint>, vs array<double>"


def _rows(*columns) -> pd.DataFrame:
    names = ("cls", "v", "cell", "d", "times", "vs")
    return pd.DataFrame({n: pd.Series(list(c), dtype="int32" if n == "cell" else object) for n, c in zip(names, columns)})


def _search(k: int):
    """For each query of a cell its k + 1 nearest points within ``far``; neighbour vectors are laid end to end."""

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or points.empty:
            return _rows([], [], [], [], [], [])
        base, times = np.stack(points["v"].to_numpy()).astype(float), points["times"].to_numpy()
        rows = np.stack(queries["v"].to_numpy()).astype(float)
        chunk, m = max(1, AT_ONCE // len(base)), min(k + 1, len(base))
        d, at = [], []
        for lo in range(0, len(rows), chunk):
            far = _distances(rows[lo : lo + chunk], base)
            best = np.argpartition(far, m - 1, axis=1)[:, :m].copy()  # a view would hold the places of all points
            d.append(np.take_along_axis(far, best, axis=1))
            at.append(best)
        d, at = np.concatenate(d), np.concatenate(at)
        near = d <= queries["far"].to_numpy()[:, None]
        some = np.flatnonzero(near.any(axis=1))
        found = queries.iloc[some]
        picks = [at[i, near[i]] for i in some]
        return _rows(found["cls"], found["v"], found["cell"], [d[i, near[i]] for i in some], [times[j] for j in picks], [base[j].ravel() for j in picks])

    return run


def _unpacked():
    """The laid-out neighbours as structs (d, v, times)."""
    p = F.size("v")
    return F.transform("d", lambda d, i: F.struct(d.alias("d"), F.slice("vs", i * p + 1, p).alias("v"), F.element_at("times", i + 1).alias("times")))


def _probe(queries: DataFrame, points: DataFrame, k: int, rows_per_task: int) -> DataFrame:
    """Search the named cell for every query: one row per query, cell and block of the cell's points.

    Crowded cells are split by query and by point, so a task holds at most about ``rows_per_task`` of each.
    """
    split = lambda df, name: df.groupBy("cls", "cell").agg(F.ceil(F.count("*") / rows_per_task).cast("int").alias(name))
    load = split(queries, "parts").join(split(points, "blocks"), ["cls", "cell"])
    own = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(load, ["cls", "cell"]).withColumn("part", own("parts")).withColumn("block", every("blocks"))
    p = points.join(load, ["cls", "cell"]).withColumn("block", own("blocks")).withColumn("part", every("parts"))
    by = ["cls", "cell", "part", "block"]
    # Aliases give the query side new column identities: both sides may come from one table.
    q = q.select(*[F.col(c).alias(c) for c in ("cls", "v", "cell", "far", "part", "block")])
    # A fixed partition count keeps small but compute-heavy groups spread over all tasks.
    n = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, p = q.repartition(n, *by), p.repartition(n, *by)
    return q.groupBy(*by).cogroup(p.select("cls", "v", "times", *by[1:]).groupBy(*by)).applyInPandas(_search(k), FOUND).select("cls", "v", "cell", _unpacked().alias("near"))


def _trim(near, own, k: int):
    """The nearest structs (d, v, times, from) with the query's own occurrence taken out, cut once k are covered.

    ``from`` is the rank of the first occurrence; each struct stands for at least
    one point, so the first k always suffice.
    """
    others = F.transform(near, lambda x: F.struct(x["d"].alias("d"), x["v"].alias("v"), F.when(x["v"] == own, x["times"] - 1).otherwise(x["times"]).alias("times")))
    first = F.slice(F.array_sort(F.filter(others, lambda x: x["times"] > 0)), 1, k)

    def ranked(xs):
        before = lambda i: F.aggregate(F.slice(xs, F.lit(1), i), F.lit(0).cast("bigint"), lambda s, y: s + y["times"])
        return F.transform(xs, lambda x, i: F.struct(x["d"].alias("d"), x["v"].alias("v"), x["times"].alias("times"), before(i).alias("from")))

    return F.filter(let(first, ranked), lambda x: x["from"] < k)


def nearest(queries: DataFrame, points: DataFrame, k: int, *, cell_points: int = CELL_POINTS, rows_per_task: int = 20_000, seed: int = 42) -> DataFrame:
    """(cls, v, near): the k nearest other points of the same class for each distinct query vector.

    ``queries`` holds distinct (cls, v) that also occur in ``points`` (cls, v, times).
    """
    points = keep(points)  # read for the sizes, the pivots and the cells
    pivots = pick_pivots(points, "cls", "v", cell_points, seed)
    spots = keep(assign_cells(points, "cls", "v", pivots))
    asked = queries.join(spots.select("cls", "v", "cell"), ["cls", "v"]).withColumn("far", F.lit(float("inf")))  # queries are points: their cells are known
    home = _probe(asked, spots, k, rows_per_task).groupBy("cls", "v", "cell").agg(F.flatten(F.collect_list("near")).alias("near"))  # blocks of the cell together
    if max((len(p) for p in pivots.values()), default=1) == 1:
        return home.select("cls", "v", _trim(F.col("near"), F.col("v"), k).alias("near"))

    home = keep(home)  # read twice below
    radius = {(r["cls"], r["cell"]): r["r"] for r in spots.groupBy("cls", "cell").agg(F.max("reach").alias("r")).collect()}
    limits = {c: np.array([radius.get((c, i), -np.inf) for i in range(len(p))]) for c, p in pivots.items()}
    apart = {c: _distances(p, p) for c, p in pivots.items()}
    last = F.try_element_at("mine", F.lit(-1))
    bound = F.when(last["from"] + last["times"] >= k, last["d"]).otherwise(float("inf"))

    @F.pandas_udf("array<int>")
    def others(keys: pd.Series, vectors: pd.Series, cells: pd.Series, bounds: pd.Series) -> pd.Series:
        out = []
        for name, v, own, far in zip(keys, vectors, cells, bounds):
            d = np.sqrt(((pivots[name] - np.asarray(v, dtype=float)) ** 2).sum(axis=1))
            gap = np.where(apart[name][own] > 0, apart[name][own], np.inf)
            low = np.maximum(d - limits[name], (d**2 - d[own] ** 2) / (2 * gap))
            hit = (low <= far * (1 + 1e-9)) & np.isfinite(limits[name])
            hit[own] = False
            out.append(np.flatnonzero(hit).astype(np.int32))
        return pd.Series(out)

    known = home.withColumn("mine", _trim(F.col("near"), F.col("v"), k)).select("cls", "v", "cell", bound.alias("far"))
    more = known.withColumn("cell", F.explode(others("cls", "v", "cell", "far"))).select("cls", "v", "cell", (F.col("far") * (1 + 1e-9)).alias("far"))
    found = home.unionByName(_probe(more, spots, k, rows_per_task))
    near = F.flatten(F.collect_list("near"))
    return found.groupBy("cls", "v").agg(near.alias("near")).select("cls", "v", _trim(F.col("near"), F.col("v"), k).alias("near"))
