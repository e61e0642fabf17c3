"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

A table projects unit vectors on a few random Gaussian directions and cuts each projection into cells of a fixed
width.  If a neighbour has cosine c with the query, its projection is about normal around c times the query's, which gives every
cell the probability that it holds the neighbour.  A query visits cells in falling order of that probability until
they add up to ``target``.  Candidates of all tables are ranked by exact cosine.

A second round takes the cosine of the query's own k-th best so far, which is no more than that of its true k-th, and visits the cells that are still
missing for it, so a query far from the groups that set the sample's cosine goes on until its own target holds.

A cell is compared with its queries as one matrix product.  Crowded cells are split by hash, and so are the queries,
so no group has more than about ``block`` rows of either kind, whatever the data; nothing is dropped.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nocturne.llm.common import U64, materialize, mix, pick

_erf = np.vectorize(math.erf, otypes=[float])


@dataclass
class Tables:
    """Directions, offsets and width of the tables, and the cosine that a near neighbour is taken to have."""

    dimension: int
    directions: np.ndarray  # table, dimension, projection
    offsets: np.ndarray
    width: float
    cosine: float

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cell coordinates by table and row."""
        return np.stack([np.floor((unit @ a + b) / self.width).astype(np.int64) for a, b in zip(self.directions, self.offsets)])


def fit_tables(sample: np.ndarray, *, tables: int = 2, projections: int = 4, width: float = 0.3, seed: int = 5) -> Tables:
    """Directions do not depend on the data. The cosine is the median of each sampled vector's fifth nearest within the sample, a low estimate."""
    n, d = sample.shape
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    few = unit[: min(n, 512)]
    near = np.sort(few @ unit.T, axis=1)[:, ::-1]
    cosine = float(np.clip(np.median(near[:, min(5, n - 1)]), 0.05, 0.999))
    rng = np.random.default_rng(seed)
    p = min(projections, d)
    directions = np.stack([np.linalg.qr(rng.normal(size=(d, p)))[0] for _ in range(tables)])
    return Tables(d, directions, rng.uniform(0, width, (tables, p)), width, cosine)


def _valid(column: pa.Array, dimension: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a usable vector, and the vectors as doubles."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dimension) if dimension else np.flatnonzero(sizes > 0)
    if not len(rows):
        return rows, np.zeros((0, dimension or 1))
    x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dimension)  # a null becomes NaN
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
    return rows[good], x[good]


def _mixed(cells: np.ndarray) -> np.ndarray:
    """One number per row of cell coordinates; exact, as coordinates are small."""
    out = np.zeros(len(cells), np.int64)
    for k in range(cells.shape[1]):
        out = out * 4096 + cells[:, k] + 2048
    return out


def _index(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: Tables = shared.value
        for batch in batches:
            rows, x = _valid(batch.column("vector"), tables.dimension)
            ids = pc.take(batch.column("vec_id"), pa.array(rows))
            cells = tables.cells(x / np.linalg.norm(x, axis=1, keepdims=True)) if len(rows) else np.zeros((len(tables.offsets), 0, 1), np.int64)
            load = pa.array([v.astype("<f8").tobytes() for v in x], pa.binary())
            for t in range(len(tables.offsets)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(_mixed(cells[t])), ids, load], ["table", "cell", "vec_id", "load"])

    return run


def _visits(tables: Tables, directory, x: np.ndarray, cosine: np.ndarray, target: float, least: int) -> Iterator[list[np.ndarray]]:
    """By table, for each query the cells (places in the directory) to visit if a neighbour has that cosine; all cells where it is NaN."""
    known = np.where(np.isnan(cosine), 0.0, np.clip(cosine, -0.999, 0.999))
    sd = np.sqrt(np.maximum(1 - known**2, 1e-4) / tables.dimension)[:, None]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for t, (cells, counts) in enumerate(directory):
        centre = known[:, None] * (unit @ tables.directions[t]) + tables.offsets[t]
        chance = np.ones((len(x), len(cells)))
        for k in range(cells.shape[1]):
            low, at = np.unique(cells[:, k], return_inverse=True)
            z = lambda c, k=k: (c[None, :] * tables.width - centre[:, k : k + 1]) / (sd * math.sqrt(2))
            chance *= ((_erf(z(low + 1)) - _erf(z(low))) / 2)[:, at.ravel()]
        order = np.argsort(-chance, axis=1, kind="stable")
        out = []
        for i, o in enumerate(order):
            enough = (np.cumsum(chance[i, o]) >= target) & (np.cumsum(counts[o]) >= least)
            out.append(o[: int(np.argmax(enough)) + 1] if enough.any() and not np.isnan(cosine[i]) else o)
        yield out


def _probe(shared, target: float, least: int, again: bool = False):
    """Cells to visit by the sample's cosine or, ``again``, those that the query's own cosine adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, directory = shared.value
        for batch in batches:
            rows, x = _valid(batch.column("vector"), tables.dimension)
            ids = pc.take(batch.column("vec_id"), pa.array(rows)).to_pylist()
            out = []
            first = _visits(tables, directory, x, np.full(len(rows), tables.cosine), target, least)
            if again:
                own = pc.take(batch.column("own"), pa.array(rows)).to_numpy(zero_copy_only=False).astype(float)  # a null becomes NaN
                both = zip(_visits(tables, directory, x, own, target, least), first)
                first = ([np.setdiff1d(b, a) for b, a in zip(*pair)] for pair in both)
            loads = [v.astype("<f8").tobytes() for v in x]
            for t, visits in enumerate(first):
                keys = _mixed(directory[t][0])
                for vec, load, places in zip(ids, loads, visits):
                    out.extend((t, int(keys[c]), vec, load) for c in places)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["table", "cell", "vec_id", "load"])

    return run


def _compare(k: int):
    """Exact cosines of one block of queries and one block of a cell, the best k of each query."""

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = group.column("vec_id").to_numpy()
        x = np.frombuffer(b"".join(group.column("load").to_pylist()), "<f8").reshape(len(ids), -1)
        norm = np.sqrt((x * x).sum(1))
        q, v = np.flatnonzero(asks), np.flatnonzero(~asks)
        q_out, v_out, s_out = [], [], []
        if len(q) and len(v):
            rough = (x[q] / norm[q, None]) @ (x[v] / norm[v, None]).T
            rough[ids[q][:, None] == ids[v][None, :]] = -2
            edge = np.partition(rough, max(len(v) - k, 0), axis=1)[:, max(len(v) - k, 0)] - 1e-9
            a, b = np.nonzero((rough >= edge[:, None]) & (rough > -1.5))
            score = np.empty(len(a))
            for lo in range(0, len(a), 65536):  # row by row: equal vectors have equal scores
                i, j = q[a[lo : lo + 65536]], v[b[lo : lo + 65536]]
                score[lo : lo + 65536] = (x[i] * x[j]).sum(1) / (norm[i] * norm[j])
            order = np.lexsort((ids[v[b]], -score, a))
            a, b, score = a[order], b[order], score[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            keep = place < k
            q_out, v_out, s_out = ids[q[a[keep]]], ids[v[b[keep]]], score[keep]
        return pa.table([pa.array(q_out, pa.int64()), pa.array(v_out, pa.int64()), pa.array(s_out, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(
    base: DataFrame, queries: DataFrame, *, k: int = 5, vector: str = "embedding", tables: int = 2, projections: int = 4, width: float = 0.3,
    target: float = 0.75, sample_rows: int = 4096, block: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` nearest found, nearest first, ties to the smaller vec_id.

    Both tables have vec_id and a vector column; a row of ``base`` with the query's vec_id is no candidate. The score is the cosine in double precision.
    Rows without id, and vectors that are null, zero, hold a null or non-finite component or differ in length from most of the
    sample, take no part. Equal vectors are separate candidates; repeated rows of one vec_id count once. An empty table gives no rows.
    ``sample_rows``: the rows, those whose ids hash lowest, from which the length and a neighbour's cosine are estimated; every row is indexed.
    ``target``: the probability that the visited cells of one table hold a neighbour of that cosine. At 0.75 two tables find 0.95 of the
    true neighbours on isotropic vectors of 64 dimensions, where they have to visit most cells; closer neighbours need few.
    """
    spark = base.sparkSession
    base = pick(base, "vec_id", vector).toDF("vec_id", "vector").filter("vec_id is not null and vector is not null").withColumn("vec_id", F.col("vec_id").cast("bigint"))
    asked = pick(queries, "vec_id", vector).toDF("vec_id", "vector").filter("vec_id is not null and vector is not null").withColumn("vec_id", F.col("vec_id").cast("bigint"))
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    sizes = [len(r["vector"]) for r in sample]
    dimension = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
    rows = [r["vector"] for r in sample if len(r["vector"]) == dimension and None not in r["vector"]]
    x = np.array(rows, float).reshape(-1, max(dimension, 1))
    x = x[np.isfinite(x).all(1) & (np.abs(x).sum(1) > 0)]
    schema = "table int, cell long, vec_id long, load binary"
    if not len(x):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = fit_tables(x, tables=tables, projections=projections, width=width)
    sc = spark.sparkContext
    index = materialize(base.mapInArrow(_index(sc.broadcast(fitted)), schema).dropDuplicates(["table", "cell", "vec_id", "load"]))
    # Occupied cells: (2 / width + 2) ** projections at most, whatever the number of rows.
    found = index.groupBy("table", "cell").agg(F.count("*").alias("n")).orderBy("table", "cell").collect()
    directory = []
    for t in range(tables):
        keys = np.array([r["cell"] for r in found if r["table"] == t], np.int64)
        p = fitted.directions.shape[2]
        cells = np.stack([keys // 4096 ** (p - 1 - i) % 4096 - 2048 for i in range(p)], 1).reshape(-1, p)
        directory.append((cells, np.array([r["n"] for r in found if r["table"] == t], np.int64)))
    parts = [(r["table"], r["cell"], -(-r["n"] // block)) for r in found]
    wide = F.broadcast(spark.createDataFrame(parts, "table int, cell long, parts long"))  # as many rows as there are cells
    sent = sc.broadcast((fitted, directory))
    salt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n) if isinstance(n, int) else n)
    keys = ["table", "cell", "part", "lot"]

    def compared(probes: DataFrame) -> DataFrame:
        lots = max(1, -(-(probes.groupBy("table", "cell").count().agg(F.max("count")).first()[0] or 0) // block))
        left = index.join(wide, ["table", "cell"]).withColumn("part", salt(F.col("parts"))).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
        right = probes.join(wide, ["table", "cell"]).withColumn("lot", salt(lots).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        both = left.select(*keys, "vec_id", "load", F.lit(False).alias("asks")).union(right.select(*keys, "vec_id", "load", F.lit(True)))
        return both.groupBy(*keys).applyInArrow(_compare(k), "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        near = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    near = materialize(best(compared(materialize(asked.mapInArrow(_probe(sent, target, 10 * k), schema)))))
    own = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("own"))
    more = materialize(asked.join(own, "vec_id", "left").mapInArrow(_probe(sent, target, 10 * k, again=True), schema))
    return best(near.select("query_id", "vec_id", "score").union(compared(more)))
