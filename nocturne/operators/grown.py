"""Random forests whose trees are grown inside tasks.

Spark ML keeps dense statistics of every node and the whole tree on the driver. Here the driver holds only the nodes of more than ``LOCAL_ROWS`` rows of a
tree's bag. These are split level by level, by the weights per (node, feature, bin, class) that tasks add up. A node
of fewer rows is one group of a shuffle: a task grows all that is below it. The trees are written to the shared folder by the tasks
and joined to the rows of a prediction by (tree, node).

As in Spark ML values come in at most 32 bins whose edges are taken from a sample, a row's weight in a tree is a Poisson draw, a node tries the square root of the number of features, gini decides, and a leaf votes with its shares.
"""
from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.session import shared_dir

LOCAL_ROWS = 100_000  # rows of a bag that one task grows a subtree from
BINS = 32  # of a feature, Spark ML's default
SAMPLE = 10_000  # rows that the bins are taken from
VOTE = float(1 << 40)  # votes are added as integers: their sum doesn't depend on the order
DRAWS = [sum(math.exp(-1) / math.factorial(k) for k in range(m + 1)) for m in range(12)]  # distribution of a Poisson draw of mean 1
TREES = "tree int, node int, feature array<int>, cut array<int>, child array<int>, votes array<double>, gain array<double>"


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, kind=np.uint8) -> np.ndarray:
    """A column of binary rows as a matrix."""
    if not len(column):
        return np.zeros((0, width), kind)
    flat = (pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column).cast(pa.binary())
    begin = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset]
    return np.frombuffer(flat.buffers()[2], kind, len(flat) * width, begin).reshape(-1, width)


def _part(v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight times (1 - gini), classes are the first axis; a cut's gain is the sum of its sides less the whole."""
    return np.einsum("ij,ij->j", v, v) / np.maximum(weight, 1e-300)


def _dense(at: np.ndarray, bins: np.ndarray, y: np.ndarray, w: np.ndarray, count: int, width: int, classes: int) -> tuple[np.ndarray, ...]:
    """(node, bin, rows, class weights) up to each bin of each node, from a histogram; also behind bins that no row has, which cut as the bin before does."""
    cell = at * width + bins
    left = np.bincount(y * (count * width) + cell, w, classes * count * width).reshape(classes, count, width).cumsum(2)[:, :, :-1]
    rows = np.bincount(cell, minlength=count * width).reshape(count, width).cumsum(1)[:, :-1]
    return np.repeat(np.arange(count), width - 1), np.tile(np.arange(width - 1), count), rows.ravel(), left.reshape(classes, -1)


def _sparse(at: np.ndarray, bins: np.ndarray, y: np.ndarray, w: np.ndarray, count: int, width: int, classes: int) -> tuple[np.ndarray, ...]:
    """The same from sorted rows, at bins that a node has but its last: for nodes of few rows."""
    shift = int(len(at)).bit_length()
    key = np.sort(((at * width + bins) << shift) | np.arange(len(at)))  # sorting numbers is faster than sorting places by them
    row = key & ((1 << shift) - 1)
    key >>= shift
    end = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)  # the last row of each bin
    cell = np.repeat(np.arange(len(end)), np.diff(end, prepend=-1))
    upto = np.bincount(y[row] * len(end) + cell, w[row], classes * len(end)).reshape(classes, -1).cumsum(1)
    node, bin_ = np.divmod(key[end], width)
    more = node[1:] == node[:-1]
    first = np.searchsorted(node, np.arange(count))  # each node's first cell
    base = np.zeros((classes, count))
    base[:, 1:] = upto[:, first[1:] - 1]
    last = np.flatnonzero(more)
    own = node[last]
    return own, bin_[last], end[last] + 1 - (end[first - 1] + 1)[own] * (first > 0)[own], upto[:, last] - base[:, own]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, depth: int, least: int, tried: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """A tree of bins, all nodes of a level at a time. Node i has its feature (-1: a leaf), cut (to the left up to it), first child (the right one is next) and class weights."""
    n, p = x.shape
    flat, width = x.ravel(), max(2, int(x.max(initial=0)) + 1)
    y = y.astype(np.int64)
    gains, levels = np.zeros(p), []
    rows, node, count, made = np.arange(n), np.zeros(n, np.int64), 1, 1  # rows lie by node
    for level in range(depth + 1):
        total = np.bincount(y[rows] * count + node, w[rows], classes * count).reshape(classes, count)
        size = np.bincount(node, minlength=count)
        feature, cut, child = np.full(count, -1, np.int32), np.zeros(count, np.int32), np.zeros(count, np.int32)
        levels.append((feature, cut, child, total.T))
        wanted = (np.count_nonzero(total, axis=0) > 1) & (size >= 2 * least) & (level < depth)
        if not wanted.any():
            break
        ids, total, size = np.flatnonzero(wanted), total[:, wanted], size[wanted]
        rows, at = rows[wanted[node]], np.repeat(np.arange(len(ids)), size)
        weight = total.sum(0)
        tries = np.argsort(rng.random((len(ids), p)), axis=1)[:, :tried]
        best, whole = np.zeros(len(ids)), _part(total, weight)
        places, own_y, own_w = rows * p, y[rows], w[rows]
        cuts = _dense if len(ids) * width <= 2 * len(rows) else _sparse
        for j in range(tried):
            at_node, bins, k, left = cuts(at, flat[places + np.repeat(tries[:, j], size)].astype(np.int64), own_y, own_w, len(ids), width, classes)
            able = (k >= least) & (size[at_node] - k >= least)
            if not able.all():
                at_node, bins, left = at_node[able], bins[able], left[:, able]
            if not len(bins):
                continue
            lw = left.sum(0)
            score = _part(left, lw) + _part(total[:, at_node] - left, weight[at_node] - lw)
            begin = np.flatnonzero(np.concatenate(([True], at_node[1:] != at_node[:-1])))
            own = at_node[begin]
            top = np.maximum.reduceat(score, begin)
            hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(begin, len(bins)))))
            spot = hit[np.searchsorted(hit, begin)]  # the first best one of each node
            gain = top - whole[own]
            better = gain > np.maximum(best[own], 1e-9 * weight[own])
            own = own[better]
            best[own] = gain[better]
            feature[ids[own]], cut[ids[own]] = tries[own, j], bins[spot[better]]
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        np.add.at(gains, feature[ids], best)
        child[split] = made + 2 * np.arange(len(split))
        kept = feature[ids][at] >= 0
        rows, parent = rows[kept], ids[at[kept]]
        node = child[parent] - made + (x[rows, feature[parent]] > cut[parent])
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        count = 2 * len(split)
        made += count
    feature, cut, child, votes = (np.concatenate(v) for v in zip(*levels))
    return {"feature": feature, "cut": cut, "child": child, "votes": votes, "gain": gains}


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The leaf that each row comes to from node ``at``."""
    at, going = at.copy(), np.arange(len(x))
    while len(going := going[feature[at[going]] >= 0]):
        f = feature[at[going]]
        at[going] = child[at[going]] + (x[going, f] > cut[at[going]])
    return at


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # xxHash's numbers


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _with_int(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _mixed(_turned((h + P5 + np.uint64(4)) ^ (x.astype(np.uint32).astype(np.uint64) * P1), 23) * P2 + P3)


def bags(row: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each row is in the bag of each tree: ``_draw`` for all trees, in numpy, since Spark works out a lambda cell by cell."""
    first = np.uint64(42) + P5 + np.uint64(8)  # Spark's xxhash64 begins with 42
    h = _mixed(_turned(first ^ (_turned(row.astype(np.int64).view(np.uint64) * P2, 31) * P1), 27) * P1 + P4)
    out = np.empty((len(row), trees), np.uint8)
    for t in range(trees):
        u = (_with_int(_with_int(h, np.array([t])), np.array([seed])) & np.uint64((1 << 53) - 1)) / float(1 << 53)
        out[:, t] = np.searchsorted(DRAWS, u, side="right")
    return out


def _binned(rows: DataFrame, edges: list[list[float]]) -> DataFrame:
    """The vector column ``x`` as a byte per feature: how many edges lie below it."""
    rest = [f for f in rows.schema if f.name != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(edges))
            bins = np.stack([np.searchsorted(np.array(e), x[:, f]) for f, e in enumerate(edges)], 1).astype(np.uint8)
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, bins.size + 1, len(edges), dtype=np.int32)), pa.py_buffer(bins.tobytes())])
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], packed], [*[f.name for f in rest], "x"])

    return rows.mapInArrow(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rest], "x binary"]))


def _seed(*numbers: int) -> np.random.Generator:
    return np.random.default_rng([n & 0xFFFFFFFF for n in numbers])


class Top:
    """The nodes of all trees that are too large for a task, and their children; tree i starts at node i."""

    def __init__(self, trees: int, p: int):
        self.trees, self.p = trees, p
        self.feature, self.cut, self.child, self.tree = np.full(trees, -1, np.int32), np.zeros(trees, np.int32), np.zeros(trees, np.int32), np.arange(trees)
        self.level = np.zeros(trees, np.int32)
        self.gain = np.zeros((trees, p))

    def told(self) -> dict:
        return {k: getattr(self, k).tolist() for k in ("feature", "cut", "child", "tree", "level", "gain")} | {"trees": self.trees, "p": self.p}

    @classmethod
    def of(cls, told: dict) -> Top:
        top = cls(told["trees"], told["p"])
        for k in ("feature", "cut", "child", "tree", "level", "gain"):
            setattr(top, k, np.array(told[k], getattr(top, k).dtype).reshape(-1, top.p) if k == "gain" else np.array(told[k], getattr(top, k).dtype))
        return top

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """Where each row lies, per tree."""
        return np.stack([walk(x, self.feature, self.cut, self.child, np.full(len(x), t)) for t in range(self.trees)], 1)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Each row once per tree, with ``tree`` and ``node``."""
        if len(self.feature) == self.trees:
            return rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1)))).withColumn("node", F.col("tree"))
        names, types = [f.name for f in rows.schema], rows.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = pa.FixedSizeListArray.from_arrays(pa.array(self.nodes(_matrix(batch.column("x"), self.p)).astype(np.int32).ravel()), self.trees)
                yield pa.RecordBatch.from_arrays([*batch.columns, at.cast(pa.list_(pa.int32()))], [*names, "_at"])

        placed = rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in types) + ", _at array<int>")
        return placed.select(*names, F.posexplode("_at").alias("tree", "node"))

    def split(self, rows: DataFrame, classes: int, depth: int, least: int, tried: int, seed: int) -> bool:
        """Split the leaves that hold more than ``LOCAL_ROWS`` rows of their bags; False if there are none."""
        p, trees = self.p, self.trees
        tries = np.argsort(_seed(seed, len(self.feature)).random((len(self.feature), p)), axis=1)[:, :tried]
        able = (self.feature < 0) & (self.level < depth)

        def sizes(batches):
            n = np.zeros(len(able), np.int64)
            for batch in batches:
                at, bag = self.nodes(_matrix(batch.column("x"), p)), bags(batch.column("row").to_numpy(), trees, seed)
                n += np.bincount(at[bag > 0], minlength=len(able))
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["node", "n"])

        held = {r["node"]: r["n"] for r in rows.select("x", "row").mapInArrow(sizes, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}
        large = np.array(sorted(i for i, n in held.items() if n > LOCAL_ROWS and able[i] and i not in self.done), int)
        if not len(large):
            return False
        slot = np.full(len(able), -1)
        slot[large] = np.arange(len(large))

        def counts(batches):
            cells = len(large) * tried * BINS * classes
            found = np.zeros((2, cells))  # one sum for each cell and task
            for batch in batches:
                bins, bag = _matrix(batch.column("x"), p), bags(batch.column("row").to_numpy(), trees, seed)
                y, w = (batch.column(c).to_numpy() for c in ("y", "w"))
                at = self.nodes(bins)
                row, tree = np.nonzero((bag > 0) & (slot[at] >= 0))
                s = slot[at[row, tree]]
                for j in range(tried):
                    cell = ((s * tried + j) * BINS + bins[row, tries[large][s, j]]) * classes + y[row]
                    found[0] += np.bincount(cell, bag[row, tree] * w[row], cells)
                    found[1] += np.bincount(cell, minlength=cells)
            there = np.flatnonzero(found[1])
            if len(there):
                yield pa.RecordBatch.from_arrays([pa.array(there // (tried * BINS * classes)), pa.array(there), pa.array(found[0][there]), pa.array(found[1][there])], ["slot", "cell", "w", "n"])

        def pick(key, table):
            s = key[0].as_py()
            h = np.zeros((2, tried * BINS * classes))
            cell = table.column("cell").to_numpy() - s * tried * BINS * classes
            for i, c in enumerate(("w", "n")):
                h[i][cell] = table.column(c).to_numpy()
            left, n = h[0].reshape(tried, BINS, classes).cumsum(1), h[1].reshape(tried, BINS, classes).sum(2).cumsum(1)
            there = (n >= max(1, least)) & (n[:, -1:] - n >= max(1, least))
            right = left[:, -1:] - left
            part = lambda v: (v * v).sum(-1) / np.maximum(v.sum(-1), 1e-300)
            score = np.where(there, part(left) + part(right) - part(left[:, -1:]), 0.0)
            j, b = np.unravel_index(np.argmax(score), score.shape)
            f = int(tries[large[s], j])
            good = score[j, b] > 1e-9 * left[j, -1].sum()
            return pa.table({"slot": [s], "feature": [f if good else -1], "cut": [int(b)], "gain": [float(score[j, b])]})

        sums = rows.mapInArrow(counts, "slot long, cell long, w double, n double").groupBy("slot", "cell").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        best = sums.groupBy("slot").applyInArrow(pick, "slot long, feature long, cut long, gain double").collect()
        for r in sorted(best, key=lambda r: r["slot"]):  # a handful of numbers per large node
            i = int(large[r["slot"]])
            self.done.add(i)
            if r["feature"] >= 0:
                self.feature[i], self.cut[i], self.child[i] = r["feature"], r["cut"], len(self.feature)
                self.gain[self.tree[i], r["feature"]] += r["gain"]
                self.feature, self.cut, self.child = np.append(self.feature, [-1, -1]).astype(np.int32), np.append(self.cut, [0, 0]).astype(np.int32), np.append(self.child, [0, 0]).astype(np.int32)
                self.tree, self.level = np.append(self.tree, [self.tree[i]] * 2), np.append(self.level, [self.level[i] + 1] * 2).astype(np.int32)
        return True

    def fit(self, rows: DataFrame, *args) -> Top:
        self.done: set[int] = set()  # nodes that have been tried
        while self.split(rows, *args):
            pass
        return self


class GrownForest:
    """Trees in a folder, one row per (tree, node of the top)."""

    def __init__(self, path: str, top: Top, edges: list[list[float]], classes: int, rows: int, importances: list[float]):
        self.path, self.top, self.edges, self.classes, self.rows, self.importances = path, top, edges, classes, rows, importances

    @property
    def getNumTrees(self) -> int:
        return self.top.trees

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.importances)

    def transform(self, df: DataFrame) -> DataFrame:
        """``rawPrediction``, ``probability`` and ``prediction`` from the votes of all trees."""
        spark, p, classes = df.sparkSession, self.top.p, self.classes
        folder = shared_dir(spark)
        df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")  # fixes the row numbers
        rows = spark.read.parquet(f"{folder}/rows")
        lots = max(1, math.ceil(rows.count() / max(self.rows, LOCAL_ROWS)))  # more rows than the forest was fitted on come in several lots
        asked = self.top.dealt(_binned(rows.select("_row", vector_to_array("_x").alias("x")), self.edges)).withColumn("lot", F.pmod(F.xxhash64("_row"), F.lit(lots)).cast("int"))
        trees = spark.read.schema(TREES).parquet(self.path).drop("gain").withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))

        def vote(tree, rows):
            if not rows.num_rows:
                return pa.table({"_row": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.int64()))})
            feature, cut, child, votes = (tree.column(c).combine_chunks().flatten().to_numpy() for c in ("feature", "cut", "child", "votes"))
            at = walk(_matrix(rows.column("x"), p), feature, cut, child, np.zeros(rows.num_rows, np.int64))
            share = votes.reshape(-1, classes)[at]
            share = np.rint(share / share.sum(1, keepdims=True) * VOTE).astype(np.int64)
            return pa.table({"_row": rows.column("_row"), "v": pa.FixedSizeListArray.from_arrays(pa.array(share.ravel()), classes).cast(pa.list_(pa.int64()))})

        by = ["tree", "node", "lot"]
        votes = trees.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(vote, "_row long, v array<bigint>")
        total = votes.groupBy("_row").agg(F.array(*[F.sum(F.get("v", F.lit(c))) / VOTE for c in range(classes)]).alias("_v"))
        most = F.array_position("_v", F.array_max("_v")).cast("double") - 1
        out = rows.join(total, "_row")
        return out.select(*df.columns, array_to_vector("_v").alias("rawPrediction"), array_to_vector(F.transform("_v", lambda v: v / self.top.trees)).alias("probability"), most.alias("prediction"))

    def write(self) -> GrownForest:
        return self

    def overwrite(self) -> GrownForest:
        return self

    def save(self, path: str) -> None:
        """The trees and, written last, how to read them."""
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        spark.read.schema(TREES).parquet(self.path).write.mode("overwrite").parquet(f"{path}/trees")
        told = json.dumps({"top": self.top.told(), "edges": self.edges, "classes": self.classes, "rows": self.rows, "importances": self.importances})
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/forest")

    @classmethod
    def load(cls, path: str) -> GrownForest:
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        told = json.loads(spark.read.text(f"{path}/forest").first()[0])
        return cls(f"{path}/trees", Top.of(told["top"]), told["edges"], told["classes"], told["rows"], told["importances"])


def _draw(row: Column, tree: Column, seed: int) -> Column:
    """How often a row is in the bag of a tree."""
    u = F.pmod(F.xxhash64(row, tree, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return sum(((u >= c).cast("int") for c in DRAWS[1:]), (u >= DRAWS[0]).cast("int")).cast("tinyint")


def grow_forest(data: DataFrame, n_rows: int, n_trees: int, seed: int, *, featuresCol: str, labelCol: str, maxDepth: int, minInstancesPerNode: int, weightCol: str | None = None) -> GrownForest:
    spark = data.sparkSession
    folder = shared_dir(spark)
    weight = F.col(weightCol) if weightCol else F.lit(1.0)
    vectors = data.select(vector_to_array(featuresCol).alias("x"), F.col(labelCol).cast("int").alias("y"), weight.cast("double").alias("w"))
    p, classes = vectors.agg(F.max(F.size("x")), F.max("y") + 1).first()
    some = np.array(vectors.sample(min(1.0, 2 * SAMPLE / n_rows), seed).limit(SAMPLE).select("x").toArrow().column("x").combine_chunks().flatten()).reshape(-1, p)
    edges = [np.unique(np.quantile(column[column < column.max()], np.arange(1, BINS) / BINS, method="lower") if np.ptp(column) else []).tolist() for column in some.T]
    _binned(vectors, edges).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")  # fixes the row numbers
    rows = spark.read.parquet(f"{folder}/rows")
    tried = max(1, math.ceil(math.sqrt(p))) if n_trees > 1 else p
    top = Top(n_trees, p)
    if n_rows * (1 - math.exp(-1)) > LOCAL_ROWS * 0.9:
        top.fit(rows.select("x", "y", "w", "row"), classes, maxDepth, minInstancesPerNode, tried, seed)
    drawn = _draw(F.col("row"), F.col("tree"), seed)
    bags = top.dealt(rows).withColumn("k", drawn).filter("k > 0").select("tree", "node", "x", "y", (F.col("k") * F.col("w")).alias("w"))
    levels = top.level

    def grown(key, table):
        tree, node = key[0].as_py(), key[1].as_py()
        y, w = (table.column(c).to_numpy() for c in ("y", "w"))
        made = grow(_matrix(table.column("x"), p), y, w, classes, maxDepth - int(levels[node]), minInstancesPerNode, tried, _seed(seed, tree, node))
        kinds = {"feature": pa.int32(), "cut": pa.int32(), "child": pa.int32(), "votes": pa.float64(), "gain": pa.float64()}
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), **{k: pa.array([made[k].ravel()], pa.list_(t)) for k, t in kinds.items()}})

    groups = int(np.count_nonzero(top.feature < 0))
    bags.repartition(groups, "tree", "node").groupBy("tree", "node").applyInArrow(grown, TREES).write.parquet(f"{folder}/trees")
    sums = spark.read.schema(TREES).parquet(f"{folder}/trees").groupBy("tree").agg(*[F.sum(F.get("gain", F.lit(f))).alias(f"g{f}") for f in range(p)]).collect()  # a row per tree
    gain = np.array([[r[f"g{f}"] for f in range(p)] for r in sums]) + top.gain[[r["tree"] for r in sums]]
    share = (gain / np.maximum(gain.sum(1, keepdims=True), 1e-300)).sum(0)
    return GrownForest(f"{folder}/trees", top, edges, classes, n_rows, [float(v) for v in share / (share.sum() or 1.0)])
