"""Random forests of any size. Of more than ``PIECE_ROWS`` rows their trees are grown inside tasks (see ``grown``), of fewer by Spark ML, a few trees at a time.

A forest without a depth limit has about as many nodes as rows times trees, and Spark ML holds a model on the driver.  So a forest is fitted as
pieces of at most ``ROW_TREES`` rows times trees (one tree at least); each piece is a Spark ML forest that is saved to the shared folder as soon
as it is fitted.  A prediction reads them one after the other and adds up their votes.
"""
from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from nocturne.operators.grown import grow_forest
from nocturne.session import shared_dir

PIECE_ROWS = 1_000  # of more rows Spark ML's dense statistics of each node cost more than the rows themselves
ROW_TREES = 100_000  # rows times trees of a piece
ROWS_A_TASK = 100_000  # every task of a fit holds the statistics of all nodes being split, so tasks are few
GROWN_A_TASK = 5_000  # each such row is dealt to all trees
NODE_MEMORY_MB = 256  # for these statistics
AT_ONCE = 8  # pieces being fitted or applied
VOTE = float(1 << 40)  # votes are added as integers: their sum doesn't depend on the order

_pool = ThreadPoolExecutor(AT_ONCE)  # of the whole process, so that forests fitted side by side share the bound


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()  # a thread may have no active one


def _each(jobs: list[Callable]) -> list:
    spark = _session()
    return [f.result() for f in [_pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


class Forest:
    """Pieces in folders, with the number of trees, the weight and the importances of each."""

    def __init__(self, paths: list[str], trees: list[int], importances: list[list[float]]):
        self.paths, self.trees, self.importances = paths, trees, importances

    @property
    def featureImportances(self) -> DenseVector:
        """As of one forest: trees count alike, the sum is 1."""
        total = [sum(n * x for n, x in zip(self.trees, column)) for column in zip(*self.importances)]
        return DenseVector([x / (sum(total) or 1.0) for x in total])

    def transform(self, df: DataFrame) -> DataFrame:
        """``rawPrediction``, ``probability`` and ``prediction`` from the votes of all pieces."""
        spark = df.sparkSession
        folder = shared_dir(spark)
        df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")  # fixes the row numbers
        rows = spark.read.parquet(f"{folder}/rows")

        def vote(i: int, path: str) -> int:
            model = RandomForestClassificationModel.load(path)
            votes = model.transform(rows.select("_row", "_x")).select("_row", F.transform(vector_to_array("rawPrediction"), lambda v: F.round(v * VOTE).cast("bigint")).alias("v"))
            votes.write.parquet(f"{folder}/votes/piece={i}")
            return model.numClasses

        n = _each([lambda i=i, path=path: vote(i, path) for i, path in enumerate(self.paths)])[0]
        votes = spark.read.schema("_row long, v array<bigint>").parquet(f"{folder}/votes")
        total = votes.groupBy("_row").agg(F.array(*[F.sum(F.get("v", F.lit(c))) / VOTE for c in range(n)]).alias("_v"))
        most = F.array_position("_v", F.array_max("_v")).cast("double") - 1
        share = F.transform("_v", lambda v: v / sum(self.trees))
        out = rows.join(total, "_row")
        return out.select(*df.columns, array_to_vector("_v").alias("rawPrediction"), array_to_vector(share).alias("probability"), most.alias("prediction"))

    def write(self) -> Forest:
        return self

    def overwrite(self) -> Forest:
        return self

    def save(self, path: str) -> None:
        """Every piece in a folder of its own, and how to read them, written last."""
        paths = [f"{path}/piece_{i}" for i in range(len(self.paths))]
        _each([lambda a=a, b=b: RandomForestClassificationModel.load(a).write().overwrite().save(b) for a, b in zip(self.paths, paths)])
        told = json.dumps({"trees": self.trees, "importances": self.importances})
        _session().createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/forest")

    @classmethod
    def load(cls, path: str) -> Forest:
        told = json.loads(_session().read.text(f"{path}/forest").first()[0])
        return cls([f"{path}/piece_{i}" for i in range(len(told["trees"]))], told["trees"], told["importances"])


def fit_forest(data: DataFrame, n_rows: int, n_trees: int, seed: int, **settings):
    """A Spark ML forest where one piece holds all of it, a ``Forest``, or a ``GrownForest`` of many rows."""
    if n_rows > PIECE_ROWS:
        return grow_forest(data, n_rows, n_trees, seed, **settings)
    each = min(n_trees, max(1, ROW_TREES // max(n_rows, 1)))
    sizes = [min(each, n_trees - lo) for lo in range(0, n_trees, each)]
    subset = "sqrt" if n_trees > 1 else "all"

    def piece(i: int) -> RandomForestClassificationModel:
        return RandomForestClassifier(numTrees=sizes[i], featureSubsetStrategy=subset, cacheNodeIds=True, maxMemoryInMB=NODE_MEMORY_MB, seed=seed + 1_000_003 * i, **settings).fit(data)

    if len(sizes) == 1:
        return piece(0)
    folder = shared_dir(data.sparkSession)

    def kept(i: int) -> list[float]:
        model = piece(i)
        model.write().overwrite().save(f"{folder}/piece_{i}")
        return [float(x) for x in model.featureImportances.toArray()]

    importances = _each([lambda i=i: kept(i) for i in range(len(sizes))])
    return Forest([f"{folder}/piece_{i}" for i in range(len(sizes))], sizes, importances)


def tasks_for(n_rows: int) -> int:
    return max(1, math.ceil(n_rows / (GROWN_A_TASK if n_rows > PIECE_ROWS else ROWS_A_TASK)))
