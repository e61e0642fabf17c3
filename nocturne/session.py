"""Session helpers: folders that driver and executors share, and frames that are read more than once."""
from __future__ import annotations

import atexit
import uuid
import warnings
from collections import deque

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_folders: list[tuple[SparkSession, str]] = []
_kept: deque[DataFrame] = deque()
MOST_KEPT = 48  # frames held at a time


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder that the cluster names, else under the session's warehouse.

    Both are taken to be shared by driver and executors, whatever their scheme: a ``file:`` path may be a mount that all of them have.
    ``release()`` deletes the folders.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    base = named or spark.conf.get("spark.sql.warehouse.dir")
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/work-{uuid.uuid4().hex}")
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not named and full.startswith("file:") and not sc.master.startswith("local"):
        warnings.warn(f"spark.checkpoint.dir is not set, so {full} is used: driver and executors must share it", stacklevel=2)
    _folders.append((spark, full))
    return full


def keep(df: DataFrame) -> DataFrame:
    """Hold a frame that is read more than once. Its lineage stays, so what a lost executor held is computed again.

    Of many frames the latest ``MOST_KEPT`` are held; an earlier one that is read again is computed again.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(df)
    while len(_kept) > MOST_KEPT:
        try:
            _kept.popleft().unpersist()
        except Exception:  # its session has ended
            continue
    return df


def release() -> None:
    """Drop what ``keep`` holds and delete the folders of ``shared_dir``; frames that need them can't be used afterwards."""
    while _kept:
        try:
            _kept.pop().unpersist()
        except Exception:  # the session has ended
            _kept.clear()
    while _folders:
        spark, full = _folders.pop()
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(full)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:
            _folders.clear()


atexit.register(release)
