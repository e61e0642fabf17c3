"""Tables by file suffix, prediction folders and two-table exports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.operators.ordered import positions
from nocturne.operators.schema import nan_to_null, q


def _suffix(path: str) -> str:
    tail = path.rstrip("/").rsplit("/", 1)[-1]
    kind = tail.rsplit(".", 1)[-1].lower() if "." in tail else ""
    if kind not in ("csv", "parquet"):
        raise ValueError(f"unsupported table format {kind!r}: use .csv or .parquet")
    return kind


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV (with header) or Parquet by suffix; NaN is read as null.

    Give a schema for CSV where it is known: inference reads the files twice.
    """
    if _suffix(path) == "parquet":
        return nan_to_null(spark.read.parquet(path))
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return nan_to_null(df)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    if _suffix(path) == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).option("header", True).csv(path)


def read_headerless_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Columns are named 0, 1, 2 and so on."""
    df = spark.read.csv(path, header=False, schema=schema) if schema else spark.read.csv(path, header=False, inferSchema=True)
    return df.toDF(*map(str, range(len(df.columns))))


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per model and fold."""
    df.write.mode(mode).partitionBy("model", "fold_id").parquet(path)


def read_predictions(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """Predictions with ``row_id``, the position within model and fold along ``order``."""
    df = spark.read.parquet(path)
    return positions(df, ["model", "fold_id"], order, "row_id")


def two_table_export(df: DataFrame, staging: Column, events: Column, staging_path: str, events_path: str, order: list[str], max_staging: int | None = None, max_events: int | None = None) -> None:
    """One parent to a staging and an event table; a row may go to both, each with its own row cap.

    A cap keeps the first rows along ``order`` (a feature of the export, off by default).
    """
    for rows, path, cap in ((df.filter(staging), staging_path, max_staging), (df.filter(events), events_path, max_events)):
        if cap is not None:
            rows = rows.orderBy(*[q(c) for c in order]).limit(cap)
        write_table(rows, path)


def ingest_report(files: DataFrame, used: Column, source: Column, notes: Column | None = None) -> DataFrame:
    """Files used and skipped per source, with its notes."""
    out = files.groupBy(source.alias("source")).agg(
        F.count_if(used).alias("n_files_used"), F.count_if(~used | used.isNull()).alias("n_files_skipped"),
        *([F.max(notes).alias("notes")] if notes is not None else []),
    )
    return out
