"""Input tables and the views that bind operators to them, as frames and as SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.operators.ordered import positions


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _stage(kind):
    return (
        F.when(kind == "purchase", "W").when(kind == "view", "N1").when(kind == "click", "N2").when(kind == "error", "N3").otherwise("REM")
    )


def staged(spark, sf) -> DataFrame:
    """Events as labelled rows, without positions."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("recording_id"), _stage(F.col("event_type")).alias("sleep_stage"),
        F.col("value").alias("eeg_value"), "event_id", "ts", "event_type",
    )


def epochs(spark, sf) -> DataFrame:
    placed = positions(staged(spark, sf), ["recording_id"], ["ts", "event_id"], "epoch_index")
    return placed.select("recording_id", "epoch_index", "sleep_stage", "eeg_value", "event_id", "ts")


EPOCHS = """v_epochs AS (
  SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch_index,
    CASE event_type WHEN 'purchase' THEN 'W' WHEN 'view' THEN 'N1' WHEN 'click' THEN 'N2' WHEN 'error' THEN 'N3' ELSE 'REM' END AS sleep_stage,
    value AS eeg_value, event_id, ts, event_type FROM events)"""


def arrays(spark, sf) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.floor(v / 20).cast("bigint").alias("recording_id"), (v % 20).alias("epoch_index"),
        F.col("embedding").alias("signal"), (F.col("label") % 5).alias("stage_code"),
        F.when(v % 3 != 0, F.col("label") % 2).alias("apnea_binary"),
    )


ARRAYS = """v_arrays AS (
  SELECT vec_id, CAST(floor(vec_id / 20) AS BIGINT) AS recording_id, vec_id % 20 AS epoch_index, embedding AS signal,
    label % 5 AS stage_code, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE label % 2 END AS apnea_binary FROM embeddings)"""


def preds(spark, sf) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l, "doc_id").select(
        F.col("doc_id").alias("row_id"), (F.col("doc_id") % 5).alias("fold_id"), F.col("source").alias("subject_id"),
        F.col("quality").alias("y_true"), (F.col("n_chars") >= 800).cast("int").alias("pred_a"),
        (F.col("lang") == "en").cast("int").alias("pred_b"), F.col("n_chars").cast("double").alias("score_a"),
        (F.col("n_chars") % 100).cast("double").alias("score_b"),
    )


PREDS = """v_preds AS (
  SELECT d.doc_id AS row_id, d.doc_id % 5 AS fold_id, d.source AS subject_id, l.quality AS y_true,
    CASE WHEN d.n_chars >= 800 THEN 1 ELSE 0 END AS pred_a, CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS pred_b,
    CAST(d.n_chars AS DOUBLE) AS score_a, CAST(d.n_chars % 100 AS DOUBLE) AS score_b
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def mpreds(spark, sf) -> DataFrame:
    e = staged(spark, sf)
    return e.select(
        F.col("event_id").alias("row_id"), F.col("recording_id").alias("subject_id"), (F.col("event_id") % 5).alias("fold_id"),
        F.col("sleep_stage").alias("y_true"),
        F.when(F.col("event_id") % 3 == 0, "N2").otherwise(F.col("sleep_stage")).alias("y_pred"),
    )


MPREDS = (
    EPOCHS
    + """, v_mpreds AS (
  SELECT event_id AS row_id, recording_id AS subject_id, event_id % 5 AS fold_id, sleep_stage AS y_true,
    CASE WHEN event_id % 3 = 0 THEN 'N2' ELSE sleep_stage END AS y_pred FROM v_epochs)"""
)


def dirty(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.unionByName(c.filter(k % 50 == 0)).select(
        "c_custkey", F.when(k % 7 != 0, F.col("c_acctbal")).alias("Acct Bal"),
        F.when(k % 40 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")).alias("nation_text"),
        F.when(k % 3 == 0, F.concat(F.lit("  "), F.upper("c_mktsegment"), F.lit(" "))).otherwise(F.lower("c_mktsegment")).alias("segment"),
        F.when(k % 2 == 0, "yes").otherwise("No").alias("active"),
        F.when(k % 10 == 0, F.col("c_acctbal")).alias("mostly_missing"),
    )


DIRTY = """v_dirty AS (
  SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS "Acct Bal",
    CASE WHEN c_custkey % 40 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS VARCHAR) END AS nation_text,
    CASE WHEN c_custkey % 3 = 0 THEN '  ' || upper(c_mktsegment) || ' ' ELSE lower(c_mktsegment) END AS segment,
    CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'No' END AS active,
    CASE WHEN c_custkey % 10 <> 0 THEN NULL ELSE c_acctbal END AS mostly_missing
  FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 50 = 0) t)"""


def intervals(spark, sf) -> DataFrame:
    start = ((F.col("event_id") * 37) % 2000).cast("double")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("recording_id"), "event_id", start.alias("start_sec"),
        (start + F.col("value")).alias("end_sec"), "event_type",
    )


INTERVALS = """v_intervals AS (
  SELECT user_id AS recording_id, event_id, CAST((event_id * 37) % 2000 AS DOUBLE) AS start_sec,
    CAST((event_id * 37) % 2000 AS DOUBLE) + value AS end_sec, event_type FROM events)"""


def annotations(spark, sf) -> DataFrame:
    e = epochs(spark, sf)
    return e.select(
        "recording_id", (F.col("epoch_index") * 300).cast("double").alias("onset"),
        (30 * (1 + F.col("event_id") % 5) + F.col("event_id") % 7).cast("double").alias("duration"),
        F.col("sleep_stage").alias("label"),
    )


ANNOTATIONS = (
    EPOCHS
    + """, v_annotations AS (
  SELECT recording_id, CAST(epoch_index * 300 AS DOUBLE) AS onset,
    CAST(30 * (1 + event_id % 5) + event_id % 7 AS DOUBLE) AS duration, sleep_stage AS label FROM v_epochs)"""
)


class Catalog:
    """Queries by name, each with an optional SQL twin."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            self.queries[name] = fn
            if sql:
                self.sql[name] = sql
            return fn

        return keep


def r(col, digits: int = 6):
    """Rounded double without negative zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)
