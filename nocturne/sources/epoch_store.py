"""The epoch store: fixed-length sample rows, partitioned by dataset, with a manifest."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.functions.arrays import cut_epoch
from nocturne.functions.text import store_relpath
from nocturne.operators.ordered import positions
from nocturne.operators.timeseries import attach_samples

STORE_VERSION = 1
# Columns every manifest must have.
MANIFEST = {
    "epoch_store_relpath": "string",
    "epoch_store_row": "bigint",
    "sample_hz": "double",
    "samples_per_epoch": "bigint",
    "channel_name_used": "string",
    "store_version": "bigint",
}


def epochs_from_samples(samples: DataFrame, epochs: DataFrame, keys: list[str], width: int, idx: str = "sample_idx", value: str = "value") -> DataFrame:
    """One sample array per epoch, in time order; an epoch's own samples are all a group holds."""
    hits = attach_samples(samples, epochs.select(*keys, "epoch_index", "epoch_start_sample", "epoch_end_sample"), keys, width, idx)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).cast("float").alias("v"))))
    got = hits.groupBy(*keys, "epoch_index").agg(F.transform(ordered, lambda x: x["v"]).alias("signal"))
    return epochs.join(got, [*keys, "epoch_index"], "left")


def store_rows(df: DataFrame, *, sample_hz: float, epoch_seconds: float = 30.0, channel: str = "eeg_channel_standardized", signal: str = "signal") -> DataFrame:
    """Epochs with manifest columns and samples cut or padded to the epoch length."""
    n = round(sample_hz * epoch_seconds)
    placed = positions(df, ["dataset_id", "recording_id"], ["epoch_index"], "epoch_store_row")
    name = F.trim(F.col(channel)) if channel in df.columns else F.lit("")
    xs = F.coalesce(F.col(signal).cast("array<float>"), F.array().cast("array<float>"))
    return placed.withColumns({
        "epoch_store_relpath": store_relpath(F.col("dataset_id").cast("string"), F.col("recording_id").cast("string")),
        "sample_hz": F.lit(float(sample_hz)), "samples_per_epoch": F.lit(n).cast("bigint"),
        "channel_name_used": name, "store_version": F.lit(STORE_VERSION).cast("bigint"),
        "epoch_seconds": F.lit(float(epoch_seconds)),
        signal: cut_epoch(xs, F.lit(1.0), F.lit(0.0), F.lit(float(n)), n),
    })


def bucket_of(relpath, buckets: int):
    """The folder of a recording: it follows from its path, so a path alone finds its rows."""
    return F.concat_ws("_of_", F.pmod(F.xxhash64(relpath), F.lit(buckets)).cast("string"), F.lit(str(buckets)))


def write_epoch_store(df: DataFrame, path: str, *, buckets: int = 64, **kw) -> DataFrame:
    """Write the store, in folders by data set and bucket of recordings and clustered by recording and epoch, and return its manifest."""
    rows = store_rows(df, **kw).withColumn("bucket", bucket_of(F.col("epoch_store_relpath"), buckets))
    by = ["dataset_id", "bucket", "recording_id", "epoch_index"]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("dataset_id", "bucket").parquet(path)
    return read_manifest(df.sparkSession, path, kw.get("signal", "signal"))


def read_recording(spark: SparkSession, path: str, relpath: str) -> DataFrame:
    """The epochs that a manifest's ``epoch_store_relpath`` names, in store order; only that recording's folder is read."""
    store = spark.read.parquet(path)
    some = store.select("bucket").first()
    if some is None:
        return store
    wanted = spark.range(1).select(bucket_of(F.lit(relpath), int(some["bucket"].rsplit("_", 1)[1])).alias("b")).first()["b"]
    return store.filter((F.col("bucket") == wanted) & (F.col("epoch_store_relpath") == relpath)).orderBy("epoch_store_row")


def read_manifest(spark: SparkSession, path: str, signal: str = "signal") -> DataFrame:
    """The manifest of a store: everything but the samples, which stay unread."""
    return validate_manifest(spark.read.parquet(path).drop(signal, "bucket"))


def validate_manifest(df: DataFrame) -> DataFrame:
    """Required columns present and typed; a value that is not a number fails the query."""
    absent = [c for c in MANIFEST if c not in df.columns]
    if absent:
        raise ValueError(f"manifest columns missing: {absent}")

    def typed(name: str, kind: str) -> Column:
        col = F.col(name)
        if kind == "string":
            return col.cast("string")
        number = col.cast("string").try_cast("double")
        bad = F.raise_error(F.concat(F.lit(f"{name} is not a number: "), F.coalesce(col.cast("string"), F.lit("null")))).cast(kind)
        return F.when(number.isNull(), bad).otherwise(number.cast(kind))

    return df.withColumns({c: typed(c, k) for c, k in MANIFEST.items()})


def stored_stats(manifest: DataFrame) -> DataFrame:
    """Shape and parameters per stored recording."""
    return manifest.groupBy("dataset_id", "recording_id").agg(
        F.count("*").alias("n_epochs"), F.max("samples_per_epoch").alias("samples_per_epoch"), F.max("sample_hz").alias("sample_hz"),
        F.max("epoch_seconds").alias("epoch_seconds"), F.max("store_version").alias("store_version"), F.max("channel_name_used").alias("channel"),
    )


def check_existing_store(expected: DataFrame, manifest: DataFrame, *, force: bool = False) -> DataFrame:
    """Per expected recording: ``missing``, ``match`` or the list of differing fields, and whether it must be written.

    A stored recording that differs is an error to resolve, so it is not written unless forced.
    """
    keys = ["dataset_id", "recording_id"]
    have = stored_stats(manifest).select(*keys, *[F.col(c).alias(f"_{c}") for c in ("n_epochs", "samples_per_epoch", "sample_hz", "epoch_seconds", "store_version", "channel")])
    both = expected.join(have, keys, "left")
    far = lambda a, b: F.abs(F.col(a) - F.col(b)) >= 1e-6
    named = (F.col("channel") != "") & (F.col("_channel") != "")
    tests = {
        "n_epochs": F.col("n_epochs") != F.col("_n_epochs"), "samples_per_epoch": F.col("samples_per_epoch") != F.col("_samples_per_epoch"),
        "sample_hz": far("sample_hz", "_sample_hz"), "epoch_seconds": far("epoch_seconds", "_epoch_seconds"),
        "store_version": F.col("store_version") != F.col("_store_version"), "channel": named & (F.col("channel") != F.col("_channel")),
    }
    wrong = F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))
    missing = F.col("_n_epochs").isNull()
    state = F.when(missing, "missing").when(F.size(wrong) == 0, "match").otherwise(F.array_join(wrong, ","))
    return both.select(*keys, state.alias("state"), (missing | F.lit(force)).alias("to_write"))
