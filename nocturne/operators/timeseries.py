"""Epoching, windows and context."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.operators.ordered import moved, positions, ranged_positions, running, shifted
from nocturne.operators.schema import q


def expand_intervals(df: DataFrame, recording: str, order: list[str], *, onset: str = "onset", duration: str = "duration", label: Column, fs: Column, signal_len: Column, epoch_sec: float = 30.0) -> DataFrame:
    """Annotations to whole epochs; unmapped labels and epochs past the signal end are left out of the numbering."""
    n = F.floor(q(duration) / epoch_sec).cast("int")
    rows = df.withColumn("_label", label).filter(F.col("_label").isNotNull() & (n > 0))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1)))
    start = q(onset) + F.col("_i") * epoch_sec
    rows = rows.withColumns({
        "epoch_start_sec": start,
        "epoch_end_sec": start + epoch_sec,
        "epoch_start_sample": F.bround(start * fs).cast("bigint"),
        "epoch_end_sample": F.bround((start + epoch_sec) * fs).cast("bigint"),
        "_len": signal_len,
    }).filter((F.col("epoch_end_sample") <= F.col("_len")) & (F.col("epoch_start_sample") < F.col("epoch_end_sample")))
    placed = positions(rows, [recording], [*order, "_i"], "epoch_index")
    return placed.select(recording, "epoch_index", "epoch_start_sample", "epoch_end_sample", "epoch_start_sec", "epoch_end_sec", F.col("_label").alias("sleep_stage"))


def segments_to_next(df: DataFrame, recording: str, order: list[str], sample: str, signal_len: Column, fs: Column) -> DataFrame:
    """Each annotation lasts until the next one of its recording, the last until the record end."""
    out = shifted(df, [recording], order, {"_next": (sample, 1)})
    end = F.coalesce(F.col("_next"), signal_len).cast("bigint")
    return out.select(
        *df.columns, q(sample).alias("epoch_start_sample"), end.alias("epoch_end_sample"),
        (q(sample) / fs).alias("epoch_start_sec"), (end / fs).alias("epoch_end_sec"),
    )


def epochs_ending_at(df: DataFrame, sample: str, fs: Column, epoch_sec: float = 30.0) -> DataFrame:
    """The epoch before each annotation sample, clamped at the record start."""
    start = F.greatest(q(sample) - F.bround(epoch_sec * fs).cast("bigint"), F.lit(0))
    return df.withColumns({
        "epoch_start_sample": start, "epoch_end_sample": q(sample),
        "epoch_start_sec": start / fs, "epoch_end_sec": q(sample) / fs,
    })


def align_to_grid(df: DataFrame, sample: str, fs: Column, signal_len: Column, epoch_sec: float = 30.0) -> DataFrame:
    """The fixed grid window holding each sample, clamped to the record; ``skipped`` marks empty windows."""
    width = (F.lit(epoch_sec) * fs).cast("bigint")
    start = F.floor(q(sample) / width) * width
    end = F.least(start + width, signal_len)
    return df.withColumns({
        "event_center_sample": q(sample), "epoch_start_sample": start, "epoch_end_sample": end,
        "epoch_start_sec": start / fs, "epoch_end_sec": end / fs, "skipped": start >= end,
    })


def attach_samples(samples: DataFrame, epochs: DataFrame, keys: list[str], width: int, idx: str = "sample_idx") -> DataFrame:
    """Samples with the epoch they fall in: an equi-join on (recording, bucket), range checked again."""
    buckets = F.sequence(F.floor(F.col("epoch_start_sample") / width), F.floor(F.greatest(F.col("epoch_end_sample") - 1, F.col("epoch_start_sample")) / width))
    e = epochs.withColumn("_bucket", F.explode(buckets))
    s = samples.withColumn("_bucket", F.floor(q(idx) / width))
    hit = (q(idx) >= F.col("epoch_start_sample")) & (q(idx) < F.col("epoch_end_sample"))
    return s.join(e, [*keys, "_bucket"]).filter(hit).drop("_bucket")


def slice_channel_stats(samples: DataFrame, epochs: DataFrame, channels: dict[str, str], keys: list[str], epoch_key: str = "epoch_index", width: int = 3000, value: str = "value") -> DataFrame:
    """Mean and population deviation of the finite samples per epoch and channel, one column pair per channel.

    ``channels`` maps the channel value to its column stem.  Epochs without samples keep nulls.
    """
    x = q(value).cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    hits = attach_samples(samples.filter(ok), epochs.select(*keys, epoch_key, "epoch_start_sample", "epoch_end_sample"), keys, width)
    aggs = []
    for name, stem in channels.items():
        v = F.when(F.col("channel").cast("string") == str(name), x)
        aggs += [F.avg(v).alias(f"{stem}_mean"), F.stddev_pop(v).alias(f"{stem}_std")]
    return epochs.join(hits.groupBy(*keys, epoch_key).agg(*aggs), [*keys, epoch_key], "left")


def temporal_context(df: DataFrame, recording: str, order: str, features: list[str], lags=(1, 2), leads=(1, 2)) -> DataFrame:
    """Earlier and later values of each feature; at the edges the recording's first or last non-null value."""
    steps = [("lag", -k) for k in sorted(set(lags)) if k > 0] + [("lead", k) for k in sorted(set(leads)) if k > 0]
    wanted = {f"{c}_{way}{abs(k)}": (c, k) for way, k in steps for c in features}
    edges = []
    for c in features:
        at = F.when(q(c).isNotNull(), q(order))
        edges += [F.min_by(q(c), at).alias(f"_f_{c}"), F.max_by(q(c), at).alias(f"_l_{c}")]
    placed = ranged_positions(df, [recording], [order], "_pos")
    filled = placed.attach(moved(placed.frame, [recording], wanted), df.groupBy(recording).agg(*edges))
    fill = [F.coalesce(q(n), q(f"_f_{c}" if k < 0 else f"_l_{c}")).alias(n) for n, (c, k) in wanted.items()]
    return filled.select(*df.columns, *fill)


def sequence_index(df: DataFrame, recording: str, order: list[str], length: int) -> DataFrame:
    """Per epoch its row number in (recording, order) and a centred window of row numbers clamped to the recording."""
    if length <= 0 or length % 2 == 0:
        raise ValueError("the window length must be positive and odd")
    half = length // 2
    sizes = df.groupBy(recording).agg(F.count("*").alias("_n"))
    base = running(sizes, [], [recording], sums={"_end": F.col("_n")})
    rows = ranged_positions(df, [recording], order, "_pos")
    placed = rows.attach(rows.frame, base)
    first = F.col("_end") - F.col("_n")
    window = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda d: first + F.least(F.greatest(F.col("_pos") + d, F.lit(0)), F.col("_n") - 1))
    return placed.select(*df.columns, (first + F.col("_pos")).alias("row_index"), window.alias("window"))


def recording_batches(df: DataFrame, recording: str, order: list[str], batch_size: int, *, drop_last: bool = False, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """Batches that never mix recordings; shuffling draws the order inside and between them from hashes."""
    if batch_size <= 0:
        raise ValueError("the batch size must be positive")
    data, by = df, order
    if shuffle:
        data = df.withColumn("_draw", F.xxhash64(F.lit(seed), q(recording), *[q(c) for c in order]))
        by = ["_draw", *order]
    rows = ranged_positions(data, [recording], by, "_pos")
    placed = rows.frame.withColumn("batch_id", F.floor(F.col("_pos") / batch_size))
    if drop_last:
        sizes = df.groupBy(recording).agg(F.count("*").alias("_n"))
        placed = rows.attach(placed, sizes).filter((F.col("batch_id") + 1) * batch_size <= F.col("_n"))
    rank = F.xxhash64(F.lit(seed), q(recording), F.col("batch_id")) if shuffle else F.col("batch_id")
    return placed.select(*df.columns, "batch_id", (F.col("_pos") % batch_size).alias("slot"), rank.alias("batch_order"))


def batch_count(df: DataFrame, recording: str, batch_size: int, drop_last: bool = False) -> DataFrame:
    """Number of batches over all recordings."""
    n = df.groupBy(recording).agg(F.count("*").alias("n"))
    per = F.floor(F.col("n") / batch_size) if drop_last else F.ceil(F.col("n") / batch_size)
    return n.agg(F.sum(per).alias("n_batches"))
