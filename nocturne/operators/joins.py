"""Flags, alignments and set operations between tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.operators.ordered import join_on, running
from nocturne.operators.schema import q


def flag_by_key(df: DataFrame, events: DataFrame, keys: list[str], out: str = "flag") -> DataFrame:
    """1 where the key occurs among the events; the event keys are made distinct first, so rows never multiply."""
    seen = events.select(*[q(k) for k in keys]).dropna().distinct().withColumn("_seen", F.lit(1))
    return df.join(seen, keys, "left").select(*[df[f"`{c}`"] if c not in keys else q(c) for c in df.columns], F.coalesce("_seen", F.lit(0)).alias(out))


def flag_by_overlap(epochs: DataFrame, events: DataFrame, recording: str, start: str, end: str, event_start: str, event_end: str, out: str = "flag") -> DataFrame:
    """1 where some event of the recording has ``event_start < end and event_end > start``.

    Epochs (at their end) and events (at their start) are merged in time order;
    the running maximum of event ends, taken over events that started strictly
    before the epoch's end, exceeds the epoch's start exactly when one overlaps.
    Long events and crowded times cost nothing extra, and no pairs are formed.
    """
    a = epochs.select("*", q(end).cast("double").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_stop"))
    b = events.select(q(recording), q(event_start).cast("double").alias("_t"), F.lit(1).alias("_kind"), q(event_end).cast("double").alias("_stop"))
    merged = a.unionByName(b.filter(F.col("_t").isNotNull() & F.col("_stop").isNotNull()), allowMissingColumns=True)
    seen = running(merged, [recording], ["_t", "_kind"], maxes={"_reach": F.col("_stop")})
    hit = F.coalesce(F.col("_reach") > q(start), F.lit(False))
    return seen.filter("_kind = 0").select(*epochs.columns, hit.cast("int").alias(out))


def align_predictions(a: DataFrame, b: DataFrame, keys=("fold_id", "row_id")) -> DataFrame:
    """Two models' predictions side by side; differing truths fail the query."""
    def tagged(df, tag):
        return df.select(*keys, *[q(c).alias(f"{c}_{tag}") for c in df.columns if c not in keys])

    joined = tagged(a, "a").join(tagged(b, "b"), list(keys))
    same = F.col("y_true_a").cast("string").eqNullSafe(F.col("y_true_b").cast("string"))
    checked = F.when(same, F.col("y_true_a")).otherwise(F.raise_error(F.lit("truth differs between the models")).cast(joined.schema["y_true_a"].dataType))
    return joined.withColumn("y_true_a", checked)


def alignment_mismatches(a: DataFrame, b: DataFrame, keys=("fold_id", "row_id")) -> DataFrame:
    x = a.select(*keys, F.col("y_true").cast("string").alias("ya"))
    y = b.select(*keys, F.col("y_true").cast("string").alias("yb"))
    return x.join(y, list(keys)).agg(F.count("*").alias("n_rows"), F.count_if(~F.col("ya").eqNullSafe(F.col("yb"))).alias("n_mismatch"))


def assign_fold(df: DataFrame, folds: DataFrame, subject: str, fold: str = "fold") -> DataFrame:
    """Subject folds onto rows; a subject without a fold fails the query."""
    extra = [c for c in folds.columns if c != subject]
    joined = join_on(df, folds.select(subject, *extra), [subject])
    return joined.withColumn(fold, F.coalesce(q(fold), F.raise_error(F.lit("subject without a fold")).cast("int")))


def gap_vs_baseline(df: DataFrame, baseline: Column, selected: Column, metrics: dict[str, str]) -> DataFrame:
    """Metric differences to one baseline row on the selected rows, null elsewhere."""
    row = df.filter(baseline).select(*[q(c).cast("double") for c in metrics.values()]).first()
    gaps = {name: F.when(selected, q(c).cast("double") - F.lit(row[i])) if row else F.lit(None).cast("double") for i, (name, c) in enumerate(metrics.items())}
    return df.withColumns(gaps)


def pending_work(wanted: DataFrame, metrics: DataFrame, artifacts: DataFrame, keys=("model", "fold")) -> DataFrame:
    """Wanted (model, fold) pairs that lack a metric row or an artifact."""
    keys = list(keys)
    done = metrics.select(*keys).distinct().join(artifacts.select(*keys).distinct(), keys, "left_semi")
    return wanted.join(done, keys, "left_anti")


def union_corpora(*tables: DataFrame) -> DataFrame:
    """Rows of all corpora by column name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def before_after_compare(raw: DataFrame, processed: DataFrame, target_raw: str, target_processed: str) -> DataFrame:
    """Counts per target value in both tables, with table sizes and whether the balance changed."""
    def counts(df, t, out):
        return df.groupBy(F.coalesce(q(t).cast("string"), F.lit("<MISSING>")).alias("label")).agg(F.count("*").alias(out))

    both = counts(raw, target_raw, "raw_count").join(counts(processed, target_processed, "prep_count"), "label", "full")
    both = both.select("label", F.coalesce("raw_count", F.lit(0)).alias("raw_count"), F.coalesce("prep_count", F.lit(0)).alias("prep_count"))
    total = both.agg(F.sum("raw_count").alias("r"), F.sum("prep_count").alias("p"), F.bool_or(F.col("raw_count") != F.col("prep_count")).alias("d")).first()
    return both.select(
        "label", "raw_count", "prep_count", F.lit(total["r"] or 0).cast("bigint").alias("raw_rows"), F.lit(len(raw.columns)).alias("raw_cols"),
        F.lit(total["p"] or 0).cast("bigint").alias("prep_rows"), F.lit(len(processed.columns)).alias("prep_cols"), F.lit(bool(total["d"])).alias("balance_changed"),
    )
