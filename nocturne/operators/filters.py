"""Row filters and the checks that guard a fit."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.functions.labels import normalize_stage_label
from nocturne.functions.text import STAGE_TOKENS
from nocturne.operators.ordered import positions, ranged_positions
from nocturne.operators.schema import q


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def drop_target_missing(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[f"`{target}`" if "." in target else target])


def deduplicate(df: DataFrame, subset: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Whole-row duplicates, or the first row in ``order`` per key.

    The keyed form keeps the row with the smallest order inside the aggregation,
    so a key shared by many rows is reduced before the shuffle.
    """
    if not subset:
        return df.dropDuplicates()
    if not order:
        raise ValueError("keeping the first row needs order columns")
    row = F.struct(*[q(c) for c in df.columns])
    return df.groupBy(*[q(c) for c in subset]).agg(F.min_by(row, F.struct(*[q(c) for c in order])).alias("_row")).select("_row.*")


def label_subset(df: DataFrame, target: str, labels: list[str]) -> DataFrame:
    out = df.filter(q(target).cast("string").isin(*labels))
    if out.isEmpty():
        raise ValueError(f"no row of {target!r} has a label in {sorted(labels)}")
    return out


def binary_target_violations(df: DataFrame, target: str, *, training: bool = True, relaxed: bool = False) -> DataFrame:
    """One row per broken rule (rule, count); empty when the target is usable."""
    t = q(target)
    text = t.cast("string")
    if isinstance(df.schema[target].dataType, T.StringType):
        ok = F.trim(text).isin("0", "1")
    else:
        ok = t.cast("double").isin(0.0, 1.0)
    stats = df.agg(
        F.count(t).alias("n"), F.count_distinct(t).alias("k"), F.count_if(t.isNotNull() & ~ok).alias("bad"),
    )
    rules = [F.struct(F.lit("empty").alias("rule"), F.when(F.col("n") == 0, F.lit(0).cast("bigint")).alias("found"))]
    if training:
        rules.append(F.struct(F.lit("single_class").alias("rule"), F.when((F.col("n") > 0) & (F.col("k") < 2), F.col("k")).alias("found")))
    if relaxed:
        rules.append(F.struct(F.lit("too_many_classes").alias("rule"), F.when(F.col("k") > 2, F.col("k")).alias("found")))
    else:
        rules.append(F.struct(F.lit("not_zero_one").alias("rule"), F.when(F.col("bad") > 0, F.col("bad")).alias("found")))
    return stats.select(F.explode(F.array(*rules)).alias("v")).select("v.*").filter(F.col("found").isNotNull())


def validate_binary_target(df: DataFrame, target: str, **kw) -> DataFrame:
    found = binary_target_violations(df, target, **kw).collect()
    if found:
        raise ValueError(f"target {target!r}: " + ", ".join(f"{r['rule']} ({r['found']})" for r in found))
    return df


def subject_count(df: DataFrame, subject: str) -> DataFrame:
    return df.agg(F.count_distinct(q(subject).cast("string")).alias("n_subjects"))


def validate_cv_ready(df: DataFrame, subject: str, n_splits: int) -> DataFrame:
    n = subject_count(df, subject).first()[0]
    if n < n_splits:
        raise ValueError(f"{n_splits} folds need as many subjects, found {n}")
    return df


def unseen_labels(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    known = train.select(q(target).cast("string").alias("label")).distinct()
    return test.select(q(target).cast("string").alias("label")).distinct().join(known, "label", "left_anti").filter("label is not null")


def wake_trim(df: DataFrame, recording: str, order: list[str], stage: str = "sleep_stage", minutes: int = 30, epoch_sec: float = 30.0) -> DataFrame:
    """Keep each recording from a margin before its first non-wake epoch to a margin after its last."""
    margin = int(minutes * 60 / epoch_sec)
    rows = ranged_positions(df, [recording], order, "_pos")
    placed = rows.frame
    awake = F.when(~q(stage).eqNullSafe("W"), F.col("_pos"))
    span = placed.groupBy(recording).agg(F.min(awake).alias("_a"), F.max(awake).alias("_b"), F.count("*").alias("_n"))
    span = span.withColumns({"_lo": F.greatest(F.col("_a") - margin, F.lit(0)), "_hi": F.least(F.col("_b") + margin, F.col("_n") - 1)})
    whole = F.col("_a").isNull()
    kept = rows.attach(placed, span, "inner").filter(whole | F.col("_pos").between(F.col("_lo"), F.col("_hi")))
    return kept.select(
        *df.columns,
        F.when(~whole, F.col("_n")).alias("recording_epochs_before_trim"),
        F.when(~whole, F.col("_hi") - F.col("_lo") + 1).alias("recording_epochs_after_trim"),
        F.when(~whole, F.lit(minutes)).alias("wake_trim_minutes"),
    )


def task_rows(df: DataFrame, mask: str) -> DataFrame:
    out = df.filter(q(mask).cast("int") > 0)
    if out.isEmpty():
        raise ValueError(f"no rows with {mask!r} set")
    return out


def kept_subjects(df: DataFrame, subject: str, keep, seed: int = 42) -> DataFrame:
    """Subjects in hash order whose position passes ``keep(position, n_subjects)``."""
    ids = df.select(q(subject).cast("string").alias("_subject")).filter("_subject is not null").distinct()
    ids = ids.withColumn("_hash", F.xxhash64(F.lit(seed), F.col("_subject")))
    n = ids.count()
    placed = positions(ids, [], ["_hash", "_subject"], "_rank")
    return placed.filter(keep(F.col("_rank"), n)).select("_subject")


def subject_fraction(df: DataFrame, subject: str, fraction: float, seed: int = 42) -> DataFrame:
    """A seeded share of whole subjects, at least one."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must lie in (0, 1]")
    if fraction == 1:
        return df
    chosen = kept_subjects(df, subject, lambda rank, n: rank < max(1, math.floor(n * fraction)), seed)
    return df.join(chosen, q(subject).cast("string") == F.col("_subject"), "left_semi")


def sequence_metadata(df: DataFrame, target: str, subject: str, recording: str, order: str, labels: list[str] | None = None, fraction: float = 1.0, seed: int = 42, extra: tuple = ("source_file",)) -> DataFrame:
    """Rows ready for sequence windows: known labels, complete keys, chosen labels and subjects."""
    out = df.withColumn(target, normalize_stage_label(q(target))) if target == "sleep_stage" else df
    out = out.dropna(subset=[target, subject, recording, order, *extra])
    if labels:
        out = label_subset(out, target, labels)
    out = subject_fraction(out, subject, fraction, seed)
    if out.isEmpty():
        raise ValueError("no row is left for sequence windows")
    return out


def with_routes(df: DataFrame, stage: str = "stage", events: str = "tokens") -> DataFrame:
    """Add ``in_stage`` (the stage token is known) and ``in_event`` (there are event tokens); a row may be both."""
    return df.withColumns({"in_stage": q(stage).isin(*STAGE_TOKENS), "in_event": q(events) != ""})


def route_rows(df: DataFrame, stage: str = "stage", events: str = "tokens", out: str = "target") -> DataFrame:
    """One row per table a row goes to: ``stage``, ``event``, both, or ``skipped``."""
    told = with_routes(df, stage, events)
    goals = F.array(F.when(F.col("in_stage"), "stage"), F.when(F.col("in_event"), "event"), F.when(~F.col("in_stage") & ~F.col("in_event"), "skipped"))
    return told.select(*[q(c) for c in df.columns], F.explode(F.array_compact(goals)).alias(out))
