"""Subject profiles, folds without leakage, and subject-wise samples."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.operators.filters import kept_subjects
from nocturne.operators.joins import assign_fold
from nocturne.operators.ordered import Desc, positions
from nocturne.operators.quantiles import exact_quantiles
from nocturne.operators.schema import q


NO_STAGE = "UNK"  # fixed value


def distinct_subjects(df: DataFrame, subject: str, order: list[str]) -> DataFrame:
    """Subjects with the order value of their first row."""
    return df.groupBy(q(subject)).agg(F.min(F.struct(*[q(c) for c in order])).alias("_first")).select(subject, "_first.*")


def dominant_labels(df: DataFrame, subject: str, label: str) -> DataFrame:
    """(subject, n_rows, dominant): the most frequent label, the smallest on ties, null if there is none."""
    counts = df.groupBy(q(subject), q(label).cast("string").alias("_l")).agg(F.count("*").alias("_k"))
    known = F.when(F.col("_l").isNotNull(), F.struct(-F.col("_k"), F.col("_l")))
    return counts.groupBy(subject).agg(F.sum("_k").alias("n_rows"), F.min_by("_l", known).alias("dominant"))


def _deal(subjects: DataFrame, subject: str, strata: list[str], k: int, seed: int | None) -> DataFrame:
    """Deal subjects into folds back and forth, largest first, separately per stratum.

    Without a seed equal sizes go by subject; with one they go by hash.
    """
    rows, by = subjects, [Desc("n_rows"), subject]
    if seed is not None:
        rows, by = subjects.withColumn("_h", F.xxhash64(F.lit(seed), q(subject))), [Desc("n_rows"), "_h", subject]
    placed = positions(rows, strata, by, "_pos")
    step = F.col("_pos") % (2 * k)
    fold = F.when(step < k, step).otherwise(2 * k - 1 - step)
    if strata and seed is not None:
        fold = F.pmod(fold + F.xxhash64(F.lit(seed), *[q(s) for s in strata]), F.lit(k))
    return placed.select(subject, *strata, "n_rows", fold.cast("int").alias("fold"))


def stratified_group_folds(df: DataFrame, subject: str, label: str, k: int, seed: int | None = 42) -> DataFrame:
    """(subject, dominant, n_rows, fold): each subject in one fold, each label's subjects spread over all folds."""
    return _deal(dominant_labels(df, subject, label), subject, ["dominant"], k, seed)


def group_folds(df: DataFrame, subject: str, k: int) -> DataFrame:
    """(subject, n_rows, fold) with balanced fold sizes, without labels."""
    sizes = df.groupBy(q(subject)).agg(F.count("*").alias("n_rows"))
    return _deal(sizes, subject, [], k, None)


def subject_profiles(df: DataFrame, subject: str, stage: str = "sleep_stage", apnea: str = "apnea_binary") -> DataFrame:
    """Apnea rate, dominant stage, size, quantile bin of the rate and a composite label per subject."""
    rate = F.coalesce(F.avg(q(apnea).cast("string").try_cast("double")), F.lit(0.0))
    base = df.groupBy(q(subject)).agg(rate.alias("apnea_rate"))
    dom = dominant_labels(df, subject, stage)
    out = base.join(dom, subject).withColumn("dominant_stage", F.coalesce("dominant", F.lit(NO_STAGE))).drop("dominant")
    rates = out.select("apnea_rate")
    distinct = rates.distinct().limit(3).count()
    bin_name = F.lit("all")
    if distinct > 1:
        n = min(3, distinct)
        edges = sorted(set(exact_quantiles(rates, ["apnea_rate"], [i / n for i in range(n + 1)])["apnea_rate"]))
        bin_name = F.lit(f"q{len(edges) - 2}")
        for i in range(len(edges) - 3, -1, -1):
            bin_name = F.when(F.col("apnea_rate") <= edges[i + 1], f"q{i}").otherwise(bin_name)
    return out.withColumn("apnea_bin", bin_name).withColumn("composite_label", F.concat_ws("__", "apnea_bin", "dominant_stage"))


# Names of the strategies.
STRATEGIES = (("composite_subject_stratified", "composite_label"), ("apnea_bin_only", "apnea_bin"), ("dominant_stage_only", "dominant_stage"))


def smallest_strata(profiles: DataFrame) -> DataFrame:
    """(strategy, smallest): subjects in the rarest class of each candidate label."""
    parts = [profiles.groupBy(c).count().agg(F.min("count").alias("smallest")).select(F.lit(s).alias("strategy"), "smallest") for s, c in STRATEGIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def best_stratify_label(profiles: DataFrame, n_splits: int) -> str:
    small = {r["strategy"]: r["smallest"] for r in smallest_strata(profiles).collect()}
    return next((s for s, _ in STRATEGIES if (small[s] or 0) >= n_splits), "group_only")


def shared_folds(df: DataFrame, subject: str, k: int, stage: str = "sleep_stage", apnea: str = "apnea_binary", seed: int | None = 42) -> DataFrame:
    """(subject, fold, fold_strategy_used): one fold table for both tasks."""
    profiles = subject_profiles(df, subject, stage, apnea)
    strategy = best_stratify_label(profiles, k)
    strata = [c for s, c in STRATEGIES if s == strategy]
    dealt = _deal(profiles.select(subject, *strata, "n_rows"), subject, strata, k, seed if strata else None)
    return dealt.select(subject, "fold", F.lit(strategy).alias("fold_strategy_used"))


def with_shared_folds(df: DataFrame, subject: str, k: int, **kw) -> DataFrame:
    return assign_fold(df, shared_folds(df, subject, k, **kw), subject)


def subsample_with_coverage(df: DataFrame, subject: str, label: str, fraction: float = 0.25, min_subjects: int = 32, inner_splits: int = 3, seed: int | None = 42) -> DataFrame:
    """A share of whole subjects, enlarged in draw order until every label is covered.

    The draw rank of the last label to appear says how far to go, so no loop is needed.
    """
    key = q(subject).cast("string")
    ids = df.select(key.alias("_s")).dropna().distinct()
    n = ids.count()
    goal = min(n, max(inner_splits, min_subjects, math.ceil(n * fraction)))
    if goal >= n:
        return df
    ids = ids.withColumn("_h", F.xxhash64(F.lit(seed), "_s") if seed is not None else F.col("_s").try_cast("bigint"))
    ranked = positions(ids, [], ["_h", "_s"], "_rank").select("_s", "_rank")
    rows = df.join(ranked, key == F.col("_s"))
    first = rows.filter(q(label).isNotNull()).groupBy(q(label)).agg(F.min("_rank").alias("r"))
    need = first.agg(F.max("r")).first()[0]
    last = max(goal - 1, need if need is not None else -1)
    if last + 1 < inner_splits:
        return df
    return rows.filter(F.col("_rank") <= last).select(*df.columns)


def train_val_split(df: DataFrame, subject: str, fraction: float, seed: int = 42) -> DataFrame:
    """Adds ``part``: whole subjects to ``val``, at least one and never all; the rest to ``train``."""
    n = df.select(q(subject)).dropna().distinct().count()
    if n <= 1 or fraction <= 0:
        return df.withColumn("part", F.lit("train"))
    n_val = min(max(round(n * fraction), 1), n - 1)
    val = kept_subjects(df, subject, lambda rank, _: rank < n_val, seed)
    joined = df.join(val, q(subject).cast("string") == F.col("_subject"), "left")
    return joined.select(*df.columns, F.when(F.col("_subject").isNotNull(), "val").otherwise("train").alias("part"))
