"""Summaries over folds, models and experiments, and bootstrap intervals."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nocturne.operators.metrics import auc_roc
from nocturne.operators.ordered import join_on, positions
from nocturne.operators.schema import q

NO_VALUE = "N/D"  # fixed value


def _long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(m).alias("metric"), q(m).cast("string").try_cast("double").alias("value")) for m in metrics]
    return df.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*").filter("value is not null")


def fold_metrics_summary(df: DataFrame, metrics: list[str], keys=("model",)) -> DataFrame:
    """Mean and sample deviation per model and metric, 0 for a single fold."""
    keys = list(keys)
    return _long(df, keys, metrics).groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("n"))


def best_params_summary(df: DataFrame, keys=("model",), params: str = "params", score: str = "inner_score") -> DataFrame:
    """Folds, the most frequent parameters (smallest text on ties), their count, and the inner scores."""
    keys = list(keys)
    per = df.groupBy(*keys, q(params).alias("_p")).agg(F.count("*").alias("_k"))
    top = per.groupBy(*keys).agg(F.sum("_k").alias("n_folds"), F.min_by("_p", F.struct(-F.col("_k"), "_p")).alias("params"), F.max("_k").alias("params_count"))
    scores = df.groupBy(*keys).agg(F.avg(score).alias("score_mean"), F.coalesce(F.stddev_samp(score), F.when(F.count(score) > 0, 0.0)).alias("score_std"))
    return join_on(top, scores, keys)


def experiment_summary(within: DataFrame, cross: DataFrame, metrics: list[str]) -> DataFrame:
    """Within-dataset fold means and deviations with single cross-dataset values in one wide table."""
    keys = ["experiment", "model"]
    aggs = []
    for m in metrics:
        aggs += [F.avg(q(m)).alias(f"{m}_mean"), F.when(F.count(q(m)) > 0, F.coalesce(F.stddev_samp(q(m)), F.lit(0.0))).alias(f"{m}_std")]
    a = within.groupBy(*keys).agg(*aggs).select(*keys, F.lit("within").alias("kind"), *[c for m in metrics for c in (f"{m}_mean", f"{m}_std")])
    single = [c for m in metrics for c in (q(m).cast("double").alias(f"{m}_mean"), F.lit(None).cast("double").alias(f"{m}_std"))]
    return a.unionByName(cross.select(*keys, F.lit("cross").alias("kind"), *single))


def _three(col: Column) -> Column:
    return F.coalesce(F.format_string("%.3f", F.bround(col.cast("double"), 3)), F.lit(NO_VALUE))


def metric_by_model(summary: DataFrame, models: list[str], rows: str = "metric") -> DataFrame:
    """One row per metric (or class), one ``mean ± std`` text column per model."""
    text = F.concat(_three(F.col("mean")), F.lit(" ± "), _three(F.col("std")))
    wide = summary.groupBy(rows).pivot("model", models).agg(F.max(text))
    return wide.select(rows, *[F.coalesce(q(m), F.lit(NO_VALUE)).alias(m) for m in models])


def direction_table(df: DataFrame, metrics: list[str], keys=("direction", "model")) -> DataFrame:
    """Cross-dataset values per direction and model as three-decimal text."""
    return df.select(*keys, *[_three(q(m)).alias(m) for m in metrics])


def bootstrap_mean_ci(df: DataFrame, keys: list[str], value: str, order: list[str], n_boot: int = 5000, seed: int = 42) -> DataFrame:
    """Mean and percentile interval of resampled means; one value gives a point.

    Draws are hashed positions, joined to the values by position, averaged per resample.
    """
    vals = df.filter(q(value).isNotNull())
    placed = positions(vals.select(*keys, q(value).cast("double").alias("_v"), *[q(c) for c in order if c not in keys]), keys, order, "_pos")
    sizes = vals.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(q(value).cast("double")).alias("mean"))
    rep = sizes.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    # The draws of one resample are made in rows of at most 10 000, then spread.
    step = 10_000
    rep = rep.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(step).cast("bigint"))))
    draws = rep.withColumn("_j", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + step, F.col("n")) - 1)))
    draws = draws.select(*keys, "_b", F.pmod(F.xxhash64(F.lit(seed), *[q(k) for k in keys], "_b", "_j"), F.col("n")).alias("_pos"))
    hits = draws.groupBy(*keys, "_b", "_pos").agg(F.count("*").alias("_w"))
    means = join_on(hits, placed, [*keys, "_pos"], "inner").groupBy(*keys, "_b").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("m"))
    ci = means.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    out = join_on(sizes, ci, keys)
    return out.select(*keys, "n", "mean", F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))


BLOCK_ROWS = 20_000
REPLICATES_PER_CHUNK = 250


def _blocks(cells: DataFrame, score: str, block_rows: int) -> DataFrame:
    """Score ranges of bounded size; a score with many cells is a range of its own, cut by hash."""
    n = cells.count()
    parts = max(1, -(-n // block_rows))
    cuts = cells.approxQuantile(score, [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    heavy = [r[0] for r in cells.groupBy(score).count().filter(F.col("count") > block_rows).select(score).collect()]
    inner = sorted({*cuts, *heavy, *[float(np.nextafter(h, np.inf)) for h in heavy]})
    splits = [float("-inf"), *inner, float("inf")]
    out = Bucketizer(splits=splits, inputCol=score, outputCol="block").transform(cells) if inner else cells.withColumn("block", F.lit(0.0))
    tied = F.col(score).isin(*heavy) if heavy else F.lit(False)
    salt = F.when(tied, F.pmod(F.xxhash64("y", "sa", "sb"), F.lit(max(1, parts)))).otherwise(0)
    return out.withColumns({"tied": tied, "salt": salt.cast("int")})


BLOCK_SUMS = "block double, tied boolean, replicate int, pos double, neg double, won double"


def _scrambled(x: np.ndarray) -> np.ndarray:
    """64-bit numbers as evenly spread ones."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _poisson_weights(cells: np.ndarray, times: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """A Poisson draw with mean ``times`` per cell and replicate: hashed uniform numbers, looked up in the distribution's table."""
    base = _scrambled(cells ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    u = (_scrambled(base[:, None] + replicates[None, :].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
    out = np.empty(u.shape)
    for mean in np.unique(times):
        rows = times == mean
        most = int(mean + 12 * mean**0.5 + 20)
        logs = np.arange(most) * np.log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, most)))))
        out[rows] = np.searchsorted(np.cumsum(np.exp(logs)), u[rows], "right")
    return out


def _block_sums(score: str, n_boot: int, seed: int):
    """Per resample: weighted positives, negatives and won pairs inside one block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, "cell"])
        y, s = pdf["y"].to_numpy() == 1, pdf[score].to_numpy()
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        cells, times = pdf["cell"].to_numpy().astype(np.uint64), pdf["times"].to_numpy()
        out = []
        for lo in range(0, n_boot, REPLICATES_PER_CHUNK):
            k = min(REPLICATES_PER_CHUNK, n_boot - lo)
            w = _poisson_weights(cells, times, np.arange(lo, lo + k), seed)
            pos, neg = np.add.reduceat(w * y[:, None], starts), np.add.reduceat(w * ~y[:, None], starts)
            won = (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0)
            out.append(pd.DataFrame({"replicate": np.arange(lo, lo + k), "pos": pos.sum(axis=0), "neg": neg.sum(axis=0), "won": won}))
        res = pd.concat(out)
        res["block"], res["tied"] = pdf["block"].iloc[0], pdf["tied"].iloc[0]
        return res[["block", "tied", "replicate", "pos", "neg", "won"]]

    return run


def _replicate_aucs(cells: DataFrame, score: str, n_boot: int, seed: int, block_rows: int, out: str) -> DataFrame:
    sums = _blocks(cells, score, block_rows).groupBy("block", "salt").applyInPandas(_block_sums(score, n_boot, seed), BLOCK_SUMS)
    per = sums.groupBy("replicate", "block").agg(F.max("tied").alias("tied"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
    before = Window.partitionBy("replicate").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.when(F.col("tied"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("won"))
    pairs = per.withColumn("won", inside + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    total = F.sum("pos") * F.sum("neg")
    return pairs.groupBy("replicate").agg((F.sum("won") / F.nullif(total, F.lit(0.0))).alias(out))


def bootstrap_auc_diff(df: DataFrame, y_true: str, score_a: str, score_b: str, n_boot: int = 5000, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Area difference of two models on the same rows with a percentile interval of paired resamples.

    Equal (truth, score, score) rows form one cell whose Poisson resample weight
    depends only on the cell and the replicate, so both models see the same
    resample.  Cells are cut into score ranges; a range yields its inner pairs
    and its totals, and totals of lower ranges give the rest.
    """
    num = lambda c: q(c).cast("string").try_cast("double")
    rows = df.select(num(y_true).alias("y"), num(score_a).alias("sa"), num(score_b).alias("sb")).dropna()
    cells = rows.groupBy("y", "sa", "sb").agg(F.count("*").alias("times")).withColumn("cell", F.xxhash64("y", "sa", "sb"))
    a = _replicate_aucs(cells, "sa", n_boot, seed, block_rows, "a")
    b = _replicate_aucs(cells, "sb", n_boot, seed, block_rows, "b")
    ci = a.join(b, "replicate").agg(F.percentile(F.col("a") - F.col("b"), F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    base_a, base_b = auc_roc(rows, [], "y", "sa", "a"), auc_roc(rows, [], "y", "sb", "b")
    # Three tables of one row each become one row by a union, not a join.
    rows = base_a.unionByName(base_b, allowMissingColumns=True).unionByName(ci, allowMissingColumns=True)
    one = rows.agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("p").alias("p"))
    return one.select((F.col("a") - F.col("b")).alias("auc_diff"), F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))
