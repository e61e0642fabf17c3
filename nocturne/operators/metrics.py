"""Evaluation from prediction tables, for any grouping keys."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.operators.ordered import Desc, join_on, running
from nocturne.operators.schema import q


def _keyed(df: DataFrame, keys: list[str]):
    """A constant key stands in when there is none, so every step is a grouped one."""
    return (df, keys, []) if keys else (df.withColumn("_all", F.lit(1)), ["_all"], ["_all"])


def label_marginals(df: DataFrame, keys: list[str], y_true: str, y_pred: str) -> DataFrame:
    """Per key and label: hits, true rows and predicted rows."""
    cells = df.groupBy(*keys, q(y_true).cast("string").alias("_t"), q(y_pred).cast("string").alias("_p")).agg(F.count("*").alias("_n"))
    hit = F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("_t").alias("label"), hit.alias("tp"), F.col("_n").alias("nt"), F.lit(0).cast("bigint").alias("np")),
        F.struct(F.col("_p").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("nt"), F.col("_n").alias("np")),
    )
    flat = cells.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    return flat.groupBy(*keys, "label").agg(F.sum("tp").alias("tp"), F.sum("nt").alias("nt"), F.sum("np").alias("np"))


def _f1() -> Column:
    return F.coalesce(2.0 * F.col("tp") / F.nullif(F.col("nt") + F.col("np"), F.lit(0)), F.lit(0.0))


def per_class_f1(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return label_marginals(df, keys, y_true, y_pred).select(*keys, "label", _f1().alias("f1"))


def multiclass_metrics(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred", labels: list[str] | None = None) -> DataFrame:
    """Accuracy, macro F1 over the labels seen, kappa, and ``per_class_f1_<label>`` for the given labels."""
    data, by, made = _keyed(df, keys)
    marg = label_marginals(data, by, y_true, y_pred)
    n, agree = F.sum("nt").cast("double"), F.sum("tp") / F.sum("nt")
    chance = F.sum(F.col("nt").cast("double") * F.col("np")) / (n * n)
    extra = [F.coalesce(F.max(F.when(F.col("label") == c, _f1())), F.lit(0.0)).alias(f"per_class_f1_{c.lower()}") for c in labels or []]
    out = marg.groupBy(*by).agg(
        F.sum("nt").alias("n_samples"), agree.alias("accuracy"), F.avg(_f1()).alias("macro_f1"),
        ((agree - chance) / F.nullif(1 - chance, F.lit(0.0))).alias("cohen_kappa"), *extra,
    )
    return out.drop(*made)


def score_counts(df: DataFrame, keys: list[str], y_true: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score. A NaN score is a missing one."""
    y = q(y_true).cast("string").try_cast("double")
    rows = df.filter(q(score).isNotNull() & ~F.isnan(q(score).cast("double")) & y.isNotNull())
    return rows.groupBy(*keys, q(score).cast("double").alias("score")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))


def auc_roc(df: DataFrame, keys: list[str], y_true: str = "y_true", score: str = "y_score", out: str = "auc_roc") -> DataFrame:
    """Rank-sum area with ties averaged; null when only one class is present."""
    data, by, made = _keyed(df, keys)
    cum = running(score_counts(data, by, y_true, score), by, ["score"], sums={"_below": F.col("neg")})
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    won = F.sum(F.col("pos") * (F.col("_below") - F.col("neg") / 2))
    return cum.groupBy(*by).agg((won / F.nullif(p * n, F.lit(0.0))).alias(out)).drop(*made)


def binary_metrics(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred", score: str | None = None) -> DataFrame:
    """Accuracy, size, sensitivity, specificity, the four cells and the area under the curve."""
    data, by, made = _keyed(df, keys)
    t, p = q(y_true).cast("string").try_cast("double"), q(y_pred).cast("string").try_cast("double")
    cell = {"tn": (t == 0) & (p == 0), "fp": (t == 0) & (p == 1), "fn": (t == 1) & (p == 0), "tp": (t == 1) & (p == 1)}
    base = data.groupBy(*by).agg(F.count("*").alias("n_samples"), F.count_if(t == p).alias("_ok"), *[F.count_if(c).alias(n) for n, c in cell.items()])
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0))
    base = base.select(*by, (F.col("_ok") / F.col("n_samples")).alias("accuracy"), "n_samples", share("tp", "fn").alias("sensitivity"), share("tn", "fp").alias("specificity"), "tn", "fp", "fn", "tp")
    if score is None:
        return base.withColumn("auc_roc", F.lit(None).cast("double")).drop(*made)
    return join_on(base, auc_roc(data, by, y_true, score), by).drop(*made)


def confusion_matrix(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred", max_labels: int | None = None) -> DataFrame:
    """Every label against every label, zeros included; more than ``max_labels`` for a key, if given, are an error."""
    data, by, made = _keyed(df, keys)
    cells = data.groupBy(*by, q(y_true).cast("string").alias("label_true"), q(y_pred).cast("string").alias("label_pred")).agg(F.count("*").alias("cnt"))
    names = cells.select(*by, F.explode(F.array("label_true", "label_pred")).alias("l")).distinct()
    most = max_labels is not None and names.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if max_labels is not None and most > max_labels:
        raise ValueError(f"a key has {most} labels")
    sets = names.groupBy(*by).agg(F.collect_set("l").alias("ls"))
    grid = sets.select(*by, "ls", F.explode("ls").alias("label_true")).select(*by, "label_true", F.explode("ls").alias("label_pred"))
    return join_on(grid, cells, [*by, "label_true", "label_pred"]).withColumn("cnt", F.coalesce("cnt", F.lit(0))).drop(*made)


def roc_points(df: DataFrame, keys: list[str], y_true: str = "y_true", score: str = "y_score") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score downwards, from (0, 0); nothing for a single class."""
    data, by, made = _keyed(df, keys)
    per = score_counts(data, by, y_true, score)
    total = per.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).filter("_p > 0 and _n > 0")
    cum = running(per, by, [Desc("score")], sums={"_tp": F.col("pos"), "_fp": F.col("neg")})
    points = join_on(cum, total, by, "inner").select(*by, F.col("score").alias("threshold"), (F.col("_fp") / F.col("_n")).alias("fpr"), (F.col("_tp") / F.col("_p")).alias("tpr"))
    origin = total.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(points).drop(*made)


def _binomial_tail(b: int, c: int) -> float:
    """min(1, 2 P[X <= min(b, c)]) for X ~ Binomial(b + c, 1/2)."""
    n, k = b + c, min(b, c)
    if n == 0 or b == c:
        return 1.0
    term = total = 1.0  # relative to the largest term, the k-th; smaller ones fade quickly
    i = k
    while i > 0 and term > 1e-18 * total:
        term *= i / (n - i + 1)
        total += term
        i -= 1
    log_top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    return min(1.0, 2 * math.exp(log_top + math.log(total)))


def _binomial_two_sided(b: str, c: str) -> Column:
    """Exact two-sided p from the two discordant counts of each group."""

    @F.pandas_udf("double")
    def run(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([_binomial_tail(int(x), int(y)) for x, y in zip(b, c)])

    return run(b, c)


def mcnemar(df: DataFrame, keys: list[str], y_true: str, pred_a: str, pred_b: str) -> DataFrame:
    """Discordant counts, continuity-corrected statistic and exact two-sided p."""
    data, by, made = _keyed(df, keys)
    a_ok, b_ok = q(pred_a).eqNullSafe(q(y_true)), q(pred_b).eqNullSafe(q(y_true))
    counts = data.groupBy(*by).agg(F.count_if(a_ok & ~b_ok).alias("b"), F.count_if(~a_ok & b_ok).alias("c"))
    n = F.col("b") + F.col("c")
    stat = F.coalesce(F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / F.nullif(n, F.lit(0)), F.lit(0.0))
    return counts.select(*by, "b", "c", stat.alias("statistic"), _binomial_two_sided("b", "c").alias("p_value")).drop(*made)


def masked_multitask_metrics(df: DataFrame, keys: list[str], apnea: tuple = ("apnea_true", "apnea_pred", "apnea_score", "label_mask_apnea"), stage: tuple = ("stage_true", "stage_pred", "label_mask_stage")) -> DataFrame:
    """Both tasks on their masked rows; a task without labels has null metrics and 0 samples."""
    data, by, made = _keyed(df, keys)
    t, p, s, m = apnea
    bin_ = binary_metrics(data.filter(q(m).cast("int") > 0), by, t, p, s)
    st, sp, sm = stage
    multi = multiclass_metrics(data.filter(q(sm).cast("int") > 0), by, st, sp)
    groups = data.select(*by).distinct()
    names_a = ["accuracy", "sensitivity", "specificity", "auc_roc", "n_samples"]
    a = bin_.select(*by, *[F.col(c).alias(f"apnea_{c}") for c in names_a])
    b = multi.select(*by, *[F.col(c).alias(f"stage_{c}") for c in ("accuracy", "macro_f1", "cohen_kappa")])
    out = join_on(join_on(groups, a, by), b, by)
    return out.withColumn("apnea_n_samples", F.coalesce("apnea_n_samples", F.lit(0))).drop(*made)


def validation_score(df: DataFrame, columns=("apnea_auc_roc", "apnea_accuracy", "stage_macro_f1"), out: str = "validation_score") -> DataFrame:
    """Mean of the metrics that are present, 0 when none is."""
    have = F.array_compact(F.array(*[q(c).cast("double") for c in columns]))
    total = F.aggregate(have, F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(total / F.nullif(F.size(have), F.lit(0)), F.lit(0.0)))


def recover_metrics(metrics: DataFrame, stage: DataFrame, apnea: DataFrame) -> DataFrame:
    """Metric rows plus recomputed ones for (model, fold) with both predictions but no row."""
    keys = ["model", "fold"]
    both = stage.select(*keys).distinct().join(apnea.select(*keys).distinct(), keys)
    todo = both.join(metrics.select(*keys).distinct(), keys, "left_anti")
    s = multiclass_metrics(stage.join(todo, keys, "left_semi"), keys)
    a = binary_metrics(apnea.join(todo, keys, "left_semi"), keys, score="y_score" if "y_score" in apnea.columns else None)
    rows = s.select(*keys, *[F.col(c).alias(f"stage_{c}") for c in ("accuracy", "macro_f1", "cohen_kappa")]).join(
        a.select(*keys, *[F.col(c).alias(f"apnea_{c}") for c in ("accuracy", "sensitivity", "specificity", "auc_roc", "n_samples")]), keys)
    return metrics.unionByName(rows, allowMissingColumns=True)
