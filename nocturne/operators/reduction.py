"""Dimensionality: principal axes, discriminant axes, variance and univariate selection."""
from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.operators.schema import numeric_columns, q

PAIRS_PER_JOB = 200


def feature_matrix(df: DataFrame, target: str | None, exclude=()) -> list[str]:
    """Numeric features without target and exclusions; a null among them is an error."""
    cols = numeric_columns(df, {*exclude, *([target] if target else [])})
    if not cols:
        raise ValueError("no numeric feature is left")
    row = df.agg(*[F.count_if(q(c).isNull() | F.isnan(q(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    holed = [c for i, c in enumerate(cols) if row[i]]
    if holed:
        raise ValueError(f"features with missing values: {holed}")
    return cols


def _laid_out(df: DataFrame, parts: list, features: list[str], target: str | None) -> DataFrame:
    rest = [c for c in df.columns if c not in features and c != target]
    return df.select(*parts, *[q(c) for c in rest], *([q(target)] if target and target in df.columns else []))


def _project(features: list[str], means, axes: np.ndarray, stem: str) -> list:
    out = []
    for j in range(axes.shape[1]):
        total = F.lit(0.0)
        for i, c in enumerate(features):
            total = total + (q(c).cast("double") - F.lit(float(means[i]))) * F.lit(float(axes[i, j]))
        out.append(total.alias(f"{stem}_{j + 1}"))
    return out


def _signed(axes: np.ndarray) -> np.ndarray:
    """Each axis turned so that its largest loading is positive."""
    flip = np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    return axes * np.where(flip == 0, 1, flip)


def project(df: DataFrame, fit: dict, target: str | None = None) -> DataFrame:
    """Scores of a fitted projection (``pca_fit``, ``lda_fit``) in place of its features."""
    return _laid_out(df, _project(fit["columns"], fit["means"], np.asarray(fit["axes"], float).reshape(len(fit["columns"]), -1), fit["stem"]), fit["columns"], target)


def pca(df: DataFrame, target: str | None = None, n: int | float = 0.95, exclude=()) -> tuple[DataFrame, list[float]]:
    """Centred principal scores ``pca_i`` (a count, or the share of variance to reach) and explained shares."""
    fit = pca_fit(df, target, n, exclude)
    return project(df, fit, target), fit["shares"]


def pca_fit(df: DataFrame, target: str | None = None, n: int | float = 0.95, exclude=()) -> dict:
    """Columns, means, axes and explained shares."""
    cols = feature_matrix(df, target, exclude)
    means = df.agg(*[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    vectors = VectorAssembler(inputCols=cols, outputCol="_v").transform(df.select(*[q(c).cast("double").alias(c) for c in cols]))
    model = PCA(k=len(cols), inputCol="_v", outputCol="_p").fit(vectors)
    share = [float(x) for x in model.explainedVariance.toArray()]
    if isinstance(n, float) and 0 < n < 1:
        k = min(int(np.searchsorted(np.cumsum(share), n, side="right")) + 1, len(cols))
    else:
        k = min(int(n), len(cols))
    axes = _signed(np.asarray(model.pc.toArray())[:, :k])
    return {"stem": "pca", "columns": cols, "means": [float(m) for m in means], "axes": axes.tolist(), "shares": share[:k]}


def covariances(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Population covariance matrix from pairwise aggregates, a bounded number per job."""
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    out = np.zeros((len(cols), len(cols)))
    for at in range(0, len(pairs), PAIRS_PER_JOB):
        chunk = pairs[at : at + PAIRS_PER_JOB]
        row = df.agg(*[F.covar_pop(q(cols[i]).cast("double"), q(cols[j]).cast("double")).alias(f"c{n}") for n, (i, j) in enumerate(chunk)]).first()
        for n, (i, j) in enumerate(chunk):
            out[i, j] = out[j, i] = row[n]
    return out


def is_class_target(df: DataFrame, target: str) -> bool:
    """Strings and booleans are classes; numbers are when they have few distinct values."""
    kind = df.schema[target].dataType
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return True
    distinct, n = df.agg(F.count_distinct(q(target)), F.count(q(target))).first()
    if distinct < 2:
        return False
    return distinct <= (min(25, max(2, n // 2)) if isinstance(kind, (T.DoubleType, T.FloatType)) else 50)


def lda(df: DataFrame, target: str, n: int | None = None, exclude=(), max_classes: int | None = None) -> DataFrame:
    """Discriminant scores ``lda_i`` with unit within-class covariance; more than ``max_classes``, if given, are an error."""
    return project(df, lda_fit(df, target, n, exclude, max_classes), target)


def lda_fit(df: DataFrame, target: str, n: int | None = None, exclude=(), max_classes: int | None = None) -> dict:
    """Columns, centre, axes and the number of classes."""
    if not is_class_target(df, target):
        raise ValueError("the target is not discrete")
    cols = feature_matrix(df, target, exclude)
    labelled = df.filter(q(target).isNotNull())
    stats = labelled.groupBy(q(target)).agg(F.count("*").alias("n"), *[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = (stats if max_classes is None else stats.limit(max_classes + 1)).collect()
    if max_classes is not None and len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    if len(rows) < 2:
        raise ValueError("at least two classes are needed")
    sizes = np.array([r["n"] for r in rows], dtype=float)
    means = np.array([[r[f"m{i}"] for i in range(len(cols))] for r in rows])
    total, centre = sizes.sum(), (sizes[:, None] * means).sum(axis=0) / sizes.sum()
    apart = means - centre
    between = (apart * sizes[:, None]).T @ apart / total
    within = (covariances(labelled, cols) - between) * total / (total - len(rows))
    # Whiten by the within-class covariance, then take the axes of the class means.
    value, vector = np.linalg.eigh(within)
    good = value > value.max() * 1e-12
    white = vector[:, good] / np.sqrt(value[good])
    _, turn = np.linalg.eigh(white.T @ between @ white)
    most = min(len(cols), len(rows) - 1)
    k = min(n or most, most)
    axes = _signed((white @ turn[:, ::-1])[:, :k])
    return {"stem": "lda", "columns": cols, "means": centre.tolist(), "axes": axes.tolist(), "classes": len(rows)}


def variance_threshold(df: DataFrame, threshold: float = 0.0, target: str | None = None, exclude=()) -> tuple[DataFrame, list[str]]:
    cols = feature_matrix(df, target, exclude)
    row = df.agg(*[F.var_pop(q(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    kept = [c for i, c in enumerate(cols) if row[i] > threshold]
    if not kept:
        raise ValueError("no feature exceeds the variance threshold")
    return _laid_out(df, [q(c) for c in kept], cols, target), [c for c in cols if c not in kept]


def anova_scores(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """(feature, score): between over within mean squares.

    Values are centred first, so the sums of the two-level aggregation do not cancel.
    """
    mid = df.agg(*[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    x = lambda i: q(cols[i]).cast("double") - F.lit(mid[i])
    aggs = []
    for i in range(len(cols)):
        aggs += [F.avg(x(i)).alias(f"a{i}"), F.var_pop(x(i)).alias(f"v{i}")]
    per = df.groupBy(q(target)).agg(F.count("*").alias("n"), *aggs)
    tops = []
    for i in range(len(cols)):
        tops += [F.sum(F.col("n") * F.col(f"a{i}")).alias(f"s{i}"), F.sum(F.col("n") * F.col(f"a{i}") * F.col(f"a{i}")).alias(f"b{i}"), F.sum(F.col("n") * F.col(f"v{i}")).alias(f"w{i}")]
    row = per.agg(F.count("*").alias("k"), F.sum("n").alias("t"), *tops)
    cells = []
    for i, c in enumerate(cols):
        between = (F.col(f"b{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col("t")) / F.nullif(F.col("k") - 1, F.lit(0))
        within = F.col(f"w{i}") / F.nullif(F.col("t") - F.col("k"), F.lit(0))
        cells.append(F.struct(F.lit(c).alias("feature"), (between / F.nullif(within, F.lit(0.0))).alias("score")))
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def regression_scores(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """(feature, score): F of the simple regression on each feature."""
    y, aggs, cells = q(target).cast("double"), [F.count("*").alias("n"), F.var_pop(q(target).cast("double")).alias("vy")], []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        aggs += [F.covar_pop(x, y).alias(f"c{i}"), F.var_pop(x).alias(f"v{i}")]
        r2 = F.col(f"c{i}") * F.col(f"c{i}") / F.nullif(F.col(f"v{i}") * F.col("vy"), F.lit(0.0))
        cells.append(F.struct(F.lit(c).alias("feature"), (r2 * (F.col("n") - 2) / F.nullif(1 - r2, F.lit(0.0))).alias("score")))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def select_k_best(df: DataFrame, target: str, k: int, score: str = "auto", exclude=()) -> tuple[DataFrame, dict[str, float]]:
    """The k best features in their original order, then the other columns and the target; with their scores."""
    if k < 1:
        raise ValueError("k must be at least 1")
    cols = feature_matrix(df, target, exclude)
    classes = is_class_target(df, target) if score == "auto" else {"f_classif": True, "f_regression": False}[score]
    table = anova_scores(df, cols, target) if classes else regression_scores(df, cols, target)
    scores = {r["feature"]: r["score"] for r in table.collect()}
    rank = sorted(cols, key=lambda c: (-(scores[c] if scores[c] is not None else float("-inf")), cols.index(c)))
    kept = [c for c in cols if c in rank[: min(k, len(cols))]]
    return _laid_out(df, [q(c) for c in kept], cols, target), {c: scores[c] for c in kept}
