"""Scaling fitted by one aggregation, and the train-only impute-and-scale pair."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.operators.quantiles import exact_quantiles
from nocturne.operators.schema import numeric_columns, q


def scale_columns(df: DataFrame, include=None, exclude=(), target: str | None = None) -> list[str]:
    gone = {*exclude, *([target] if target else [])}
    return [c for c in numeric_columns(df) if c not in gone and (include is None or c in include)]


def scale_fit(df: DataFrame, columns: list[str], method: str = "standardize") -> dict[str, tuple[float, float]]:
    """(shift, spread) per column: mean and population deviation, or minimum and range."""
    if method not in ("standardize", "minmax"):
        raise ValueError(f"unknown scaling {method!r}")
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        x = q(c).cast("double")
        aggs += [F.avg(x), F.stddev_pop(x)] if method == "standardize" else [F.min(x), F.max(x) - F.min(x)]
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def scale_apply(df: DataFrame, fit: dict[str, tuple[float, float]]) -> DataFrame:
    """Nulls stay null, constant columns become 0."""
    out = {}
    for c, (shift, spread) in fit.items():
        if shift is None:
            out[c] = q(c).cast("double")
        elif spread == 0:
            out[c] = F.when(q(c).isNotNull(), F.lit(0.0))
        else:
            out[c] = (q(c).cast("double") - F.lit(shift)) / F.lit(spread)
    return df.withColumns(out) if out else df


def fit_impute_scale(train: DataFrame, features: list[str], scale: bool = True) -> dict:
    """Medians and, on the imputed rows, means and deviations of the training rows only."""
    medians = {c: v[0] for c, v in exact_quantiles(train, features, [0.5]).items()}
    fit = {"medians": medians, "scale": {}}
    if scale:
        fit["scale"] = scale_fit(apply_impute_scale(train, fit), features)
    return fit


def apply_impute_scale(df: DataFrame, fit: dict) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(q(c).cast("double"), F.lit(m)) if m is not None else q(c).cast("double") for c, m in fit["medians"].items()})
    return scale_apply(filled, fit["scale"])
