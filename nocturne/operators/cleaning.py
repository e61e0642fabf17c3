"""Fitted cleaning steps and the whole cleaning sequence with its log."""
from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.functions.text import normalize_category, parse_number
from nocturne.operators.filters import deduplicate
from nocturne.operators.quantiles import exact_modes, exact_quantiles
from nocturne.operators.schema import drop_high_missing, nan_to_null, numeric_columns, q, rename_snake, snake_name, string_columns
from nocturne.session import keep


def missing_counts(df: DataFrame) -> DataFrame:
    """Nulls per column as (column, missing), from one aggregation."""
    row = df.agg(*[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def coerce_numeric(df: DataFrame, min_ratio: float = 0.9) -> tuple[DataFrame, list[dict]]:
    """Text columns that mostly hold numbers become doubles; the rest stay."""
    texts = string_columns(df)
    if not texts:
        return df, []
    probe = []
    for i, c in enumerate(texts):
        probe += [F.count(q(c)).alias(f"n{i}"), F.count(parse_number(q(c))).alias(f"p{i}")]
    row = df.agg(*probe).first()
    done = []
    for i, c in enumerate(texts):
        n, parsed = row[f"n{i}"], row[f"p{i}"]
        if n and parsed and parsed / n >= min_ratio:
            done.append({"column": c, "induced": n - parsed, "parsed": parsed})
    return df.withColumns({d["column"]: parse_number(q(d["column"])) for d in done}) if done else df, done


def low_cardinality(df: DataFrame, columns: list[str], most: int) -> list[str]:
    """Columns with at most ``most`` distinct non-null values.

    A sketch first sets aside columns far above the bound, so the exact distinct
    count only runs where partial aggregation keeps few rows.
    """
    if not columns:
        return []
    rough = df.agg(*[F.approx_count_distinct(q(c), 0.02).alias(f"a{i}") for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if rough[f"a{i}"] <= 2 * most + 16]
    if not near:
        return []
    exact = df.agg(*[F.count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(near)]).first()
    return [c for i, c in enumerate(near) if exact[f"d{i}"] <= most]


def normalize_strings(df: DataFrame, max_cardinality: int = 50) -> tuple[DataFrame, list[str]]:
    chosen = low_cardinality(df, string_columns(df), max_cardinality)
    return df.withColumns({c: normalize_category(q(c)) for c in chosen}) if chosen else df, chosen


def impute_fit(df: DataFrame) -> dict[str, object]:
    """Medians of numeric columns and modes of the others; only columns with nulls need a value."""
    null_row = df.agg(*[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    holed = [c for i, c in enumerate(df.columns) if null_row[i]]
    numeric = [c for c in numeric_columns(df) if c in holed]
    medians = {c: v[0] for c, v in exact_quantiles(df, numeric, [0.5]).items()}
    return {**medians, **exact_modes(df, [c for c in holed if c not in numeric], "string")}


def impute_apply(df: DataFrame, values: dict[str, object]) -> DataFrame:
    numeric = set(numeric_columns(df))
    out = {}
    for c, v in values.items():
        if v is None or c not in df.columns:
            continue
        kind = "double" if c in numeric else df.schema[c].dataType
        out[c] = F.coalesce(q(c).cast(kind), F.lit(v).cast(kind))
    return df.withColumns(out) if out else df


def tukey_fit(df: DataFrame, columns: list[str] | None = None, exclude=(), k: float = 1.5) -> list[dict]:
    """Quartiles, fences and the number of values outside them per numeric column."""
    numeric = numeric_columns(df)
    chosen = [c for c in (columns if columns is not None else numeric) if c in numeric and c not in set(exclude)]
    quart = exact_quantiles(df, chosen, [0.25, 0.75])
    fits = []
    for c in chosen:
        q1, q3 = quart[c]
        if q1 is None or q1 in (float("inf"), float("-inf")) or q3 in (float("inf"), float("-inf")):
            continue
        iqr = q3 - q1
        fits.append({"column": c, "q1": q1, "q3": q3, "iqr": iqr, "lower": q1 - k * iqr, "upper": q3 + k * iqr})
    if fits:
        hits = []
        for i, f in enumerate(fits):
            hits += [F.count_if(q(f["column"]) < f["lower"]).alias(f"l{i}"), F.count_if(q(f["column"]) > f["upper"]).alias(f"h{i}")]
        row = df.agg(*hits).first()
        for i, f in enumerate(fits):
            f["n_low"], f["n_high"] = row[f"l{i}"], row[f"h{i}"]
    return fits


def tukey_apply(df: DataFrame, fits: list[dict]) -> DataFrame:
    clip = {}
    for f in fits:
        c = q(f["column"])
        clip[f["column"]] = F.when(c.isNotNull(), F.greatest(F.least(c.cast("double"), F.lit(f["upper"])), F.lit(f["lower"])))
    return df.withColumns(clip) if clip else df


@dataclass
class CleaningOptions:
    """Column names may be given raw or in snake case."""

    target: str | None = None
    dedupe_subset: list[str] | None = None
    order: list[str] = field(default_factory=list)
    drop_missing_pct: float | None = None
    drop_target_missing: bool = False
    winsorize: bool = False
    iqr_multiplier: float = 1.5
    outlier_columns: list[str] | None = None
    outlier_exclude: list[str] = field(default_factory=list)
    max_cardinality: int = 50
    min_parsed_ratio: float = 0.9


LOG = T.StructType([
    T.StructField("metric", T.StringType()), T.StructField("value", T.StringType()), T.StructField("detail", T.StringType()),
])


def clean(df: DataFrame, options: CleaningOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """All steps in their fixed order; returns the table and a (metric, value, detail) log."""
    return clean_fit(df, options)[:2]


def clean_fit(df: DataFrame, options: CleaningOptions | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """``clean`` and what it found, for ``clean_apply``."""
    o = options or CleaningOptions()
    names = lambda xs: None if xs is None else [snake_name(x) for x in xs]
    o = replace(o, target=snake_name(o.target) if o.target else None, dedupe_subset=names(o.dedupe_subset), order=names(o.order),
                outlier_columns=names(o.outlier_columns), outlier_exclude=names(o.outlier_exclude))
    data = nan_to_null(rename_snake(df))
    if o.target and o.target not in data.columns:
        raise ValueError(f"target {o.target!r} is not a column")
    size = data.agg(F.count("*").alias("n"), *[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(data.columns)]).first()
    log = [("input_rows", size["n"], "")]
    log += [("missing_before", size[f"m{i}"], c) for i, c in enumerate(data.columns)]
    dropped: list[str] = []
    if o.drop_missing_pct is not None:
        data, dropped = drop_high_missing(data, o.drop_missing_pct, o.target)
        log += [("dropped_column", 1, c) for c in dropped]

    empty = F.lit(True)
    for c in data.columns:
        empty = empty & q(c).isNull()
    no_target = q(o.target).isNull() if o.target and o.drop_target_missing else F.lit(False)
    gone = data.agg(F.count_if(no_target).alias("t"), F.count_if(~no_target & empty).alias("e")).first()
    log += [("removed_target_missing_rows", gone["t"], ""), ("removed_empty_rows", gone["e"], "")]
    data = data.filter(~no_target & ~empty)

    data, coerced = coerce_numeric(data, o.min_parsed_ratio)
    log += [("numeric_coercion_induced_null", d["induced"], d["column"]) for d in coerced]
    data, normal = normalize_strings(data, o.max_cardinality)
    log += [("string_normalized", 1, c) for c in normal]

    lost = [c for c in o.dedupe_subset or [] if c not in data.columns]
    if lost:
        raise ValueError(f"key columns not found: {lost}")
    left = size["n"] - gone["t"] - gone["e"]
    data = keep(deduplicate(data, o.dedupe_subset, o.order))
    rows = data.count()
    log.append(("removed_duplicates", left - rows, ",".join(o.dedupe_subset or [])))
    filled, fits = impute_fit(data), []
    data = impute_apply(data, filled)
    if o.winsorize:
        fits = tukey_fit(data, o.outlier_columns, [*o.outlier_exclude, *([o.target] if o.target else [])], o.iqr_multiplier)
        data = tukey_apply(data, fits)
        log += [("winsorized_low", f["n_low"], f["column"]) for f in fits]
        log += [("winsorized_high", f["n_high"], f["column"]) for f in fits]
    log.append(("output_rows", rows, ""))
    frame = df.sparkSession.createDataFrame([(m, str(v), d) for m, v, d in log], LOG)
    return data, frame, {"dropped": dropped, "numbers": [d["column"] for d in coerced], "texts": normal, "fill": filled, "clip": fits}


def clean_apply(df: DataFrame, fit: dict) -> DataFrame:
    """Other rows cleaned as ``clean_fit`` cleaned its own: the same columns, numbers, fills and fences. No row goes."""
    data = nan_to_null(rename_snake(df)).drop(*fit["dropped"])
    texts = set(string_columns(data))
    data = data.withColumns({c: parse_number(q(c)) for c in fit["numbers"] if c in texts})
    data = data.withColumns({c: normalize_category(q(c)) for c in fit["texts"] if c in texts})
    return tukey_apply(impute_apply(data, fit["fill"]), fit["clip"])
