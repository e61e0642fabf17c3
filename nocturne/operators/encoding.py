"""One-hot encoding and its inverse, and the whole encoding step."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.functions.labels import STAGE_NAMES, encode_binary, ordinal_code
from nocturne.operators.quantiles import exact_quantiles
from nocturne.operators.schema import q, snake_name



def categories(df: DataFrame, column: str, cap: int | None = None) -> list:
    """Sorted distinct non-null values; more than ``cap``, if given, are an error, not a cut."""
    values = df.select(q(column)).dropna().distinct()
    found = [r[0] for r in (values if cap is None else values.limit(cap + 1)).collect()]
    if cap is not None and len(found) > cap:
        raise ValueError(f"{column!r} has more than {cap} categories")
    return sorted(found)


def one_hot(df: DataFrame, columns: list[str], drop_first: bool = False, cap: int | None = None) -> tuple[DataFrame, list[str]]:
    """``col_value`` double columns in value order; null gives zeros; the original column goes."""
    return one_hot_values(df, {c: categories(df, c, cap)[1 if drop_first else 0 :] for c in columns})


def one_hot_values(df: DataFrame, values: dict[str, list]) -> tuple[DataFrame, list[str]]:
    """``one_hot`` with given values; others give zeros."""
    columns, added = list(values), []
    for c, known in values.items():
        for v in known:
            added.append((f"{c}_{v}", F.coalesce(q(c) == F.lit(v), F.lit(False)).cast("double")))
    keep = [q(c) for c in df.columns if c not in columns]
    return df.select(*keep, *[col.alias(name) for name, col in added]), [name for name, _ in added]


def ordinal(df: DataFrame, column: str, order: list[str], unknown: str = "null") -> DataFrame:
    """Codes 0..n-1, unknown and missing values filled with the median code (0 when there is none)."""
    coded = df.withColumn(column, ordinal_code(q(column), order, unknown))
    if coded.filter(q(column).isNull()).isEmpty():
        return coded
    mid = exact_quantiles(coded, [column], [0.5])[column][0]
    return coded.withColumn(column, F.coalesce(q(column), F.lit(0.0 if mid is None else mid)))


@dataclass
class EncodingSpec:
    binary: list[str] = field(default_factory=list)
    ordinal: dict[str, list[str]] = field(default_factory=dict)
    nominal: list[str] = field(default_factory=list)
    drop_first: bool = False
    unknown: str = "null"


def encode(df: DataFrame, spec: EncodingSpec) -> tuple[DataFrame, list[str]]:
    """Binary, then ordinal, then nominal columns."""
    fit = encode_fit(df, spec)
    return encode_apply(df, fit)


def encode_fit(df: DataFrame, spec: EncodingSpec) -> dict:
    """The values and fills that ``encode_apply`` needs."""
    both = sorted(set(spec.nominal) & set(spec.ordinal))
    if both:
        raise ValueError(f"columns are both nominal and ordinal: {both}")
    absent = [c for c in [*spec.binary, *spec.ordinal, *spec.nominal] if c not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}")
    fills = {}
    for c, order in spec.ordinal.items():
        coded = df.select(ordinal_code(q(c), order, spec.unknown).alias(c))
        if not coded.filter(q(c).isNull()).isEmpty():
            mid = exact_quantiles(coded, [c], [0.5])[c][0]
            fills[c] = 0.0 if mid is None else mid
    named = encode_binary_columns(df, spec.binary)
    values = {c: categories(named, c)[1 if spec.drop_first else 0 :] for c in spec.nominal}
    return {"binary": spec.binary, "ordinal": spec.ordinal, "unknown": spec.unknown, "fills": fills, "values": values}


def encode_binary_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: encode_binary(q(c)) for c in columns}) if columns else df


def encode_apply(df: DataFrame, fit: dict) -> tuple[DataFrame, list[str]]:
    """The columns encoded as fitted: values that weren't there give zeros, unknown ranks the fitted median (0 if none was missing)."""
    df = encode_binary_columns(df, fit["binary"])
    for c, order in fit["ordinal"].items():
        df = df.withColumn(c, F.coalesce(ordinal_code(q(c), order, fit["unknown"]), F.lit(fit["fills"].get(c, 0.0))))
    return one_hot_values(df, fit["values"])


def decode_one_hot(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """Rebuild an absent target from its ``target_*`` indicator columns; returns the columns used.

    Only 0/1-valued columns count; for ``sleep_stage`` scaled ones with a known stage suffix also do.
    """
    target = snake_name(target)
    if target in df.columns:
        return df, []
    prefix = f"{target}_"
    near = [c for c in df.columns if c.startswith(prefix)]
    used = []
    if near:
        probe = []
        for i, c in enumerate(near):
            x = q(c).cast("string").try_cast("double")
            probe += [F.count(x).alias(f"n{i}"), F.count_if(~x.isin(0.0, 1.0)).alias(f"o{i}")]
        row = df.agg(*probe).first()
        used = [c for i, c in enumerate(near) if row[f"n{i}"] and not row[f"o{i}"]]
    if not used and target == "sleep_stage":
        used = [c for c in near if snake_name(c[len(prefix):]) in STAGE_NAMES]
    if not used:
        raise ValueError(f"neither {target!r} nor indicator columns {prefix}* found")
    values = F.array(*[F.coalesce(q(c).cast("string").try_cast("double"), F.lit(0.0)) for c in used])
    names = F.array(*[F.lit(c[len(prefix):]) for c in used])
    best = F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))
    return df.withColumn(target, F.when(F.array_max(values) <= 0, "<UNASSIGNED>").otherwise(best)), used
