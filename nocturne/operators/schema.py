"""Schema operators: renames, feature choice, subjects, channels, label masks."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.functions import labels, text

# Subject columns in order of preference, the dataset with integer stages, and the shared multi-task schema.
CODED_DATASET = "st_vincent_apnea"
SUBJECT_COLUMNS = ("subject_unit_id", "subject_id", "record_id", "recording_id")
MULTITASK_SCHEMA = {
    "dataset_id": "string",
    "subject_unit_id": "string",
    "recording_id": "string",
    "epoch_index": "bigint",
    "epoch_start_sec": "double",
    "epoch_end_sec": "double",
    "source_file": "string",
    "eeg_channel_standardized": "string",
    "apnea_binary": "double",
    "sleep_stage": "string",
    "severity_global": "double",
}


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns in schema order; booleans are categorical."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing marker: NaN becomes null in every float column."""
    return df.withColumns({c: F.nanvl(q(c), F.lit(None)) for c in float_columns(df)}) if float_columns(df) else df


def snake_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def rename_snake(df: DataFrame) -> DataFrame:
    """Column names to snake case; two names meeting is an error."""
    names = [snake_name(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names collide after renaming: {clash}")
    return df.toDF(*names)


def signal_stems(features: list[str]) -> list[str]:
    return sorted({c[: -len(s)] for c in features for s in ("_mean", "_std") if c.endswith(s)})


def resolve_features(df: DataFrame, exclude=(), include=None, allow_many_signals: bool = False) -> list[str]:
    numeric = numeric_columns(df)
    if include:
        for c in include:
            if c in set(exclude):
                raise ValueError(f"feature {c!r} is excluded")
            if c not in df.columns:
                raise ValueError(f"feature {c!r} is not a column")
            if c not in numeric:
                raise ValueError(f"feature {c!r} is not numeric")
        return list(include)
    chosen = [c for c in numeric if c not in set(exclude)]
    if not allow_many_signals and len(signal_stems(chosen)) > 1:
        raise ValueError(f"several signal stems among the features: {signal_stems(chosen)}")
    return chosen


def resolve_features_cross(train: DataFrame, other: DataFrame, exclude=(), include=None) -> list[str]:
    if include:
        resolve_features(train, exclude, include)
        return resolve_features(other, exclude, include)
    shared = sorted(set(numeric_columns(train, exclude)) & set(numeric_columns(other, exclude)))
    if not shared:
        raise ValueError("the tables share no numeric feature")
    return shared


def cast_float32(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: q(c).cast("float") for c in features})


def drop_high_missing(df: DataFrame, pct: float, target: str | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns with strictly more than ``pct`` percent nulls, never the target."""
    if not 0 <= pct <= 100:
        raise ValueError("the missing percentage must lie in 0..100")
    row = df.agg(F.count("*").alias("n"), *[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    n = row["n"]
    bad = [c for i, c in enumerate(df.columns) if n and c != target and 100.0 * (n - row[f"c{i}"]) / n > pct]
    return df.drop(*bad), bad


def ensure_subject(df: DataFrame, output: str = "subject_unit_id", prefer=SUBJECT_COLUMNS, overwrite: bool = False) -> DataFrame:
    """A subject column: existing and complete, else the first usable preferred column, else from the file path."""
    there = [c for c in dict.fromkeys([output, *prefer]) if c in df.columns]
    counts = df.agg(F.count("*"), *[F.count(q(c)) for c in there]).first()
    filled = dict(zip(there, counts[1:]))
    if not overwrite and output in there and filled[output] == counts[0]:
        return df
    for c in prefer:
        if c in there and filled[c] > 0 and (overwrite or c != output):
            return df.withColumn(output, q(c))
    if "source_file" in df.columns:
        return df.withColumn(output, text.subject_from_path(F.col("source_file").cast("string")))
    raise ValueError(f"no column to derive {output!r} from")


def match_channel(channels: DataFrame, requested: str | list[str], keys: list[str], name: str = "channel", ordinal: str = "ordinal") -> DataFrame:
    """One channel per recording: exact, then case-blind, then alphanumeric match, in request order.

    A list falls back to the first channel starting with ``eeg``; no match fails the query.
    """
    wanted = [requested] if isinstance(requested, str) else list(requested)
    low, bare = F.lower(q(name)), F.regexp_replace(F.lower(q(name)), r"[^\p{L}\p{N}]", "")
    pos = F.col(ordinal).cast("bigint")
    ranks = []
    for i, w in enumerate(wanted):
        squeezed = "".join(ch for ch in w.lower() if ch.isalnum())
        for tier, (hit, tie) in enumerate([(q(name) == w, pos), (low == w.lower(), -pos), (bare == squeezed, pos)]):
            ranks.append(F.when(hit, F.struct(F.lit(i).alias("i"), F.lit(tier).alias("tier"), tie.alias("tie"))))
    if not isinstance(requested, str):
        eeg = F.ltrim(low).startswith("eeg")
        ranks.append(F.when(eeg, F.struct(F.lit(len(wanted)).alias("i"), F.lit(0).alias("tier"), pos.alias("tie"))))
    best = F.least(*ranks) if len(ranks) > 1 else ranks[0]
    out = channels.groupBy(*keys).agg(F.min_by(q(name), best).alias(name))
    return out.withColumn(name, F.coalesce(q(name), F.raise_error(F.lit("no matching channel")).cast("string")))


def choose_first_available(channels: DataFrame, preferred: list[str], keys: list[str], name: str = "channel", ordinal: str = "ordinal", usable: str = "has_numeric") -> DataFrame:
    """First preferred channel present, else the first one with any numeric value, else null."""
    rank = F.coalesce(*[F.when(q(name) == p, F.lit(i)) for i, p in enumerate(preferred)], F.lit(len(preferred)))
    ok = (rank < len(preferred)) | F.col(usable)
    best = F.when(ok, F.struct(rank.alias("r"), F.when(rank < len(preferred), 0).otherwise(F.col(ordinal)).alias("o")))
    return channels.groupBy(*keys).agg(F.min_by(q(name), best).alias(name))


def project_multitask(df: DataFrame, **values) -> DataFrame:
    """Any corpus to the shared 11 columns: keyword values are columns or literals, missing ones null."""
    cols = []
    for name, kind in MULTITASK_SCHEMA.items():
        value = values.get(name, q(name) if name in df.columns else F.lit(None))
        cols.append((value if isinstance(value, Column) else F.lit(value)).cast(kind).alias(name))
    return df.select(*cols)


def label_masks(df: DataFrame, stage: str = "sleep_stage", apnea: str = "apnea_binary", coded_dataset: str = CODED_DATASET) -> DataFrame:
    """Multi-task rows: typed columns, normalised labels, masks, and only rows with a label."""
    absent = [c for c in ("dataset_id", "subject_unit_id", "recording_id", "epoch_index", "epoch_start_sec", "epoch_end_sec") if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    for c in (apnea, stage):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    stage_value = labels.map_stage_codes(labels.normalize_stage_label(q(stage)), F.col("dataset_id").cast("string"), coded_dataset)
    out = df.withColumns({
        stage: stage_value,
        "label_mask_apnea": q(apnea).isNotNull().cast("int"),
        "label_mask_stage": q(stage).isNotNull().cast("int"),
    })
    out = out.filter((F.col("label_mask_apnea") > 0) | (F.col("label_mask_stage") > 0))
    if out.isEmpty():
        raise ValueError("no row has a label of either task")
    out = out.dropna(subset=["dataset_id", "subject_unit_id", "recording_id", "epoch_start_sec", "epoch_end_sec"])
    number = {c: q(c).cast("string").try_cast("double") for c in (apnea, "epoch_start_sec", "epoch_end_sec")}
    return out.withColumns({
        **number,
        "epoch_index": F.coalesce(F.col("epoch_index").cast("string").try_cast("double").cast("bigint"), F.lit(0)),
        **{c: F.col(c).cast("string") for c in ("subject_unit_id", "recording_id", "dataset_id")},
    })


def label_masks_strict(df: DataFrame, stage: str = "sleep_stage", apnea: str = "apnea_binary") -> DataFrame:
    """Variant for classic models: stages outside the five names are nulled, all rows stay."""
    name = labels.normalize_stage_label(q(stage))
    valid = F.coalesce(name.isin(*labels.STAGES), F.lit(False))
    return df.withColumns({
        apnea: q(apnea).cast("string").try_cast("double"),
        stage: F.when(valid, name),
    }).withColumns({
        "label_mask_apnea": q(apnea).isNotNull().cast("int"),
        "label_mask_stage": q(stage).isNotNull().cast("int"),
    })
