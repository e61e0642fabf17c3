"""Clean, encode, balance, scale and reduce in that order, each step optional, fitted once and applied to any rows."""
from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from nocturne.operators import balance, reduction, scaling
from nocturne.operators.cleaning import CleaningOptions, clean_apply, clean_fit
from nocturne.operators.encoding import EncodingSpec, encode_apply, encode_fit
from nocturne.operators.schema import q, snake_name


@dataclass
class ChainOptions:
    """With cleaning, which renames columns, all column names may be given raw or in snake case."""

    target: str | None = None
    cleaning: CleaningOptions | None = None
    encoding: EncodingSpec | None = None
    balance: str | None = None
    balance_order: list[str] | None = None
    balance_strategy: object = "auto"
    scaling: str | None = None
    scale_exclude: tuple = ()
    reduction: str | None = None
    reduction_args: dict | None = None
    seed: int = 42


def _in_snake_case(o: ChainOptions) -> ChainOptions:
    if not o.cleaning:
        return o
    names = lambda xs: None if xs is None else [snake_name(x) for x in xs]
    e, args = o.encoding, dict(o.reduction_args or {})
    if e:
        e = replace(e, binary=names(e.binary), ordinal={snake_name(c): v for c, v in e.ordinal.items()}, nominal=names(e.nominal))
    if "exclude" in args:
        args["exclude"] = names(args["exclude"])
    return replace(o, target=snake_name(o.target) if o.target else None, encoding=e, balance_order=names(o.balance_order), scale_exclude=tuple(names(o.scale_exclude)), reduction_args=args or None)


@dataclass
class FittedChain:
    """What each step learnt from the training rows; plain values that are saved as JSON.

    ``report`` has (step, metric, value, detail) rows: the cleaning log, columns before and after encoding, class sizes before and after
    balancing, shift and spread of each scaled column, and shares, scores or dropped columns of the reduction.
    """

    target: str | None
    steps: dict = field(default_factory=dict)
    report: list = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        """Other rows by the fitted steps. Balancing is for training rows only, and no row goes."""
        s = self.steps
        if "clean" in s:
            df = clean_apply(df, s["clean"])
        if "encode" in s:
            df = encode_apply(df, s["encode"])[0]
        if "scale" in s:
            df = scaling.scale_apply(df, {c: tuple(v) for c, v in s["scale"].items()})
        return self._reduce(df)

    def _reduce(self, df: DataFrame) -> DataFrame:
        fit = self.steps.get("reduce")
        if not fit:
            return df
        if "axes" in fit:
            return reduction.project(df, fit, self.target)
        rest = [c for c in df.columns if c not in fit["columns"] and c != self.target]
        return df.select(*[q(c) for c in [*fit["kept"], *rest]], *([q(self.target)] if self.target in df.columns else []))

    def report_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, m, str(v), d) for s, m, v, d in self.report], "step string, metric string, value string, detail string")

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of JSON in the folder."""
        text = json.dumps({"target": self.target, "steps": self.steps, "report": self.report})
        spark.createDataFrame([(text,)], "chain string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedChain:
        return cls(**json.loads(spark.read.parquet(path).first()["chain"]))


def _balanced(df: DataFrame, o: ChainOptions) -> DataFrame:
    if o.balance == "smote":
        return balance.smote(df, o.target, strategy=o.balance_strategy, seed=o.seed)
    sample = {"random_under": balance.random_under, "random_over": balance.random_over}[o.balance]
    return sample(df, o.target, o.balance_order, o.balance_strategy, o.seed)


def fit_chain(df: DataFrame, options: ChainOptions) -> tuple[FittedChain, DataFrame]:
    """The fitted chain and the training rows it made, balanced if asked for."""
    o = _in_snake_case(options)
    out = FittedChain(o.target)
    note = lambda step, metric, value, detail="": out.report.append([step, metric, str(value), detail])
    if o.cleaning:
        df, log, out.steps["clean"] = clean_fit(df, o.cleaning)
        for r in log.collect():
            note("clean", r["metric"], r["value"], r["detail"])
    if o.encoding:
        before = len(df.columns)
        out.steps["encode"] = encode_fit(df, o.encoding)
        df, added = encode_apply(df, out.steps["encode"])
        note("encode", "columns_before", before)
        note("encode", "columns_after", len(df.columns))
        for c in added:
            note("encode", "added", 1, c)
    if o.balance:
        for label, n in sorted(balance.counts_of(df, o.target).items(), key=str):
            note("balance", "rows_before", n, str(label))
        df = _balanced(df, o)
        for label, n in sorted(balance.counts_of(df, o.target).items(), key=str):
            note("balance", "rows_after", n, str(label))
    if o.scaling:
        out.steps["scale"] = scaling.scale_fit(df, scaling.scale_columns(df, exclude=o.scale_exclude, target=o.target), o.scaling)
        df = scaling.scale_apply(df, out.steps["scale"])
        for c, (shift, spread) in out.steps["scale"].items():
            note("scale", "shift", shift, c)
            note("scale", "spread", spread, c)
    if o.reduction:
        args = dict(o.reduction_args or {})
        columns = reduction.feature_matrix(df, o.target, args.get("exclude", ()))
        if o.reduction in ("pca", "lda"):
            fit = (reduction.pca_fit if o.reduction == "pca" else reduction.lda_fit)(df, target=o.target, **args)
            for i, share in enumerate(fit.get("shares", [])):
                note("reduce", "explained_share", share, f"pca_{i + 1}")
        else:
            made, told = {"variance_threshold": reduction.variance_threshold, "select_k_best": reduction.select_k_best}[o.reduction](df, target=o.target, **args)
            fit = {"columns": columns, "kept": [c for c in columns if c in made.columns]}
            for c in told:
                note("reduce", "score" if isinstance(told, dict) else "dropped", told[c] if isinstance(told, dict) else 1, c)
        out.steps["reduce"] = fit
        df = out._reduce(df)
    return out, df


def tabular_chain(df: DataFrame, o: ChainOptions) -> DataFrame:
    """The training rows only."""
    return fit_chain(df, o)[1]
