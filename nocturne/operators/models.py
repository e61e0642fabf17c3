"""Spark ML models on subject-wise folds: fit, predict, search, cross-dataset and two-target runs.

The driver goes over models, folds and grid points only, a few at a time; every fit and every
prediction is a distributed job.  A tree's levels are one job after the other, so fits side by side fill the cluster.
"""
from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LinearSVC, LinearSVCModel, OneVsRest, OneVsRestModel, RandomForestClassificationModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from nocturne.operators import folds as fold_ops
from nocturne.operators import metrics
from nocturne.operators.balance import smote_to_reference_minus, with_class_weight
from nocturne.operators.encoding import categories
from nocturne.operators.forest import Forest, fit_forest, tasks_for
from nocturne.operators.filters import label_subset, task_rows, validate_binary_target, validate_cv_ready
from nocturne.operators.grown import GrownForest
from nocturne.operators.joins import assign_fold
from nocturne.operators.reporting import best_params_summary, fold_metrics_summary
from nocturne.operators.runs import RunStore
from nocturne.operators.scaling import apply_impute_scale, fit_impute_scale
from nocturne.operators.schema import q, resolve_features_cross
from nocturne.session import keep

# Default hyperparameters and the scorings each task may use.
DEFAULTS = {
    "random_forest": {"n_estimators": 200, "max_depth": None, "min_samples_leaf": 1, "class_weight": None},
    "boosted_trees": {"n_estimators": 150, "max_depth": 4, "learning_rate": 0.1, "subsample": 1.0, "colsample": 1.0, "class_weight": None},
    "kernel_margin": {"C": 1.0, "gamma": "scale", "n_components": 128, "max_iter": 50, "class_weight": None},
}
SCORINGS = {"multiclass": ("accuracy", "macro_f1", "cohen_kappa"), "binary": ("accuracy", "sensitivity", "specificity", "auc_roc")}
FALLBACK_SCORING = {"multiclass": "macro_f1", "binary": "auc_roc"}
DEEPEST = 30  # the deepest tree Spark ML grows
MOST_FITS = 4  # fits side by side
NODE_MEMORY_MB = 512  # for the statistics of the nodes that a job of a tree fit splits
BOOSTED_A_TASK = 30_000  # rows; boosting is some hundred short jobs, and a task of few rows costs more to start than to run


class FitError(ValueError):
    """The rows don't allow this fit: a single class, too few rows to resample, or labels that training hasn't seen."""


def together(jobs: list[Callable]) -> list:
    """Results of the jobs in their order, ``MOST_FITS`` at a time; where the scheduler is fair, each has its pool."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    spark = SparkSession.getActiveSession()

    def pooled(i: int, job: Callable) -> Callable:
        def run():
            if spark is not None:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit{i % MOST_FITS}")
            return job()

        return inheritable_thread_target(spark)(run) if spark is not None else run

    with ThreadPoolExecutor(MOST_FITS) as pool:
        return [f.result() for f in [pool.submit(pooled(i, job)) for i, job in enumerate(jobs)]]


def scoring_for(task: str, scoring: str, fallback: bool = False) -> str:
    key = scoring.strip().lower()
    if key in SCORINGS[task]:
        return key
    if fallback:
        return FALLBACK_SCORING[task]
    raise ValueError(f"scoring {scoring!r} is not defined for {task}")


@dataclass
class Fitted:
    """A model with everything needed to apply it to new rows."""

    name: str
    task: str
    features: list[str]
    labels: list[str]
    prep: dict
    model: object
    params: dict
    kernel: dict = field(default_factory=dict)


def encode_labels(df: DataFrame, target: str, order: list[str] | None = None) -> list[str]:
    """Labels by code: sorted, or first the present ones of ``order`` and then the others sorted."""
    seen = [str(x) for x in categories(df.select(q(target).cast("string").alias(target)), target)]
    first = [x for x in order or [] if x in seen]
    return first + [x for x in seen if x not in first]


def label_table(df: DataFrame, target: str, order: list[str] | None = None) -> DataFrame:
    rows = list(enumerate(encode_labels(df, target, order)))
    return df.sparkSession.createDataFrame([(label, i) for i, label in rows], "label string, code int")


def _code(target: str, labels: list[str]):
    return F.coalesce(*[F.when(q(target).cast("string") == x, F.lit(float(i))) for i, x in enumerate(labels)])


def _float32(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: q(c).cast("float").cast("double") for c in features})


def _kernel_map(ready: DataFrame, features: list[str], params: dict, seed: int) -> dict:
    """The kernel's width: ``auto`` is one over the number of features, ``scale`` that over the variance of all numbers of the training matrix."""
    gamma, p = params["gamma"], len(features)
    if gamma in ("scale", "auto"):
        spread = 1.0
        if gamma == "scale":
            cells = [q(c).cast("double") for c in features]
            mean, square = ready.agg(F.avg(sum(cells[1:], cells[0]) / p), F.avg(sum((c * c for c in cells[1:]), cells[0] * cells[0]) / p)).first()
            spread = square - mean * mean
        gamma = 1.0 / (p * spread) if spread > 1e-12 else 1.0
    return {"gamma": float(gamma), "n": int(params["n_components"]), "seed": seed, "p": p}


def _fourier_features(vector, kernel: dict):
    """Random Fourier features of the Gaussian kernel; an inner product of them approximates it."""
    rng = np.random.default_rng(kernel["seed"])
    w = rng.normal(0, np.sqrt(2 * kernel["gamma"]), (kernel["p"], kernel["n"]))
    shift = rng.uniform(0, 2 * np.pi, kernel["n"])

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        x = np.stack(batch.to_numpy()).astype(float) if len(batch) else np.zeros((0, kernel["p"]))
        return pd.Series(list(np.sqrt(2 / kernel["n"]) * np.cos(x @ w + shift)))

    return run(vector)


def _vectors(df: DataFrame, features: list[str], kernel: dict) -> DataFrame:
    if kernel:
        return df.withColumn("_x", array_to_vector(_fourier_features(F.array(*[q(c) for c in features]), kernel)))
    return VectorAssembler(inputCols=features, outputCol="_x").transform(df)


def _classifier(name: str, params: dict, n_classes: int, n_rows: int, seed: int, weight: str | None):
    common = {"featuresCol": "_x", "labelCol": "_y", **({"weightCol": weight} if weight else {})}
    if name == "boosted_trees":
        one = GBTClassifier(maxIter=params["n_estimators"], maxDepth=params["max_depth"], stepSize=params["learning_rate"], subsamplingRate=params["subsample"], featureSubsetStrategy="all" if params["colsample"] >= 1 else str(params["colsample"]), maxMemoryInMB=NODE_MEMORY_MB, seed=seed, **common)
    elif name == "kernel_margin":
        one = LinearSVC(maxIter=params["max_iter"], regParam=1.0 / (params["C"] * max(n_rows, 1)), standardization=False, **common)
    else:
        raise ValueError(f"unknown model {name!r}")
    return one if n_classes == 2 else OneVsRest(classifier=one, parallelism=min(n_classes, 4), **common)


def fit_model(train: DataFrame, features: list[str], target: str, name: str, params: dict | None = None, *, task: str = "multiclass", seed: int = 42, resampling: dict | None = None) -> Fitted:
    """Impute (and for the kernel model scale) on the training rows, resample, encode and fit."""
    p = {**DEFAULTS[name], **(params or {})}
    rows = _float32(train.select(*features, q(target).cast("string").alias(target)).filter(q(target).isNotNull()), features)
    prep = fit_impute_scale(rows, features, scale=name == "kernel_margin")
    ready = apply_impute_scale(rows, prep)
    if resampling:
        try:
            ready = smote_to_reference_minus(ready, target, **resampling)
        except ValueError as e:
            raise FitError(str(e)) from e
    labels = encode_labels(ready, target)
    if len(labels) < 2:
        raise FitError("the training rows hold a single class")
    weight = None
    if p.get("class_weight"):
        ready, weight = with_class_weight(ready, target, "_w"), "_w"
    kernel = _kernel_map(ready, features, p, seed) if name == "kernel_margin" else {}
    data = _vectors(ready.withColumn("_y", _code(target, labels)), features, kernel).select("_x", "_y", *([weight] if weight else []))
    n_rows = ready.count()
    if name == "random_forest":
        data = data.repartition(tasks_for(n_rows))
    elif name == "boosted_trees":
        data = data.repartition(max(1, math.ceil(n_rows / BOOSTED_A_TASK)))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)  # every step of a fit reads it
    try:
        if name == "random_forest":
            settings = {"featuresCol": "_x", "labelCol": "_y", **({"weightCol": weight} if weight else {})}
            model = fit_forest(data, n_rows, p["n_estimators"], seed, maxDepth=p["max_depth"] or DEEPEST, minInstancesPerNode=p["min_samples_leaf"], **settings)
        else:
            model = _classifier(name, p, len(labels), n_rows, seed, weight).fit(data)
    finally:
        data.unpersist()
    return Fitted(name, task, features, labels, prep, model, p, kernel)


def predict(fitted: Fitted, df: DataFrame, target: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``y_pred`` and, for two classes, ``y_score``; a truth label unknown to the model is an error."""
    if target:
        unknown = df.filter(q(target).isNotNull() & ~q(target).cast("string").isin(*fitted.labels)).select(q(target).cast("string")).distinct().take(5)
        if unknown:
            raise FitError(f"labels not in training: {[r[0] for r in unknown]}")
    data = df.select(*[q(c) for c in keep or df.columns], *[q(c).alias(f"_f_{i}") for i, c in enumerate(fitted.features)])
    names = [f"_f_{i}" for i in range(len(fitted.features))]
    prep = {"medians": {n: fitted.prep["medians"][c] for n, c in zip(names, fitted.features)}, "scale": {n: fitted.prep["scale"][c] for n, c in zip(names, fitted.features) if c in fitted.prep["scale"]}}
    out = fitted.model.transform(_vectors(apply_impute_scale(_float32(data, names), prep), names, fitted.kernel))
    score = F.lit(None).cast("double")
    if fitted.task == "binary" and "probability" in out.columns:
        score = vector_to_array("probability")[1]
    elif fitted.task == "binary" and "rawPrediction" in out.columns:
        score = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    label = F.element_at(F.array(*map(F.lit, fitted.labels)), (F.col("prediction") + 1).cast("int"))
    return out.select(*[q(c) for c in keep or df.columns], label.alias("y_pred"), score.alias("y_score"))


def evaluate(preds: DataFrame, keys: list[str], task: str) -> DataFrame:
    if task == "binary":
        return metrics.binary_metrics(preds, keys, score="y_score")
    return metrics.multiclass_metrics(preds, keys)


def fold_predictions(fitted: Fitted, test: DataFrame, target: str, subject: str, fold: int) -> DataFrame:
    out = predict(fitted, test, target, keep=[subject, target])
    return out.select(q(target).cast("string").alias("y_true"), "y_pred", "y_score", q(subject).cast("string").alias("subject_id"), F.lit(fold).alias("fold_id"), F.lit(fitted.name).alias("model"))


def with_folds(df: DataFrame, subject: str, target: str, k: int, seed: int, stratify: bool = True) -> DataFrame:
    """Rows with a fold, written once: every fit of the run reads the same files."""
    dealt = fold_ops.stratified_group_folds(df, subject, target, k, seed) if stratify else fold_ops.group_folds(df, subject, k)
    return keep(assign_fold(df, dealt.select(subject, "fold"), subject))


def grid(space: dict[str, list]) -> list[dict]:
    names = sorted(space)
    return [dict(zip(names, values)) for values in product(*[space[n] for n in names])] if space else []


@dataclass
class Search:
    space: dict[str, dict[str, list]]
    scoring: str = "macro_f1"
    inner_splits: int = 3
    subsample: dict | None = None  # fraction and min_subjects, for the kernel model


def nested_grid_search(train: DataFrame, subject: str, target: str, features: list[str], name: str, search: Search, base: dict | None = None, *, task: str = "multiclass", seed: int = 42, resampling: dict | None = None) -> tuple[dict, float | None, list[dict]]:
    """Best parameters by the mean score over inner subject folds.

    The first of equal scores wins; a candidate whose fit fails is left out; with
    no candidate the base parameters are returned.
    """
    key, base = scoring_for(task, search.scoring), dict(base or {})
    candidates = grid(search.space.get(name, {}))
    if not candidates:
        return base, None, []
    rows = train.select(subject, target, *features)
    if name == "kernel_margin" and search.subsample:
        rows = fold_ops.subsample_with_coverage(rows, subject, target, inner_splits=search.inner_splits, seed=seed, **search.subsample)
    validate_cv_ready(rows, subject, search.inner_splits)
    inner = with_folds(rows, subject, target, search.inner_splits, seed)
    best, best_score, table = base, None, []

    def inner_fold(params: dict, f: int) -> DataFrame | None:
        try:
            m = fit_model(inner.filter(F.col("fold") != f), features, target, name, params, task=task, seed=seed, resampling=resampling)
            return fold_predictions(m, inner.filter(F.col("fold") == f), target, subject, f)
        except FitError:
            return None

    units = [({**base, **c}, f) for c in candidates for f in range(search.inner_splits)]
    done = together([lambda params=params, f=f: inner_fold(params, f) for params, f in units])
    for i, c in enumerate(candidates):
        params, parts = {**base, **c}, done[i * search.inner_splits : (i + 1) * search.inner_splits]
        if any(part is None for part in parts):
            continue
        got = [r[key] for r in evaluate(reduce(DataFrame.unionByName, parts), ["fold_id"], task).select(key).collect()]
        if not got or any(v is None for v in got):
            continue
        score = float(np.mean(got))
        table.append({"params": json.dumps(params, sort_keys=True), "score": score})
        if best_score is None or score > best_score:
            best, best_score = params, score
    return best, best_score, table


@dataclass
class CvRun:
    predictions: DataFrame
    metrics: DataFrame
    finals: dict[str, Fitted]
    tuning: list[dict]

    def summary(self, names: list[str]) -> DataFrame:
        return fold_metrics_summary(self.metrics, names)

    def best_params(self, spark: SparkSession) -> DataFrame:
        return best_params_summary(spark.createDataFrame(self.tuning, "model string, fold string, params string, inner_score double"))


def _state(m: Fitted) -> dict:
    return {"task": m.task, "prep": m.prep, "params": m.params, "kernel": m.kernel, "reader": type(m.model).__name__}


def run_subject_cv(df: DataFrame, subject: str, target: str, features: list[str], models: dict[str, dict], *, k: int = 5, task: str = "multiclass", seed: int = 42, search: Search | None = None, resampling: dict | None = None, labels: list[str] | None = None, done: set | None = None, refit: bool = True, stratify: bool = True, folded: DataFrame | None = None, store: str | None = None) -> CvRun:
    """Every model on every fold, then a final fit on all rows.  ``done`` (model, fold) pairs are skipped.

    With ``store`` each fold's predictions and model and each final model are written to that folder as they are made (see ``runs``); a second call
    takes what is there and fits only what is missing, and its result covers all folds.
    """
    if folded is None:
        data = df.select(subject, target, *features).filter(q(target).isNotNull())
        data = label_subset(data, target, labels) if labels else data
        if task == "binary":
            validate_binary_target(data, target)
        validate_cv_ready(data, subject, k)
        folded = with_folds(data, subject, target, k, seed, stratify)
    spark = folded.sparkSession
    run = RunStore(spark, store) if store else None
    kept = {(r["model"], r["fold"]): r for r in run.manifest().collect()} if run else {}  # a row per model and fold

    def choose(rows, name, params):
        if not search:
            return params, None
        return nested_grid_search(rows, subject, target, features, name, search, params, task=task, seed=seed, resampling=resampling)[:2]

    def unit(name: str, fold: int | str):
        train = folded if fold == "final" else folded.filter(F.col("fold") != fold)
        chosen, score = choose(train, name, models[name])
        m = fit_model(train, features, target, name, chosen, task=task, seed=seed, resampling=resampling)
        preds = None if fold == "final" else fold_predictions(m, folded.filter(F.col("fold") == fold), target, subject, fold)
        if run:
            path = run.model_path(name, str(fold))
            if preds is not None:
                run.write_predictions(preds, name, fold)
            m.model.write().overwrite().save(path)
            run.finish(name, str(fold), path, m.features, m.labels, _state(m), chosen, score)
        return m, preds, chosen, score

    units = [(name, f) for name in models for f in [*range(k), *(["final"] if refit else [])] if not (done and (name, f) in done)]
    missing = [u for u in units if (u[0], str(u[1])) not in kept]
    if not any(f != "final" for _, f in missing) and not kept:
        raise ValueError("every model and fold is already done")
    made = dict(zip(missing, together([lambda u=u: unit(*u) for u in missing])))
    finals, tuning = {}, []
    for name, f in units:
        if (name, f) in made:
            m, _, chosen, score = made[name, f]
            written = json.dumps(chosen, sort_keys=True)
        else:
            row = kept[name, str(f)]
            m, written, score = None, row["chosen"], row["inner_score"]
        if f == "final":
            finals[name] = m or load_model({**row.asDict(), "algorithm": name})
        if search:
            tuning.append({"model": name, "fold": str(f), "params": written, "inner_score": score})
    preds = run.predictions() if run else reduce(DataFrame.unionByName, [p for _, p, _, _ in made.values() if p is not None])
    out = CvRun(preds, evaluate(preds, ["model", "fold_id"], task), finals, tuning)
    if run and missing:
        run.write_table(out.metrics, "metrics")
        run.write_table(metrics.confusion_matrix(preds, ["model", "fold_id"]), "confusion")
        if task == "binary":
            run.write_table(metrics.roc_points(preds, ["model", "fold_id"]), "roc")
    return out


def run_cross_dataset(train: DataFrame, other: DataFrame, subject: str, target: str, models: dict[str, dict], *, task: str = "multiclass", features: list[str] | None = None, exclude=(), seed: int = 42, search: Search | None = None, resampling: dict | None = None, labels: list[str] | None = None, zero_one: bool = True) -> CvRun:
    """Fit on one table (searching there only) and evaluate on the other with the shared features.

    ``labels`` keeps the rows of both tables that have one of them. A binary target is checked on both: training needs both classes, and with ``zero_one`` its values are 0 and 1.
    """
    cols = features or resolve_features_cross(train, other, exclude=[subject, target, *exclude])
    train, other = train.filter(q(target).isNotNull()), other.filter(q(target).isNotNull())
    if labels:
        train, other = label_subset(train, target, labels), label_subset(other, target, labels)
    if task == "binary":
        validate_binary_target(train, target, relaxed=not zero_one)
        validate_binary_target(other, target, training=False, relaxed=not zero_one)

    def unit(name: str):
        best, tuned = models[name], None
        if search:
            best, score, _ = nested_grid_search(train, subject, target, cols, name, search, models[name], task=task, seed=seed, resampling=resampling)
            tuned = {"model": name, "fold": "train", "params": json.dumps(best, sort_keys=True), "inner_score": score}
        m = fit_model(train, cols, target, name, best, task=task, seed=seed, resampling=resampling)
        return m, fold_predictions(m, other, target, subject, 0), tuned

    made = dict(zip(models, together([lambda name=name: unit(name) for name in models])))
    preds = reduce(DataFrame.unionByName, [p for _, p, _ in made.values()])
    return CvRun(preds, evaluate(preds, ["model"], task), {name: m for name, (m, _, _) in made.items()}, [t for _, _, t in made.values() if t])


TASKS = {"stage": ("multiclass", "label_mask_stage"), "apnea": ("binary", "label_mask_apnea")}


def _two_target_metrics(runs: dict[str, CvRun], keys: list[str]) -> DataFrame:
    s = runs["stage"].metrics.select(*keys, *[F.col(c).alias(f"stage_{c}") for c in ("accuracy", "macro_f1", "cohen_kappa")])
    a = runs["apnea"].metrics.select(*keys, *[F.col(c).alias(f"apnea_{c}") for c in ("accuracy", "sensitivity", "specificity", "auc_roc", "n_samples")])
    return s.join(a, keys, "full")


def _task_search(search: Search | None, task: str) -> Search | None:
    return Search(search.space, scoring_for(task, search.scoring, fallback=True), search.inner_splits, search.subsample) if search else None


def run_multitarget_cv(df: DataFrame, subject: str, features: list[str], models: dict[str, dict], *, stage: str = "sleep_stage", apnea: str = "apnea_binary", k: int = 5, seed: int = 42, search: Search | None = None, refit: bool = False, store: str | None = None) -> tuple[dict[str, CvRun], DataFrame]:
    """Both tasks on one shared fold table; returns the runs and one joined metric row per model and fold. ``store`` as in ``run_subject_cv``, a folder per task."""
    folded = keep(fold_ops.with_shared_folds(df, subject, k, stage=stage, apnea=apnea, seed=seed))
    runs = {}
    for name, (task, mask) in TASKS.items():
        target = stage if name == "stage" else apnea
        rows = task_rows(folded, mask)
        if task == "binary":
            rows = rows.withColumn(target, q(target).cast("int"))
        runs[name] = run_subject_cv(rows, subject, target, features, models, k=k, task=task, seed=seed, search=_task_search(search, task), refit=refit, folded=rows, store=f"{store}/{name}" if store else None)
    return runs, _two_target_metrics(runs, ["model", "fold_id"])


def run_multitarget_cross(train: DataFrame, other: DataFrame, subject: str, features: list[str], models: dict[str, dict], *, stage: str = "sleep_stage", apnea: str = "apnea_binary", seed: int = 42, search: Search | None = None) -> tuple[dict[str, CvRun], DataFrame]:
    runs = {}
    for name, (task, mask) in TASKS.items():
        target = stage if name == "stage" else apnea
        a, b = task_rows(train, mask), task_rows(other, mask)
        if task == "binary":
            a, b = (t.withColumn(target, q(target).cast("int")) for t in (a, b))
        runs[name] = run_cross_dataset(a, b, subject, target, models, task=task, features=features, seed=seed, search=_task_search(search, task))
    return runs, _two_target_metrics(runs, ["model"])


def feature_importance(spark: SparkSession, fitted: Fitted, top: int = 10) -> DataFrame:
    """The most important features of a tree model; one-against-rest models are averaged."""
    parts = fitted.model.models if isinstance(fitted.model, OneVsRestModel) else [fitted.model]
    if not all(hasattr(m, "featureImportances") for m in parts):
        raise ValueError(f"{fitted.name} has no feature importances")
    weight = np.mean([m.featureImportances.toArray() for m in parts], axis=0)
    rows = [(c, float(w)) for c, w in zip(fitted.features, weight)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


REGISTRY = "experiment string, dataset string, algorithm string, artifact_type string, mode string, fold string, path string, features array<string>, labels array<string>, state string"
READERS = {"RandomForestClassificationModel": RandomForestClassificationModel, "GBTClassificationModel": GBTClassificationModel, "LinearSVCModel": LinearSVCModel, "OneVsRestModel": OneVsRestModel, "Forest": Forest, "GrownForest": GrownForest}


def save_models(spark: SparkSession, models: dict[tuple[str, str], Fitted], root: str, *, experiment: str, dataset: str, mode: str) -> DataFrame:
    """Save models by (name, fold) with Spark ML persistence; returns the registry, also written next to them."""
    rows = []
    for (name, fold), m in models.items():
        path = f"{root}/models/{name}_{fold}"
        m.model.write().overwrite().save(path)
        state = json.dumps(_state(m))
        rows.append((experiment, dataset, name, "final" if fold == "final" else "fold", mode, fold, path, m.features, m.labels, state))
    out = spark.createDataFrame(rows, REGISTRY)
    out.write.mode("overwrite").parquet(f"{root}/registry")
    return spark.read.parquet(f"{root}/registry")


def load_model(row) -> Fitted:
    """A saved model from its registry row."""
    s = json.loads(row["state"])
    scale = {c: tuple(v) for c, v in s["prep"]["scale"].items()}
    return Fitted(row["algorithm"], s["task"], list(row["features"]), list(row["labels"]), {"medians": s["prep"]["medians"], "scale": scale}, READERS[s["reader"]].load(row["path"]), s["params"], s["kernel"])
