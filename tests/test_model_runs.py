"""Runs that go on where they stopped, checks on both tables, and models that have to learn."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nocturne.operators import models

FOREST = {"random_forest": {"n_estimators": 8, "max_depth": 3}}


@pytest.fixture(scope="module")
def signal(spark):
    """Two features carry the class, one is noise, one is constant."""
    rnd = np.random.default_rng(2)
    y = rnd.integers(0, 2, 240)
    frame = pd.DataFrame({"subject": [f"s{i % 12}" for i in range(240)], "y": y, "a": y + rnd.normal(scale=0.6, size=240), "b": -y + rnd.normal(scale=0.6, size=240), "noise": rnd.normal(size=240), "flat": 1.0})
    return spark.createDataFrame(frame).cache()


def test_a_second_call_fits_nothing_and_a_half_run_goes_on(spark, signal, tmp_path, monkeypatch):
    fits = []
    fit = models.fit_model
    monkeypatch.setattr(models, "fit_model", lambda *a, **k: fits.append(a[3]) or fit(*a, **k))
    search = models.Search({"random_forest": {"max_depth": [2]}}, "accuracy", inner_splits=2)
    call = lambda k=3: models.run_subject_cv(signal, "subject", "y", ["a", "b", "noise"], FOREST, k=k, task="binary", search=search, store=str(tmp_path / "run"))
    first = call()
    assert len(fits) == 4 * 3  # three folds and the final fit, each with two inner folds
    rows = sorted(map(tuple, first.metrics.collect()))
    again = call()
    assert len(fits) == 12 and sorted(map(tuple, again.metrics.collect())) == rows
    assert {t["fold"] for t in again.tuning} == {"0", "1", "2", "final"} and again.tuning == first.tuning
    a, b = (models.predict(run.finals["random_forest"], signal).select("y_pred").collect() for run in (first, again))
    assert a == b
    for part in ("metrics", "confusion", "roc"):
        assert spark.read.parquet(f"{tmp_path}/run/{part}").select("fold_id").distinct().count() == 3
    (tmp_path / "run" / "manifest" / "model=random_forest" / "fold=1").rename(tmp_path / "gone")  # as if the run had stopped in this fold
    half = call()
    assert len(fits) == 12 + 3 and sorted(map(tuple, half.metrics.collect())) == rows
    recount = half.predictions.groupBy("model", "fold_id").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("again"), F.count("*").alias("n"))
    both = half.metrics.join(recount, ["model", "fold_id"]).collect()
    assert len(both) == 3 and all(r.accuracy == pytest.approx(r.again) for r in both) and sum(r.n for r in both) == 240


@pytest.mark.parametrize("name", ["random_forest", "boosted_trees", "kernel_margin"])
def test_models_learn_a_planted_signal(signal, name):
    """A model that ignores its features fails here: the area under the curve on unseen subjects, and chance on labels without signal."""
    small = {"random_forest": {"n_estimators": 20, "max_depth": 4}, "boosted_trees": {"n_estimators": 10, "max_depth": 2}, "kernel_margin": {}}[name]
    run = models.run_subject_cv(signal, "subject", "y", ["a", "b", "noise", "flat"], {name: small}, k=2, task="binary", refit=False)
    assert all(r.auc_roc > 0.85 for r in run.metrics.collect())


def test_scale_is_one_over_the_variance_of_the_matrix(signal):
    fitted = models.fit_model(signal, ["a", "b", "noise", "flat"], "y", "kernel_margin", {"max_iter": 2}, task="binary")
    assert fitted.kernel["gamma"] == pytest.approx(1 / (4 * 0.75), rel=1e-2)  # three standardised columns and a constant one
    assert models.fit_model(signal, ["a", "flat"], "y", "kernel_margin", {"max_iter": 2, "gamma": "auto"}, task="binary").kernel["gamma"] == 0.5


def test_cross_dataset_labels_and_targets(spark):
    train = spark.createDataFrame([("a", "N1", 1.0), ("a", "N2", 2.0), ("b", "N1", 1.1), ("b", "N2", 2.1), ("c", "N3", 3.0), ("c", "N3", 3.1)], "subject string, stage string, x double")
    other = spark.createDataFrame([("x", "N1", 1.5), ("x", "W", 0.5), ("y", "N2", 2.5), ("y", "W", 0.4)], "subject string, stage string, x double")
    run = models.run_cross_dataset(train, other, "subject", "stage", FOREST, labels=["N1", "N2"])
    assert sorted(r.y_true for r in run.predictions.collect()) == ["N1", "N2"] and run.finals["random_forest"].labels == ["N1", "N2"]
    with pytest.raises(models.FitError, match="labels not in training"):
        models.run_cross_dataset(train, other, "subject", "stage", FOREST)
    with pytest.raises(ValueError, match="no row"):
        models.run_cross_dataset(train, other, "subject", "stage", FOREST, labels=["N3"])
    binary = lambda values: spark.createDataFrame([(f"s{i}", v, float(i)) for i, v in enumerate(values)], "subject string, y int, x double")
    with pytest.raises(ValueError, match="single_class"):
        models.run_cross_dataset(binary([1, 1]), binary([0, 1]), "subject", "y", FOREST, task="binary")
    with pytest.raises(ValueError, match="not_zero_one"):
        models.run_cross_dataset(binary([0, 1]), binary([0, 2]), "subject", "y", FOREST, task="binary")


def test_programming_errors_of_a_search_are_raised(signal, monkeypatch):
    def broken(*a, **k):
        raise ValueError("not about the rows")

    monkeypatch.setattr(models, "fit_model", broken)
    with pytest.raises(ValueError, match="not about the rows"):
        models.nested_grid_search(signal, "subject", "y", ["a"], "random_forest", models.Search({"random_forest": {"max_depth": [2]}}, "accuracy", 2), task="binary")
