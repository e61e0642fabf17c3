"""Queries: Spark ML fits on epoch features."""
from __future__ import annotations

from pyspark.sql import functions as F

from nocturne.functions.signal import export_features
from nocturne.operators import models, schema
from nocturne.plans import views
from nocturne.plans.views import ARRAYS, EPOCHS, Catalog
from nocturne.session import keep, shared_dir

catalog = Catalog()
add = catalog.add

PREFIX = "eeg_"
STAGES = {0: "W", 1: "N1", 2: "N2", 3: "N3", 4: "REM"}


def features(spark, sf):
    a = views.arrays(spark, sf)
    stage = F.coalesce(*[F.when(F.col("stage_code") == i, s) for i, s in STAGES.items()])
    f = export_features(a, "signal", 64.0)
    f = f.select(F.col("recording_id").alias("subject"), "vec_id", stage.alias("sleep_stage"), "apnea_binary", *[c for c in f.columns if c.startswith(PREFIX)])
    return keep(schema.label_masks_strict(f))


def columns_of(f):
    """All exported features."""
    return [c for c in f.columns if c.startswith(PREFIX)]


def _fit(spark, sf, name, target, task):
    f = features(spark, sf).filter(F.col(target).isNotNull())
    if task == "binary":
        f = f.withColumn(target, F.col(target).cast("int"))
    train, test = f.filter("subject % 5 <> 0"), f.filter("subject % 5 = 0")
    m = models.fit_model(train, columns_of(f), target, name, {"class_weight": "balanced"}, task=task)
    return models.predict(m, test, target, keep=["vec_id", target])


@add("l4_fit_random_forest")
def l4(spark, sf):
    return _fit(spark, sf, "random_forest", "sleep_stage", "multiclass")


@add("l5_fit_boosted_trees")
def l5(spark, sf):
    return _fit(spark, sf, "boosted_trees", "apnea_binary", "binary")


@add("l5_fit_boosted_trees_multiclass")
def l5b(spark, sf):
    return _fit(spark, sf, "boosted_trees", "sleep_stage", "multiclass")


@add("l6_fit_kernel_margin")
def l6(spark, sf):
    return _fit(spark, sf, "kernel_margin", "apnea_binary", "binary")


@add("l7_encode_labels", f"WITH {EPOCHS}, l AS (SELECT DISTINCT sleep_stage AS label FROM v_epochs) SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM l")
def l7(spark, sf):
    return models.label_table(views.staged(spark, sf), "sleep_stage")


@add("l7_encode_labels_ordered", f"WITH {EPOCHS}, l AS (SELECT DISTINCT sleep_stage AS label FROM v_epochs) SELECT label, CAST(row_number() OVER (ORDER BY CASE label WHEN 'W' THEN 0 WHEN 'REM' THEN 1 ELSE 2 END, label) - 1 AS INTEGER) AS code FROM l")
def l7b(spark, sf):
    return models.label_table(views.staged(spark, sf), "sleep_stage", ["W", "REM", "absent"])


@add("l8_run_subject_cv")
def l8(spark, sf):
    run = models.run_subject_cv((f := features(spark, sf)), "subject", "sleep_stage", columns_of(f), {"random_forest": {}}, k=5, refit=True)
    return run.metrics


@add("l8_subject_cv_coverage", f"WITH {ARRAYS} SELECT 'random_forest' AS model, count(*) AS n_rows, count(DISTINCT recording_id) AS n_subjects, 5::BIGINT AS n_folds, 1::BIGINT AS folds_per_subject FROM v_arrays")
def l8b(spark, sf):
    """Each row is predicted exactly once and no subject is split over folds."""
    p = models.run_subject_cv((f := features(spark, sf)), "subject", "sleep_stage", columns_of(f), {"random_forest": {}}, k=5, refit=True).predictions
    per = p.groupBy("model", "subject_id").agg(F.count("*").alias("n"), F.count_distinct("fold_id").alias("k"))
    folds = p.groupBy("model").agg(F.count_distinct("fold_id").alias("n_folds"))
    return per.groupBy("model").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_subjects"), F.max("k").alias("folds_per_subject")).join(folds, "model")


@add("l9_nested_grid_search")
def l9(spark, sf):
    search = models.Search({"random_forest": {"max_depth": [None, 10]}}, "macro_f1")
    best, score, table = models.nested_grid_search((f := features(spark, sf)), "subject", "sleep_stage", columns_of(f), "random_forest", search)
    rows = [(t["params"], t["score"], t["score"] == score) for t in table]
    return spark.createDataFrame(rows, "params string, score double, best boolean")


@add("l10_run_cross_dataset")
def l10(spark, sf):
    f = features(spark, sf).drop("label_mask_apnea", "label_mask_stage", "apnea_binary", "vec_id")
    return models.run_cross_dataset(f.filter("subject % 2 = 0"), f.filter("subject % 2 = 1"), "subject", "sleep_stage", {"random_forest": {}}).metrics


@add("l11_run_multitarget_cv")
def l11(spark, sf):
    return models.run_multitarget_cv((f := features(spark, sf)), "subject", columns_of(f), {"random_forest": {}}, k=5, refit=True)[1]


@add("l11_run_multitarget_cross")
def l11b(spark, sf):
    f = features(spark, sf)
    return models.run_multitarget_cross(f.filter("subject % 2 = 0"), f.filter("subject % 2 = 1"), "subject", columns_of(f), {"random_forest": {}})[1]


@add("l12_feature_importance")
def l12(spark, sf):
    f = features(spark, sf)
    m = models.fit_model(f, columns_of(f), "sleep_stage", "random_forest")
    return models.feature_importance(spark, m, 5)


@add("l13_model_registry", "SELECT 'demo' AS experiment, 'arrays' AS dataset, 'random_forest' AS algorithm, 'final' AS artifact_type, 'cv' AS mode, 'final' AS fold, 24::BIGINT AS n_features, (SELECT count(DISTINCT label % 5) FROM embeddings) AS n_labels, (SELECT count(*) FROM embeddings) AS n_rows, (SELECT count(*) FROM embeddings) AS n_equal")
def l13(spark, sf):
    """A saved and reloaded model predicts as before."""
    f = features(spark, sf)
    m = models.fit_model(f, columns_of(f), "sleep_stage", "random_forest")
    reg = models.save_models(spark, {("random_forest", "final"): m}, shared_dir(spark), experiment="demo", dataset="arrays", mode="cv")
    again = models.load_model(reg.first())
    a = models.predict(m, f, keep=["vec_id"]).select("vec_id", F.col("y_pred").alias("a"))
    b = models.predict(again, f, keep=["vec_id"]).select("vec_id", F.col("y_pred").alias("b"))
    same = a.join(b, "vec_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("a") == F.col("b")).alias("n_equal")).first()
    return reg.select("experiment", "dataset", "algorithm", "artifact_type", "mode", "fold", F.size("features").cast("bigint").alias("n_features"), F.size("labels").cast("bigint").alias("n_labels"), F.lit(same["n_rows"]).alias("n_rows"), F.lit(same["n_equal"]).alias("n_equal"))


# What holds for any fitted model, with SQL.
STAGE_NAMES = "('W', 'N1', 'N2', 'N3', 'REM')"


def _checked(p, known):
    """Rows, distinct rows, predictions outside the known labels and scores outside [0, 1]."""
    bad = ~F.col("y_score").between(0, 1) if "y_score" in p.columns else F.lit(False)
    return p.agg(F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("n_distinct"), F.count_if(~F.col("y_pred").isin(*known)).alias("n_unknown"), F.count_if(F.coalesce(bad, F.lit(False))).alias("n_bad_scores"))


def _checked_sql(where):
    return f"WITH {ARRAYS} SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_distinct, 0::BIGINT AS n_unknown, 0::BIGINT AS n_bad_scores FROM v_arrays WHERE recording_id % 5 = 0 AND {where}"


@add("l4_random_forest_checks", _checked_sql("TRUE"))
def l4c(spark, sf):
    return _checked(l4(spark, sf), STAGES.values())


@add("l5_boosted_trees_checks", _checked_sql("apnea_binary IS NOT NULL"))
def l5c(spark, sf):
    return _checked(l5(spark, sf), ["0", "1"])


@add("l6_kernel_margin_checks", _checked_sql("apnea_binary IS NOT NULL"))
def l6c(spark, sf):
    return _checked(l6(spark, sf), ["0", "1"])


@add("l8_subject_cv_checks", "SELECT 5::BIGINT AS n_rows, 0::BIGINT AS n_bad")
def l8c(spark, sf):
    """The folds' metrics are those recomputed from the predictions."""
    f = features(spark, sf)
    run = models.run_subject_cv(f, "subject", "sleep_stage", columns_of(f), {"random_forest": {}}, k=5, refit=True)
    again = run.predictions.groupBy("fold_id").agg(F.avg((F.col("y_true").cast("string") == F.col("y_pred").cast("string")).cast("double")).alias("again"))
    fold = "fold_id" if "fold_id" in run.metrics.columns else "fold"
    both = run.metrics.withColumn("fold_id", F.col(fold)).select("fold_id", "accuracy").join(again, "fold_id", "left")
    return both.agg(F.count("*").alias("n_rows"), F.count_if(~F.coalesce(F.abs(F.col("accuracy") - F.col("again")) < 1e-9, F.lit(False))).alias("n_bad"))


@add("l9_grid_search_checks", "SELECT 2::BIGINT AS n_candidates, 1::BIGINT AS n_best, true AS best_is_highest")
def l9c(spark, sf):
    t = l9(spark, sf)
    return t.agg(F.count("*").alias("n_candidates"), F.count_if("best").alias("n_best"), (F.max("score") == F.max(F.when(F.col("best"), F.col("score")))).alias("best_is_highest"))


def _metric_bounds(m, columns):
    """Rows of a metrics table, and values outside [0, 1]."""
    wrong = [F.coalesce(~F.col(c).between(0, 1), F.lit(False)).cast("int") for c in columns if c in m.columns]
    return m.agg(F.count("*").alias("n_rows"), F.sum(sum(wrong, F.lit(0))).cast("bigint").alias("n_bad"), F.lit(len(wrong)).alias("n_metrics"))


@add("l10_cross_dataset_checks", "SELECT 1::BIGINT AS n_rows, 0::BIGINT AS n_bad, 2::INTEGER AS n_metrics")
def l10c(spark, sf):
    return _metric_bounds(l10(spark, sf), ["accuracy", "macro_f1"])


@add("l11_multitarget_cv_checks", "SELECT 5::BIGINT AS n_rows, 0::BIGINT AS n_bad, 3::INTEGER AS n_metrics")
def l11c(spark, sf):
    return _metric_bounds(l11(spark, sf), ["stage_accuracy", "stage_macro_f1", "apnea_accuracy"])


@add("l12_feature_importance_checks", "SELECT 24::BIGINT AS n_features, 1.0::DOUBLE AS total, 0::BIGINT AS n_negative")
def l12c(spark, sf):
    f = features(spark, sf)
    m = models.fit_model(f, columns_of(f), "sleep_stage", "random_forest")
    t = models.feature_importance(spark, m, 24)
    return t.agg(F.count("*").alias("n_features"), views.r(F.sum("importance")).alias("total"), F.count_if(F.col("importance") < 0).alias("n_negative"))
