"""Queries: metrics, statistics and summaries over predictions."""
from __future__ import annotations

from pyspark.sql import functions as F

from nocturne.operators import joins, metrics, reporting
from nocturne.plans import views
from nocturne.plans.views import MPREDS, PREDS, Catalog, r

catalog = Catalog()
add = catalog.add

STAGES = ["W", "N1", "N2", "N3", "REM"]


def _marginals(source, keys, truth="y_true", guess="y_pred"):
    k = "".join(f"{x}, " for x in keys)
    return f"""cm AS (SELECT {k}{truth} AS t, {guess} AS p, count(*) AS n FROM {source} GROUP BY ALL), side AS (SELECT {k}t AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, n AS nt, 0 AS np FROM cm UNION ALL SELECT {k}p, 0, 0, n FROM cm),
 marg AS (SELECT {k}label, sum(tp) AS tp, sum(nt) AS nt, sum(np) AS np, coalesce(2.0::DOUBLE * sum(tp) / nullif(sum(nt) + sum(np), 0), 0) AS f1 FROM side GROUP BY ALL)"""


def _multi_sql(source, keys, labels=(), **kw):
    k = "".join(f"{x}, " for x in keys)
    extra = "".join(f", round(coalesce(max(CASE WHEN label = '{c}' THEN f1 END), 0), 6) AS per_class_f1_{c.lower()}" for c in labels)
    return f"""{_marginals(source, keys, **kw)} SELECT {k}CAST(sum(nt) AS BIGINT) AS n_samples, round(sum(tp) / sum(nt), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
 round((sum(tp) / sum(nt) - sum(nt * np) / pow(sum(nt), 2)) / nullif(1 - sum(nt * np) / pow(sum(nt), 2), 0), 6) + 0.0 AS cohen_kappa{extra} FROM marg GROUP BY ALL"""


def _auc_sql(source, keys, score, name="auc_roc", truth="y_true"):
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    k = "".join(f"{x}, " for x in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {k}(sum(rk) FILTER (WHERE {truth} = 1) - count(*) FILTER (WHERE {truth} = 1) * (count(*) FILTER (WHERE {truth} = 1) + 1) / 2.0) / nullif(count(*) FILTER (WHERE {truth} = 1) * count(*) FILTER (WHERE {truth} <> 1), 0)::DOUBLE AS {name}
 FROM (SELECT *, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {k}{score}) - 1) / 2.0 AS rk FROM {source}) rr {group}"""


@add("m1_multiclass_metrics", f"WITH {MPREDS}, {_multi_sql('v_mpreds', ['fold_id'], STAGES)}")
def m1(spark, sf):
    m = metrics.multiclass_metrics(views.mpreds(spark, sf), ["fold_id"], labels=STAGES)
    return m.withColumns({c: r(c) for c in m.columns if c not in ("fold_id", "n_samples")})


def _bin_sql(source, pred, keys=("fold_id",)):
    k = "".join(f"{x}, " for x in keys)
    return f"""SELECT {k}count(*) AS n_samples, avg(CASE WHEN y_true = {pred} THEN 1.0 ELSE 0.0 END) AS accuracy, coalesce(sum(CASE WHEN y_true = 1 AND {pred} = 1 THEN 1 ELSE 0 END) / nullif(sum(y_true), 0), 0) AS sensitivity,
 coalesce(sum(CASE WHEN y_true = 0 AND {pred} = 0 THEN 1 ELSE 0 END) / nullif(count(*) - sum(y_true), 0), 0) AS specificity, count(*) FILTER (WHERE y_true = 0 AND {pred} = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND {pred} = 1) AS fp,
 count(*) FILTER (WHERE y_true = 1 AND {pred} = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND {pred} = 1) AS tp FROM {source} GROUP BY ALL"""


@add("m2_binary_metrics", f"WITH {PREDS}, b AS ({_bin_sql('v_preds', 'pred_a')}), a AS ({_auc_sql('v_preds', ['fold_id'], 'score_a')}) SELECT b.fold_id, n_samples, round(accuracy, 6) AS accuracy, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, tn, fp, fn, tp, round(auc_roc, 6) AS auc_roc FROM b JOIN a ON a.fold_id = b.fold_id")
def m2(spark, sf):
    m = metrics.binary_metrics(views.preds(spark, sf), ["fold_id"], "y_true", "pred_a", "score_a")
    return m.withColumns({c: r(c) for c in ("accuracy", "sensitivity", "specificity", "auc_roc")})


@add("m3_auc_roc", f"WITH {PREDS}, a AS ({_auc_sql('v_preds', ['subject_id'], 'score_b')}) SELECT subject_id, round(auc_roc, 6) AS auc_roc FROM a")
def m3(spark, sf):
    return metrics.auc_roc(views.preds(spark, sf), ["subject_id"], "y_true", "score_b").withColumn("auc_roc", r("auc_roc"))


@add("m4_confusion_matrix", f"WITH {MPREDS}, l AS (SELECT DISTINCT fold_id, sleep_stage FROM (SELECT fold_id, y_true AS sleep_stage FROM v_mpreds UNION ALL SELECT fold_id, y_pred FROM v_mpreds) t) SELECT a.fold_id, a.sleep_stage AS label_true, b.sleep_stage AS label_pred, (SELECT count(*) FROM v_mpreds m WHERE m.fold_id = a.fold_id AND m.y_true = a.sleep_stage AND m.y_pred = b.sleep_stage) AS cnt FROM l a JOIN l b ON a.fold_id = b.fold_id")
def m4(spark, sf):
    return metrics.confusion_matrix(views.mpreds(spark, sf), ["fold_id"])


@add("m5_roc_points", f"""WITH {PREDS}, s AS (SELECT fold_id, score_b AS threshold, sum(y_true) AS p, sum(1 - y_true) AS n FROM v_preds GROUP BY 1, 2), t AS (SELECT fold_id, sum(p) AS tp, sum(n) AS tn FROM s GROUP BY 1 HAVING sum(p) > 0 AND sum(n) > 0)
 SELECT fold_id, CAST(NULL AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM t UNION ALL SELECT s.fold_id, threshold, round(sum(n) OVER w / tn, 6), round(sum(p) OVER w / tp, 6) FROM s JOIN t ON s.fold_id = t.fold_id WINDOW w AS (PARTITION BY s.fold_id ORDER BY threshold DESC)""")
def m5(spark, sf):
    return metrics.roc_points(views.preds(spark, sf), ["fold_id"], "y_true", "score_b").withColumns({"fpr": r("fpr"), "tpr": r("tpr")})


@add("m6_mcnemar", f"""WITH {PREDS}, d AS (SELECT fold_id, count(*) FILTER (WHERE pred_a = y_true AND pred_b <> y_true) AS b, count(*) FILTER (WHERE pred_a <> y_true AND pred_b = y_true) AS c FROM v_preds GROUP BY 1),
 t AS (SELECT fold_id, b, c, unnest(range(least(b, c) + 1)) AS i FROM d) SELECT fold_id, b, c, round(pow(abs(b - c) - 1, 2) / (b + c), 6)::DOUBLE AS statistic, round(CASE WHEN b = c THEN 1 ELSE least(1, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))) END + 1e-9, 6)::DOUBLE AS p_value FROM t GROUP BY fold_id, b, c""")
def m6(spark, sf):
    return metrics.mcnemar(views.preds(spark, sf), ["fold_id"], "y_true", "pred_a", "pred_b").withColumns({"statistic": r("statistic"), "p_value": r(F.col("p_value") + 1e-9)})


@add("m7_bootstrap_mean_ci")
def m7(spark, sf):
    folds = fold_table(spark, sf)
    return reporting.bootstrap_mean_ci(folds, ["model"], "accuracy", ["fold"])


@add("m8_bootstrap_auc_diff")
def m8(spark, sf):
    return reporting.bootstrap_auc_diff(views.preds(spark, sf), "y_true", "score_a", "score_b")


@add("m8_auc_difference", f"WITH {PREDS}, a AS ({_auc_sql('v_preds', [], 'score_a', 'x')}), b AS ({_auc_sql('v_preds', [], 'score_b', 'y')}) SELECT round(x - y, 6) + 0.0 AS auc_diff FROM a, b")
def m8b(spark, sf):
    return reporting.bootstrap_auc_diff(views.preds(spark, sf), "y_true", "score_a", "score_b").select(r("auc_diff").alias("auc_diff"))


def multitask(spark, sf):
    p = views.preds(spark, sf)
    k = F.col("row_id")
    return p.select(
        "fold_id", F.col("y_true").alias("apnea_true"), F.col("pred_a").alias("apnea_pred"), F.col("score_a").alias("apnea_score"), ((k % 3 != 0) & (F.col("fold_id") != 2)).cast("int").alias("label_mask_apnea"),
        F.col("subject_id").alias("stage_true"), F.when(k % 4 == 0, "none").otherwise(F.col("subject_id")).alias("stage_pred"), (k % 2).cast("int").alias("label_mask_stage"))


MULTI = f"""WITH {PREDS}, ap AS (SELECT * FROM v_preds WHERE row_id % 3 <> 0 AND fold_id <> 2), st AS (SELECT fold_id, subject_id AS y_true, CASE WHEN row_id % 4 = 0 THEN 'none' ELSE subject_id END AS y_pred FROM v_preds WHERE row_id % 2 = 1), b AS ({_bin_sql('ap', 'pred_a')}), a AS ({_auc_sql('ap', ['fold_id'], 'score_a')}), {_multi_sql('st', ['fold_id']).replace(' SELECT fold_id, CAST', ', mm AS (SELECT fold_id, CAST', 1)}),
 res AS (SELECT f.fold_id, round(b.accuracy, 6) AS apnea_accuracy, round(b.sensitivity, 6) AS apnea_sensitivity, round(b.specificity, 6) AS apnea_specificity, round(a.auc_roc, 6) AS apnea_auc_roc, coalesce(b.n_samples, 0) AS apnea_n_samples, mm.accuracy AS stage_accuracy, mm.macro_f1 AS stage_macro_f1, mm.cohen_kappa AS stage_cohen_kappa
 FROM (SELECT DISTINCT fold_id FROM v_preds) f LEFT JOIN b ON b.fold_id = f.fold_id LEFT JOIN a ON a.fold_id = f.fold_id LEFT JOIN mm ON mm.fold_id = f.fold_id)"""


def _rounded_multi(spark, sf):
    m = metrics.masked_multitask_metrics(multitask(spark, sf), ["fold_id"])
    return m.withColumns({c: r(c) for c in m.columns if c not in ("fold_id", "apnea_n_samples")})


@add("m9_masked_multitask_metrics", f"{MULTI} SELECT * FROM res")
def m9(spark, sf):
    return _rounded_multi(spark, sf)


@add("m10_validation_score", f"{MULTI} SELECT fold_id, round(coalesce(list_avg(list_filter([apnea_auc_roc, apnea_accuracy, stage_macro_f1], lambda x: x IS NOT NULL)), 0), 5) AS validation_score FROM res")
def m10(spark, sf):
    v = metrics.validation_score(_rounded_multi(spark, sf))
    return v.select("fold_id", r("validation_score", 5).alias("validation_score"))


# Fold metric rows of two models, used by the summaries.
FOLD_SQL = f"""WITH {PREDS}, fm AS (SELECT 'a' AS model, fold_id AS fold, round(avg(CASE WHEN y_true = pred_a THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy, round(sum(CASE WHEN y_true = 1 AND pred_a = 1 THEN 1 ELSE 0 END) / sum(y_true), 6)::DOUBLE AS sensitivity FROM v_preds GROUP BY 1, 2
 UNION ALL SELECT 'b', fold_id, round(avg(CASE WHEN y_true = pred_b THEN 1.0 ELSE 0.0 END), 6)::DOUBLE, round(sum(CASE WHEN y_true = 1 AND pred_b = 1 THEN 1 ELSE 0 END) / sum(y_true), 6)::DOUBLE FROM v_preds GROUP BY 1, 2)"""


def fold_table(spark, sf):
    p = views.preds(spark, sf)
    one = lambda m, d: metrics.binary_metrics(d, ["fold_id"], "y_true", f"pred_{m}").select(F.lit(m).alias("model"), F.col("fold_id").alias("fold"), r("accuracy").alias("accuracy"), r("sensitivity").alias("sensitivity"))
    return one("a", p).unionByName(one("b", p))


SUMMARY_SQL = FOLD_SQL + ", lm AS (SELECT model, 'accuracy' AS metric, accuracy AS v FROM fm UNION ALL SELECT model, 'sensitivity', sensitivity FROM fm), sm AS (SELECT model, metric, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, count(*) AS n FROM lm GROUP BY 1, 2)"


@add("a20_fold_metrics_summary", SUMMARY_SQL + " SELECT model, metric, round(mean, 6) AS mean, round(std, 6) AS std, n FROM sm")
def a20(spark, sf):
    return reporting.fold_metrics_summary(fold_table(spark, sf), ["accuracy", "sensitivity"]).withColumns({"mean": r("mean"), "std": r("std")})


@add("m11_metric_tables", SUMMARY_SQL + " SELECT metric, max(CASE WHEN model = 'a' THEN printf('%.3f ± %.3f', mean, std) END) AS a, max(CASE WHEN model = 'b' THEN printf('%.3f ± %.3f', mean, std) END) AS b, 'N/D' AS c FROM sm GROUP BY metric")
def m11(spark, sf):
    return reporting.metric_by_model(reporting.fold_metrics_summary(fold_table(spark, sf), ["accuracy", "sensitivity"]), ["a", "b", "c"])


@add("m11_direction_table", FOLD_SQL + " SELECT 'x to y' AS direction, model, printf('%.3f', accuracy) AS accuracy, printf('%.3f', sensitivity) AS sensitivity FROM fm")
def m11b(spark, sf):
    return reporting.direction_table(fold_table(spark, sf).withColumn("direction", F.lit("x to y")), ["accuracy", "sensitivity"])


@add("m11_class_table", f"WITH {MPREDS}, {_marginals('v_mpreds', ['fold_id'])}, sm AS (SELECT label, avg(f1) AS mean, coalesce(stddev_samp(f1), 0) AS std FROM marg GROUP BY label) SELECT label, printf('%.3f ± %.3f', mean, std) AS forest FROM sm")
def m11c(spark, sf):
    f1 = metrics.per_class_f1(views.mpreds(spark, sf), ["fold_id"]).withColumn("model", F.lit("forest"))
    s = reporting.fold_metrics_summary(f1, ["f1"], keys=("model", "label"))
    return reporting.metric_by_model(s, ["forest"], rows="label")


def tuned(spark, sf):
    return fold_table(spark, sf).select("model", "fold", F.concat(F.lit('{"depth": '), (F.col("fold") % 3).cast("string"), F.lit("}")).alias("params"), F.col("accuracy").alias("inner_score"))


@add("a21_best_params_summary", FOLD_SQL + """, p AS (SELECT model, '{"depth": ' || fold % 3 || '}' AS params, accuracy FROM fm), k AS (SELECT model, params, count(*) AS n FROM p GROUP BY 1, 2)
 SELECT p.model, count(*) AS n_folds, (SELECT params FROM k WHERE k.model = p.model ORDER BY n DESC, params LIMIT 1) AS params, (SELECT max(n) FROM k WHERE k.model = p.model) AS params_count, round(avg(accuracy), 6) AS score_mean, round(coalesce(stddev_samp(accuracy), 0), 6) AS score_std FROM p GROUP BY p.model""")
def a21(spark, sf):
    return reporting.best_params_summary(tuned(spark, sf)).withColumns({"score_mean": r("score_mean"), "score_std": r("score_std")})


EXPERIMENTS_SQL = FOLD_SQL + """, ex AS (SELECT 'tuned' AS experiment, model, 'within' AS kind, round(avg(accuracy), 6) AS accuracy_mean, round(coalesce(stddev_samp(accuracy), 0), 6) AS accuracy_std FROM fm GROUP BY model UNION ALL SELECT 'cross' || fold, model, 'cross', round(accuracy, 6), NULL FROM fm)"""


def experiments(spark, sf):
    f = fold_table(spark, sf)
    s = reporting.experiment_summary(f.withColumn("experiment", F.lit("tuned")), f.withColumn("experiment", F.concat(F.lit("cross"), F.col("fold").cast("string"))), ["accuracy"])
    return s.withColumns({"accuracy_mean": r("accuracy_mean"), "accuracy_std": r("accuracy_std")})


@add("a22_experiment_summary", EXPERIMENTS_SQL + " SELECT * FROM ex")
def a22(spark, sf):
    return experiments(spark, sf)


@add("j6_gap_vs_baseline", EXPERIMENTS_SQL + " SELECT experiment, model, CASE WHEN experiment = 'tuned' THEN round(accuracy_mean - (SELECT accuracy_mean FROM ex WHERE experiment = 'cross0' AND model = 'a'), 6) + 0.0 END AS gap_accuracy FROM ex")
def j6(spark, sf):
    e = experiments(spark, sf)
    g = joins.gap_vs_baseline(e, (F.col("experiment") == "cross0") & (F.col("model") == "a"), F.col("experiment") == "tuned", {"gap_accuracy": "accuracy_mean"})
    return g.select("experiment", "model", r("gap_accuracy").alias("gap_accuracy"))


def _model(spark, sf, m):
    return views.preds(spark, sf).select("fold_id", "row_id", "y_true", F.col(f"pred_{m}").alias("y_pred"))


@add("j4_align_predictions", f"WITH {PREDS} SELECT fold_id, row_id, y_true AS y_true_a, pred_a AS y_pred_a, y_true AS y_true_b, pred_b AS y_pred_b FROM v_preds")
def j4(spark, sf):
    return joins.align_predictions(_model(spark, sf, "a"), _model(spark, sf, "b"))


@add("j4_alignment_mismatches", f"WITH {PREDS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE row_id % 17 = 0) AS n_mismatch FROM v_preds")
def j4b(spark, sf):
    b = _model(spark, sf, "b").withColumn("y_true", F.when(F.col("row_id") % 17 == 0, 1 - F.col("y_true")).otherwise(F.col("y_true")))
    return joins.alignment_mismatches(_model(spark, sf, "a"), b)


@add("j7_pending_work", FOLD_SQL + ", w AS (SELECT DISTINCT m AS model, fold_id AS fold FROM v_preds, (VALUES ('a'), ('b')) t(m)) SELECT model, fold FROM w WHERE NOT EXISTS (SELECT 1 FROM fm WHERE fm.model = w.model AND fm.fold = w.fold AND NOT (fm.model = 'b' AND fm.fold = 3)) OR (model = 'a' AND fold = 1)")
def j7(spark, sf):
    done = fold_table(spark, sf).filter("not (model = 'b' and fold = 3)")  # a run that has not ended
    models = F.array(F.lit("a"), F.lit("b"))
    wanted = views.preds(spark, sf).select(F.explode(models).alias("model"), F.col("fold_id").alias("fold")).distinct()
    return joins.pending_work(wanted, done, done.filter("not (model = 'a' and fold = 1)"))


@add("j8_recover_metrics", f"""{MULTI.replace('row_id % 3 <> 0 AND fold_id <> 2', 'TRUE').replace('WHERE row_id % 2 = 1', '')} SELECT 'a' AS model, fold_id AS fold, CASE WHEN fold_id < 2 THEN 0.5::DOUBLE ELSE stage_accuracy END AS stage_accuracy, CASE WHEN fold_id >= 2 THEN stage_macro_f1 END AS stage_macro_f1, CASE WHEN fold_id >= 2 THEN stage_cohen_kappa END AS stage_cohen_kappa,
 CASE WHEN fold_id >= 2 THEN apnea_accuracy END AS apnea_accuracy, CASE WHEN fold_id >= 2 THEN apnea_sensitivity END AS apnea_sensitivity, CASE WHEN fold_id >= 2 THEN apnea_specificity END AS apnea_specificity, CASE WHEN fold_id >= 2 THEN apnea_auc_roc END AS apnea_auc_roc, CASE WHEN fold_id >= 2 THEN apnea_n_samples END AS apnea_n_samples FROM res""")
def j8(spark, sf):
    t = multitask(spark, sf).withColumns({"model": F.lit("a"), "fold": F.col("fold_id")})
    stage = t.select("model", "fold", F.col("stage_true").alias("y_true"), F.col("stage_pred").alias("y_pred"))
    apnea = t.select("model", "fold", F.col("apnea_true").alias("y_true"), F.col("apnea_pred").alias("y_pred"), F.col("apnea_score").alias("y_score"))
    have = t.filter("fold < 2").select("model", "fold", F.lit(0.5).alias("stage_accuracy")).distinct()
    out = metrics.recover_metrics(have, stage, apnea)
    return out.withColumns({c: r(c) for c in out.columns if c not in ("model", "fold", "apnea_n_samples")})


@add("m7_bootstrap_mean_checks", FOLD_SQL + " SELECT model, count(*) AS n, round(avg(accuracy), 6) + 0.0 AS mean, true AS mean_inside, true AS inside_range FROM fm GROUP BY model")
def m7b(spark, sf):
    folds = fold_table(spark, sf)
    span = folds.groupBy("model").agg(F.min("accuracy").alias("least"), F.max("accuracy").alias("most"))
    ci = reporting.bootstrap_mean_ci(folds, ["model"], "accuracy", ["fold"]).join(span, "model")
    return ci.select("model", "n", r("mean").alias("mean"), F.col("mean").between(F.col("lo"), F.col("hi")).alias("mean_inside"), ((F.col("lo") >= F.col("least")) & (F.col("hi") <= F.col("most"))).alias("inside_range"))


@add("m8_bootstrap_auc_checks", f"WITH {PREDS}, a AS ({_auc_sql('v_preds', [], 'score_a', 'x')}), b AS ({_auc_sql('v_preds', [], 'score_b', 'y')}) SELECT round(x - y, 6) + 0.0 AS auc_diff, true AS inside, true AS has_width FROM a, b")
def m8c(spark, sf):
    ci = reporting.bootstrap_auc_diff(views.preds(spark, sf), "y_true", "score_a", "score_b")
    return ci.select(r("auc_diff").alias("auc_diff"), F.col("auc_diff").between(F.col("lo"), F.col("hi")).alias("inside"), (F.col("hi") > F.col("lo")).alias("has_width"))
