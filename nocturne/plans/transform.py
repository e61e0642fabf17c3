"""Queries: encoding, scaling, reduction, balance and subject-wise sampling."""
from __future__ import annotations

from pyspark.sql import functions as F

from nocturne.functions import labels
from nocturne.operators import balance, chain, encoding, filters, folds, reduction, scaling
from nocturne.operators.cleaning import CleaningOptions
from nocturne.plans import views
from nocturne.plans.tabular import CLEAN_DIRTY, FEATURES
from nocturne.plans.views import ARRAYS, DIRTY, EPOCHS, Catalog, r, table
from nocturne.session import shared_dir

catalog = Catalog()
add = catalog.add


@add("e1_encode_binary", f"WITH {DIRTY} SELECT c_custkey, CASE WHEN active = 'yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS active FROM v_dirty")
def e1(spark, sf):
    return views.dirty(spark, sf).select("c_custkey", labels.encode_binary(F.col("active")).alias("active"))


PRIORITIES = ["1-urgent", "2-high", "3-medium", "5-low"]


@add("e2_encode_ordinal", f"""WITH c AS (SELECT o_orderkey, CASE lower(o_orderpriority) {' '.join(f"WHEN '{p}' THEN {i}.0" for i, p in enumerate(PRIORITIES))} END AS code FROM orders)
 SELECT o_orderkey, round(coalesce(code, (SELECT quantile_cont(code, 0.5) FROM c)), 6)::DOUBLE AS o_orderpriority FROM c""")
def e2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return encoding.ordinal(o, "o_orderpriority", PRIORITIES)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@add("e3_one_hot", "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' AND c_custkey % 11 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"seg_{s}\"" for s in SEGMENTS) + " FROM customer")
def e3(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("seg"))
    return encoding.one_hot(c, ["seg"])[0]


@add("e4_decode_one_hot", "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '<UNASSIGNED>' ELSE c_mktsegment END AS seg FROM customer")
def e4(spark, sf):
    return encoding.decode_one_hot(e3(spark, sf), "seg")[0].select("c_custkey", "seg")


_Z = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}" for c in ("o_totalprice", "o_custkey"))


@add("e5_scale_standardize", f"SELECT o_orderkey, {_Z} FROM orders")
def e5(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    out = scaling.scale_apply(o, scaling.scale_fit(o, scaling.scale_columns(o, exclude=["o_orderkey"])))
    return out.withColumns({c: r(c) for c in ("o_totalprice", "o_custkey")})


@add("e6_scale_minmax", f"WITH {CLEAN_DIRTY}, b AS (SELECT min(acct_bal) AS lo, max(acct_bal) AS hi FROM v_dirty) SELECT c_custkey, round((acct_bal - lo) / (hi - lo), 6) + 0.0 AS acct_bal, 0.0::DOUBLE AS flat FROM v_dirty, b")
def e6(spark, sf):
    d = views.dirty(spark, sf).select("c_custkey", F.col("Acct Bal").alias("acct_bal"), F.lit(7.0).alias("flat"))
    return scaling.scale_apply(d, scaling.scale_fit(d, ["acct_bal", "flat"], "minmax")).withColumn("acct_bal", r("acct_bal"))


@add("e7_fit_impute_scale", f"""WITH {CLEAN_DIRTY}, tr AS (SELECT * FROM v_dirty WHERE c_custkey % 5 <> 0), m AS (SELECT quantile_cont(acct_bal, 0.5) AS md FROM tr), s AS (SELECT avg(coalesce(acct_bal, md)) AS mu, stddev_pop(coalesce(acct_bal, md)) AS sd FROM tr, m)
 SELECT c_custkey, round((coalesce(acct_bal, md) - mu) / sd, 6) + 0.0 AS acct_bal FROM v_dirty, m, s WHERE c_custkey % 5 = 0""")
def e7(spark, sf):
    d = views.dirty(spark, sf).select("c_custkey", F.col("Acct Bal").alias("acct_bal"))
    fit = scaling.fit_impute_scale(d.filter("c_custkey % 5 <> 0"), ["acct_bal"])
    return scaling.apply_impute_scale(d.filter("c_custkey % 5 = 0"), fit).withColumn("acct_bal", r("acct_bal"))


# Two features have closed-form axes, which makes the scores checkable in SQL.
_COV = "SELECT var_pop({a}) AS a, var_pop({b}) AS c, covar_pop({a}, {b}) AS b, avg({a}) AS ma, avg({b}) AS mb FROM {t}"


@add("d1_pca", f"""WITH s AS ({_COV.format(a='l_quantity', b='l_extendedprice / 1000', t='lineitem')}), e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1 FROM s), w AS (SELECT *, b / sqrt(b * b + pow(l1 - a, 2)) AS u, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS v FROM e),
 g AS (SELECT *, CASE WHEN abs(u) > abs(v) THEN sign(u) ELSE sign(v) END AS sg FROM w) SELECT l_orderkey, l_linenumber, round(sg * ((l_quantity - ma) * u + (l_extendedprice / 1000 - mb) * v), 4) + 0.0 AS pca_1, round(l1 / (a + c), 6) AS share FROM lineitem, g""")
def d1(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    out, share = reduction.pca(li, n=1, exclude=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", r("pca_1", 4).alias("pca_1"), r(F.lit(share[0])).alias("share"))


@add("d2_lda", """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS g FROM lineitem),
 c AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vxy FROM t GROUP BY g),
 w AS (SELECT sum(n * vx) / (sum(n) - 2) AS a, sum(n * vy) / (sum(n) - 2) AS d, sum(n * vxy) / (sum(n) - 2) AS b, sum(n * mx) / sum(n) AS cx, sum(n * my) / sum(n) AS cy, sum(CASE WHEN g = 1 THEN mx ELSE -mx END) AS dx, sum(CASE WHEN g = 1 THEN my ELSE -my END) AS dy FROM c),
 v AS (SELECT *, (d * dx - b * dy) / (a * d - b * b) AS u1, (a * dy - b * dx) / (a * d - b * b) AS u2 FROM w), z AS (SELECT *, sqrt(u1 * u1 * a + 2 * u1 * u2 * b + u2 * u2 * d) AS s, CASE WHEN abs(u1) > abs(u2) THEN sign(u1) ELSE sign(u2) END AS sg FROM v)
 SELECT l_orderkey, l_linenumber, round(sg * ((x - cx) * u1 + (y - cy) * u2) / s, 4) + 0.0 AS lda_1, CASE WHEN g = 1 THEN 'O' ELSE 'F' END AS status FROM t, z""")
def d2(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"), F.when(F.col("l_linestatus") == "O", "O").otherwise("F").alias("status"))
    out = reduction.lda(li, "status", exclude=["l_orderkey", "l_linenumber"])
    return out.withColumn("lda_1", r("lda_1", 4))


@add("d3_variance_threshold", "SELECT l_orderkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def d3(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", *FEATURES, "l_returnflag")
    return reduction.variance_threshold(li, 1.0, exclude=["l_orderkey"])[0]


def _anova_sql(c):
    return f"""SELECT '{c}' AS feature, round((sum(n * pow(mc - m, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) AS score FROM
 (SELECT count(*) AS n, avg({c}) AS mc, var_pop({c}) AS v FROM lineitem GROUP BY l_returnflag) g, (SELECT avg({c}) AS m FROM lineitem) a"""


@add("d4_anova_scores", " UNION ALL ".join(_anova_sql(c) for c in FEATURES))
def d4(spark, sf):
    return reduction.anova_scores(table(spark, sf, "lineitem"), FEATURES, "l_returnflag").withColumn("score", r("score", 5))


@add("d4_regression_scores", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(pow(corr({c}, l_extendedprice), 2) * (count(*) - 2) / (1 - pow(corr({c}, l_extendedprice), 2)), 3) AS score FROM lineitem" for c in ["l_quantity", "l_discount", "l_tax"]))
def d4b(spark, sf):
    return reduction.regression_scores(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").withColumn("score", r("score", 3))


def _kept_sql(c):
    return f"CASE WHEN (SELECT count(*) FROM s WHERE score > (SELECT score FROM s WHERE feature = '{c}')) < 2 THEN {c} ELSE 0 END"


@add("d4_select_k_best", f"WITH s AS ({' UNION ALL '.join(_anova_sql(c) for c in FEATURES)}) SELECT l_orderkey, l_returnflag, {' + '.join(_kept_sql(c) for c in FEATURES)} AS total FROM lineitem")
def d4c(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", *FEATURES, "l_returnflag")
    out, scores = reduction.select_k_best(li, "l_returnflag", 2, exclude=["l_orderkey"])
    total = F.lit(0.0)
    for c in scores:
        total = total + F.col(c)
    return out.select("l_orderkey", "l_returnflag", total.alias("total"))


@add("d5_clean_encode_balance_scale", f"""WITH {CLEAN_DIRTY}, k AS (SELECT DISTINCT c_custkey, acct_bal, lower(trim(segment)) AS segment, lower(active) AS active FROM v_dirty), f AS (SELECT c_custkey, coalesce(acct_bal, (SELECT quantile_cont(acct_bal, 0.5) FROM k)) AS acct_bal, segment, active FROM k),
 z AS (SELECT c_custkey, (acct_bal - avg(acct_bal) OVER ()) / stddev_pop(acct_bal) OVER () AS acct_bal, segment, active FROM f)
 SELECT c_custkey, round(acct_bal, 6) + 0.0 AS acct_bal, CASE active WHEN 'yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS active, """ + ", ".join(f"CASE WHEN segment = '{s.lower()}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS segment_{s.lower()}" for s in SEGMENTS) + " FROM z")
def d5(spark, sf):
    o = chain.ChainOptions(
        cleaning=CleaningOptions(drop_missing_pct=60.0), encoding=encoding.EncodingSpec(binary=["active"], nominal=["segment"]), scaling="standardize",
        scale_exclude=("c_custkey", "active", *[f"segment_{s.lower()}" for s in SEGMENTS]))
    out = chain.tabular_chain(views.dirty(spark, sf).drop("nation_text"), o)
    return out.withColumn("acct_bal", r("acct_bal"))


@add("d5_chain_on_new_rows", f"""WITH {CLEAN_DIRTY}, k AS (SELECT DISTINCT c_custkey, acct_bal, lower(trim(segment)) AS segment FROM v_dirty),
 h AS (SELECT * FROM k WHERE c_custkey % 3 <> 0), m AS (SELECT quantile_cont(acct_bal, 0.5) AS mid FROM h),
 s AS (SELECT avg(coalesce(acct_bal, mid)) AS shift, stddev_pop(coalesce(acct_bal, mid)) AS spread FROM h, m)
 SELECT c_custkey, round((coalesce(acct_bal, mid) - shift) / spread, 6) + 0.0 AS acct_bal, """ + ", ".join(f"CASE WHEN segment = '{s.lower()}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS segment_{s.lower()}" for s in SEGMENTS)
     + " FROM k, m, s WHERE c_custkey % 3 = 0")
def d5b(spark, sf):
    """Fitted on two thirds, saved, read back and applied to the rest, with the columns' raw names."""
    d = views.dirty(spark, sf).drop("nation_text", "active")
    o = chain.ChainOptions(cleaning=CleaningOptions(drop_missing_pct=60.0), encoding=encoding.EncodingSpec(nominal=["segment"]), scaling="standardize", scale_exclude=("c_custkey", *[f"segment_{s.lower()}" for s in SEGMENTS]),
                           reduction="variance_threshold", reduction_args={"exclude": ["c_custkey"]})
    fitted, _ = chain.fit_chain(d.filter("c_custkey % 3 <> 0"), o)
    folder = shared_dir(spark)
    fitted.save(spark, folder)
    return chain.FittedChain.load(spark, folder).apply(d.filter("c_custkey % 3 = 0").distinct()).withColumn("acct_bal", r("acct_bal"))


@add("d5_balanced_and_reduced", f"""WITH {CLEAN_DIRTY}, k AS (SELECT DISTINCT c_custkey, acct_bal, CAST(c_custkey % 5 = 0 AS INTEGER) AS flag FROM v_dirty)
 SELECT flag, (SELECT min(n) FROM (SELECT count(*) AS n FROM k GROUP BY flag)) AS cnt, 0.0::DOUBLE AS mean_1, 1.0::DOUBLE AS both_spreads FROM k GROUP BY flag""")
def d5c(spark, sf):
    """Balancing and projection really run: equal classes, centred axes, and all of the two standardised columns' variance on them, whichever rows are drawn."""
    d = views.dirty(spark, sf).select("c_custkey", "Acct Bal", (F.col("c_custkey") % 5 == 0).cast("int").alias("Flag"))
    o = chain.ChainOptions(target="Flag", cleaning=CleaningOptions(target="Flag"), balance="random_under", balance_order=["c_custkey"], scaling="standardize", reduction="pca", reduction_args={"n": 2})
    _, made = chain.fit_chain(d, o)
    every = made.agg(views.r(F.avg("pca_1")).alias("mean_1"), views.r((F.var_pop("pca_1") + F.var_pop("pca_2")) / 2).alias("both_spreads"))
    counts = made.groupBy("flag").agg(F.count("*").alias("cnt"))
    row = every.first()
    return counts.select("flag", "cnt", F.lit(row["mean_1"] + 0.0).alias("mean_1"), F.lit(row["both_spreads"]).alias("both_spreads"))


@add("a15_class_counts", f"WITH {EPOCHS} SELECT sleep_stage AS label, count(*) AS cnt FROM v_epochs GROUP BY 1")
def a15(spark, sf):
    return balance.class_counts(views.staged(spark, sf), "sleep_stage")


@add("a16_class_weights", "SELECT CAST(quality AS VARCHAR) AS label, round((SELECT count(*) FROM labels) / (2.0::DOUBLE * count(*)), 6) AS weight FROM labels GROUP BY quality")
def a16(spark, sf):
    return balance.class_weights(table(spark, sf, "labels"), "quality").withColumn("weight", r("weight"))


@add("a16_row_weights", "SELECT doc_id, round((SELECT count(*) FROM labels) / (2.0::DOUBLE * count(*) OVER (PARTITION BY quality)), 6) AS weight FROM labels")
def a16b(spark, sf):
    return balance.with_class_weight(table(spark, sf, "labels"), "quality").select("doc_id", r("weight").alias("weight"))


@add("r1_random_under", "WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT CAST(quality AS VARCHAR) AS label, (SELECT min(n) FROM c) AS cnt, (SELECT min(n) FROM c) AS distinct_rows FROM c")
def r1(spark, sf):
    u = balance.random_under(table(spark, sf, "labels"), "quality", ["doc_id"])
    return u.groupBy(F.col("quality").cast("string").alias("label")).agg(F.count("*").alias("cnt"), F.count_distinct("doc_id").alias("distinct_rows"))


@add("r1_random_under_ratio", "WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT CAST(quality AS VARCHAR) AS label, CASE WHEN quality = 0 THEN n ELSE CAST(floor((SELECT min(n) FROM c) / 0.5) AS BIGINT) END AS cnt FROM c")
def r1b(spark, sf):
    return balance.class_counts(balance.random_under(table(spark, sf, "labels"), "quality", ["doc_id"], strategy=0.5), "quality")


@add("r2_random_over", "WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT CAST(quality AS VARCHAR) AS label, (SELECT max(n) FROM c) AS cnt, n AS distinct_rows FROM c")
def r2(spark, sf):
    u = balance.random_over(table(spark, sf, "labels"), "quality", ["doc_id"])
    # Drawn rows repeat originals, so the distinct rows stay those of the input.
    return u.groupBy(F.col("quality").cast("string").alias("label")).agg(F.count("*").alias("cnt"), F.count_distinct("doc_id").alias("distinct_rows"))


def smote_input(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.round(F.col("o_totalprice") / 1000, 3).alias("price"), (F.col("o_custkey") % 97).alias("cust"), F.when(F.col("o_orderkey") % 10 == 0, "rare").when(F.col("o_orderkey") % 10 < 4, "some").otherwise("many").alias("cls"))


@add("r3_smote", """WITH c AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'rare' WHEN o_orderkey % 10 < 4 THEN 'some' ELSE 'many' END AS label, count(*) AS n, min(round(o_totalprice / 1000, 3)) AS lo, max(round(o_totalprice / 1000, 3)) AS hi FROM orders GROUP BY 1)
 SELECT label, (SELECT max(n) FROM c) AS cnt, lo, hi FROM c""")
def r3(spark, sf):
    s = balance.smote(smote_input(spark, sf), "cls")
    return s.groupBy(F.col("cls").alias("label")).agg(F.count("*").alias("cnt"), F.min("price").alias("lo"), F.max("price").alias("hi"))


@add("r4_smote_to_reference_minus", """WITH c AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'rare' WHEN o_orderkey % 10 < 4 THEN 'some' ELSE 'many' END AS label, count(*) AS n FROM orders GROUP BY 1)
 SELECT label, CASE WHEN label IN ('rare', 'some') THEN greatest(n, (SELECT n FROM c WHERE label = 'many') - 500) ELSE n END AS cnt FROM c""")
def r4(spark, sf):
    return balance.class_counts(balance.smote_to_reference_minus(smote_input(spark, sf), "cls", "many", 500, ["rare", "some", "absent"]), "cls")


@add("r5_subject_fraction", "WITH s AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT CAST(greatest(1, floor(n * 0.3)) AS BIGINT) AS n_subjects, TRUE AS whole FROM s")
def r5(spark, sf):
    e = views.staged(spark, sf)
    part = filters.subject_fraction(e, "recording_id", 0.3)
    mine = part.groupBy("recording_id").agg(F.count("*").alias("k"))
    all_ = e.groupBy("recording_id").agg(F.count("*").alias("n"))
    return mine.join(all_, "recording_id").agg(F.count("*").alias("n_subjects"), F.bool_and(F.col("k") == F.col("n")).alias("whole"))


@add("r6_subject_subsample_with_coverage", f"""WITH {EPOCHS}, l AS (SELECT recording_id, CASE WHEN recording_id % 100 = 37 THEN 'odd' ELSE sleep_stage END AS label, event_id FROM v_epochs), s AS (SELECT recording_id, row_number() OVER (ORDER BY recording_id) - 1 AS rk FROM (SELECT DISTINCT recording_id FROM l) t),
 g AS (SELECT greatest((SELECT least(count(*), greatest(3, 32, ceil(count(*) * 0.25))) - 1 FROM s), (SELECT max(m) FROM (SELECT min(rk) AS m FROM l JOIN s USING (recording_id) GROUP BY label) x)) AS last) SELECT event_id, recording_id, label FROM l JOIN s USING (recording_id), g WHERE rk <= last""")
def r6(spark, sf):
    l = views.staged(spark, sf).select("event_id", "recording_id", F.when(F.col("recording_id") % 100 == 37, "odd").otherwise(F.col("sleep_stage")).alias("label"))
    return folds.subsample_with_coverage(l, "recording_id", "label", seed=None)


@add("r7_train_val_split", "WITH s AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT 'val' AS part, CAST(least(greatest(round_even(n * 0.2, 0), 1), n - 1) AS BIGINT) AS n_subjects FROM s UNION ALL SELECT 'train', n - CAST(least(greatest(round_even(n * 0.2, 0), 1), n - 1) AS BIGINT) FROM s")
def r7(spark, sf):
    p = folds.train_val_split(views.staged(spark, sf), "recording_id", 0.2)
    return p.groupBy("part").agg(F.count_distinct("recording_id").alias("n_subjects"))


@add("r8_balance_report", """WITH c AS (SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS n, min(n) AS lo, count(*) AS k FROM c)
 SELECT label, c.n AS cnt_before, t.lo AS cnt_after, round(t.n / (t.k * c.n), 6)::DOUBLE AS weight, CAST(t.n AS BIGINT) AS rows_before, CAST(t.lo * t.k AS BIGINT) AS rows_after, '' AS warning FROM c, t""")
def r8(spark, sf):
    l = table(spark, sf, "labels")
    return balance.balance_report(l, balance.random_under(l, "quality", ["doc_id"]), "quality", "random_under").withColumn("weight", r("weight"))


LABELLED = f"""WITH {ARRAYS}, a AS (SELECT recording_id % 50 AS subject, CASE stage_code WHEN 0 THEN 'W' WHEN 1 THEN 'N1' WHEN 2 THEN 'N2' WHEN 3 THEN 'N3' ELSE 'REM' END AS sleep_stage, apnea_binary, vec_id FROM v_arrays)"""


def labelled(spark, sf):
    a = views.arrays(spark, sf)
    stage = F.when(F.col("stage_code") == 0, "W").when(F.col("stage_code") == 1, "N1").when(F.col("stage_code") == 2, "N2").when(F.col("stage_code") == 3, "N3").otherwise("REM")
    return a.select((F.col("recording_id") % 50).alias("subject"), stage.alias("sleep_stage"), "apnea_binary", "vec_id")


PROFILE_SQL = LABELLED + """, d AS (SELECT subject, sleep_stage, count(*) AS k FROM a GROUP BY 1, 2), dom AS (SELECT subject, (list(sleep_stage ORDER BY k DESC, sleep_stage))[1] AS dominant_stage FROM d GROUP BY subject),
 p AS (SELECT subject, coalesce(avg(apnea_binary), 0) AS apnea_rate, count(*) AS n_rows FROM a GROUP BY subject), e AS (SELECT quantile_cont(apnea_rate, 1 / 3.0) AS e1, quantile_cont(apnea_rate, 2 / 3.0) AS e2 FROM p),
 prof AS (SELECT p.subject, apnea_rate, n_rows, dominant_stage, CASE WHEN apnea_rate <= e1 THEN 'q0' WHEN apnea_rate <= e2 THEN 'q1' ELSE 'q2' END AS apnea_bin FROM p JOIN dom ON p.subject = dom.subject, e)"""


@add("a18_subject_profiles", PROFILE_SQL + " SELECT subject, round(apnea_rate, 6) AS apnea_rate, n_rows, dominant_stage, apnea_bin, apnea_bin || '__' || dominant_stage AS composite_label FROM prof")
def a18(spark, sf):
    return folds.subject_profiles(labelled(spark, sf), "subject").withColumn("apnea_rate", r("apnea_rate"))


@add("a19_best_stratify_label", PROFILE_SQL + """ SELECT 'composite_subject_stratified' AS strategy, min(k) AS smallest FROM (SELECT count(*) AS k FROM prof GROUP BY apnea_bin || dominant_stage) x UNION ALL SELECT 'apnea_bin_only', min(k) FROM (SELECT count(*) AS k FROM prof GROUP BY apnea_bin) y
 UNION ALL SELECT 'dominant_stage_only', min(k) FROM (SELECT count(*) AS k FROM prof GROUP BY dominant_stage) z""")
def a19(spark, sf):
    return folds.smallest_strata(folds.subject_profiles(labelled(spark, sf), "subject"))


@add("a23_distinct_subjects", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def a23(spark, sf):
    return folds.distinct_subjects(table(spark, sf, "events"), "user_id", ["event_id"])


def _deal_sql(by):
    return f"CAST(CASE WHEN pos % 10 < 5 THEN pos % 10 ELSE 9 - pos % 10 END AS INTEGER) AS fold FROM (SELECT *, row_number() OVER ({by} ORDER BY n_rows DESC, subject) - 1 AS pos"


DOMINANT = f"""WITH {EPOCHS}, d AS (SELECT recording_id AS subject, sleep_stage, count(*) AS k FROM v_epochs GROUP BY 1, 2), s AS (SELECT subject, CAST(sum(k) AS BIGINT) AS n_rows, (list(sleep_stage ORDER BY k DESC, sleep_stage))[1] AS dominant FROM d GROUP BY subject)"""


@add("l1_stratified_group_folds", f"{DOMINANT} SELECT subject AS recording_id, dominant, n_rows, {_deal_sql('PARTITION BY dominant')} FROM s) t")
def l1(spark, sf):
    return folds.stratified_group_folds(views.staged(spark, sf), "recording_id", "sleep_stage", 5, seed=None)


@add("l1_stratified_group_folds_seeded", f"{DOMINANT}, c AS (SELECT dominant, count(*) AS n FROM s GROUP BY 1) SELECT dominant, n AS subjects, CAST(n - n // 5 * 5 > 0 AS INTEGER) AS spread FROM c WHERE n >= 5")
def l1b(spark, sf):
    """Per label: its subjects, and how far fold sizes differ (0 or 1 when balanced)."""
    f = folds.stratified_group_folds(views.staged(spark, sf), "recording_id", "sleep_stage", 5, seed=7)
    per = f.groupBy("dominant", "fold").agg(F.count_distinct("recording_id").alias("k"))
    return per.groupBy("dominant").agg(F.sum("k").alias("subjects"), (F.max("k") - F.min("k")).cast("int").alias("spread")).filter("subjects >= 5")


@add("l2_group_folds", f"{DOMINANT} SELECT subject AS recording_id, n_rows, {_deal_sql('')} FROM s) t")
def l2(spark, sf):
    return folds.group_folds(views.staged(spark, sf), "recording_id", 5)


@add("l3_shared_folds", PROFILE_SQL + f""", g AS (SELECT 'apnea_bin' AS how, subject, n_rows, row_number() OVER (PARTITION BY apnea_bin ORDER BY n_rows DESC, subject) - 1 AS pos FROM prof UNION ALL SELECT 'composite', subject, n_rows, row_number() OVER (PARTITION BY apnea_bin, dominant_stage ORDER BY n_rows DESC, subject) - 1 FROM prof
 UNION ALL SELECT 'dominant', subject, n_rows, row_number() OVER (PARTITION BY dominant_stage ORDER BY n_rows DESC, subject) - 1 FROM prof UNION ALL SELECT 'none', subject, n_rows, row_number() OVER (ORDER BY n_rows DESC, subject) - 1 FROM prof),
 h AS (SELECT CASE WHEN (SELECT min(k) FROM (SELECT count(*) AS k FROM prof GROUP BY apnea_bin, dominant_stage) x) >= 3 THEN 'composite' WHEN (SELECT min(k) FROM (SELECT count(*) AS k FROM prof GROUP BY apnea_bin) x) >= 3 THEN 'apnea_bin' WHEN (SELECT min(k) FROM (SELECT count(*) AS k FROM prof GROUP BY dominant_stage) x) >= 3 THEN 'dominant' ELSE 'none' END AS how)
 SELECT a.vec_id, a.subject, CAST(CASE WHEN pos % 6 < 3 THEN pos % 6 ELSE 5 - pos % 6 END AS INTEGER) AS fold, CASE h.how WHEN 'composite' THEN 'composite_subject_stratified' WHEN 'apnea_bin' THEN 'apnea_bin_only' WHEN 'dominant' THEN 'dominant_stage_only' ELSE 'group_only' END AS fold_strategy_used FROM a JOIN g ON a.subject = g.subject JOIN h ON h.how = g.how""")
def l3(spark, sf):
    return folds.with_shared_folds(labelled(spark, sf), "subject", 3, seed=None).select("vec_id", "subject", "fold", "fold_strategy_used")
