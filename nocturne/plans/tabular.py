"""Queries: schema, cleaning and profiling operators."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from nocturne.functions import text
from nocturne.operators import cleaning, filters, profile, schema
from nocturne.plans import views
from nocturne.plans.views import DIRTY, Catalog, r, table

catalog = Catalog()
add = catalog.add

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *FEATURES]
CLEAN_DIRTY = DIRTY.replace('"Acct Bal"', "acct_bal")


@add("p1_snake_case", "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS kind, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def p1(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.snake_case(F.col("p_type")).alias("kind"), text.snake_case(F.col("p_name")).alias("name"))


@add("p1_rename_columns", f"WITH {CLEAN_DIRTY} SELECT c_custkey, acct_bal, nation_text, segment, active, mostly_missing FROM v_dirty")
def p1b(spark, sf):
    return schema.rename_snake(views.dirty(spark, sf))


@add("p2_normalize_category", f"WITH {DIRTY} SELECT c_custkey, lower(trim(regexp_replace(segment, '\\s+', ' ', 'g'))) AS segment FROM v_dirty")
def p2(spark, sf):
    return views.dirty(spark, sf).select("c_custkey", text.normalize_category(F.col("segment")).alias("segment"))


@add("p3_string_normalize_low_cardinality", "SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, lower(o_orderpriority) AS o_orderpriority, 'Order ' || o_orderkey AS tag FROM orders")
def p3(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.concat(F.lit("Order "), F.col("o_orderkey")).alias("tag"))
    return cleaning.normalize_strings(o)[0]


@add("p4_numeric_coerce", f"WITH {CLEAN_DIRTY} SELECT c_custkey, TRY_CAST(nation_text AS DOUBLE) AS nation_text, segment, active FROM v_dirty")
def p4(spark, sf):
    d = views.dirty(spark, sf).select("c_custkey", "nation_text", "segment", "active")
    return cleaning.coerce_numeric(d)[0]


@add("p5_drop_high_missing_columns", f"WITH {CLEAN_DIRTY} SELECT c_custkey, acct_bal, nation_text, segment, active FROM v_dirty")
def p5(spark, sf):
    return schema.drop_high_missing(schema.rename_snake(views.dirty(spark, sf)), 60.0)[0]


@add("p6_resolve_features", "SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def p6(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*schema.resolve_features(li, exclude=["l_orderkey", "l_partkey", "l_suppkey"]))


@add("p7_resolve_features_cross", "SELECT 'customer' AS origin, c_acctbal AS acctbal, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_acctbal, s_nationkey FROM supplier")
def p7(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey as nation", "c_acctbal as acctbal", "c_mktsegment")
    s = table(spark, sf, "supplier").selectExpr("s_suppkey", "s_nationkey as nation", "s_acctbal as acctbal")
    cols = schema.resolve_features_cross(c, s)
    return c.select(F.lit("customer").alias("origin"), *cols).unionByName(s.select(F.lit("supplier").alias("origin"), *cols))


@add("p9_cast_float32", "SELECT l_orderkey, CAST(l_extendedprice AS REAL) AS l_extendedprice, CAST(l_discount AS REAL) AS l_discount FROM lineitem")
def p9(spark, sf):
    return schema.cast_float32(table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount"), ["l_extendedprice", "l_discount"])


@add("f1_drop_empty_rows", f"WITH {CLEAN_DIRTY} SELECT acct_bal, mostly_missing FROM v_dirty WHERE acct_bal IS NOT NULL OR mostly_missing IS NOT NULL")
def f1(spark, sf):
    return filters.drop_empty_rows(schema.rename_snake(views.dirty(spark, sf)).select("acct_bal", "mostly_missing"))


@add("f2_drop_target_missing", f"WITH {CLEAN_DIRTY} SELECT * FROM v_dirty WHERE acct_bal IS NOT NULL")
def f2(spark, sf):
    return filters.drop_target_missing(schema.rename_snake(views.dirty(spark, sf)), "acct_bal")


@add("f3_deduplicate_rows", f"WITH {CLEAN_DIRTY} SELECT DISTINCT * FROM v_dirty")
def f3(spark, sf):
    return filters.deduplicate(schema.rename_snake(views.dirty(spark, sf)))


@add("f3_deduplicate_subset_first", "SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) t WHERE k = 1")
def f3b(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return filters.deduplicate(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@add("a1_missing_counts", f"WITH {CLEAN_DIRTY} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM v_dirty" for c in ["c_custkey", "acct_bal", "nation_text", "segment", "active", "mostly_missing"]))
def a1(spark, sf):
    return cleaning.missing_counts(schema.rename_snake(views.dirty(spark, sf)))


def _profile_sql(source, kinds, with_=""):
    return with_ + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count({c}) AS non_null_count, count(*) - count({c}) AS missing_count, "
        f"round((count(*) - count({c})) / count(*) * 100, 4) AS missing_pct, count(DISTINCT {c}) AS n_unique FROM {source}"
        for c, k in kinds.items()
    )


LINE_KINDS = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
              "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
              "l_shipdate": "timestamp_ntz"}


@add("a2_dataset_profile", _profile_sql("lineitem", LINE_KINDS))
def a2(spark, sf):
    return profile.dataset_profile(table(spark, sf, "lineitem"))


@add("a2_dataset_profile_missing", _profile_sql("v_dirty", {"c_custkey": "bigint", "acct_bal": "double", "nation_text": "string", "segment": "string", "active": "string", "mostly_missing": "double"}, f"WITH {CLEAN_DIRTY} "))
def a2b(spark, sf):
    return profile.dataset_profile(schema.rename_snake(views.dirty(spark, sf)))


DESCRIBE = ["mean", "median", "mode", "std", "var", "min", "max", "range", "iqr", "skewness", "kurtosis"]


def _describe_sql(c):
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
  (SELECT round({c}, 4) FROM (SELECT {c}, count(*) AS k FROM lineitem GROUP BY {c}) m ORDER BY k DESC, {c} LIMIT 1) AS mode,
  round(stddev_samp({c}), 4) AS std, round(var_samp({c}), 3) AS var, min({c}) + 0.0 AS min, max({c}) + 0.0 AS max, round(max({c}) - min({c}), 4) AS range,
  round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, round(skewness({c}), 5) + 0.0 AS skewness, round(kurtosis({c}), 5) + 0.0 AS kurtosis FROM lineitem"""


@add("a3_describe_numeric", " UNION ALL ".join(_describe_sql(c) for c in LINE_NUMERIC))
def a3(spark, sf):
    d = profile.describe_numeric(table(spark, sf, "lineitem"))
    digits = {"var": 3, "skewness": 5, "kurtosis": 5}
    return d.select("column", "count", *[r(c, digits.get(c, 4)).alias(c) for c in DESCRIBE])


@add("a4_describe_categorical", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS category, count(*) AS frequency, round(count(*) / (SELECT count(*) FROM lineitem) * 100, 4) AS proportion_pct FROM lineitem GROUP BY {c}" for c in ["l_returnflag", "l_linestatus"]))
def a4(spark, sf):
    return profile.describe_categorical(table(spark, sf, "lineitem").select(*FEATURES, "l_returnflag", "l_linestatus"))


def _pairs_sql(cols, fn, source="lineitem", same=True):
    rows = [(a, b) for a in cols for b in cols if same or a != b]
    return " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round({fn(a, b)}, 6) + 0.0 AS r FROM {source}" for a, b in rows)


@add("a5_correlation_pearson", _pairs_sql(LINE_NUMERIC, lambda a, b: f"corr({a}, {b})"))
def a5(spark, sf):
    return profile.correlation_pearson(table(spark, sf, "lineitem")).withColumn("r", r("r"))


@add("a5_correlation_pairwise_nulls", f"WITH {CLEAN_DIRTY} SELECT 'acct_bal' AS column_a, 'mostly_missing' AS column_b, round(corr(acct_bal, mostly_missing), 6) AS r FROM v_dirty UNION ALL SELECT 'acct_bal', 'c_custkey', round(corr(acct_bal, c_custkey), 6) FROM v_dirty UNION ALL SELECT 'mostly_missing', 'c_custkey', round(corr(mostly_missing, c_custkey), 6) FROM v_dirty")
def a5b(spark, sf):
    d = schema.rename_snake(views.dirty(spark, sf))
    m = profile.correlation_pearson(d, ["acct_bal", "mostly_missing", "c_custkey"])
    rank = F.create_map(*[x for kv in {"acct_bal": 0, "mostly_missing": 1, "c_custkey": 2}.items() for x in map(F.lit, kv)])
    return m.filter(rank[F.col("column_a")] < rank[F.col("column_b")]).withColumn("r", r("r"))


def _spearman_sql(a, b, source):
    avg_rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return (f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(ra, rb), 6) AS r FROM (SELECT {avg_rank(a)} AS ra, {avg_rank(b)} AS rb "
            f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t")


@add("a6_correlation_spearman", f"WITH {CLEAN_DIRTY} " + " UNION ALL ".join([_spearman_sql("acct_bal", "mostly_missing", "v_dirty"), _spearman_sql("acct_bal", "c_custkey", "v_dirty"), _spearman_sql("mostly_missing", "c_custkey", "v_dirty")]))
def a6(spark, sf):
    d = schema.rename_snake(views.dirty(spark, sf))
    return profile.correlation_spearman(d, ["acct_bal", "mostly_missing", "c_custkey"]).withColumn("r", r("r"))


@add("a6_correlation_spearman_lineitem", " UNION ALL ".join(_spearman_sql(a, b, "lineitem") for a, b in combinations(LINE_NUMERIC, 2)))
def a6b(spark, sf):
    return profile.correlation_spearman(table(spark, sf, "lineitem"), LINE_NUMERIC).withColumn("r", r("r"))


@add("a7_top_variance_columns", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(var_samp({c}), 3) AS variance FROM lineitem" for c in LINE_NUMERIC) + ") t ORDER BY variance DESC LIMIT 4")
def a7(spark, sf):
    return profile.top_variance_columns(table(spark, sf, "lineitem"), 4).withColumn("variance", r("variance", 3))


@add("a8_histogram", """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
 c AS (SELECT CAST(least(29, floor((l_extendedprice - lo) * 30 / (hi - lo))) AS INTEGER) AS bin, count(*) AS cnt FROM lineitem, b GROUP BY 1)
 SELECT CAST(g.i AS INTEGER) AS bin, round(lo + g.i * ((hi - lo) / 30), 6) AS "left", round(lo + (g.i + 1) * ((hi - lo) / 30), 6) AS "right", coalesce(cnt, 0) AS cnt
 FROM range(30) g(i) CROSS JOIN b LEFT JOIN c ON c.bin = g.i""")
def a8(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice").withColumns({"left": r("left"), "right": r("right")})


BOX = LINE_NUMERIC


def _box_sql(c):
    return f"""SELECT '{c}' AS "column", round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
 (SELECT min({c}) + 0.0 FROM lineitem WHERE {c} >= q1 - 1.5 * (q3 - q1)) AS whisker_low, (SELECT max({c}) + 0.0 FROM lineitem WHERE {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
 (SELECT count(*) FROM lineitem WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers
 FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM lineitem) t"""


@add("a9_box_stats", " UNION ALL ".join(f"SELECT \"column\", q1, median, q3, CAST(whisker_low AS DOUBLE) AS whisker_low, CAST(whisker_high AS DOUBLE) AS whisker_high, n_outliers FROM ({_box_sql(c)}) u" for c in BOX))
def a9(spark, sf):
    b = profile.box_stats(table(spark, sf, "lineitem"), BOX)
    return b.select("column", *[r(c).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "n_outliers")


@add("a10_target_distribution", "SELECT 'counts' AS kind, o_orderpriority AS category, count(*) AS frequency, round(count(*) / (SELECT count(*) FROM orders) * 100, 4) AS pct FROM orders GROUP BY o_orderpriority")
def a10(spark, sf):
    return profile.target_distribution(table(spark, sf, "orders"), "o_orderpriority")


@add("a10_target_distribution_numeric", """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders),
 c AS (SELECT CAST(least(39, floor((o_totalprice - lo) * 40 / (hi - lo))) AS INTEGER) AS bin, count(*) AS cnt FROM orders, b GROUP BY 1)
 SELECT 'histogram' AS kind, CAST(g.i AS VARCHAR) AS category, coalesce(cnt, 0) AS frequency, round(coalesce(cnt, 0) / n * 100, 4) AS pct
 FROM range(40) g(i) CROSS JOIN b LEFT JOIN c ON c.bin = g.i""")
def a10b(spark, sf):
    return profile.target_distribution(table(spark, sf, "orders"), "o_totalprice")


_MISS = " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS v FROM v_dirty" for c in ["c_custkey", "acct_bal", "nation_text", "segment", "active", "mostly_missing"])
_SKEW = " UNION ALL ".join(f"SELECT '{c}' AS name, skewness({c}) AS v FROM v_dirty" for c in ["c_custkey", "acct_bal", "mostly_missing"])


@add("a11_eda_summary", f"""WITH {CLEAN_DIRTY}, m AS ({_MISS}), s AS ({_SKEW})
 SELECT 'rows' AS metric, '' AS name, CAST(count(*) AS DOUBLE) AS value FROM v_dirty UNION ALL SELECT 'columns', '', 6.0 UNION ALL SELECT 'numeric_columns', '', 3.0
 UNION ALL SELECT 'categorical_columns', '', 3.0 UNION ALL SELECT 'total_missing', '', CAST(sum(v) AS DOUBLE) FROM m
 UNION ALL SELECT * FROM (SELECT 'missing', name, CAST(v AS DOUBLE) FROM m ORDER BY v DESC, name LIMIT 5) x
 UNION ALL SELECT * FROM (SELECT 'skewness', name, round(v, 5) + 0.0 FROM s ORDER BY abs(v) DESC, name LIMIT 3) y""")
def a11(spark, sf):
    return profile.eda_summary(schema.rename_snake(views.dirty(spark, sf))).withColumn("value", r("value", 5))


@add("a12_impute_median_mode", f"""WITH {CLEAN_DIRTY}, t AS (SELECT c_custkey, acct_bal, mostly_missing, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE lower(trim(segment)) END AS segment FROM v_dirty)
 SELECT c_custkey, round(coalesce(acct_bal, (SELECT quantile_cont(acct_bal, 0.5) FROM t)), 6) + 0.0 AS acct_bal, round(coalesce(mostly_missing, (SELECT quantile_cont(mostly_missing, 0.5) FROM t)), 6) + 0.0 AS mostly_missing,
 coalesce(segment, (SELECT segment FROM t WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)) AS segment FROM t""")
def a12(spark, sf):
    d = schema.rename_snake(views.dirty(spark, sf)).select(
        "c_custkey", "acct_bal", "mostly_missing", F.when(F.col("c_custkey") % 4 != 0, F.lower(F.trim("segment"))).alias("segment"))
    return cleaning.impute_apply(d, cleaning.impute_fit(d)).withColumns({"acct_bal": r("acct_bal"), "mostly_missing": r("mostly_missing")})


_FENCE = "SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem"


@add("a13_tukey_winsorize", "WITH " + ", ".join(f"f{i} AS ({_FENCE.format(c=c)})" for i, c in enumerate(LINE_NUMERIC))
     + " SELECT l_orderkey AS okey, l_linenumber AS line, " + ", ".join(f"round(greatest(least({c}, f{i}.q3 + 0.4 * (f{i}.q3 - f{i}.q1)), f{i}.q1 - 0.4 * (f{i}.q3 - f{i}.q1)), 6) AS {c}" for i, c in enumerate(LINE_NUMERIC))
     + " FROM lineitem" + "".join(f", f{i}" for i in range(len(LINE_NUMERIC))))
def a13(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), *LINE_NUMERIC)
    fits = cleaning.tukey_fit(d, LINE_NUMERIC, k=0.4)
    return cleaning.tukey_apply(d, fits).withColumns({c: r(c) for c in LINE_NUMERIC})


_CLEANED = f"""WITH {CLEAN_DIRTY}, k AS (SELECT DISTINCT c_custkey, acct_bal, TRY_CAST(nation_text AS DOUBLE) AS nation_text, lower(trim(segment)) AS segment, lower(active) AS active FROM v_dirty),
 f AS (SELECT c_custkey, coalesce(acct_bal, (SELECT quantile_cont(acct_bal, 0.5) FROM k)) AS acct_bal, coalesce(nation_text, (SELECT quantile_cont(nation_text, 0.5) FROM k)) AS nation_text, segment, active FROM k),
 b AS (SELECT quantile_cont(acct_bal, 0.25) AS q1, quantile_cont(acct_bal, 0.75) AS q3 FROM f)"""


@add("a14_clean_table", _CLEANED + " SELECT c_custkey, round(greatest(least(acct_bal, q3 + 0.5 * (q3 - q1)), q1 - 0.5 * (q3 - q1)), 6) AS acct_bal, nation_text, segment, active FROM f, b")
def a14(spark, sf):
    o = cleaning.CleaningOptions(drop_missing_pct=60.0, winsorize=True, iqr_multiplier=0.5, outlier_columns=["acct_bal"])
    return cleaning.clean(views.dirty(spark, sf), o)[0].withColumn("acct_bal", r("acct_bal"))


@add("a14_cleaning_log", _CLEANED + """ SELECT 'input_rows' AS metric, CAST(count(*) AS VARCHAR) AS value, '' AS detail FROM v_dirty
 UNION ALL SELECT 'missing_before', CAST(count(*) - count(c_custkey) AS VARCHAR), 'c_custkey' FROM v_dirty UNION ALL SELECT 'missing_before', CAST(count(*) - count(acct_bal) AS VARCHAR), 'acct_bal' FROM v_dirty
 UNION ALL SELECT 'missing_before', CAST(count(*) - count(nation_text) AS VARCHAR), 'nation_text' FROM v_dirty UNION ALL SELECT 'missing_before', CAST(count(*) - count(segment) AS VARCHAR), 'segment' FROM v_dirty
 UNION ALL SELECT 'missing_before', CAST(count(*) - count(active) AS VARCHAR), 'active' FROM v_dirty UNION ALL SELECT 'missing_before', CAST(count(*) - count(mostly_missing) AS VARCHAR), 'mostly_missing' FROM v_dirty
 UNION ALL SELECT 'dropped_column', '1', 'mostly_missing' UNION ALL SELECT 'removed_target_missing_rows', '0', '' UNION ALL SELECT 'removed_empty_rows', '0', ''
 UNION ALL SELECT 'numeric_coercion_induced_null', CAST(count(*) - count(TRY_CAST(nation_text AS DOUBLE)) AS VARCHAR), 'nation_text' FROM v_dirty
 UNION ALL SELECT 'string_normalized', '1', 'segment' UNION ALL SELECT 'string_normalized', '1', 'active'
 UNION ALL SELECT 'removed_duplicates', CAST((SELECT count(*) FROM v_dirty) - (SELECT count(*) FROM k) AS VARCHAR), ''
 UNION ALL SELECT 'winsorized_low', CAST(count(*) FILTER (WHERE acct_bal < q1 - 0.5 * (q3 - q1)) AS VARCHAR), 'acct_bal' FROM f, b
 UNION ALL SELECT 'winsorized_high', CAST(count(*) FILTER (WHERE acct_bal > q3 + 0.5 * (q3 - q1)) AS VARCHAR), 'acct_bal' FROM f, b
 UNION ALL SELECT 'output_rows', CAST(count(*) AS VARCHAR), '' FROM k""")
def a14b(spark, sf):
    o = cleaning.CleaningOptions(drop_missing_pct=60.0, winsorize=True, iqr_multiplier=0.5, outlier_columns=["acct_bal"])
    return cleaning.clean(views.dirty(spark, sf), o)[1]
