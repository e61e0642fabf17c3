"""Ordered operators give the rows of plain windows, on data where one key holds most rows, and spread that key."""
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from nocturne.operators import balance, filters, folds, joins, metrics, ordered, profile, quantiles, timeseries
from nocturne.operators.ordered import Desc
from nocturne.sources import recordings

RANGES = 20


@pytest.fixture(scope="module")
def rows(spark):
    """1000 rows: key 'a' holds two thirds, 'b' and a null key the rest; equal order values occur."""
    key = F.when(F.col("id") % 3 < 2, "a").when(F.col("id") % 2 == 0, "b")
    t = ((F.col("id") * 7919) % 503).cast("bigint")
    df = spark.range(1000).select(key.alias("k"), "id", t.alias("t"), ((F.col("id") * 31) % 97).cast("double").alias("v"))
    return df.withColumn("name", F.concat(F.lit("item_"), F.lpad(F.col("t").cast("string"), 4, "0"))).cache()


def same(a, b):
    cols = sorted(a.columns)
    x = sorted(map(repr, a.select(cols).collect()))
    y = sorted(map(repr, b.select(cols).collect()))
    assert x == y and x


@pytest.mark.parametrize("order", [["t", "id"], ["name", "id"]])
def test_running_and_positions(rows, order):
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), (F.count("*").over(w) - 1).alias("pos"))
    got = ordered.running(rows, ["k"], order, sums={"s": F.col("v")}, maxes={"m": F.col("v")}, ranges=RANGES)
    got = ordered.positions(got, ["k"], order, "pos", ranges=RANGES)
    same(got, want)


def test_no_range_holds_a_large_share(rows):
    """Neither a key of two thirds of the rows, nor one order value that all rows share, makes a large range."""
    for df, by in ((rows, ["k", "t", "id"]), (rows.withColumn("t", F.lit(1)), ["t", "id"]), (rows.withColumn("k", F.lit("a")), ["k", "name", "id"])):
        sizes = [r["count"] for r in ordered.with_range(df, by, RANGES).groupBy("_range").count().collect()]
        assert len(sizes) > RANGES / 2 and max(sizes) < 3 * 1000 / RANGES


def test_the_plan_is_the_same_for_few_rows(rows):
    for df in (rows, rows.limit(3)):
        assert "_range" in ordered.positions(df, ["k"], ["t", "id"])._jdf.queryExecution().toString()


def test_plans_for_thousands_of_ranges(spark):
    """The cut points lie in one array per column, so that making the plan takes no longer for many ranges."""
    df = spark.range(100_000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("t"), F.col("id").cast("string").alias("name")).cache()
    df.count()
    for ranges in (20, 2000):
        start = time.perf_counter()
        got = ordered.running(df, ["k"], ["t", "name"], sums={"s": F.lit(1)}, ranges=ranges)
        assert time.perf_counter() - start < 5
    assert got.groupBy("k").agg((F.max("s") == F.count("*")).alias("ok")).filter("ok").count() == 3


@pytest.mark.parametrize("kind", ["nan", "binary", "struct", "descending", "long_prefix", "timestamp", "decimal", "null", "date", "float", "array"])
def test_order_types(rows, kind):
    made = {
        "nan": F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("v")),
        "binary": F.unhex(F.hex(F.col("t"))),
        "struct": F.struct(F.col("v").alias("a"), F.col("name").alias("b")),
        "long_prefix": F.concat(F.lit("recording_0_with_the_same_long_prefix_"), F.lpad(F.col("t").cast("string"), 6, "0")),
        "timestamp": F.timestamp_seconds(F.col("t")),
        "decimal": F.col("t").cast("decimal(30,3)"),
        "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("t").cast("int")), "float": (F.col("t") / 3).cast("float"), "array": F.array(F.col("t"), F.lit(2)),
        "null": F.when(F.col("id") % 4 > 0, F.col("t")),
    }
    df = rows.withColumn("o", made.get(kind, F.col("t")))
    order, by = (["o", "id"], ["o", "id"]) if kind != "descending" else ([Desc("o"), "id"], [F.desc("o"), "id"])
    for keys in (["k"], []):
        w = Window.partitionBy(*keys).orderBy(*by)
        want = df.select("id", (F.row_number().over(w) - 1).cast("bigint").alias("pos"))
        same(ordered.positions(df, keys, order, ranges=RANGES).select("id", "pos"), want)


def test_modes_and_medians_of_large_numbers(spark):
    big = 2**53
    df = spark.createDataFrame([(big,), (big + 1,), (big + 1,)], "n long").withColumn("d", (F.col("n") * F.lit("1" + "0" * 20).cast("decimal(21,0)")).cast("decimal(38,0)"))
    quartiles, modes = quantiles.quantiles_and_modes(df, ["n", "d"], [0.5])
    assert modes["n"] == big + 1 and int(modes["d"]) == (big + 1) * 10**20
    assert quartiles["n"] == [float(big + 1)]


def test_scores_that_are_not_numbers(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, float("nan")), (0, None)], "y_true int, y_score double")
    assert metrics.auc_roc(df, []).first()[0] == 1.0
    assert quantiles.exact_quantiles(df, ["y_score"], [0.5])["y_score"] == [0.5]


def test_running_without_keys_and_with_nulls(rows):
    df = rows.withColumn("t", F.when(F.col("id") % 11 != 0, F.col("t")))
    w = Window.orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(ordered.running(df, [], ["t", "id"], sums={"s": F.col("v")}, ranges=RANGES), df.withColumn("s", F.sum("v").over(w)))


def test_running_when_one_order_value_dominates(rows):
    df = rows.withColumn("t", F.lit(5))
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(ordered.running(df, ["k"], ["t", "id"], sums={"s": F.col("v")}, ranges=RANGES), df.withColumn("s", F.sum("v").over(w)))


def test_shifted(rows):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = rows.select("*", F.lag("v", 2).over(w).alias("a"), F.lead("v", 1).over(w).alias("b"))
    same(ordered.shifted(rows, ["k"], ["t", "id"], {"a": ("v", -2), "b": ("v", 1)}, ranges=RANGES), want)


def test_exact_quantiles(rows):
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    df = rows.withColumn("w", F.when(F.col("id") % 4 == 0, F.col("v") / 3)).withColumn("empty", F.lit(None).cast("double"))
    a = quantiles.exact_quantiles(df, ["v", "w", "empty"], probs)
    assert a["empty"] == [None] * 6
    for c in ("v", "w"):
        x = sorted(r[0] for r in df.select(c).dropna().collect())
        at = [(len(x) - 1) * p for p in probs]
        assert a[c] == pytest.approx([x[math.floor(i)] + (x[math.ceil(i)] - x[math.floor(i)]) * (i - math.floor(i)) for i in at])


def test_quantiles_of_every_kind_of_number(spark):
    """Radix refinement beside sorting: signs, infinities, zeros, ties, wide spreads, whole numbers and decimals, and an interval with many equal values."""
    rnd = np.random.default_rng(4)
    n = 20_000
    made = {
        "normal": rnd.normal(size=n), "wide": np.exp(rnd.normal(scale=200, size=n)) * rnd.choice([-1, 1], n), "ties": rnd.integers(0, 3, n) * 0.5, "one": np.full(n, 7.25),
        "zeros": np.where(rnd.random(n) < 0.5, 0.0, -0.0), "ends": rnd.choice([-np.inf, 0.0, 5e-324, np.inf], n), "near": 1e9 + rnd.random(n) * 1e-6, "holes": np.where(rnd.random(n) < 0.3, np.nan, rnd.random(n)),
    }
    frame = pd.DataFrame(made | {"whole": rnd.integers(-(2**62), 2**62, n), "small": rnd.integers(-3, 3, n).astype("int16")})
    df = spark.createDataFrame(frame).withColumn("money", (F.col("small") * 1.25).cast("decimal(15,2)")).repartition(5)
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9999, 1.0]
    got = quantiles.exact_quantiles(df, df.columns, probs)
    frame["money"] = frame["small"] * 1.25
    for c in df.columns:
        x = sorted(frame[c].dropna().tolist())
        at = [(len(x) - 1) * p for p in probs]
        want = [quantiles._between(x[math.floor(i)], x[math.ceil(i)], i - math.floor(i)) for i in at]
        assert got[c] == pytest.approx(want, rel=1e-15, nan_ok=True), c
    assert quantiles.exact_quantiles(df.limit(0), ["whole", "normal"], [0.5]) == {"whole": [None], "normal": [None]}


def test_quantile_passes_send_bounded_tables(spark):
    """What a pass counts per partition doesn't grow with the number of distinct values."""
    df = spark.range(0, 300_000, 1, 3).select(F.xxhash64("id").alias("c0"))
    sent = df.mapInArrow(quantiles._counting([(0, 0, (1 << 64) - 1)]), "slot long, bin long, n long, least long, most long").cache()
    assert sent.count() <= 3 * 2**quantiles.BITS and sent.agg(F.sum("n")).first()[0] == 300_000


def test_shifted_over_many_pieces(rows):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = rows.select("*", F.lag("v", 2).over(w).alias("a"), F.lead("v", 3).over(w).alias("b"))
    same(ordered.shifted(rows, ["k"], ["t", "id"], {"a": ("v", -2), "b": ("v", 3)}, ranges=RANGES, piece_rows=7), want)


def test_context_and_sequences(rows):
    df = rows.withColumn("v", F.when(F.col("id") % 5 != 0, F.col("v"))).withColumn("e", F.col("t") * 1000 + F.col("id")).select("k", "e", "v")
    w = Window.partitionBy("k").orderBy("e")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = lambda f: f("v", ignorenulls=True).over(whole)
    want = df.select(
        "*", *[F.coalesce(F.lag("v", i).over(w), edge(F.first)).alias(f"v_lag{i}") for i in (1, 2)], *[F.coalesce(F.lead("v", i).over(w), edge(F.last)).alias(f"v_lead{i}") for i in (1, 2)]
    )
    same(timeseries.temporal_context(df, "k", "e", ["v"]), want)
    got = timeseries.sequence_index(df, "k", ["e"], 5).select("k", "e", "row_index")
    same(got, df.select("k", "e", (F.row_number().over(Window.orderBy("k", "e")) - 1).cast("bigint").alias("row_index")))


def test_overlap_flags(spark, rows):
    epochs = rows.filter("id < 300").select("k", "id", (F.col("t") * 30.0).alias("s"), (F.col("t") * 30.0 + 30).alias("e"))
    events = rows.filter("id >= 300").select("k", (F.col("t") * 30.0 + F.col("v")).alias("a"), (F.col("t") * 30.0 + F.col("v") * 2 - 20).alias("b"))
    hits = epochs.alias("x").join(events.alias("y"), F.expr("x.k = y.k and y.a < x.e and y.b > x.s")).select("x.id").distinct().withColumn("hit", F.lit(1))
    want = epochs.filter("k is not null").join(hits, "id", "left").select("id", F.coalesce("hit", F.lit(0)).alias("flag"))
    same(joins.flag_by_overlap(epochs, events, "k", "s", "e", "a", "b").filter("k is not null").select("id", "flag"), want)
    assert 0 < want.filter("flag = 1").count() < want.count()


def test_metrics_ranks_and_trims(rows):
    p = rows.select("k", (F.col("id") % 3 == 0).cast("int").alias("y_true"), F.col("t").cast("double").alias("y_score"), "id", "t", "v").fillna("none", ["k"])
    local = p.toPandas()
    for keys in ([], ["k"]):
        for r in metrics.auc_roc(p, keys).collect():
            part = local[local.k == r["k"]] if keys else local
            up, down = part[part.y_true == 1].y_score, part[part.y_true == 0].y_score
            if len(up) and len(down):
                won = sum((down < s).sum() + (down == s).sum() / 2 for s in up)
                assert r["auc_roc"] == pytest.approx(won / len(up) / len(down))
        points = metrics.roc_points(p, keys).toPandas()
        assert points.groupby("k").tpr.max().eq(1).all() if keys else points.tpr.max() == 1
    got = {(r["column_a"], r["column_b"]): r["r"] for r in profile.correlation_spearman(p, ["t", "v", "id"]).collect()}
    want = local[["t", "v", "id"]].rank().corr()
    assert got and all(v == pytest.approx(want.loc[a, b]) for (a, b), v in got.items())
    stages = rows.withColumn("sleep_stage", F.when((F.col("t") < 20) | (F.col("t") > 480), "W").otherwise("N2"))
    trimmed = filters.wake_trim(stages, "k", ["t", "id"], minutes=2)
    assert trimmed.count() < stages.count() and trimmed.filter("sleep_stage = 'N2'").count() == stages.filter("sleep_stage = 'N2'").count()


def test_samples_and_folds(rows):
    named = rows.fillna("none", ["k"])
    sizes = sorted(r["count"] for r in named.groupBy("k").count().collect())
    for f, size in ((balance.random_under, sizes[0]), (balance.random_over, sizes[-1])):
        assert {r["count"] for r in f(named, "k", ["id"]).groupBy("k").count().collect()} == {size}
    df = rows.withColumn("subject", F.col("id") % 211).withColumn("label", F.when(F.col("subject") % 5 > 0, "x").otherwise("y"))
    for seed in (3, None):
        dealt = folds.stratified_group_folds(df, "subject", "label", 4, seed).groupBy("dominant", "fold").count().toPandas()
        spread = dealt.groupby("dominant")["count"]
        assert (spread.max() - spread.min() <= 2).all() and (spread.size() == 4).all()
    batches = timeseries.recording_batches(df, "k", ["id"], 16).groupBy("k", "batch_id").count().toPandas()
    assert batches["count"].max() == 16


def test_segment_cap_follows_path_order(spark, tmp_path):
    for i in range(12):
        d = tmp_path / f"Non_Events/b{i % 3}"
        d.mkdir(parents=True, exist_ok=True)
        name = f"S1_p{i}_Stagen{i % 5}.csv" if i % 4 else f"S1_p{i}.csv"
        (d / name).write_text("misc,C3-M2\n" + "\n".join(f"x,{j * i}" for j in range(8)))
    used, report = recordings.scan_segment_files(spark, str(tmp_path), max_files=4)
    paths = [r[0] for r in recordings.segment_files(spark, str(tmp_path)).orderBy("source_file").select("source_file", "usable").collect()]
    ok = [r["source_file"] for r in recordings.segment_files(spark, str(tmp_path)).filter("usable").orderBy("source_file").collect()]
    assert sorted(r[0] for r in used.select("source_file").collect()) == ok[:4]
    seen = paths[: paths.index(ok[4])]  # files are looked at until the next usable one would exceed the cap
    row = report.first()
    assert (row["n_files_used"], row["n_files_skipped"]) == (4, len(seen) - 4)


def test_describe_takes_one_narrow_scan(spark):
    """Moments come from one Arrow scan with sums per task, not from a wide row of aggregates; beside NumPy, with nulls, NaN, constants, an offset and no values."""
    rnd = np.random.default_rng(5)
    n = 4_000
    made = pd.DataFrame({"far": 1e6 + rnd.exponential(size=n), "few": rnd.integers(0, 3, n), "same": np.full(n, 2.5), "holes": rnd.normal(size=n)})
    df = spark.createDataFrame(made).repartition(7).withColumn("holes", F.when(F.col("few") != 0, F.col("holes"))).withColumn("none", F.lit(None).cast("double"))
    out = profile.describe_numeric(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "kurtosis(" not in plan
    got = {r["column"]: r.asDict() for r in out.collect()}
    holes = made["holes"][made["few"] != 0]
    for c, x in {"far": made["far"], "few": made["few"], "holes": holes}.items():
        want = {"count": len(x), "mean": x.mean(), "median": x.median(), "mode": float(x.mode()[0]), "std": x.std(), "var": x.var(), "min": x.min(), "max": x.max(), "skewness": x.skew(), "kurtosis": x.kurt()}
        for k, v in want.items():
            assert got[c][k] == pytest.approx(v, rel=1e-8), (c, k)
    assert (got["same"]["var"], got["same"]["skewness"], got["same"]["kurtosis"], got["same"]["mode"]) == (0.0, None, None, 2.5)
    assert got["none"]["count"] == 0 and all(got["none"][k] is None for k in ("mean", "mode", "median", "std", "min", "max", "range", "skewness"))
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "x double")
    seen = profile.describe_numeric(odd).first()
    assert (seen["count"], seen["min"]) == (3, 1.0) and math.isnan(seen["max"]) and math.isnan(seen["mean"])
    assert profile.describe_numeric(odd.limit(0)).first()["count"] == 0


def test_modes_counted_in_tasks_first(spark):
    df = spark.range(300_000, numPartitions=3).select((F.col("id") % 7).alias("few"), F.when(F.col("id") % 3 == 0, -0.0).otherwise(F.col("id") * 1.5).alias("many"), (F.col("id") % 2 == 0).alias("flag"), F.lit(None).cast("int").alias("none"))
    assert quantiles.exact_modes(df, df.columns) == {"few": 0, "many": 0.0, "flag": 0.0, "none": None}


def test_neighbour_search_holds_one_chunk_of_distances():
    """What a task holds doesn't grow with queries times points: only the nearest of each query are kept."""
    import tracemalloc

    from nocturne.operators import neighbors

    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(4_000, 2)), 3)
    points = pd.DataFrame({"v": list(v), "times": 1})
    queries = pd.DataFrame({"cls": "a", "v": list(v[:2_000]), "cell": 0, "far": np.inf})
    search = neighbors._search(5)
    tracemalloc.start()
    try:
        found = search(queries, points)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30e6, peak  # all places together are 64 MB
    for i in (0, 77, 1_999):
        assert np.allclose(np.sort(found["d"][i]), np.sort(np.sqrt(((v - v[i]) ** 2).sum(1)))[:6])


def test_spearman_keeps_no_row_per_value_in_executors(spark, monkeypatch):
    """A row per value and column is written to the shared folder; only tables of the ranges are kept. A row's ranks meet before they are summed."""
    kept, real = [], profile.keep
    monkeypatch.setattr(profile, "keep", lambda df: kept.append(df.columns) or real(df))
    rng = np.random.default_rng(4)
    made = pd.DataFrame({"a": rng.integers(0, 9, 500) * 1.0, "b": rng.normal(size=500), "c": rng.normal(size=500)})
    out = profile.correlation_spearman(spark.createDataFrame(made))
    got = {(r.column_a, r.column_b): r.r for r in out.collect()}
    want = made.rank().corr()
    assert len(got) == 3 and all(abs(want.loc[a, b] - r) < 1e-9 for (a, b), r in got.items())
    assert kept and not any("row" in names for names in kept)
