"""Profiling tables: one wide aggregation per step, long results."""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.operators.ordered import with_range
from nocturne.operators.quantiles import exact_quantiles, quantiles_and_modes
from nocturne.operators.schema import numeric_columns, q
from nocturne.session import keep, shared_dir


def _family(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "bigint"
    return "double" if isinstance(kind, (T.FloatType, T.DoubleType)) else "string"


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_unique) of non-null values, from one pass. Whole numbers travel as they are, others as fingerprints of 128 bits, so texts stay where they are."""
    zero = F.lit(0).cast("bigint")

    def mark(c: str):
        family = _family(df.schema[c].dataType)
        x = q(c).cast(family)
        if family == "bigint":
            return x, zero
        x = x + F.lit(0.0) if family == "double" else x
        return F.xxhash64(x), F.xxhash64(F.lit(1), x)

    cells = []
    for i, c in enumerate(columns):
        one, two = mark(c)
        cells.append(F.when(q(c).isNotNull(), F.struct(F.lit(i).alias("at"), one.alias("a"), two.alias("b"))))
    long = df.select(F.explode(F.array_compact(F.array(*cells))).alias("kv")).select("kv.*")
    counts = long.distinct().groupBy("at").agg(F.count("*").alias("n_unique"))
    return counts.select(F.get(F.array(*map(F.lit, columns)), F.col("at")).alias("column"), "n_unique")


def dataset_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null, missing, missing percent, distinct non-null values."""
    row = df.agg(F.count("*").alias("n"), *[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    cells = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"c{i}").alias("non_null_count"))
        for i, f in enumerate(df.schema)
    ]
    base = row.select("n", F.explode(F.array(*cells)).alias("x")).select("n", "x.*")
    missing = F.col("n") - F.col("non_null_count")
    pct = F.when(F.col("n") > 0, F.round(missing / F.nullif(F.col("n"), F.lit(0)) * 100, 4)).otherwise(0.0)
    return (
        base.join(distinct_counts(df, df.columns), "column", "left")
        .select("column", "dtype", "non_null_count", missing.alias("missing_count"), pct.alias("missing_pct"),
                F.coalesce("n_unique", F.lit(0)).alias("n_unique"))
        .orderBy(F.desc("missing_count"), "column")
    )


def corrected_skewness(n, biased):
    """Bias-corrected skewness from the population value."""
    n = n.cast("double")
    return F.when(n >= 3, biased * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def corrected_kurtosis(n, biased):
    """Bias-corrected excess kurtosis from the population value."""
    n = n.cast("double")
    return F.when(n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * biased + 6))


def _together(n, total, m2, m3, m4):
    """Sums of parts (along the first axis) as those of the whole: values, their sum and their sums of squares, cubes and fourth powers about the mean."""
    size = n.sum(0)
    d = np.where(n > 0, total / np.maximum(n, 1) - total.sum(0) / np.maximum(size, 1), 0.0)
    return (
        size, total.sum(0), (m2 + n * d**2).sum(0), (m3 + 3 * d * m2 + n * d**3).sum(0),
        (m4 + 4 * d * m3 + 6 * d**2 * m2 + n * d**4).sum(0),
    )


def _moments(batches):
    """Rows (i, n, total, m2, m3, m4, lo, hi) per column and task. NaN is the largest number, as in Spark."""
    parts, ends = [], []
    with np.errstate(all="ignore"):
        for batch in batches:
            sums, sides = [], []
            for column in batch.columns:
                x = column.drop_null().to_numpy(zero_copy_only=False)
                d = x - x.sum() / max(len(x), 1)
                square = d * d
                sums.append((len(x), x.sum(), square.sum(), (square * d).sum(), (square * square).sum()))
                sides.append((np.fmin.reduce(x), x.max()) if len(x) else (np.nan, -np.inf))
            parts.append(sums)
            ends.append(sides)
        if parts:
            n, *sums = _together(*np.moveaxis(np.array(parts, float), -1, 0))
            lo, hi = np.moveaxis(np.array(ends), -1, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.arange(len(n)), n.astype(np.int64), *sums, np.fmin.reduce(lo), hi.max(0))], ["i", "n", "total", "m2", "m3", "m4", "lo", "hi"]
            )


def _shapes(df: DataFrame, names: list[str]) -> DataFrame:
    """(i, n, mean, m2, m3, m4, lo, hi) per column with values, from one scan: sums per task, put together by their distance from the mean."""
    parts = df.select(*[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).mapInArrow(_moments, "i long, n long, total double, m2 double, m3 double, m4 double, lo double, hi double")
    whole = Window.partitionBy("i")
    n, d = F.col("n"), F.col("d")
    parts = parts.filter("n > 0").withColumn("d", F.col("total") / n - F.sum("total").over(whole) / F.sum("n").over(whole))
    d2 = d * d
    return parts.groupBy("i").agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.sum(F.col("m2") + n * d2).alias("m2"), F.sum(F.col("m3") + 3 * d * F.col("m2") + n * d2 * d).alias("m3"),
        F.sum(F.col("m4") + 4 * d * F.col("m3") + 6 * d2 * F.col("m2") + n * d2 * d2).alias("m4"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, median, mode, spread, range, iqr and corrected shape per numeric column."""
    names = columns or numeric_columns(df)
    quart, modes = quantiles_and_modes(df, names, [0.25, 0.5, 0.75])
    told = []
    for i, c in enumerate(names):
        lo, mid, hi = quart[c]
        told.append((i, c, mid, None if modes[c] is None else float(modes[c]), None if lo is None else hi - lo))
    told = df.sparkSession.createDataFrame(told, "i long, column string, median double, mode double, iqr double")
    n = F.col("n").cast("double")
    var = F.when(n > 1, F.col("m2") / F.nullif(n - 1, F.lit(0.0)))
    skew = F.when(F.col("m2") != 0, F.sqrt(n) * F.col("m3") / F.sqrt(F.col("m2") * F.col("m2") * F.col("m2")))
    kurt = F.when(F.col("m2") != 0, n * F.col("m4") / (F.col("m2") * F.col("m2")) - 3)
    return told.join(_shapes(df, names), "i", "left").select(
        "column", F.coalesce("n", F.lit(0)).alias("count"), "mean", "median", "mode", F.sqrt(var).alias("std"), var.alias("var"), F.col("lo").alias("min"), F.col("hi").alias("max"),
        (F.col("hi") - F.col("lo")).alias("range"), "iqr", corrected_skewness(F.col("n"), skew).alias("skewness"), corrected_kurtosis(F.col("n"), kurt).alias("kurtosis"),
    ).orderBy("column")


def describe_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Value frequencies of every non-numeric column, nulls as <MISSING>."""
    names = columns or [c for c in df.columns if c not in numeric_columns(df)]
    cells = [F.struct(F.lit(c).alias("column"), F.coalesce(q(c).cast("string"), F.lit("<MISSING>")).alias("category")) for c in names]
    counts = df.select(F.explode(F.array(*cells)).alias("kv")).select("kv.*").groupBy("column", "category").agg(F.count("*").alias("frequency"))
    n = df.count()
    return counts.withColumn("proportion_pct", F.round(F.col("frequency") / max(n, 1) * 100, 4))


def _pair_sums(names: list[str], shift: list[float]):
    """Sums over the rows complete for each pair of columns: one matrix product per Arrow batch, one row per pair and partition."""
    p = len(names)

    def run(batches):
        total = np.zeros((6, p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) if batch.num_rows else np.zeros((0, p))
            there = ~np.isnan(x)
            x, here = np.where(there, x - shift, 0.0), there.astype(float)
            sums, squares = x.T @ here, (x * x).T @ here
            total += np.stack([here.T @ here, sums, sums.T, squares, squares.T, x.T @ x])
        i, j = np.indices((p, p)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(t.ravel()) for t in total)], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    return run


def correlation_pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form, from one scan; a constant column gives null. NaN is null."""
    names = columns or numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double")
    clean = df.select(*[F.nanvl(q(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(names)])
    least = clean.agg(*[F.min(f"x{i}").alias(f"x{i}") for i in range(len(names))]).first()  # what is subtracted: a constant column becomes zeros
    parts = clean.mapInArrow(_pair_sums(names, [0.0 if v is None else float(v) for v in least]), "i long, j long, n double, x double, y double, xx double, yy double, xy double")
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])

    def spread(square, total):
        v = F.col(square) - F.col(total) * F.col(total) / F.col("n")
        return F.when(v > 1e-12 * F.col(square), v)  # less is rounding

    r = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.sqrt(spread("xx", "x")) * F.sqrt(spread("yy", "y")))
    label = F.array(*[F.lit(c) for c in names])
    return s.select(F.get(label, F.col("i").cast("int")).alias("column_a"), F.get(label, F.col("j").cast("int")).alias("column_b"), F.when(F.col("n") > 0, r).alias("r"))


def _ranks(long: DataFrame) -> DataFrame:
    """(v, row, rank): average ranks of ``x`` within each ``v``.

    Rows are ranked per (v, range of values); what earlier ranges hold is added from a small table.  Only values at the ends of ranges can stand in
    several of them, and these are counted over all ranges, so a value that most rows share is ranked in many tasks.
    """
    path = shared_dir(long.sparkSession)
    with_range(long, ["v", "x", "row"]).write.parquet(path)  # read three times; kept in executors it would be a row per value there, in blocks as large as its partitions
    cut = long.sparkSession.read.parquet(path)
    parts = cut.groupBy("v", "_range").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("v").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = keep(parts.withColumn("ahead", ahead))  # one row per cut point and v at most
    ends = parts.select("v", F.explode(F.array("lo", "hi")).alias("x")).distinct()
    held = cut.join(F.broadcast(ends), ["v", "x"]).groupBy("v", "x", "_range").agg(F.count("*").alias("k")).join(parts, ["v", "_range"])
    first = F.min(F.col("ahead") + F.when(F.col("x") == F.col("hi"), F.col("n") - F.col("k")).otherwise(0))
    spread = held.groupBy("v", "x").agg(first.alias("_first"), F.sum("k").alias("_ties"))
    local = cut.select(
        "v", "row", "x", "_range", (F.rank().over(Window.partitionBy("v", "_range").orderBy("x")) - 1).alias("_before"), F.count("*").over(Window.partitionBy("v", "_range", "x")).alias("_same")
    )
    both = local.join(F.broadcast(parts.select("v", "_range", "ahead")), ["v", "_range"]).join(F.broadcast(spread), ["v", "x"], "left")
    rank = F.coalesce(F.col("_first"), F.col("ahead") + F.col("_before")) + (F.coalesce("_ties", "_same") + 1) / 2
    return both.select("v", "row", rank.alias("rank"))


def correlation_spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson on average ranks, ranks taken on the rows complete for the pair; null if a side is constant. NaN is null.

    A column is ranked once among the rows of all columns without nulls, and once for each column with nulls.  The ranks go back to their rows,
    and all pairs are summed in one scan.
    """
    names = columns or numeric_columns(df)
    spark = df.sparkSession
    empty = spark.createDataFrame([], "column_a string, column_b string, r double")
    if len(names) < 2:
        return empty
    clean = [F.nanvl(q(c).cast("double"), F.lit(None).cast("double")) + F.lit(0.0) for c in names]
    path = shared_dir(spark)
    df.select(F.monotonically_increasing_id().alias("row"), *[x.alias(f"x{i}") for i, x in enumerate(clean)]).write.parquet(path)  # fixes the row numbers
    rows = spark.read.parquet(path)
    holes = rows.agg(*[F.count_if(F.col(f"x{i}").isNull()).alias(f"x{i}") for i in range(len(names))]).first()
    holed = {i for i, n in enumerate(holes) if n}
    mask = lambda a, b: (a, b if b in holed else None)
    wanted = sorted({v for a, b in combinations(range(len(names)), 2) for v in (mask(a, b), mask(b, a))}, key=str)
    number = {v: i for i, v in enumerate(wanted)}
    value = lambda a, b: F.col(f"x{a}") if b is None else F.when(F.col(f"x{b}").isNotNull(), F.col(f"x{a}"))
    cells = F.array(*[F.struct(F.lit(i).alias("v"), value(a, b).alias("x")) for (a, b), i in number.items()])
    long = rows.select("row", F.explode(cells).alias("c")).select("row", "c.*").filter("x is not null")
    ranks = _ranks(long)
    sizes = {r["v"]: r["count"] for r in long.groupBy("v").count().collect()}
    # A row's ranks come from as many tasks as it has columns: brought together first, since sums per task before that would be wide rows for nothing.
    wide = ranks.repartition("row").groupBy("row").agg(*[F.max(F.when(F.col("v") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(wanted))]).drop("row")
    shift = [(sizes.get(i, 0) + 1) / 2 for i in range(len(wanted))]  # the mean rank
    parts = wide.mapInArrow(_pair_sums([f"r{i}" for i in range(len(wanted))], shift), "i long, j long, n double, x double, y double, xx double, yy double, xy double")
    pairs = [(number[mask(a, b)], number[mask(b, a)], names[a], names[b]) for a, b in combinations(range(len(names)), 2)]
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.col("n")
    r = (F.col("xy") - F.col("x") * F.col("y") / n) / F.nullif(F.sqrt(F.col("xx") - F.col("x") * F.col("x") / n) * F.sqrt(F.col("yy") - F.col("y") * F.col("y") / n), F.lit(0.0))
    told = spark.createDataFrame(pairs, "i long, j long, column_a string, column_b string")
    return told.join(s, ["i", "j"], "left").select("column_a", "column_b", F.when(n > 0, r).alias("r"))


def top_variance_columns(df: DataFrame, n: int = 15) -> DataFrame:
    names = numeric_columns(df)
    row = df.agg(*[F.var_samp(q(c).cast("double")).alias(f"v{i}") for i, c in enumerate(names)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(names)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*").orderBy(F.desc_nulls_last("variance"), "column").limit(n)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the value range, the last one closed, empty bins kept."""
    x = q(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, left double, right double, cnt bigint")
    n_bins = bins if hi > lo else 1
    width = (hi - lo) / n_bins
    at = F.least(F.lit(n_bins - 1), F.floor((x - lo) * n_bins / (hi - lo))) if hi > lo else F.lit(0)
    counts = df.filter(x.isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("cnt"))
    grid = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("left"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("right"),
        F.coalesce("cnt", F.lit(0)).alias("cnt"),
    )


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, whisker ends at 1.5 iqr and the number of points beyond them."""
    quart = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    usable = [c for c in columns if quart[c][0] is not None]
    aggs, cells = [], []
    for i, c in enumerate(usable):
        q1, q2, q3 = quart[c]
        lo, hi, x = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), q(c).cast("double")
        inside = x.between(lo, hi)
        aggs += [F.min(F.when(inside, x)).alias(f"a{i}"), F.max(F.when(inside, x)).alias(f"b{i}"), F.count_if(~inside).alias(f"o{i}")]
        cells.append(F.struct(
            F.lit(c).alias("column"), F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"),
            F.col(f"a{i}").alias("whisker_low"), F.col(f"b{i}").alias("whisker_high"), F.col(f"o{i}").alias("n_outliers"),
        ))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("b")).select("b.*")


def target_distribution(df: DataFrame, target: str, max_values: int = 25, bins: int = 40) -> DataFrame:
    """Counts per value, or a histogram when a numeric target has many values.

    Result: (kind, category, frequency, pct); for a histogram the category is the bin.
    """
    n = df.count()
    if target in numeric_columns(df):
        distinct = df.agg(F.count_distinct(q(target))).first()[0]
        if distinct > max_values:
            table = histogram(df, target, bins)
            return table.select(F.lit("histogram").alias("kind"), F.col("bin").cast("string").alias("category"),
                                F.col("cnt").alias("frequency"), F.round(F.col("cnt") / max(n, 1) * 100, 4).alias("pct"))
    label = F.coalesce(q(target).cast("string"), F.lit("<MISSING>"))
    counts = df.groupBy(label.alias("category")).agg(F.count("*").alias("frequency"))
    return counts.select(F.lit("counts").alias("kind"), "category", "frequency", F.round(F.col("frequency") / max(n, 1) * 100, 4).alias("pct"))


def eda_summary(df: DataFrame) -> DataFrame:
    """(metric, name, value): sizes, missing totals, top-5 missing columns, top-3 absolute skewness."""
    names = numeric_columns(df)
    missing = [F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    shape = []
    for i, c in enumerate(names):
        x = q(c).cast("double")
        shape += [F.skewness(x).alias(f"s{i}"), F.count(x).alias(f"k{i}")]
    row = df.agg(F.count("*").alias("n"), *missing, *shape)
    total = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0))
    fixed = [("rows", F.col("n")), ("columns", F.lit(len(df.columns))), ("numeric_columns", F.lit(len(names))),
             ("categorical_columns", F.lit(len(df.columns) - len(names))), ("total_missing", total)]
    cell = lambda m, name, v: F.struct(F.lit(m).alias("metric"), F.lit(name).alias("name"), v.cast("double").alias("value"))
    wide = row.select(
        F.array(*[cell(m, "", v) for m, v in fixed]).alias("base"),
        F.array(*[cell("missing", c, F.col(f"m{i}")) for i, c in enumerate(df.columns)]).alias("miss"),
        F.array(*([cell("skewness", c, corrected_skewness(F.col(f"k{i}"), F.col(f"s{i}"))) for i, c in enumerate(names)] or [cell("skewness", "", F.lit(None))])).alias("skew"),
    )
    long = wide.select(F.explode("base").alias("x")).select("x.*")
    miss = wide.select(F.explode("miss").alias("x")).select("x.*").orderBy(F.desc("value"), "name").limit(5)
    skew = wide.select(F.explode("skew").alias("x")).select("x.*").filter("value is not null").orderBy(F.desc(F.abs("value")), "name").limit(3)
    return long.unionByName(miss).unionByName(skew)
