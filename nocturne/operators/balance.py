"""Class counts, weights and resampling to exact class targets."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.operators import neighbors
from nocturne.operators.ordered import positions
from nocturne.operators.schema import numeric_columns, q


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows of each class; rows without one don't count."""
    return df.filter(q(target).isNotNull()).groupBy(q(target).cast("string").alias("label")).agg(F.count("*").alias("cnt"))


def counts_of(df: DataFrame, target: str, max_classes: int | None = None) -> dict[str, int]:
    """Class counts on the driver; more than ``max_classes``, if given, are an error."""
    counts = class_counts(df, target)
    rows = (counts if max_classes is None else counts.limit(max_classes + 1)).collect()
    if max_classes is not None and len(rows) > max_classes:
        raise ValueError(f"{target!r} has more than {max_classes} classes")
    return {r["label"]: r["cnt"] for r in rows}


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(label, weight) with weight = rows / (classes * class rows); rows without a class count among the rows."""
    counts = class_counts(df, target)
    return counts.select("label", (F.lit(df.count()) / (F.lit(counts.count()) * F.col("cnt"))).alias("weight"))


def with_class_weight(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """Balanced weight on every row, null where the class is."""
    weights = class_weights(df, target).select(F.col("label").alias("_label"), F.col("weight").alias("_weight"))
    return df.join(weights, q(target).cast("string") == F.col("_label"), "left").select(*[q(c) for c in df.columns], F.col("_weight").alias(out))


def targets(counts: dict[str, int], under: bool, strategy="auto") -> dict[str, int]:
    """Rows each class should have: a dict, a minority/majority ratio, or a named rule."""
    low, high = min(counts.values()), max(counts.values())
    if isinstance(strategy, dict):
        for c, t in strategy.items():
            if c not in counts or (t > counts[c] if under else t < counts[c]):
                raise ValueError(f"target {t} is not possible for class {c!r}")
        return {**counts, **strategy}
    if isinstance(strategy, float):
        if len(counts) != 2:
            raise ValueError("a ratio needs two classes")
        few, many = min(counts, key=lambda c: counts[c]), max(counts, key=lambda c: (counts[c], c))
        if under:
            goal = {few: counts[few], many: int(counts[few] / strategy)}
            if goal[many] > counts[many]:
                raise ValueError("the ratio would add rows to the larger class")
        else:
            goal = {many: counts[many], few: int(counts[many] * strategy)}
            if goal[few] < counts[few]:
                raise ValueError("the ratio would remove rows from the smaller class")
        return goal
    goal = low if under else high
    smallest = min(counts, key=lambda c: counts[c])
    largest = max(counts, key=lambda c: counts[c])
    chosen = {
        "auto": set(counts) - {smallest if under else largest}, "not minority": set(counts) - {smallest},
        "not majority": set(counts) - {largest}, "all": set(counts), "majority": {largest}, "minority": {smallest},
    }[strategy]
    return {c: goal if c in chosen else n for c, n in counts.items()}


def _draw_order(df: DataFrame, seed: int, order: list[str]):
    return df.withColumn("_draw", F.xxhash64(F.lit(seed), *[q(c) for c in order]))


def _by_class(target: str, table: dict[str, int]):
    return F.coalesce(*[F.when(q(target).cast("string") == c, F.lit(n)) for c, n in table.items()], F.lit(0))


def random_under(df: DataFrame, target: str, order: list[str], strategy="auto", seed: int = 42) -> DataFrame:
    """Each class cut to its target by hash order; ``order`` names columns that identify a row."""
    goal = targets(counts_of(df, target), True, strategy)
    placed = positions(_draw_order(df, seed, order), [target], ["_draw", *order], "_pos")
    return placed.filter(F.col("_pos") < _by_class(target, goal)).drop("_draw", "_pos")


def drawn_rows(df: DataFrame, target: str, order: list[str], counts: dict[str, int], extra: dict[str, int], seed: int) -> DataFrame:
    """Rows drawn with replacement: ``extra`` draws per class, each with its number ``_i``.

    Draws are hashed row numbers; the join key (class, row number) is spread evenly.
    """
    spark = df.sparkSession
    drawn = [
        spark.range(m).select(F.lit(c).alias("_cls"), F.col("id").alias("_i"), F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.col("id")), F.lit(counts[c])).alias("_pos"))
        for c, m in extra.items() if m > 0
    ]
    if not drawn:
        return df.limit(0).withColumn("_i", F.lit(0).cast("bigint"))
    placed = positions(_draw_order(df, seed, order), [target], ["_draw", *order], "_pos").drop("_draw")
    placed = placed.withColumn("_cls", q(target).cast("string")).filter(F.col("_cls").isin(*extra))
    return placed.join(reduce(DataFrame.unionByName, drawn), ["_cls", "_pos"]).select(*df.columns, "_i")


def random_over(df: DataFrame, target: str, order: list[str], strategy="auto", seed: int = 42) -> DataFrame:
    """All rows, plus rows drawn with replacement until each class has its target."""
    counts = counts_of(df, target)
    goal = targets(counts, False, strategy)
    return df.unionByName(drawn_rows(df, target, order, counts, {c: goal[c] - n for c, n in counts.items()}, seed).drop("_i"))


def smote(df: DataFrame, target: str, features: list[str] | None = None, strategy="auto", k: int = 5, seed: int = 42, **search) -> DataFrame:
    """All rows, plus synthetic ones between a drawn row and one of its k nearest class mates.

    Every column but the target must be a numeric feature without nulls.
    """
    cols = features or [c for c in df.columns if c != target]
    others = [c for c in df.columns if c != target]
    if sorted(cols) != sorted(others) or set(others) - set(numeric_columns(df)):
        raise ValueError("synthetic rows need numeric features only")
    holes = df.agg(*[F.count_if(q(c).isNull() | F.isnan(q(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    if any(holes):
        raise ValueError("synthetic rows need features without missing values")
    counts = counts_of(df, target)
    goal = targets(counts, False, strategy)
    extra = {c: goal[c] - n for c, n in counts.items() if goal[c] > n}
    if any(counts[c] <= k for c in extra):
        raise ValueError(f"a class to fill has no {k} neighbours: {[c for c in extra if counts[c] <= k]}")
    if not extra:
        return df
    vector = F.array(*[q(c).cast("double") for c in cols])
    base = drawn_rows(df, target, cols, counts, extra, seed).select(q(target).cast("string").alias("cls"), vector.alias("v"), "_i")
    pool = df.filter(q(target).cast("string").isin(*extra)).select(q(target).cast("string").alias("cls"), vector.alias("v"))
    near = neighbors.nearest(base.select("cls", "v").distinct(), neighbors.merged_points(pool, "cls", "v"), k, seed=seed, **search)
    u = (F.pmod(F.xxhash64(F.lit(seed + 2), "cls", "_i"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    pick = F.pmod(F.xxhash64(F.lit(seed + 1), "cls", "_i"), F.lit(k))
    made = base.join(near, ["cls", "v"]).withColumn("_pick", pick).withColumn("_u", u)
    mate = F.element_at(F.filter("near", lambda x: x["from"] <= F.col("_pick")), -1)["v"]
    made = made.withColumn("_x", F.zip_with("v", mate, lambda a, b: a + F.col("_u") * (b - a)))
    kinds = {f.name: f.dataType for f in df.schema}
    out = [F.col("_x")[i].cast(kinds[c]).alias(c) for i, c in enumerate(cols)]
    return df.unionByName(made.select(*out, F.col("cls").cast(kinds[target]).alias(target)))


def reference_targets(counts: dict[str, int], reference: str, offset: int, labels: list[str], k: int = 5) -> tuple[dict[str, int], int]:
    """Targets max(1, reference rows - offset) for listed smaller classes, and the neighbour count; empty when it does not apply."""
    ref = counts.get(reference, 0)
    goal = max(1, ref - offset)
    plan = {c: goal for c in labels if 0 < counts.get(c, 0) < goal}
    if ref <= 1 or not plan:
        return {}, 0
    smallest = min(counts[c] for c in plan)
    k = min(k, smallest - 1)
    return ({}, 0) if smallest <= 1 or k < 1 else (plan, k)


def smote_to_reference_minus(train: DataFrame, target: str, reference: str = "N2", offset: int = 7000, labels=("W", "N1", "N3", "REM"), k: int = 5, seed: int = 42, **search) -> DataFrame:
    """Listed classes of a training table filled up to the reference class less an offset."""
    plan, near = reference_targets(counts_of(train, target), reference, offset, list(labels), k)
    return smote(train, target, strategy=plan, k=near, seed=seed, **search) if plan else train


def balance_report(before: DataFrame, after: DataFrame, target: str, method: str) -> DataFrame:
    """(label, before, after, suggested weight, rows before and after, warning)."""
    a, b = class_counts(before, target), class_counts(after, target).withColumnRenamed("cnt", "cnt_after")
    both = a.join(b, "label", "full").join(class_weights(before, target), "label", "left")
    small = a.agg(F.min("cnt"), F.sum("cnt")).first()
    n_after = after.count()
    warn = "smallest class has no more than 5 rows" if method == "smote" and small[0] <= 5 else ""
    return both.select("label", F.coalesce("cnt", F.lit(0)).alias("cnt_before"), F.coalesce("cnt_after", F.lit(0)).alias("cnt_after"), "weight",
                       F.lit(small[1]).cast("bigint").alias("rows_before"), F.lit(n_after).cast("bigint").alias("rows_after"), F.lit(warn).alias("warning"))
