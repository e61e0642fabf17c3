"""Ordered calculations inside groups, by one plan for every size.

A window partitioned by the group key alone would run each group in one task.  Here the rows are cut into ranges of
(keys, order): a random sample of bounded size gives the cut points, which the plan holds as one sorted array per column, and a row's
range is found by bisection, so the plan has the same size for any number of ranges.  The window runs per (keys, range), and a table of at
most one row per cut point carries the totals of a group's earlier ranges.  A group that holds most rows is spread over most ranges, and so
is one order value that many rows share if a later order column tells them apart.  Any cut points give the same result.

Order columns may be of any type Spark can sort.  Nulls come first (last when descending) and NaN is the largest
number, as in Spark's own sorting; quantiles and modes take NaN for null.
"""
from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.session import keep

SAMPLE_PER_RANGE = 24  # sampled rows for each cut point
RANGES_PER_PARTITION = 3  # ranges go to shuffle partitions by hash; several smaller ones even the partitions out
PIECE_ROWS = 65_536  # rows between two borders when values are shifted


@dataclass(frozen=True)
class Desc:
    """A descending order column."""

    name: str


def _name(entry: str | Desc) -> str:
    return entry.name if isinstance(entry, Desc) else entry


def _sort(entry: str | Desc) -> Column:
    return F.desc(f"`{entry.name}`") if isinstance(entry, Desc) else F.asc(f"`{entry}`")


def _literal(value, kind: T.DataType) -> Column:
    """A constant of the given type."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def _before(entry: str | Desc, bound: Column) -> tuple[Column, Column]:
    """Whether a row's value sorts before the bound, and whether it equals it."""
    col = F.col(f"`{_name(entry)}`")
    if isinstance(entry, Desc):
        less = F.when(col.isNull(), False).when(bound.isNull(), True).otherwise(col > bound)
    else:
        less = F.when(bound.isNull(), False).when(col.isNull(), True).otherwise(col < bound)
    return less, col.eqNullSafe(bound)


def _written(col: Column, kind: T.DataType) -> Column:
    """A value as text that ``_array`` reads back; nested values stay as they are."""
    if isinstance(kind, T.BinaryType):
        return F.hex(col)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col).cast("string")
    return col if isinstance(kind, (T.StructType, T.ArrayType, T.NullType)) else col.cast("string")


def _array(values: list, kind: T.DataType) -> Column:
    """A constant array, made by one call for any length unless its values are nested."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.NullType)):
        return F.array(*[_literal(v, kind) for v in values])
    texts = F.from_json(F.lit(json.dumps(values)), "array<string>")
    if isinstance(kind, T.BinaryType):
        return F.transform(texts, F.unhex)
    if isinstance(kind, T.TimestampType):
        return F.transform(texts, lambda x: F.timestamp_micros(x.cast("bigint")))
    return texts.cast(T.ArrayType(kind))


def with_range(df: DataFrame, by: list[str | Desc], ranges: int | None = None) -> DataFrame:
    """The frame with ``_range``, the number of the range a row falls into along ``by``. Cut points come from a random sample; the frame is read twice for it, so keep it."""
    wanted = ranges or RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [_name(e) for e in by]
    kinds = [df.schema[n].dataType for n in names]
    narrow = df.select(*[F.col(f"`{n}`") for n in names])
    share = SAMPLE_PER_RANGE * wanted / max(1, narrow.count())
    sample = narrow if share >= 1 else narrow.sample(share, 7)
    rows = sample.orderBy(*[_sort(e) for e in by]).select(*[_written(F.col(f"`{n}`"), k).alias(f"c{i}") for i, (n, k) in enumerate(zip(names, kinds))]).collect()
    step = max(1, -(-len(rows) // wanted))
    cuts = [row for before, row in zip([None, *rows[step::step]], rows[step::step]) if row != before]
    arrays = [_array([row[i] for row in cuts], kind) for i, kind in enumerate(kinds)] if cuts else []

    if not cuts:
        return df.withColumn("_range", F.lit(0))

    def reached(at: Column) -> Column:
        """Whether the row sorts at or behind the cut."""
        before = F.lit(False)
        for entry, array in reversed(list(zip(by, arrays))):
            less, equal = _before(entry, F.get(array, at))
            before = less | (equal & before)
        return ~before

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])  # bisection: one step for each bit of the number of cuts
    return df.withColumn("_range", F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= len(cuts)) & reached(n + k - 1), n + k).otherwise(n)))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on keys that treats nulls as equal and keeps the left key columns."""
    renamed = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") if c in keys else F.col(f"`{c}`") for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


@dataclass(frozen=True)
class Ranged:
    """A frame whose groups are cut into ranges: ``frame`` has the column ``_range``, ``parts`` one row per (keys, _range)."""

    frame: DataFrame
    keys: list[str]
    parts: DataFrame

    def attach(self, frame: DataFrame, groups: DataFrame, how: str = "left") -> DataFrame:
        """Join one row per group to the rows of a frame made from this one: per (keys, range), so a large group isn't one task."""
        spread = join_on(self.parts, groups, self.keys, how)
        return join_on(frame, spread, [*self.keys, "_range"], how).drop("_range")


def ranged(
    df: DataFrame, keys: list[str], order: list[str | Desc], *, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, ranges: int | None = None
) -> Ranged:
    """``running`` with the ranges it went by."""
    sums, maxes = sums or {}, maxes or {}
    fns = {**{n: F.sum for n in sums}, **{n: F.max for n in maxes}}
    data = keep(df.select("*", *[c.alias(f"_in_{n}") for n, c in {**sums, **maxes}.items()]))  # read for the number of rows, the cut points, the sums and the totals
    cut = with_range(data, [*keys, *order], ranges)
    by = [*[f"`{k}`" for k in keys], "_range"]
    along = Window.partitionBy(*by).orderBy(*[_sort(e) for e in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select(*[f"`{c}`" for c in df.columns], "_range", *[f(f"_in_{n}").over(along).alias(f"_in_{n}") for n, f in fns.items()])
    before = Window.partitionBy(*by[:-1]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by).agg(*[f(f"_in_{n}").alias(f"_tot_{n}") for n, f in fns.items()])
    carry = totals.select(*by, F.count("*").over(before).alias("_earlier"), *[f(f"_tot_{n}").over(before).alias(f"_carry_{n}") for n, f in fns.items()])
    carry = carry.filter("_earlier > 0").drop("_earlier")  # a group in two ranges has a cut point inside, so there are at most as many rows as cuts
    both = join_on(local, F.broadcast(carry), [*keys, "_range"])
    merged = [
        F.coalesce(F.col(f"_in_{n}") + F.col(f"_carry_{n}"), f"_in_{n}", f"_carry_{n}").alias(n) if n in sums else F.greatest(f"_in_{n}", f"_carry_{n}").alias(n)
        for n in fns
    ]
    return Ranged(both.select(*[f"`{c}`" for c in df.columns], "_range", *merged), keys, totals.select(*by))


def running(
    df: DataFrame, keys: list[str], order: list[str | Desc], *, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, ranges: int | None = None
) -> DataFrame:
    """Running sums and maxima along ``order`` within ``keys``, current row included. Rows that ``order`` ties come in any order."""
    return ranged(df, keys, order, sums=sums, maxes=maxes, ranges=ranges).frame.drop("_range")


def ranged_positions(df: DataFrame, keys: list[str], order: list[str | Desc], name: str = "pos", ranges: int | None = None) -> Ranged:
    """``positions`` with the ranges it went by."""
    out = ranged(df, keys, order, sums={name: F.lit(1).cast("bigint")}, ranges=ranges)
    return Ranged(out.frame.withColumn(name, F.col(name) - 1), keys, out.parts)


def positions(df: DataFrame, keys: list[str], order: list[str | Desc], name: str = "pos", ranges: int | None = None) -> DataFrame:
    """Zero-based position of each row within its group."""
    return running(df, keys, order, sums={name: F.lit(1).cast("bigint")}, ranges=ranges).withColumn(name, F.col(name) - 1)


def moved(placed: DataFrame, keys: list[str], wanted: dict[str, tuple[str, int]], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``shifted`` for a frame that has the positions within its groups as ``_pos``."""
    reach = max((abs(k) for _, k in wanted.values()), default=0)
    width = max(piece_rows, reach + 1)
    home, offset = F.floor(F.col("_pos") / width), F.col("_pos") % width
    copies = F.array_compact(F.array(home, F.when((offset < reach) & (home > 0), home - 1), F.when(offset >= width - reach, home + 1)))
    spread = placed.withColumn("_home", home).withColumn("_piece", F.explode(copies))
    w = Window.partitionBy(*[f"`{k}`" for k in keys], "_piece").orderBy("_pos")
    picked = [(F.lag(f"`{c}`", -k) if k < 0 else F.lead(f"`{c}`", k)).over(w).alias(n) for n, (c, k) in wanted.items()]
    return spread.select(*[f"`{c}`" for c in placed.columns], "_home", "_piece", *picked).filter("_home = _piece").drop("_home", "_piece")


def shifted(df: DataFrame, keys: list[str], order: list[str | Desc], wanted: dict[str, tuple[str, int]], *, ranges: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``name = column at offset`` (negative: earlier rows) without leaving the group.

    Each group is cut at fixed positions and every piece also receives the few rows next to its borders, so no piece needs the whole group.
    """
    return moved(positions(df, keys, order, "_pos", ranges), keys, wanted, piece_rows).drop("_pos")
