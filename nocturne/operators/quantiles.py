"""Exact quantiles and modes of many columns.

Quantiles are found by radix refinement.  Every number has an order-preserving key of 64 bits; a pass counts, per column and interval that still
holds a wanted rank, the keys by their leading bits above the interval's least one, and the rank tells which of these smaller intervals to go on with, from its
least to its largest key.  One or two passes lead to intervals that hold one value or few, which are then read off.  What travels is a table of bounded size per partition, column and interval, whatever
the number of rows and of distinct values.

The mode needs the counts of all values: numbers are counted by key within a task first and then by key, others by value.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.operators.ordered import running
from nocturne.session import keep

BITS = 12  # by which a pass refines
FEW = 1_000  # values in an interval that are read off instead of being refined
TOP = np.uint64(1 << 63)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _family(kind: T.DataType) -> str:
    """The type in which values of a column are counted, without loss."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(kind, T.DecimalType):
        return kind.simpleString()
    return "double" if isinstance(kind, (T.FloatType, T.DoubleType, T.BooleanType)) else "string"


def _by_family(df: DataFrame, columns: list[str], as_type: str | None) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(as_type or _family(df.schema[c].dataType), []).append(c)
    return out


def value_counts(df: DataFrame, columns: list[str], as_type: str = "double") -> DataFrame:
    """Long (name, value, cnt) table of values that are neither null nor NaN; the shuffle carries partial counts."""

    def clean(c: str) -> Column:
        x = F.col(f"`{c}`")
        return F.when(~F.isnan(x), x).cast(as_type) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else x.cast(as_type)

    pairs = [F.struct(F.lit(c).alias("name"), clean(c).alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*pairs)).alias("kv")).select("kv.*")
    return long.filter(F.col("value").isNotNull()).groupBy("name", "value").agg(F.count("*").alias("cnt"))


def _between(lo, hi, share: float):
    """Linear interpolation; whole numbers stay exact where both ends agree."""
    if lo == hi:
        return float(lo)
    lo, hi = float(lo), float(hi)
    return lo + (hi - lo) * share


# Keys


def _scale(kind: T.DataType) -> int | None:
    """Decimals that fit 64 bits are whole numbers of their last digit; None for other types."""
    return kind.scale if isinstance(kind, T.DecimalType) and kind.precision <= 18 else None


def _has_key(kind: T.DataType) -> bool:
    return isinstance(kind, (*WHOLE, T.FloatType, T.DoubleType, T.BooleanType)) or _scale(kind) is not None


def _number(df: DataFrame, c: str) -> Column:
    """The column as bigint or double, without loss."""
    kind, x = df.schema[c].dataType, F.col(f"`{c}`")
    if isinstance(kind, WHOLE):
        return x.cast("bigint")
    if (scale := _scale(kind)) is not None:
        return (x * F.lit(Decimal(10**scale)).cast(f"decimal({scale + 1},0)")).cast("bigint")
    return x.cast("double")


def _keys(column: pa.Array) -> np.ndarray:
    """Keys of the values that are neither null nor NaN, in the order of the values."""
    x = column.drop_null().to_numpy(zero_copy_only=False)
    if x.dtype == np.float64:
        x = x[~np.isnan(x)] + 0.0  # one zero only
        bits = x.view(np.uint64)
        return np.where(bits & TOP, ~bits, bits | TOP)
    return x.astype(np.int64).view(np.uint64) ^ TOP


def _value(key: int, kind: T.DataType):
    """The number of a key."""
    if isinstance(kind, WHOLE) or _scale(kind) is not None:
        whole = key - (1 << 63)
        return Decimal(whole).scaleb(-kind.scale) if isinstance(kind, T.DecimalType) else whole
    bits = key & ~(1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _key(value) -> int:
    """The key of a number as ``_number`` gives it."""
    if isinstance(value, int):
        return value + (1 << 63)
    bits = int(np.array([value + 0.0]).view(np.uint64)[0])
    return (1 << 64) - 1 - bits if bits >> 63 else bits | 1 << 63


@dataclass
class _Target:
    """A wanted rank among the keys of a column from ``lo`` to ``hi``; ``count`` keys are there."""

    column: int
    rank: int
    lo: int
    hi: int
    count: int

    @property
    def interval(self) -> tuple[int, int, int]:
        return self.column, self.lo, self.hi


def _inside(keys: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Those of sorted keys that lie in the interval."""
    return keys[np.searchsorted(keys, np.uint64(lo)) : np.searchsorted(keys, np.uint64(hi), "right")]


def _signed(keys: np.ndarray) -> np.ndarray:
    return (keys ^ TOP).view(np.int64)


def _counting(intervals: list[tuple[int, int, int]]):
    """Rows (slot, bin, n, least, most): the keys of each interval in at most 2 ** BITS bins of equal width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            sorted_keys = {c: np.sort(_keys(batch.column(c))) for c in {c for c, _, _ in intervals}}
            for slot, (c, lo, hi) in enumerate(intervals):
                own = _inside(sorted_keys[c], lo, hi)
                if len(own):
                    bins = (own - np.uint64(lo)) >> np.uint64(max(0, (hi - lo).bit_length() - BITS))
                    starts = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
                    ends = np.append(starts[1:], len(own))
                    found.append((np.full(len(starts), slot), bins[starts].astype(np.int64), ends - starts, _signed(own[starts]), _signed(own[ends - 1])))
            if sum(len(f[0]) for f in found) > 1 << 20:
                found = [_added(found)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _added(found)], ["slot", "bin", "n", "least", "most"])

    return run


def _added(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    slot, place, n, least, most = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, slot))
    slot, place, n, least, most = (x[order] for x in (slot, place, n, least, most))
    first = np.flatnonzero(np.concatenate(([True], (slot[1:] != slot[:-1]) | (place[1:] != place[:-1]))))
    return slot[first], place[first], np.add.reduceat(n, first), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)


def _listing(intervals: list[tuple[int, int, int]]):
    """Rows (slot, key, n): the values of each interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot, (c, lo, hi) in enumerate(intervals):
                own, n = np.unique(_inside(np.sort(_keys(batch.column(c))), lo, hi), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), slot)), pa.array(_signed(own)), pa.array(n)], ["slot", "key", "n"])

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (i, key, n): the values of each column, equal ones of a task counted together as long as few are held."""

    def rows(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["i", "key", "n"])

    found: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        for i, column in enumerate(batch.columns):
            values, n = np.unique(_signed(_keys(column)), return_counts=True)
            entry = np.full(len(values), i, np.int64), values, n
            if 2 * len(values) > batch.num_rows:  # mostly different: nothing to gain
                yield rows(entry)
            else:
                found.append(entry)
                size += len(values)
        if size > 1 << 18:
            found = [_summed(found)]
            size = len(found[0][0])
            if size > 1 << 17:
                yield rows(found.pop())
                size = 0
    if found:
        yield rows(_summed(found))


def _summed(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    i, key, n = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((key, i))
    i, key, n = i[order], key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (key[1:] != key[:-1])))) if len(i) else order
    return i[first], key[first], np.add.reduceat(n, first) if len(i) else n


def _within(data: DataFrame, intervals: list[tuple[int, int, int]]) -> DataFrame:
    """The rows with a value in one of the intervals: what the others hold stays out of Python."""
    def inside(c: int, lo: int, hi: int) -> Column:
        kind = data.schema[c].dataType
        return F.col(f"c{c}").between(F.lit(_value(lo, kind)), F.lit(_value(hi, kind)))

    return data.filter(reduce(Column.__or__, [inside(*i) for i in intervals]))


def _refine(data: DataFrame, targets: list[_Target]) -> None:
    """Take the targets a pass further."""
    intervals = sorted({t.interval for t in targets})
    counted = _within(data, intervals).mapInArrow(_counting(intervals), "slot long, bin long, n long, least long, most long")
    bins = counted.groupBy("slot", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    # One row per slot: its bins in order, at most 2 ** BITS; the wanted ones are picked there, so a handful of numbers per target comes back.
    lists = bins.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "least", "most"))).alias("bins"))
    wanted: dict[int, list[int]] = {}
    for t in targets:
        wanted.setdefault(intervals.index(t.interval), []).append(t.rank)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for slot, rows in zip(batch.column("slot").to_pylist(), batch.column("bins")):
                flat = rows.values
                n, least, most = (flat.field(k).to_numpy() for k in range(1, 4))
                upto = np.cumsum(n)
                for rank in sorted(set(wanted[slot])):
                    k = int(np.searchsorted(upto, rank, "right"))
                    out.append((slot, rank, int(upto[k] - n[k]), int(n[k]), int(least[k]), int(most[k])))
        names = ["slot", "rank", "before", "n", "least", "most"]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * len(names), names)

    schema = "slot long, rank long, before long, n long, least long, most long"
    picked = {(r["slot"], r["rank"]): r for r in lists.mapInArrow(pick, schema).collect()}
    for t in targets:
        r = picked[intervals.index(t.interval), t.rank]
        t.lo, t.hi, t.rank, t.count = r["least"] + (1 << 63), r["most"] + (1 << 63), t.rank - r["before"], r["n"]


def _read_off(data: DataFrame, targets: list[_Target]) -> None:
    """The keys of targets whose intervals hold few values."""
    intervals = sorted({t.interval for t in targets})
    rows = _within(data, intervals).mapInArrow(_listing(intervals), "slot long, key long, n long").groupBy("slot", "key").agg(F.sum("n").alias("n"))
    held: dict[int, list[tuple[int, int]]] = {}
    for r in rows.collect():
        held.setdefault(r["slot"], []).append((r["key"], r["n"]))
    for t in targets:
        left = t.rank
        for key, n in sorted(held[intervals.index(t.interval)]):
            if left < n:
                t.lo = t.hi = key + (1 << 63)
                break
            left -= n


def _radix_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    data = keep(df.select(*[_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)]))  # read once a pass
    clean = [F.nanvl(F.col(f"c{i}"), F.lit(None).cast("double")) if f.dataType == T.DoubleType() else F.col(f"c{i}") for i, f in enumerate(data.schema)]
    sides = data.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(clean) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    last = [sides[f"n{i}"] - 1 for i in range(len(columns))]
    targets = {
        (i, rank): _Target(i, rank, _key(sides[f"lo{i}"]), _key(sides[f"hi{i}"]), m + 1)
        for i, m in enumerate(last) if m >= 0 for p in probs for rank in (math.floor(m * p), math.ceil(m * p))
    }
    while open_ones := [t for t in targets.values() if t.lo < t.hi]:
        few = [t for t in open_ones if t.count <= FEW]
        if len(few) == len(open_ones):
            _read_off(data, few)
        else:
            _refine(data, [t for t in open_ones if t.count > FEW])
    out: dict[str, list[float | None]] = {}
    for i, (c, m) in enumerate(zip(columns, last)):
        kind = df.schema[c].dataType
        at = lambda rank, i=i, kind=kind: _value(targets[i, rank].lo, kind)
        out[c] = [None if m < 0 else _between(at(math.floor(m * p)), at(math.ceil(m * p)), m * p - math.floor(m * p)) for p in probs]
    return out


def _counted_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Quantiles of numbers that don't fit 64 bits: value counts accumulated along the sorted values."""
    quantiles: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    for family, names in _by_family(df, columns, None).items():
        counts = value_counts(df, names, family)
        last = {r["name"]: r["n"] - 1 for r in counts.groupBy("name").agg(F.sum("cnt").alias("n")).collect()}
        if not last:
            continue
        cum = running(counts, ["name"], ["value"], sums={"cum": F.col("cnt")})
        at = lambda rank, last=last: F.coalesce(*[F.when(F.col("name") == c, F.lit(rank(m))) for c, m in last.items()])
        marks = []
        for i, p in enumerate(probs):
            marks.append(F.min(F.when(F.col("cum") > at(lambda m, p=p: math.floor(m * p)), F.col("value"))).alias(f"lo{i}"))
            marks.append(F.min(F.when(F.col("cum") > at(lambda m, p=p: math.ceil(m * p)), F.col("value"))).alias(f"hi{i}"))
        for r in cum.groupBy("name").agg(*marks).collect():
            m = last[r["name"]]
            quantiles[r["name"]] = [_between(r[f"lo{i}"], r[f"hi{i}"], m * p - math.floor(m * p)) for i, p in enumerate(probs)]
    return quantiles


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of numeric columns; null and NaN don't count, and a column without values has None."""
    keyed = [c for c in columns if _has_key(df.schema[c].dataType)]
    found = _radix_quantiles(df, keyed, probs) if keyed else {}
    if rest := [c for c in columns if c not in found]:
        found |= _counted_quantiles(df, rest, probs)
    return {c: found[c] for c in columns}


def exact_modes(df: DataFrame, columns: list[str], as_type: str | None = None) -> dict:
    """Most frequent value per column, the smallest on ties, counted in the column's own type unless one is given."""
    found: dict = {c: None for c in columns}
    keyed = [] if as_type else [c for c in columns if _has_key(df.schema[c].dataType)]
    if keyed:
        counts = df.select(*[_number(df, c) for c in keyed]).mapInArrow(_tally, "i long, key long, n long").groupBy("i", "key").agg(F.sum("n").alias("n"))
        best = counts.groupBy("i").agg(F.min(F.struct(-F.col("n"), "key")).alias("b")).select("i", F.col("b.key").alias("key"))
        found |= {keyed[r["i"]]: _value(r["key"] + (1 << 63), df.schema[keyed[r["i"]]].dataType) for r in best.collect()}
    for family, names in _by_family(df, [c for c in columns if c not in keyed], as_type).items():
        best = value_counts(df, names, family).groupBy("name").agg(F.min(F.struct(-F.col("cnt"), "value")).alias("b"))
        found |= {r["name"]: r["v"] for r in best.select("name", F.col("b.value").alias("v")).collect()}
    return found


def quantiles_and_modes(df: DataFrame, columns: list[str], probs: list[float]) -> tuple[dict[str, list[float | None]], dict]:
    """Exact linear-interpolated quantiles, and the most frequent value (smallest on ties), per numeric column."""
    return exact_quantiles(df, columns, probs), exact_modes(df, columns)
