"""Packing of tokenised documents into sequences of a fixed length.

Linear grouping scheme: the large lengths are sorted and cut into groups of equal cardinality; for planning, a length
counts as the largest of its group.  With so few sizes the fullest configuration of a sequence can be found exactly,
by dynamic programming; it is used as often as its sizes last, then the next is sought.  Actual documents then take
the places of their group, largest first, which leaves room, and the small ones go to the tightest room that fits.

Only the number of pieces of each length reaches the driver, at most one number per possible length, and the plan speaks of the
k-th piece of a length.  The ranks are counted on the executors over (length, slice) and added up, so that a length that most
pieces share is not one task.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nocturne.llm.common import materialize, pick, slices
from nocturne.llm.tokens import encoder

PARTS = 128  # the pieces of a length are ranked in so many parts at least,
RANKED = 50_000  # and in more where a part would hold more pieces than this on average


# Tokens


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end], "<u4")
                lo, piece = 0, 0
                while lo < len(ids):
                    hi = lo + ((len(ids) - lo) % capacity or capacity)  # only the first can be shorter
                    raw = ids[lo:hi].tobytes()
                    out.append((doc, piece, lo, hi - lo, zlib.crc32(raw), *([raw] if with_ids else [])))
                    lo, piece = hi, piece + 1
            types = [batch.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids and ``end``, cut only where they exceed the capacity."""
    docs = pick(docs, "doc_id", "text")
    schema = f"doc_id {docs.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.mapInArrow(_pieces(path, capacity, end, with_ids), schema)


# Plan


@dataclass
class Plan:
    """Places: the pieces of ``length`` with ranks from ``rank`` on, ``count`` of them, go to sequences from ``sequence`` on, one each, at ``offset``."""

    capacity: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    used: dict[int, int] = field(default_factory=dict)

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.used[length] = rank + count
        self.rows.append((length, rank, count, sequence, offset))


def fullest(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many of each size fill a sequence best. The first size is in it at least once; sizes fall."""
    room = capacity - sizes[0]
    reach = np.full(room + 1, -1, np.int64)  # the size that first reached each sum
    reach[0] = len(sizes)
    took = np.zeros(room + 1, np.int64)
    for j, size in enumerate(sizes):
        left = counts[j] - (j == 0)
        if left <= 0 or size > room:
            continue
        took[:] = 0
        # Each pass adds one more of this size to the sums that have just been reached with it.
        new = reach[: room + 1 - size] >= 0
        for _ in range(min(left, room // size)):
            to = np.zeros(room + 1, bool)
            to[size:] = new & (reach[size:] < 0)
            if not to.any():
                break
            reach[to] = j
            new = to[: room + 1 - size]
    best = int(np.flatnonzero(reach >= 0)[-1])
    out = [0] * len(sizes)
    out[0] = 1
    while best:
        out[reach[best]] += 1
        best -= sizes[reach[best]]
    return out


def plan_sequences(counts: dict[int, int], capacity: int, groups: int = 400, small: int = 4) -> Plan:
    """Where the pieces go, from how many there are of each length. Lengths up to ``capacity / small`` are the small ones."""
    plan = Plan(capacity)
    room: dict[int, list[tuple[int, int]]] = {}  # free places: by size, (first sequence, how many)

    def opened(n: int) -> int:
        plan.sequences += n
        return plan.sequences - n

    if whole := counts.get(capacity, 0):
        plan.place(capacity, whole, opened(whole), 0)
    large = sorted(((n, c) for n, c in counts.items() if capacity > n > capacity // small and c), reverse=True)
    total = sum(c for _, c in large)
    # groups of equal cardinality: runs of (length, count), largest first
    grouped: list[list[list[int]]] = []
    if total:
        each, filled = -(-total // groups), 0
        for n, c in large:
            while c:
                if filled % each == 0:
                    grouped.append([])
                take = min(c, each - filled % each)
                grouped[-1].append([n, take])
                filled, c = filled + take, c - take
    while grouped:
        sizes, left = [g[0][0] for g in grouped], [sum(c for _, c in g) for g in grouped]
        use = fullest(sizes, left, capacity)
        bins = min(n // u for n, u in zip(left, use) if u)
        slots = [j for j, u in enumerate(use) for _ in range(u)]
        # The slots of a group share its pieces, in turn the larger ones; stretches in which no slot changes its length are alike.
        taken: list[list[list[int]]] = []
        for j in slots:
            need, runs = bins, []
            while need:
                n, c = grouped[j][0]
                take = min(c, need)
                runs.append([n, take])
                need -= take
                if take == c:
                    grouped[j].pop(0)
                else:
                    grouped[j][0][1] -= take
            taken.append(runs)
        first, done = opened(bins), 0
        while done < bins:
            stretch = min(runs[0][1] for runs in taken)
            offset = 0
            for runs in sorted(taken, key=lambda r: -r[0][0]):
                plan.place(runs[0][0], stretch, first + done, offset)
                offset += runs[0][0]
                runs[0][1] -= stretch
                if not runs[0][1]:
                    runs.pop(0)
            room.setdefault(capacity - offset, []).append((first + done, stretch))
            done += stretch
            taken = [r for r in taken if r]
        grouped = [g for g in grouped if g]
    for n, c in sorted(((n, c) for n, c in counts.items() if n <= capacity // small and c), reverse=True):
        while c:
            fit = min((r for r in room if r >= n), default=None)
            if fit is None:
                many = -(-c // (capacity // n))
                room[fit := capacity] = [(opened(many), many)]
            at, bins = room[fit].pop()
            if not room[fit]:
                del room[fit]
            per = min(fit // n, c)
            use = min(bins, c // per)
            for k in range(per):
                plan.place(n, use, at, capacity - fit + k * n)
            c -= per * use
            room.setdefault(fit - per * n, []).append((at, use))
            if bins > use:
                room.setdefault(fit, []).append((at + use, bins - use))
    return plan


# Places


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank, sequence, offset, stride = shared.value
        for batch in batches:
            n, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, n * stride + k, "right") - 1
            own = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(sequence[at] + k - rank[at]), pa.array(offset[at])], [*own, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, *, capacity: int = 2048, end: int = 0, with_ids: bool = False, groups: int = 400, small: int = 4) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece of every document.

    A document is its ids and then ``end``; a null or empty text is ``end`` alone. Longer documents than ``capacity`` are cut into pieces of
    that length, but for the first, which has the rest. Pieces of a sequence follow each other without gaps. Equal and repeated documents
    each get their place; a null doc_id stays null; an empty table gives an empty table. ``assemble`` makes the sequences.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenize_pieces(docs, path, capacity, end, with_ids))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    plan = plan_sequences(counts, capacity, groups, small)
    width = max(PARTS, -(-sum(counts.values()) // RANKED))
    order = ["doc_id", "piece", "ids_crc32"]
    salted = pieces.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(width)))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = salted.groupBy("length", "slice").agg(F.count("*").alias("n")).select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "slice").orderBy(*order)) - 1).join(ahead, ["length", "slice"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("ahead")).alias("rank"))
    rows = np.array(sorted(plan.rows) or [(0, 0, 0, 0, 0)], np.int64)
    stride = int(sum(counts.values())) + 1
    shared = spark.sparkContext.broadcast((rows[:, 0] * stride + rows[:, 1], rows[:, 1], rows[:, 3], rows[:, 4], stride))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_assign(shared), schema)


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, doc_ids): the ids of each sequence as one array; ``packed`` has ids."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4") for parts in batch.column("parts").to_pylist()]
            docs = [[p["doc_id"] for p in parts] for parts in batch.column("parts").to_pylist()]
            kind = batch.column("parts").type.value_type.field("doc_id").type
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(docs, pa.list_(kind))], ["sequence_id", "length", "ids", "doc_ids"])

    kind = packed.schema["doc_id"].dataType.simpleString()
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return grouped.mapInArrow(join, f"sequence_id long, length long, ids array<long>, doc_ids array<{kind}>")
