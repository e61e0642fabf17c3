"""Near-duplicate documents by word shingles.

One-permutation hashing: one 64-bit hash per shingle, its top bits choose a bin, each bin keeps its smallest hash.  Bins
without a shingle take the value of the first filled bin on a random walk of their own (optimal densification).  Bands
of bins make buckets.  Documents with equal shingle sets are one node; inside a bucket every node is compared with the
smallest one only, a star, so pairs grow with the nodes.  Links are confirmed on full shingle sets.

Stars can miss a link between two nodes that both are unlike the hub.  Where, after the components of the stars, a bucket
still has nodes of more than one component, its nodes are compared block by block inside tasks and only links are sent on.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import LOWER, U64, Words, binary, materialize, mix, pick, rolled, slices
from nocturne.llm.graph import components


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text is one shingle, a text without words has none."""
    words = Words(texts, LOWER)
    h = words.hashes()
    full = mix(rolled(h, size))
    out = []
    for start, n in zip(words.starts.tolist(), words.counts.tolist()):
        if n >= size:
            out.append(np.unique(full[start : start + n - size + 1]))
        elif n:
            out.append(mix(rolled(h[start : start + n], n) + U64(n)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One densified row of bins per non-empty set."""
    sig, filled = np.zeros((len(sets), bins), U64), np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        at = ((s >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)  # rises with the hash
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        sig[i, at[first]], filled[i, at[first]] = s[first], True
        if len(first) == 1:
            sig[i], filled[i] = s[0], True
    base = filled.copy()
    row, col = np.nonzero(~filled)
    turn = 0
    while len(row):
        turn += 1
        to = (mix(col.astype(U64) + U64(turn << 20)) % U64(bins)).astype(np.int64)
        hit = base[row, to]
        sig[row[hit], col[hit]] = sig[row[hit], to[hit]]
        row, col = row[~hit], col[~hit]
    return sig


def _sign(size: int, bands: int, rows: int):
    weights = mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(binary(batch.column("text")), size)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            prints: list = [None] * len(sets)
            if some:
                sig = signatures([sets[i] for i in some], bands * rows).reshape(len(some), bands, rows)
                band = mix(mix(sig * weights).sum(-1, dtype=U64) + mix(np.arange(bands, dtype=U64))).astype(np.int64)
                for i, k in zip(some, band):
                    keys[i], prints[i] = k, xxhash.xxh3_128_digest(sets[i].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "print", "bands"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(binary(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            keep = [_alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(percent: int):
    """Two blocks of one bucket: links between different components, as a forest over components."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["node", "component", "block", "hashes", "i", "j"]).to_pylist()
        i, j = rows[0]["i"], rows[0]["j"]
        sets = [np.frombuffer(r["hashes"], "<u8") for r in rows]
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while up.setdefault(c, c) != c:
                c = up[c]
            return c

        left = [k for k, r in enumerate(rows) if r["block"] == i]
        right = [k for k, r in enumerate(rows) if r["block"] == j]
        out = []
        for x in left:
            for y in right:
                if i == j and y <= x:
                    continue
                p, q = top(rows[x]["component"]), top(rows[y]["component"])
                if p != q and _alike(sets[x], sets[y], percent):
                    up[p] = q
                    out.append((rows[x]["component"], rows[y]["component"]))
        return pa.table([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, *, size: int = 5, percent: int = 85, bands: int = 48, rows: int = 8, block: int = 128, carry: list[str] | None = None
) -> DataFrame:
    """(carry columns, doc_id, n_shingles, component_id, kept) for every document.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A document's set has the distinct shingles of ``size`` words;
    with fewer words, all of them as one; without words or text it is empty and linked with nothing. Two documents are
    linked at ``percent`` per cent of Jaccard similarity or more; links are confirmed on the full sets (64-bit hashes). component_id is the
    smallest doc_id that links reach. Repeated rows share it; of rows with one doc_id all are kept or none. A row without
    doc_id stands alone: its component_id is null and it is kept. An empty table gives an empty table.

    A pair at exactly the threshold shares no band, and is missed, with probability (1 - s**rows)**bands: 2e-7 at 0.85 as set.
    ``block``: nodes that a task compares at once where a bucket is left with several components.
    """
    spark, carry = docs.sparkSession, [c for c in carry or [] if c not in ("doc_id", "text")]
    plain = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    signed = materialize(plain.mapInArrow(_sign(size, bands, rows), "doc_id long, n_shingles long, print binary, bands array<long>"))
    # Documents with equal sets are one node, named by the smallest of them.
    classes = materialize(signed.filter("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    members = classes.select("node", F.explode("bands").alias("band"))
    stars = members.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("most")).filter("hub < most").select("band", "hub")
    edges = materialize(members.join(stars, "band").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    # One doc_id may stand in several rows with different texts: the set is that of the row the node was named by.
    named = signed.select(F.col("doc_id").alias("node"), "print").join(classes.select("node", "print").join(ends, "node"), ["node", "print"]).select("node").distinct()
    texts = plain.withColumnRenamed("doc_id", "node").join(named, "node").select("node", "text")
    sets = materialize(texts.mapInArrow(_sets(size), "node long, hashes binary").groupBy("node", F.length("hashes").alias("n")).agg(F.first("hashes").alias("hashes")).drop("n"))
    linked = materialize(
        edges.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b")
        .mapInArrow(_confirm(percent), "a long, b long")
    )
    first = materialize(components(linked))
    # Buckets whose nodes are in more than one component by now.
    of = members.join(stars, "band").join(first.withColumnRenamed("id", "node"), "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    mixed = of.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")).filter("lo < hi")
    mixed = mixed.groupBy("n", "mark").agg(F.min("band").alias("band"))  # buckets of the same nodes need one comparison
    rest = of.join(mixed.select("band", F.ceil(F.col("n") / block).alias("wide")), "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("wide")))
    pairs = rest.select("band", "node", "component", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("wide") - 1)).alias("other"))
    pairs = pairs.select("band", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    late = pairs.join(sets, "node").groupBy("band", "i", "j").applyInArrow(_blocks(percent), "a long, b long")
    second = components(late)
    final = first.join(second.select(F.col("id").alias("component"), F.col("component").alias("lower")), "component", "left").select("id", F.coalesce("lower", "component").alias("component"))
    alone = second.join(first.select("id"), "id", "left_anti")
    nodes = classes.select("print", F.col("node").alias("id")).join(final.union(alone), "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    source = signed.select("doc_id", "n_shingles", "print")
    found = source.join(nodes, "print", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    found = found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    if not carry:
        return found
    judged = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"), F.max("kept").alias("kept"))
    return pick(docs, *carry, "doc_id", "text").join(judged, "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
