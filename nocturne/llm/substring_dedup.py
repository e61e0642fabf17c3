"""Removal of passages that another document already has (windows of consecutive words).

Super-k-mer partitioning: every window of ``width`` words has a minimiser, the smallest hash among its runs of three
words.  Consecutive windows with one minimiser travel as one string of words to the bucket of that minimiser, so that
equal windows meet, and a window costs about three words of shuffle instead of ``width``.  A bucket sorts its windows
and compares neighbours word by word, so equal hashes alone decide nothing.

Copies inside one slice of a few MB are settled before the shuffle: only a slice's first document of a window is sent on.
A passage that stands in a third of all documents therefore reaches its bucket once a slice, not once a document.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import U64, Words, binary, mix, pick, rolled, shuffle_width, slices, sliding_min, total_bytes, window_starts

SEED = 3  # words of a minimiser
RANGES = "doc_id long, version long, first int, last int"


def _earliest(f: np.ndarray, ids: np.ndarray, at: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """For windows in rising order of owner, the owner of the first equal window. ``f``: their hashes, ``at``: their first words."""
    order = np.argsort(f, kind="stable")
    g, start = f[order], at[order]
    same = np.concatenate(([False], g[1:] == g[:-1]))
    pairs = np.flatnonzero(same)
    differ = np.zeros(len(pairs), bool)
    for j in range(width):
        differ |= ids[start[pairs] + j] != ids[start[pairs - 1] + j]
    for value in np.unique(g[pairs[differ]]):  # equal hashes of unequal windows
        lo, hi = np.searchsorted(g, value), np.searchsorted(g, value, "right")
        words = [tuple(ids[s : s + width]) for s in start[lo:hi]]
        inner = sorted(range(hi - lo), key=lambda i: (words[i], i))
        order[lo:hi] = order[lo:hi][inner]
        same[lo:hi] = [i > 0 and words[inner[i]] == words[inner[i - 1]] for i in range(hi - lo)]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    out = np.empty(len(order), owner.dtype)
    out[order] = owner[order[head]]
    return out


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs, from a flag on the first element of each."""
    starts = np.flatnonzero(breaks)
    return starts, np.append(starts[1:], len(breaks))


def _spans(at: np.ndarray, text: np.ndarray, flagged: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring flagged windows as (text, first word, word after the last)."""
    p, d = at[flagged], text[flagged]
    if not len(p):
        return d, p, p
    s, e = _runs(np.concatenate(([True], (np.diff(p) != 1) | (np.diff(d) != 0))))
    return d[s], p[s], p[e - 1] + width


def _pack(doc: np.ndarray, version: np.ndarray, first: np.ndarray, last: np.ndarray, body: bytes) -> bytes:
    head = np.array([len(doc)], "<i8").tobytes() + b"".join(a.astype(t).tobytes() for a, t in ((doc, "<i8"), (version, "<u4"), (first, "<i4"), (last, "<i4")))
    return zstandard.ZstdCompressor(level=3).compress(head + body)


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for t, size in (("<i8", 8), ("<u4", 4), ("<i4", 4), ("<i4", 4)):
        out.append(np.frombuffer(raw, t, n, at).astype(np.int64))
        at += n * size
    return *out, raw[at:]


def _cut(width: int, buckets: int):
    """Batches of documents to packed super-k-mers (settled false) and spans that are settled already (settled true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.argsort(doc, kind="stable")
            doc, texts = doc[rows], binary(batch.column("text").take(pa.array(rows)))
            version = np.array([zlib.crc32(t) for t in texts], np.int64)
            words = Words(texts)
            at, text = window_starts(words.counts, width)
            if not len(at):
                continue
            h, begin = words.hashes(), words.starts
            owner = doc[text]
            later = _earliest(rolled(h, width)[at], words.ids, at, owner, width) < owner
            least = sliding_min(mix(rolled(h, SEED)), width - SEED + 1)[at]
            out: list[tuple[bool, int, bytes]] = []
            d, p, e = _spans(at, text, later, width)
            home = mix(doc[d].astype(U64)) % U64(buckets)
            for b in np.unique(home).tolist():
                k = home == b
                out.append((True, b, _pack(doc[d[k]], version[d[k]], p[k] - begin[d[k]], e[k] - begin[d[k]], b"")))
            p, d, least = at[~later], text[~later], least[~later]
            if len(p):
                s, e = _runs(np.concatenate(([True], (np.diff(p) != 1) | (np.diff(d) != 0) | (least[1:] != least[:-1]))))
                p, last, d, home = p[s], p[e - 1] + width, d[s], (mix(least[s]) % U64(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                p, last, d, home = p[order], last[order], d[order], home[order]
                lo, hi = words.offsets[p], words.offsets[last]
                for i, j in zip(*_runs(np.concatenate(([True], np.diff(home) != 0)))):
                    body = b"".join([words.joined[x:y] for x, y in zip(lo[i:j].tolist(), hi[i:j].tolist())])
                    out.append((False, int(home[i]), _pack(doc[d[i:j]], version[d[i:j]], (p - begin[d])[i:j], (last - begin[d])[i:j], body)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.bool_(), pa.int64(), pa.binary()))], ["settled", "bucket", "load"])

    return run


def _settle(width: int):
    """One bucket: spans whose windows also start in a smaller document."""

    def run(table: pa.Table) -> pa.Table:
        done, parts = [], []
        for settled, blob in zip(table.column("settled").to_pylist(), table.column("load").to_pylist()):
            (done if settled else parts).append(_unpack(blob))
        found = [tuple(x[:4]) for x in done]
        if parts:
            doc, version, first, last = (np.concatenate([x[i] for x in parts]) for i in range(4))
            words = Words.packed(last - first, b"".join(x[4] for x in parts))
            at, run_no = window_starts(words.counts, width)
            order = np.argsort(doc[run_no], kind="stable")
            owner = doc[run_no[order]]
            f = rolled(mix(words.ids.astype(U64)), width)[at[order]]
            later = np.empty(len(at), bool)
            later[order] = _earliest(f, words.ids, at[order], owner, width) < owner
            r, p, e = _spans(at, run_no, later, width)
            shift = first[r] - words.starts[r]
            found.append((doc[r], version[r], p + shift, e + shift))
        cols = [np.concatenate([x[i] for x in found]) for i in range(4)]
        return pa.table([pa.array(c.astype(t)) for c, t in zip(cols, ("i8", "i8", "i4", "i4"))], ["doc_id", "version", "first", "last"])

    return run


def repeated_spans(docs: DataFrame, width: int = 13, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, version, first, last): spans of words covered by windows that also start in a document of smaller doc_id.

    ``version`` is the CRC-32 of the text and tells rows of one doc_id apart. Spans may overlap.
    ``bucket_bytes``: text that one bucket gets on average; the number of buckets follows from the input.
    """
    docs = pick(docs, "doc_id", "text").filter("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    buckets = max(shuffle_width(docs.sparkSession), -(-total_bytes(docs) // bucket_bytes))
    parts = docs.mapInArrow(_cut(width, buckets), "settled boolean, bucket long, load binary")
    return parts.groupBy("bucket").applyInArrow(_settle(width), RANGES)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, firsts, lasts = binary(batch.column("text")), batch.column("firsts").to_pylist(), batch.column("lasts").to_pylist()
        kept, n_words, n_removed = [], [], []
        for text, first, last in zip(texts, firsts, lasts):
            words = (text or b"").split()
            n_words.append(len(words))
            if first:
                change = np.zeros(len(words) + 1, np.int32)
                np.add.at(change, first, 1)
                np.add.at(change, last, -1)
                words = [w for w, c in zip(words, np.cumsum(change).tolist()) if not c]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        texts = pa.array(kept, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, width: int = 13, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, text, n_words, n_removed): every document with the words that are left, joined by one space.

    Words are runs of bytes other than space and 0x09-0x0D. A word goes when a window of ``width`` words that covers it also starts
    in a document with a smaller doc_id; windows are judged on the input. A null text has no words. A row without
    doc_id is kept whole and covers nothing. Rows that share a doc_id are each other's equals: none is the smaller. An empty table gives an empty table.
    Of other columns nothing is read.
    """
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    spans = repeated_spans(docs, width, bucket_bytes).groupBy("doc_id", "version").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    keyed = docs.withColumn("version", F.crc32(F.col("text").cast("binary")))
    return keyed.join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "firsts", "lasts").mapInArrow(_strip, "doc_id long, text string, n_words long, n_removed long")
