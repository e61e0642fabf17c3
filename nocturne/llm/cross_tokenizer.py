"""Alignment of two tokenizers' tokens over the same bytes.

A slice of documents is tokenised both ways and handled as Arrow arrays: the lists of ids are flattened and keep their document as
parent index, byte lengths are summed up within each document to token ends, and a hash join of both sides on (document, end) gives
the places where tokens of both end together.  These places cut a document into groups and link the two tokens that end there.

The pairs of linked ids of a slice are counted in the task; Spark adds the counts of all slices and brings the totals back to the
slices that hold a pair, once per slice, where the documents' links find them.
"""
from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nocturne.llm.common import binary, materialize, pick, slices
from nocturne.llm.tokens import alphabet, encoder

CHUNK = 1 << 19  # bytes of text that are aligned at a time
SLICE = 8 << 20  # bytes of text whose pairs are counted together
#: A place in front of a space where both tokenizers always cut: a space and a letter after a letter.
_safe = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


class Pair:
    """The two tokenizers: a byte-level BPE file (A) and a sentencepiece model (B)."""

    def __init__(self, byte_level: str, pieces: str):
        self.encode_a = encoder(byte_level, plain=True)
        of, vocabulary = alphabet(), json.loads(Tokenizer.from_file(byte_level).to_str())["model"]["vocab"]
        known = {i: bytes(of[c] for c in token) for token, i in vocabulary.items() if all(c in of for c in token)}
        self.a = pa.array([known.get(i, b"") for i in range(max(vocabulary.values()) + 1)], pa.large_binary())
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.b = pa.array(
            [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)],
            pa.large_binary(),
        )
        self.may_cut = not any("▁" in n.lstrip("▁") for n in names)  # no piece holds a space behind something else
        self.wide = max(len(self.a), len(self.b))
        self.decimal = pa.array([f"{i}{end}" for end in ",|;" for i in range(self.wide)], pa.large_string()).cast(pa.large_binary())

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def cut(self, text: str, size: int) -> list[str]:
        """The text in pieces of about ``size`` characters; each piece stands for a space and its text."""
        out, at = [], 0
        while self.may_cut and len(text) - at > size:
            place = _safe.search(text, at + size)
            if not place:
                break
            out.append(text[at : place.start()])
            at = place.end()
        return [*out, text[at:]]

    def fits(self, raw: bytes, ids: list[int]) -> bool:
        """Whether B's tokens spell a space and the text."""
        spelled = self.b.take(pa.array(ids, pa.int64()))
        return b"".join(spelled.to_pylist()) == b" " + raw


@functools.cache
def pair(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


def _listed(ids: list[list[int]]) -> pa.ListArray:
    return pa.array(ids, pa.large_list(pa.int32()))


def _tokens(lists: pa.Array, spelled: pa.Array, names: tuple[str, str, str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(document, end, id, place) of all tokens; the spelled bytes and where each document's begin."""
    document, ids = pc.list_parent_indices(lists), pc.list_flatten(lists)
    token = spelled.take(ids)
    ends = pc.cumulative_sum(pc.binary_length(token).cast(pa.int64()))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], ends.to_numpy()))[np.concatenate(([0], np.cumsum(counts)))]  # bytes before each document
    inside = pc.subtract(ends, pa.array(bounds[:-1]).take(document))
    made = pa.table({"document": document, "end": inside, names[0]: ids, names[1]: pa.array(np.arange(len(ids)))})
    return made, np.frombuffer(token.buffers()[2] or b"", np.uint8), bounds


class Aligned:
    """One chunk of texts: links in order, and per text its counts and groups."""

    def __init__(self, own: Pair, texts: list[str]):
        raw = [t.encode() for t in texts]
        ids_a = [own.encode_a(" " + t) if t else [] for t in texts]
        ids_b = own.encode_b(texts)
        self.valid = np.zeros(len(texts), bool)
        for _ in range(2):  # what doesn't fit is emptied, and the rest is set up again
            lists = _listed(ids_a), _listed(ids_b)
            (a, spelled_a, at_a), (b, spelled_b, at_b) = _tokens(lists[0], own.a, ("a", "a_at", "")), _tokens(lists[1], own.b, ("b", "b_at", ""))
            views = memoryview(spelled_a), memoryview(spelled_b)
            for i, text in enumerate(raw):
                whole = b" " + text
                self.valid[i] = bool(text) and views[0][at_a[i] : at_a[i + 1]] == whole and views[1][at_b[i] : at_b[i + 1]] == whole
            bad = [i for i in range(len(texts)) if not self.valid[i] and (ids_a[i] or ids_b[i])]
            if not bad:
                break
            for i in bad:
                ids_a[i], ids_b[i] = [], []
        self.n_a, self.n_b = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        links = a.join(b, keys=["document", "end"], join_type="inner", use_threads=False).sort_by("a_at").combine_chunks()
        columns = {n: links[n].to_numpy().astype(np.int64) for n in ("document", "end", "a", "b", "a_at", "b_at")}
        self.links = columns
        self.n_links = np.bincount(columns["document"], minlength=len(texts))
        self.pairs = columns["a"] * len(own.b) + columns["b"]
        self._write(own, a["a"].to_numpy(), b["b"].to_numpy())

    def _write(self, own: Pair, ids_a: np.ndarray, ids_b: np.ndarray) -> None:
        """``groups``: per text `a1,a2|b1;a3|b2,b3` as a view into one buffer."""
        last_a, last_b = self.links["a_at"], self.links["b_at"]
        group_a = np.searchsorted(last_a, np.arange(len(ids_a)))  # the group of each token: the first that ends there or later
        group_b = np.searchsorted(last_b, np.arange(len(ids_b)))
        before_b = np.concatenate(([0], last_b + 1))  # B tokens before each group
        upto_a = last_a + 1
        merged = np.empty(len(ids_a) + len(ids_b), np.int64)
        kind = np.zeros(len(ids_a), np.int64)
        kind[last_a] = own.wide
        merged[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + kind
        kind = np.zeros(len(ids_b), np.int64)
        kind[last_b] = 2 * own.wide
        if len(ids_b):
            merged[np.arange(len(ids_b)) + upto_a[group_b]] = ids_b + kind
        spelled = own.decimal.take(pa.array(merged))
        ends = np.frombuffer(spelled.buffers()[1], np.int64, len(merged) + 1) if len(merged) else np.zeros(1, np.int64)
        bounds = ends[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))]
        data = memoryview(spelled.buffers()[2] or b"")
        self.groups = [data[x : max(x, y - 1)] for x, y in zip(bounds.tolist(), bounds[1:].tolist())]

    def spans(self) -> list[list[dict]]:
        """Per text its groups: the byte of the space and text where each ends, and its numbers of A and B tokens."""
        link = self.links
        starts = np.cumsum(self.n_links) - self.n_links
        new = np.zeros(len(link["end"]), bool)
        new[starts[self.n_links > 0]] = True
        base_a, base_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        prev = lambda x, base: np.where(new, base[link["document"]] - 1, np.concatenate(([-1], x[:-1])))
        many_a, many_b = link["a_at"] - prev(link["a_at"], base_a), link["b_at"] - prev(link["b_at"], base_b)
        rows = [{"end": e, "n_a": x, "n_b": y} for e, x, y in zip(link["end"].tolist(), many_a.tolist(), many_b.tolist())]
        return [rows[s : s + n] for s, n in zip(starts.tolist(), self.n_links.tolist())]


class _Slice:
    """Rows of a slice: its documents with the numbers of their pairs, and the pairs with their counts."""

    def __init__(self, own: Pair, number: int, with_groups: bool):
        self.own, self.number, self.with_groups = own, number, with_groups
        self.rows, self.pairs, self.lengths, self.size = [], [], [], 0

    def document(self, doc, raw: bytes | None, row) -> None:
        self.rows.append({"doc_id": doc, "row": row, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "hash": None, "groups": []})
        self.size += len(raw or b"")

    def chunk(self, parts: list[tuple[int, str]]) -> None:
        """Align texts, each with the number of its document among the rows."""
        made = Aligned(self.own, [t for _, t in parts])
        spans = made.spans() if self.with_groups else None
        for k, (at, _) in enumerate(parts):
            if not made.valid[k]:
                continue
            row = self.rows[at]
            first = row["hash"] is None
            row["hash"] = row["hash"] or hashlib.sha256()
            row["hash"].update(b"" if first else b";")
            row["hash"].update(made.groups[k])
            if spans is not None:
                base = row["groups"][-1]["end"] if row["groups"] else 0
                row["groups"] += [{**s, "end": s["end"] + base} for s in spans[k]]
            row["n_a"] += int(made.n_a[k])
            row["n_b"] += int(made.n_b[k])
            row["n_links"] += int(made.n_links[k])
        self.pairs.append(made.pairs)

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        every = np.concatenate([np.zeros(0, np.int64), *self.pairs])
        counted = pa.table({"pair": every}).group_by("pair", use_threads=False).aggregate([("pair", "count")]).sort_by("pair")
        distinct = counted["pair"].to_numpy().astype(np.int64)
        codes = np.searchsorted(distinct, every).astype(np.int32)
        sizes = np.array([r["n_links"] for r in self.rows], np.int64)
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(codes))
        n = len(self.rows)
        column = lambda name, t: pa.array([r[name] for r in self.rows] + [None], t)
        lists = lambda x, t: pa.array([None] * n + [x], pa.list_(t))
        groups = pa.list_(pa.struct([("end", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64())]))
        out = {
            "slice": pa.array([self.number] * (n + 1), pa.int64()), "doc_id": column("doc_id", kind), "n_a": column("n_a", pa.int64()), "n_b": column("n_b", pa.int64()),
            "n_links": column("n_links", pa.int64()), "groups_sha256": pa.array([r["hash"].hexdigest() if r["hash"] else "" for r in self.rows] + [None], pa.string()),
            "codes": pa.concat_arrays([listed, pa.nulls(1, pa.list_(pa.int32()))]), "pairs": lists(distinct, pa.int64()), "counts": lists(counted["pair_count"].to_numpy(), pa.int64()),
        }
        if self.with_groups:
            out["groups"] = pa.array([r["groups"] for r in self.rows] + [None], groups)
        return pa.RecordBatch.from_pydict(out)


def _slices(byte_level: str, pieces: str, with_groups: bool, chunk: int, slice_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = pair(byte_level, pieces), TaskContext.get().partitionId() << 32
        part, waiting, size, kind = None, [], 0, None
        for batch in slices(batches, limit=chunk):
            kind = batch.column("doc_id").type
            for row, (doc, raw) in enumerate(zip(batch.column("doc_id").to_pylist(), binary(batch.column("text")))):
                part = part or _Slice(own, number, with_groups)
                part.document(doc, raw, row)
                texts = own.cut((raw or b"").decode(errors="replace"), max(1, chunk // 4))
                if len(texts) > 1 and not all(own.fits(t.encode(), ids) for t in texts for ids in own.encode_b([t])):
                    continue  # no tokens at all when any piece doesn't fit
                for text in texts:
                    waiting.append((len(part.rows) - 1, text))
                    size += len(text)
                    if size >= chunk:
                        part.chunk(waiting)
                        waiting, size = [], 0
                if part.size >= slice_size:
                    if waiting:
                        part.chunk(waiting)
                    yield part.batch(kind)
                    part, waiting, size, number = None, [], 0, number + 1
        if part:
            if waiting:
                part.chunk(waiting)
            yield part.batch(kind)

    return run


def _sum_up(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """(doc columns, n_best, count_sum) of one slice."""
    total, best = (np.zeros(pairs.num_rows, np.int64) for _ in range(2))
    code = pairs["code"].to_numpy().astype(np.int64)
    total[code], best[code] = pairs["total"].to_numpy(), pairs["is_best"].to_numpy().astype(np.int64)
    codes = documents["codes"].combine_chunks()
    flat, sizes = pc.list_flatten(codes).to_numpy(), pc.list_value_length(codes).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    summed = [np.diff(np.concatenate(([0], np.cumsum(x[flat])))[ends]) for x in (best, total)]
    kept = documents.drop_columns(["codes", "home"])
    return kept.append_column("n_best", pa.array(summed[0])).append_column("count_sum", pa.array(summed[1]))


def align(docs: DataFrame, byte_level: str, pieces: str, *, with_groups: bool = False, chunk: int = CHUNK, slice_size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    documents: (doc_id, n_a, n_b, n_links, groups_sha256, n_best, count_sum[, groups]); groups lists where each ends, in bytes of a space and the
    text, and how many tokens it has. pairs: (a_id, b_id, total, is_best), every pair of ids that is linked somewhere, with the number of its links and
    whether no other A id has more with its B id.

    A null or empty text, and one that either tokenizer doesn't spell as a space and the text (it holds U+2581, say, or isn't UTF-8), has zeros and an empty groups_sha256. Rows
    with equal or null doc_ids each get their row; an empty table gives empty tables; other columns are left out. A long text is cut where both
    tokenizers cut anyway, so a task holds some ``chunk`` bytes of text at a time, and the pairs of ``slice_size`` bytes or of one longer text.
    """
    docs = pick(docs, "doc_id", "text")
    kind = docs.schema[0].dataType.simpleString()
    groups = ", groups array<struct<end: long, n_a: long, n_b: long>>" * with_groups
    own_columns = f"doc_id {kind}, n_a long, n_b long, n_links long, groups_sha256 string"
    schema = f"slice long, {own_columns}, codes array<int>, pairs array<long>, counts array<long>{groups}"
    written = materialize(docs.mapInArrow(_slices(byte_level, pieces, with_groups, chunk, slice_size), schema))
    width = pair(byte_level, pieces).model.get_piece_size()
    held = written.filter("pairs is not null").select("slice", F.posexplode(F.arrays_zip("pairs", "counts")).alias("code", "p"))
    held = held.select("slice", "code", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = held.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b_id", F.col("pair") % width)
    top = totals.groupBy("b_id").agg(F.max("total").alias("top"))
    known = materialize(totals.join(top, "b_id").select("pair", "b_id", "total", (F.col("total") == F.col("top")).alias("is_best")))
    back = held.join(known, "pair").select("slice", "code", "total", "is_best")
    documents = written.filter("pairs is null").drop("pairs", "counts").withColumnRenamed("slice", "home")
    out = documents.groupBy("home").cogroup(back.groupBy("slice")).applyInArrow(_sum_up, own_columns + groups + ", n_best long, count_sum long")
    pairs = known.select(F.expr(f"pair div {width}").alias("a_id"), "b_id", "total", "is_best")
    return out, pairs
