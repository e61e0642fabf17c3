"""Benchmark decontamination: documents that hold passages of test items.

The test items of a block become one generalised suffix automaton over words.  Documents stream through it; at every
word the automaton knows the longest run of words that ends there and stands in some item.  Runs of at least a
window's length are hits; the state tells which items hold the window.

The automaton is built on the driver from a block of items of bounded size (``block_words``) and broadcast; a larger
benchmark makes more blocks, which the documents pass one after another with what they found so far.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import ALNUM, Words, binary, materialize, pick, slices

WORD = re.compile(rb"[^ ]+")


class SuffixAutomaton:
    """All runs of words of several items. ``add`` them, then ``seal`` to find the windows' states.

    Transitions are kept in one dictionary by (state, word); ``home`` has the items of the window of ``width`` words
    by the state that stands for it, ``short`` the items of fewer words by state and length.
    """

    def __init__(self, width: int):
        self.width, self.vocabulary, self.items = width, {}, []
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.home: dict[int, list[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.shortest = width

    def _copy(self, p: int, c: int, q: int) -> int:
        """A state for the shorter runs of q, reached from p by c."""
        new = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, c, q)
        new = len(self.step)
        self.step.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, c, q)
        return new

    def add(self, item: str, words: list[bytes]) -> None:
        codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        self.items.append((item, codes))
        self.shortest = min(self.shortest, len(codes))
        last = 0
        for c in codes:
            last = self._extend(last, c)

    def reach(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a run that ends in ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def seal(self) -> SuffixAutomaton:
        for item, codes in self.items:
            state = 0
            for i, c in enumerate(codes):
                state = self.step[state][c]
                if i + 1 >= self.width:
                    state = self.reach(state, self.width)
                    self.home.setdefault(state, []).append(item)
            if len(codes) < self.width:
                self.short.setdefault(self.reach(state, len(codes)), []).append((len(codes), item))
        self.items = []
        near = [0] * len(self.step)  # the nearest suffix, itself included, that is a short item
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            near[s] = s if s in self.short else near[self.link[s]]
        self.near = near
        return self

    def matches(self, codes: list[int], at: int, spans: list[tuple[int, int]], found: set[str]) -> int:
        """Hits of a run of known words that begins at word ``at``; the longest match."""
        step, link, length, width, near = self.step, self.link, self.length, self.width, self.near
        state = size = most = 0
        for i, c in enumerate(codes, at + 1):
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step[state].get(c)
            if to is None:
                continue
            state, size = to, size + 1
            if size >= width:
                spans.append((i - size, i))
                found.update(self.home[self.reach(state, width)])
                most = max(most, size)
            s = near[state]
            while s:
                for n, item in self.short[s]:
                    if n <= size:
                        spans.append((i - n, i))
                        found.add(item)
                        most = max(most, n)
                s = near[link[s]]
        return most


def _pieces(width: int, piece_words: int):
    """Items as normalised words; long ones in pieces that overlap by all but one word of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), binary(batch.column("text"))):
                words = (text or b"").translate(ALNUM).split()
                for lo in range(0, max(len(words) - width + 1, min(len(words), 1)), piece_words):
                    part = words[lo : lo + piece_words + width - 1]
                    out.append((item, lo, len(part), b" ".join(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["item_id", "piece", "n", "words"])

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text.translate(ALNUM))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    out.append(text[at:])
    return b"".join(out)


def _scan(shared, carry: list[str], coverage: float, last: bool):
    """One block over the documents. The last block also cuts and judges."""
    share = Fraction(str(coverage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in slices(batches):
            texts = binary(batch.column("text"))
            words = Words(texts, ALNUM)
            known = np.fromiter((automaton.vocabulary.get(w[:-1], -1) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
            codes = known[words.ids] if len(known) else words.ids
            spans = [list(map(tuple, x)) for x in batch.column("spans").to_pylist()]
            items = [set(x) for x in batch.column("items").to_pylist()]
            longest = batch.column("longest").to_pylist()
            # runs of words that stand in some item, not across texts
            text = np.repeat(np.arange(len(texts)), words.counts)
            inside = np.flatnonzero(codes >= 0)
            if len(inside):
                lo = np.flatnonzero(np.concatenate(([True], (np.diff(inside) != 1) | (np.diff(text[inside]) != 0))))
                hi = np.append(lo[1:], len(inside))
                begin = words.starts
                for i, j in zip(lo.tolist(), hi.tolist()):
                    if j - i >= automaton.shortest:
                        d, s = int(text[inside[i]]), int(inside[i])
                        longest[d] = max(longest[d], automaton.matches(codes[s : s + j - i].tolist(), s - int(begin[d]), spans[d], items[d]))
            spans = [_merged(x) for x in spans]
            items = [sorted(x) for x in items]
            hits = [sum(b - a for a, b in x) for x in spans]
            span_type, item_type = pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())
            columns = {c: batch.column(c) for c in carry}
            columns |= {"doc_id": batch.column("doc_id"), "n_words": pa.array(words.counts), "longest": pa.array(longest, pa.int64()), "spans": pa.array([[[a, b] for a, b in x] for x in spans], span_type), "items": pa.array(items, item_type)}
            if not last:
                columns["text"] = batch.column("text")
            else:
                bad = [n > 0 and n * share.denominator >= share.numerator * w for n, w in zip(hits, words.counts.tolist())]
                columns["text"] = pa.array([_cut(t, x) if x else t for t, x in zip(texts, spans)], pa.binary()).cast(pa.string())
                columns |= {"n_hit": pa.array(hits, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "contaminated": pa.array(bad, pa.bool_())}
                columns["items_sha256"] = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items])
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def decontaminate(
    docs: DataFrame, items: DataFrame, *, width: int = 13, coverage: float = 0.05, block_words: int = 200_000, carry: list[str] | None = None
) -> DataFrame:
    """Every document with what it shares with the items.

    Words are runs of digits, letters a-z (A-Z are lower-cased) and non-ASCII characters. A window is ``width`` consecutive words of an
    item; an item of fewer words, but not none, is one window. Words inside an occurrence of a window are hits.

    Returns the ``carry`` columns, doc_id, text (without the hit spans), n_words, n_hit, n_items and ``items`` (ids, as
    sorted text) with windows in the document, items_sha256 of the comma-joined ids, ``spans`` of hit words
    ([first, after last]), ``longest`` match in words, and ``contaminated``: hits of at least ``coverage`` of the words.
    A null text has no words, stays null and is not contaminated; items without id are no items; equal items count each
    (one id counts once); repeated documents are judged each; an empty table on either side gives no hits.
    ``block_words``: words of items that one automaton holds at most, twice that for a block of one piece.
    """
    spark, carry = docs.sparkSession, [c for c in carry or [] if c not in ("doc_id", "text")]
    pieces = materialize(
        pick(items, "item_id", "text").filter("item_id is not null").withColumn("item_id", F.col("item_id").cast("string"))
        .mapInArrow(_pieces(width, max(1, block_words // 8)), "item_id string, piece long, n long, words binary")
    )
    blocks = max(1, -(-int(pieces.agg(F.sum("n")).first()[0] or 0) * 2 // block_words))
    placed = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks)))
    fields = {f.name: f.dataType.simpleString() for f in pick(docs, *carry).schema} if carry else {}
    fields |= {"doc_id": pick(docs, "doc_id").schema[0].dataType.simpleString(), "n_words": "bigint", "longest": "bigint", "spans": "array<array<int>>", "items": "array<string>", "text": "string"}
    judged = {"n_hit": "bigint", "n_items": "bigint", "contaminated": "boolean", "items_sha256": "string"}
    state = pick(docs, *carry, "doc_id", "text").withColumns(
        {"spans": F.array().cast("array<array<int>>"), "items": F.array().cast("array<string>"), "longest": F.lit(0).cast("bigint")}
    )
    for b in range(blocks):
        automaton = SuffixAutomaton(width)
        for row in placed.filter(F.col("block") == b).orderBy("item_id", "piece").collect():  # block_words at most, about
            automaton.add(row["item_id"], bytes(row["words"]).split(b" "))
        shared, last = spark.sparkContext.broadcast(automaton.seal()), b == blocks - 1
        schema = ", ".join(f"`{n}` {t}" for n, t in (fields | (judged if last else {})).items())
        state = state.mapInArrow(_scan(shared, carry, coverage, last), schema)
        if not last:
            state = materialize(state)
    return state
