"""Graded toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all thresholds t_0 < t_1 < ...: a word that makes a
document worse does so at every grade. x counts features over the distinct words of a text: the word and its
first letters, since insults come with endings; only features that go with toxic labels beyond chance have a weight.
The expected severity is the sum of P(grade > k).
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import ALNUM, U64, Words, binary, materialize, pick, slices


PREFIXES = (4, 5, 6)  # bytes of a word's beginnings that are features beside the word


def word_features(words: Words) -> np.ndarray:
    """64-bit hashes of each dictionary word's features: itself and its beginnings (a shorter word counts as its own)."""
    known = [w[:-1] for w in words.dictionary.to_pylist()]
    out = np.empty((len(known), 1 + len(PREFIXES)), U64)
    for k, n in enumerate((None, *PREFIXES)):
        out[:, k] = np.fromiter((xxhash.xxh64_intdigest(w[:n], seed=k) for w in known), U64, len(known))
    return out


def distinct_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word) of the distinct words of each text, and the features of each word."""
    words = Words(texts, ALNUM)
    size = max(len(words.dictionary), 1)
    pairs = np.unique(np.repeat(np.arange(len(texts)), words.counts) * size + words.ids)
    return pairs // size, pairs % size, word_features(words)


@dataclass
class OrdinalModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, texts: list[bytes | None]) -> np.ndarray:
        """P(grade > k) of each text, by k."""
        score = np.zeros(len(texts))
        if len(self.features):
            row, word, features = distinct_words(texts)
            at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
            per_word = np.where(self.features[at] == features, self.weights[at], 0.0).sum(1)
            score = np.bincount(row, per_word[word], minlength=len(texts))
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_ordinal(row: np.ndarray, column: np.ndarray, grade: np.ndarray, features: np.ndarray, *, ridge: float = 0.03, steps: int = 100) -> OrdinalModel:
    """Maximum likelihood with a ridge, by L-BFGS.

    ``row``, ``column``: the text and the feature number of each entry. Thresholds stay in order: the first is free and the gaps are exponentials.
    """
    top, n = max(int(grade.max(initial=0)), 1), len(grade)
    cut = np.array([np.log((n + 1) / (np.sum(grade > k) + 0.5) - 1) for k in range(top)])
    x = np.concatenate((np.zeros(len(features)), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))))
    i, m = np.arange(n), len(features)

    def cuts(x: np.ndarray) -> np.ndarray:
        return x[m] + np.concatenate(([0.0], np.cumsum(np.exp(x[m + 1 :]))))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        score = np.bincount(row, x[:m][column], minlength=n)
        above = np.column_stack([np.ones(n), _sigmoid(score[:, None] - cuts(x)), np.zeros(n)])
        slope = above * (1 - above)  # by threshold; zero at both ends
        p = np.maximum(above[i, grade] - above[i, grade + 1], 1e-12)
        d_hi, d_lo = slope[i, grade] / p, slope[i, grade + 1] / p
        d_t = np.bincount(grade, d_hi, minlength=top + 2) - np.bincount(grade + 1, d_lo, minlength=top + 2)
        later = np.cumsum(d_t[1:-1][::-1])[::-1]
        g = np.concatenate((ridge * x[:m] - np.bincount(column, (d_hi - d_lo)[row], minlength=m), later[:1], later[1:] * np.exp(x[m + 1 :])))
        return float(-np.log(p).sum() + ridge / 2 * x[:m] @ x[:m]), g

    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, back = -g, []
        for s, y in reversed(past):
            back.append((s @ d) / (s @ y))
            d = d - back[-1] * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])) if past else d / max(np.abs(g).max(), 1e-9)
        for (s, y), a in zip(past, reversed(back)):
            d = d + s * (a - (y @ d) / (s @ y))
        step, slope = 1.0, g @ d
        while step > 1e-6:
            new, g_new = loss(x + step * d)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, g_new - g
        if s @ y > 1e-10:
            past = [*past[-9:], (s, y)]
        done = value - new < 1e-6 * max(abs(value), 1)
        x, value, g = x + s, new, g_new
        if done:
            break
    return OrdinalModel(features, x[:m], cuts(x))


def grade_by_count(row: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1 and 2 where labels say only toxic or not: toxic texts with more telling features than the toxic median are 2."""
    count = np.bincount(row, minlength=len(toxic))
    middle = np.median(count[toxic]) if toxic.any() else 0.0
    return toxic.astype(np.int64) + (toxic & (count > middle))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        row, word, features = distinct_words(binary(batch.column("text")))
        ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
        columns = [features[word[a:b]].astype("<u8").tobytes() for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns, pa.binary())], ["doc_id", "columns"])


def _count(shared):
    """How many toxic and other texts of a batch have each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: set[int] = shared.value
        for batch in slices(batches, "columns"):
            sides: tuple[list, list] = ([], [])
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("columns").to_pylist()):
                sides[doc in toxic].append(np.unique(np.frombuffer(raw, "<u8")))
            for bad, side in enumerate(sides):
                feature, n = np.unique(np.concatenate(side), return_counts=True) if side else (np.zeros(0, U64), np.zeros(0, np.int64))
                other = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(feature.astype(np.int64)), pa.array(n if bad else other), pa.array(other if bad else n)], ["feature", "bad", "good"])

    return run


def telling(counts: DataFrame, n_bad: int, n_good: int, support: int = 3, least: float = 15.0) -> np.ndarray:
    """Features that ``support`` toxic texts or more have, and more of them than of others by a likelihood ratio (G) of at least ``least``; sorted."""
    total, share = F.col("bad") + F.col("good"), n_bad / max(n_bad + n_good, 1)
    g = 2 * (F.col("bad") * F.log(F.col("bad") / (total * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (total * (1 - share)))).otherwise(0.0))
    kept = counts.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter((F.col("bad") >= support) & (F.col("bad") > total * share) & (g >= least))
    return np.sort(np.array([r["feature"] for r in kept.select("feature").collect()], np.int64).astype(U64))


def _chosen(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features: np.ndarray = shared.value
        for batch in batches:
            out = []
            for raw in batch.column("columns").to_pylist():
                x = np.frombuffer(raw, "<u8")
                at = np.minimum(np.searchsorted(features, x), max(len(features) - 1, 0))
                out.append((at[features[at] == x] if len(features) else at[:0]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "columns"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample_rows: int = 8_000, graded: bool | None = None) -> OrdinalModel:
    """The model of at most ``sample_rows`` labelled documents, those whose ids hash lowest.

    Their features are counted on the executors; the driver gets the telling ones only and fits the weights.
    ``graded``: the labels are severity grades 0, 1, 2 ...; if false they only tell toxic from not, and ``grade_by_count`` grades them. By default,
    labels beyond 1 are grades. Null labels and texts don't count. Without labels, or telling features, no word has a weight.
    """
    sc = docs.sparkSession.sparkContext
    picked = pick(labels, "doc_id", label).toDF("doc_id", "grade").filter("doc_id is not null and grade is not null")
    picked = picked.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("grade").cast("long").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    grades = {r["doc_id"]: r["grade"] for r in picked.collect()}
    wanted = sc.broadcast(np.array(sorted(grades), np.int64))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.isin(batch.column("doc_id").to_numpy(zero_copy_only=False), wanted.value)))

    plain = pick(docs, "doc_id", "text").filter("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sample = materialize(plain.mapInArrow(some, "doc_id long, text string").mapInArrow(_features, "doc_id long, columns binary"))
    toxic = sc.broadcast({d for d, g in grades.items() if g > 0})
    counts = sample.mapInArrow(_count(toxic), "feature long, bad long, good long")
    found = [r["doc_id"] for r in sample.select("doc_id").collect()]
    n_bad = sum(d in toxic.value for d in found)
    features = telling(counts, n_bad, len(found) - n_bad)
    rows = sample.mapInArrow(_chosen(sc.broadcast(features)), "doc_id long, columns binary").orderBy(F.xxhash64("doc_id"), "doc_id", "columns").collect()
    columns = [np.frombuffer(r["columns"], "<i4") for r in rows]
    grade = np.array([grades[r["doc_id"]] for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(c) for c in columns]).astype(np.int64)
    column = np.concatenate(columns) if columns else np.zeros(0, np.int32)
    if graded is None:
        graded = bool(len(grade)) and grade.max() > 1
    if not graded:
        grade = grade_by_count(row, grade > 0)
    return fit_ordinal(row, column, grade, features)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            p = model.above(binary(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in (p[:, 0], p.sum(1), (p >= 0.5).sum(1), p[:, 0] >= 0.5))], ["doc_id", "p_toxic", "severity", "grade", "toxic"])

    return run


def grade(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, p_toxic, severity, grade, toxic) of every document: P(grade > 0), the expected grade, the median grade, and p_toxic >= 0.5.

    Words are runs of digits, letters (A-Z lower-cased) and non-ASCII characters, each counted once a document. A text that is
    null or has no words gets what the thresholds alone say. Repeated rows are graded each; an empty table gives an empty table.
    """
    plain = pick(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return plain.mapInArrow(_score(shared), f"doc_id {plain.schema[0].dataType.simpleString()}, p_toxic double, severity double, grade long, toxic boolean")
