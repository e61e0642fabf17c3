"""Document quality by hierarchical empirical Bayes.

A logistic model of text statistics gives each document's evidence, a log-likelihood ratio.  Documents of one host and
path are alike, so the share of good documents of a path is estimated too: towards its host's where the path has few
documents, and a host's towards the global share.  How far is estimated from how much hosts, and paths within hosts, differ
(method of moments).  The posterior of a document combines its evidence with its path's share, which leaves out the document itself.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import Words, binary, materialize, pick, slices

FEATURES = ["upper", "digit", "mark", "pause", "repeat", "variety", "length", "size", "ended", "line"]
_UPPER, _LOWER, _DIGIT, _PAUSE, _BREAK = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_PAUSE[[ord(c) for c in ".,;:'\"()-?"]] = True
_BREAK[[9, 10, 11, 12, 13, 32]] = True
_MARK = ~(_UPPER | _LOWER | _DIGIT | _PAUSE | _BREAK) & (np.arange(256) < 128)


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of ``FEATURES`` per text; zeros where there are no words."""
    words = Words(texts)
    raw = np.frombuffer(words.joined, np.uint8)
    out = np.zeros((len(texts), len(FEATURES)))
    some = np.flatnonzero(words.counts)
    if not len(some):
        return out
    first, n = words.starts[some], words.counts[some].astype(float)
    lo = words.offsets[first]
    chars = np.diff(np.append(lo, len(raw))) - n
    add = lambda flags: np.add.reduceat(flags.astype(np.int64), lo)
    # A capital of two bytes: 0xC3 and 0x80-0x9E, but 0x97.
    after = np.concatenate(([False], raw[:-1] == 0xC3))
    capital = _UPPER[raw] | (after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97))
    same = np.concatenate(([False], words.ids[1:] == words.ids[:-1]))
    same[first] = False
    per_word = lambda flags: np.add.reduceat(flags.astype(np.int64), first)
    text = np.repeat(np.arange(len(some)), words.counts[some])
    kinds = np.bincount(np.unique(text * (len(words.dictionary) + 1) + words.ids) // (len(words.dictionary) + 1), minlength=len(some))
    last = raw[words.offsets[1:] - 2]
    lines = np.array([t.count(b"\n") + 1 for t in (texts[i] for i in some)])
    out[some] = np.column_stack([
        add(capital) / chars, add(_DIGIT[raw]) / chars, add(_MARK[raw]) / chars, add(_PAUSE[raw]) / chars, per_word(same) / n, kinds / n ** 0.9,
        np.log1p(chars / n), np.log1p(n), per_word(_MARK[last]) / n, np.log1p(n / lines),
    ])
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=2 << 20):
        texts = binary(batch.column("text"))
        versions = [None if t is None else zlib.crc32(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(versions, pa.int64()), batch.column("host"), batch.column("path"), pa.array(list(features(texts)), pa.list_(pa.float64()))],
            ["doc_id", "version", "host", "path", "x"],
        )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method, on centred and scaled columns; zeros where one class is missing."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1] if x.ndim == 2 else len(FEATURES)), 0.0
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-9) * len(y) ** 0.5
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def _strength(n: str, s: str, centre: Column | float) -> Column:
    """Prior strength by moments over groups with ``n`` documents of which ``s`` are good."""
    centre = F.lit(centre) if isinstance(centre, float) else centre
    noise = centre * (1 - centre)
    spread = F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - centre, 2)) / F.sum(n)
    between = spread - F.sum(noise) / F.sum(n)
    return F.least(F.lit(1e4), F.greatest(F.lit(1.0), F.coalesce(F.avg(noise) / F.greatest(between, F.lit(1e-6)) - 1, F.lit(1.0))))


def score(
    docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", label: str = "quality", least: float = 0.5, sample_rows: int = 20_000
) -> DataFrame:
    """(doc_id, version, p_text, host_share, path_share, quality, kept) of every document; ``version`` is the CRC-32 of its text.

    The text model is fitted on the ``sample_rows`` labelled documents whose ids hash lowest, or all if fewer; everything else counts all documents.
    A labelled document counts for its host and path as labelled, others by the model. ``quality`` is the posterior, ``kept`` if it is
    ``least`` at least. A null text has no words; a null host or path is the same site as an empty one. Labels without
    value or document don't count; repeated rows count each; without labels of both classes every posterior is the global share, or
    0.5 where there is none. An empty table gives an empty table.
    """
    named = pick(docs, "doc_id", "text", host, path).toDF("doc_id", "text", "host", "path")
    named = named.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path")])
    described = materialize(named.mapInArrow(_describe, "doc_id long, version long, host string, path string, x array<double>"))
    known = pick(labels, "doc_id", label).toDF("doc_id", "y").filter("doc_id is not null and y is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("y").alias("y"))
    joined = materialize(described.join(known, "doc_id", "left"))
    sample = joined.filter("y is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "version").limit(sample_rows).select("x", "y").collect()
    x, y = np.array([r["x"] for r in sample], float).reshape(-1, len(FEATURES)), np.array([round(r["y"]) for r in sample], float)
    weights, bias = fit_logistic(x, y)
    total = joined.agg(F.avg("y").alias("y")).first()["y"]
    share = min(max(0.5 if total is None else float(total), 1e-4), 1 - 1e-4)
    prior = float(np.log(share / (1 - share)))
    base = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    model = F.lit(bias) if weights.any() else F.lit(float(np.log(base / (1 - base))))
    for i, w in enumerate(weights.tolist()):
        model = model + F.col("x")[i] * F.lit(w)
    evidence = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model - F.lit(float(np.log(base / (1 - base))))))
    told = joined.select("doc_id", "version", "host", "path", "y", evidence.alias("evidence")).withColumn("p_text", 1 / (1 + F.exp(-(F.col("evidence") + prior)))).withColumn("good", F.coalesce("y", "p_text"))
    # Shares of hosts and paths.  All sums are partial before they are shuffled, so a hot host is a row per task.
    paths = materialize(told.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("good").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    centre = paths.agg((F.sum("s") / F.sum("n")).alias("m")).first()["m"]
    centre = min(max(0.5 if centre is None else float(centre), 1e-4), 1 - 1e-4)
    host_k = float(hosts.agg(_strength("host_n", "host_s", centre).alias("k")).first()["k"] or 1.0)
    hosts = hosts.withColumn("host_share", (F.col("host_s") + host_k * centre) / (F.col("host_n") + host_k))
    sites = paths.join(hosts, "host")
    path_k = float(sites.agg(_strength("n", "s", F.col("host_share")).alias("k")).first()["k"] or 1.0)
    sites = sites.select("host", "path", "n", "s", "host_n", "host_s")
    # A document's own evidence counts once: both of its shares are those of the other documents.
    both = told.join(sites, ["host", "path"]).withColumn("host_share", (F.col("host_s") - F.col("good") + host_k * centre) / (F.col("host_n") - 1 + host_k))
    others = (F.col("s") - F.col("good") + path_k * F.col("host_share")) / (F.col("n") - 1 + path_k)
    placed = both.withColumn("path_share", F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), others)))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_share") / (1 - F.col("path_share"))))))
    return placed.select("doc_id", "version", "p_text", "host_share", "path_share", posterior.alias("quality")).withColumn("kept", F.col("quality") >= least)


def keep_good(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """The documents, with all their columns, that ``score`` keeps."""
    bad = scored.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    version = F.crc32(docs["text"].cast("binary"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & version.eqNullSafe(bad["_version"]), "left_anti")
