"""Helpers shared by the training-data operators: columns, intermediate tables, words as numbers."""
from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, whatever else the table holds.

    Names are matched by case first and ignoring case second, so a table that has both ``text`` and ``TEXT`` works.
    """
    columns = df.columns
    folded = [c.lower() for c in columns]
    at = [columns.index(n) if n in columns else folded.index(n.lower()) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder of the cluster. A local one is made only for a local master without that setting."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage starts at files that survive lost executors.

    ``release()`` deletes these folders once the results are written; the end of the driver does so too.
    """
    spark = df.sparkSession
    path = work_folder(spark)
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete what ``materialize`` wrote. Frames that read those folders can't be used afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: nothing is left to talk to
            return


atexit.register(release)


# Words.  A batch of texts becomes one byte string of words that end with one space each, and numbers into a dictionary.

#: Bytes that end a word when words are `[^\x20\x09-\x0D]+`: what bytes.split() splits on.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and makes a space of what is not in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class Words:
    """Words of several texts: ``counts`` per text, ``ids`` per word, ``dictionary`` by id, ``joined`` bytes and word ``offsets`` into them."""

    def __init__(self, texts: list[bytes | None], table: bytes | None = None):
        counts, parts = np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            if text:
                words = (text.translate(table) if table else text).split()
                if words:
                    counts[i] = len(words)
                    words.append(b"")
                    parts.append(b" ".join(words))
        self._set(counts, b"".join(parts))

    @classmethod
    def packed(cls, counts: np.ndarray, joined: bytes) -> Words:
        new = cls.__new__(cls)
        new._set(counts, joined)
        return new

    def _set(self, counts, joined):
        self.counts, self.joined = counts, joined
        raw = np.frombuffer(joined, np.uint8)
        self.offsets = np.concatenate(([0], np.flatnonzero(raw == 32) + 1)).astype(np.int64)
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.offsets) - 1, [None, pa.py_buffer(self.offsets), pa.py_buffer(joined)])
        coded = array.dictionary_encode()
        self.ids, self.dictionary = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    @property
    def starts(self) -> np.ndarray:
        """Number of the first word of each text."""
        return np.concatenate(([0], np.cumsum(self.counts)))[:-1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        table = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.dictionary.to_pylist()), U64, len(self.dictionary))
        return table[self.ids] if len(table) else np.zeros(0, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (invertible)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each run of ``width`` numbers, built from runs of 1, 2, 4 ... numbers."""
    base = U64(0x9E3779B97F4A7C15)
    n = len(h)
    if n < width:
        return np.zeros(0, U64)
    power, step, out, used, factor = h, 1, None, 0, base
    scale = U64(1)
    rest = width
    while rest:
        if rest & 1:
            piece = power[used : n - width + 1 + used] * scale
            out = piece if out is None else out + piece
            used += step
            scale = U64(int(scale) * int(factor) & 0xFFFFFFFFFFFFFFFF)
        rest >>= 1
        if rest:
            power = power[: len(power) - step] + power[step:] * factor
            factor = U64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF)
            step *= 2
    return out


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of ``width`` numbers."""
    n, step = len(h), 1
    if n < width:
        return h[:0]
    while step * 2 <= width:
        h = np.minimum(h[: len(h) - step], h[step:])
        step *= 2
    return np.minimum(h[: n - width + 1], h[width - step : n - step + 1])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers from each start on, each for its length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


def window_starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word number of the start of every window that lies in one text, and its text."""
    first = np.cumsum(counts) - counts
    n = np.maximum(counts - width + 1, 0)
    return ranges(first, n), np.repeat(np.arange(len(counts)), n)


def binary(column: pa.Array) -> list[bytes | None]:
    """Texts as bytes."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of text, or one longer row: bounds a task's arrays."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // limit)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column (one scan)."""
    return int(df.select(F.sum(F.octet_length(F.col(column)).cast("bigint"))).first()[0] or 0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
