"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

quality           documents whose posterior quality is below one half go
line dedup        non-empty lines that stand earlier in the corpus go, equal or (from 32 characters) with one edit, and documents that lose all their lines
near duplicates   of documents linked by a similarity of 0.8 the one with the smallest doc_id stays
decontamination   documents with 5 per cent or more of their words in benchmark passages go; shorter shares are cut out
packing           pieces of the documents' tokens and their places in sequences
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.llm import decontamination, line_dedup, minhash, packing, quality
from nocturne.llm.common import materialize, pick

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text is now."""
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = pick(docs, *COLUMNS)
    return quality.keep_good(docs, quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _with_lines(left: DataFrame) -> DataFrame:
    emptied = (F.col("n_removed") > 0) & (F.trim("text") == "")
    return _documents(left.filter(~F.coalesce(emptied, F.lit(False))))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_lines(line_dedup.dedup_lines(docs, exact_chars=1, carry=["lang", "source"]))


def drop_near_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same by up to three edits."""
    return _with_lines(line_dedup.dedup_lines(docs, **line_dedup.WHOLE, carry=["lang", "source"]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = minhash.near_duplicates(docs, percent=80, bands=56, rows=7, carry=["lang", "source", "n_chars"])
    return judged.filter("kept").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(decontamination.decontaminate(docs, items, carry=["lang", "source"]).filter(~F.col("contaminated")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), capacity=CAPACITY)


STAGES = [
    ("quality classifier", keep_good_documents),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The same with near lines by three edits in the line stage.
WHOLE_STAGES = [(name, drop_near_lines if name == "line dedup" else stage) for name, stage in STAGES]

#: The quality model and the packing plan can't be said in SQL; the tests run the stages beside a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, stages: list = STAGES) -> DataFrame:
    """The last stage's rows over the documents of a folder."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), *COLUMNS)
    for i, (_, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if i < len(stages) - 1:
            docs = materialize(docs)
    return docs


def run_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, WHOLE_STAGES)
