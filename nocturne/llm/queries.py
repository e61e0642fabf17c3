"""The numbered queries and their SQL."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.llm import chat, cross_tokenizer, decontamination, line_dedup, minhash, neighbors, packing, quality, spelling, substring_dedup, toxicity, url_filters, word_bpe
from nocturne.llm.sql import SQL


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that stand earlier in the corpus, by document: equal at every non-empty length, or with one edit from 32 characters on."""
    return line_dedup.dedup_lines(table(spark, sf, "documents"), exact_chars=1).drop("text")


def op1_line_dedup_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that stand earlier in the corpus, by document: equal at every non-empty length, or with up to three edits from 32 characters on."""
    return line_dedup.dedup_lines(table(spark, sf, "documents"), **line_dedup.WHOLE).drop("text")


def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words of documents left after removal of passages (13 words and more) of documents with a smaller doc_id."""
    left = substring_dedup.remove_repeats(table(spark, sf, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The policy of op3.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op3_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The rule and verdict of every page."""
    return url_filters.judge(table(spark, sf, "pages"), RULES).drop("by_link")


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """What every document shares with the benchmark items."""
    judged = decontamination.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of documents that share 85 per cent of their shingles, through links."""
    return minhash.near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """Preference pairs: of two conversations with ids 2n and 2n + 1 the first is chosen."""
    turns = table(spark, sf, "conversations")
    pairs = turns.filter("conv_id is not null").select(F.shiftright("conv_id", 1).alias("pair_id")).distinct()
    pairs = pairs.select("pair_id", (2 * F.col("pair_id")).alias("chosen_id"), (2 * F.col("pair_id") + 1).alias("rejected_id"))
    made = chat.format_preferences(turns, pairs)
    learned = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"])
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["first"].cast("string"), x["last"].cast("string"))), ",")
    sides = {f"{s}_{what}": f(F.col(f"{s}_spans")) for s in ("chosen", "rejected") for what, f in (("learned", learned), ("spans", written))}
    return made.withColumns(sides)


def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Posterior quality of every document: its text, its source and the language within the source."""
    return quality.score(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("version")


def op8_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 nearest vectors of every fiftieth."""
    vectors = table(spark, sf, "embeddings")
    return neighbors.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op9_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Where every piece of every document goes, in sequences of 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf, "documents"), path).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Expected severity of every document."""
    docs = table(spark, sf, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf, "labels")))


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Words of 6 letters and 5 occurrences or more with the more frequent words they are variants of."""
    words = spelling.count_words(table(spark, sf, "documents")).filter("length(word) >= 6 and n >= 5")
    return spelling.variants(words)


def op12_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded with a word-level BPE file and decoded again."""
    return word_bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_cross_tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    """How a byte-level BPE and a piece model cut every document, and how usual their links are."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    documents, _ = cross_tokenizer.align(table(spark, sf, "documents"), *paths)
    return documents.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")


_ALL = [
    op1_line_dedup, op1_line_dedup_whole, op2_substring_dedup, op3_url_filters, op4_decontamination, op5_minhash_near_dedup, op6_chat_formatting, op7_quality_classifier,
    op8_nearest_neighbours, op9_best_fit_packing, op10_toxicity, op11_spelling_variants, op12_bpe_round_trip, op13_cross_tokenizer,
]
QUERIES = {f.__name__: f for f in _ALL}
__all__ = ["QUERIES", "SQL"]
