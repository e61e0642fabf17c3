"""Preference pairs from conversations. DataFrame operations only.

The chosen and the rejected conversation of a pair share their first turns; these are rendered once, as the prompt.  What
follows is rendered for each side as its completion, with the spans of characters a model is to learn: the assistant's turns and
their end marks. All else in a completion (headers, other roles) is masked.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import pick

START, END = "<|im_start|>", "<|im_end|>"
SPANS = "array<struct<first:bigint,last:bigint>>"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    """Turns as text: a header, the text and an end mark each."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t), F.lit("\n"))), "")


def learned_spans(turns: Column, learner: str) -> Column:
    """Spans of characters [first, last) of the rendered turns that are the learner's words and end marks."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(s, t):
        first = s["at"] + F.length(_header(t))
        last = first + F.length(_body(t))
        span = F.array(F.struct(first.alias("first"), last.alias("last")))
        return F.struct((last + 1).alias("at"), F.when(t["role"] == learner, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, state, step, lambda s: s["spans"])


def shared_turns(a: Column, b: Column) -> Column:
    """How many first turns agree in role and text."""
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same).cast("bigint"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as one value: the text it makes is one value too."""
    plain = pick(turns, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    turn = F.struct(F.coalesce(F.col("turn").cast("bigint"), F.lit(2**63 - 1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def format_preferences(turns: DataFrame, pairs: DataFrame, learner: str = "assistant") -> DataFrame:
    """(pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans) of each row of ``pairs`` (pair_id, chosen_id, rejected_id).

    The prompt has the longest common prefix of turns (role and text), maybe none; a conversation that is all of the prompt has an empty completion, and so has
    one that is null or not there. Null roles and texts are empty; turns without number come last; turns of one number are ordered by role and text;
    turns without conversation belong to none; repeated pairs are formatted each; empty tables give empty results.
    """
    told = conversations(turns)
    pairs = pick(pairs, "pair_id", "chosen_id", "rejected_id")
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    both = pairs.join(told.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a")), "chosen_id", "left").join(told.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b")), "rejected_id", "left")
    both = both.select("pair_id", "chosen_id", "rejected_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    both = both.withColumn("n", shared_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n").cast("int") + 1, F.greatest(F.size(c), F.lit(1)))
    both = both.select("pair_id", "chosen_id", "rejected_id", "n", F.when(F.col("n") > 0, F.slice("a", F.lit(1), F.col("n").cast("int"))).otherwise(none).alias("p"), rest(F.col("a")).alias("a"), rest(F.col("b")).alias("b"))
    return both.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"),
        render(F.col("a")).alias("chosen"), learned_spans(F.col("a"), learner).alias("chosen_spans"),
        render(F.col("b")).alias("rejected"), learned_spans(F.col("b"), learner).alias("rejected_spans"),
    )
