"""Preference formatting: one prompt for the shared turns, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|{role}|>\n", "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns`` (role, text) in order; rows without conv_id belong to none."""
    ordered = F.sort_array(F.collect_list(F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(ordered.alias("all")).select(
        "conv_id", F.transform("all", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def rendered(turns: Column) -> Column:
    """Turns with their role marks as one text."""
    return F.array_join(F.transform(
        turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END))), "")


def shared_turns(a: Column, b: Column) -> Column:
    """How many first turns are the same."""
    places = F.sequence(F.lit(1), F.least(F.size(a), F.size(b)))
    differ = F.filter(places, lambda i: F.element_at(a, i) != F.element_at(b, i))
    some = F.least(F.size(a), F.size(b)) > 0
    return F.when(some, F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, F.least(F.size(a), F.size(b)))).otherwise(0)


def trained(turns: Column) -> Column:
    """Character spans ``(from, to)`` of a completion that count in the loss: the texts of
    assistant turns with their end mark, but no role marks and no other role's turns."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(t["role"]) + F.lit(len("<||>\n"))
        end = begin + F.length(t["text"]) + F.lit(len(END))
        span = F.array(F.struct(begin.alias("from"), end.alias("to")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], span)).otherwise(
            s["spans"]).alias("spans"))
    return F.aggregate(turns, state, add, lambda s: s["spans"])


def preferences(pairs: DataFrame) -> DataFrame:
    """``pair_id, n_shared, prompt, chosen, rejected, chosen_spans, rejected_spans``.

    ``pairs`` has ``pair_id, chosen, rejected``, the last two arrays of (role, text).  The
    longest common turn prefix becomes the prompt, rendered once; what follows it on each
    side becomes the completions, masked by spans.  Equal conversations give two empty
    completions, conversations that differ at once an empty prompt.  Null sides count as
    without turns.  Row-wise: nothing is shuffled.
    """
    turns = "array<struct<role:string,text:string>>"
    sides = pairs.select(
        "pair_id", *[F.coalesce(F.col(c).cast(turns), F.array().cast(turns)).alias(c) for c in ("chosen", "rejected")])
    cut = sides.withColumn("n_shared", shared_turns(F.col("chosen"), F.col("rejected")))
    rest = {c: F.slice(F.col(c), F.col("n_shared") + 1, F.greatest(F.size(c), F.lit(1))) for c in ("chosen", "rejected")}
    parts = cut.select(
        "pair_id", "n_shared", F.slice("chosen", F.lit(1), F.col("n_shared")).alias("first"),
        rest["chosen"].alias("chosen"), rest["rejected"].alias("rejected"))
    return parts.select(
        "pair_id", "n_shared", rendered(F.col("first")).alias("prompt"), rendered(F.col("chosen")).alias("chosen"),
        rendered(F.col("rejected")).alias("rejected"), trained(F.col("chosen")).alias("chosen_spans"),
        trained(F.col("rejected")).alias("rejected_spans"))


def earlier_answer_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations: the conversation up to its last assistant turn, and
    the same with that answer replaced by the assistant's answer before it (an answer to
    another question).  Conversations with fewer than two answers have no rejected answer:
    theirs stops before the last turn, so that every conversation gives a pair."""
    held = conversations(turns)
    places = F.filter(
        F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant")
    marked = held.withColumn("places", places)
    last, before = F.try_element_at("places", F.lit(-1)), F.try_element_at("places", F.lit(-2))
    end = F.coalesce(last, F.size("turns"))
    chosen = F.slice("turns", F.lit(1), end)
    other = F.when(before.isNotNull(), F.array(F.get("turns", before - 1)))
    rejected = F.concat(F.slice("turns", F.lit(1), end - 1), F.coalesce(other, F.slice("turns", F.lit(1), F.lit(0))))
    return marked.select(F.col("conv_id").alias("pair_id"), chosen.alias("chosen"), rejected.alias("rejected"))
