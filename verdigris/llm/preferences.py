"""Preference formatting, with DataFrame operations only: the longest common turn prefix of a chosen and a rejected conversation becomes the prompt, what follows becomes two completions with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHOSEN, REJECTED = 0, 1
TRAINED_ROLE = "assistant"


def head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t))), "")


def mask(turns: Column) -> Column:
    """The spans start-end (code points of the completion, end exclusive) that count in training: the trained role's texts with their end marks."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.char_length(head(t))
        end = begin + F.char_length(body(t))
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, empty, step)["spans"], ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair of the rows (pair_id, side, turn, role, text); side is CHOSEN or REJECTED.

    Columns: pair_id, n_prefix (common turns), prompt, chosen, rejected, chosen_mask, rejected_mask. Turns go by number (null first), those of one number by role, then text. Null roles and texts count as empty. Turns are common while role and text are equal. A pair that lacks a side has n_prefix 0, an empty prompt, and null for that side; equal conversations leave empty completions. Repeated rows are turns of their own. An empty table gives no rows. Rows of a pair come together in one row, as the result asks; nothing else is grouped.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = turns.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("side") == CHOSEN, turn))).alias("c"), F.sort_array(F.collect_list(F.when(F.col("side") == REJECTED, turn))).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    same = lambda i: (F.get("c", i)["role"] == F.get("r", i)["role"]) & (F.get("c", i)["text"] == F.get("r", i)["text"])
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    pairs = pairs.withColumn("n_prefix", F.aggregate(places, F.lit(0), lambda n, i: F.when((n == i) & same(i), n + 1).otherwise(n)))
    tail = lambda side: F.slice(side, F.col("n_prefix") + 1, F.size(side))
    of = lambda side, x: F.when(F.size(side) > 0, x)
    return pairs.select(
        "pair_id",
        "n_prefix",
        rendered(F.slice("c", F.lit(1), F.col("n_prefix"))).alias("prompt"),
        of("c", rendered(tail("c"))).alias("chosen"),
        of("r", rendered(tail("r"))).alias("rejected"),
        of("c", mask(tail("c"))).alias("chosen_mask"),
        of("r", mask(tail("r"))).alias("rejected_mask"),
    )


def paired_conversations(conversations: DataFrame) -> DataFrame:
    """Pairs from a table without preferences: of conversations 2k and 2k + 1 the first is chosen, the second rejected. Rows without conv_id belong to no conversation and are left out."""
    return conversations.where("conv_id is not null").select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.pmod(F.col("conv_id"), F.lit(2)).cast("int").alias("side"), "turn", "role", "text")
