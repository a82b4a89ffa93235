"""Preference formatting: a chosen and a rejected conversation as one prompt and two completions.

The prompt is the longest common prefix of turns, rendered once; what follows in either conversation is
its completion.  A mask gives the character ranges [start, end) of a completion that are learned: the
text of assistant turns with its closing mark.  DataFrame functions only, and one shuffle.

Defined cases: a null text is empty and a null role is ``unknown``; turns are in order of ``turn``,
then role and text, null first, and a repeated row of a conversation counts once; rows with a null
pair id or side are left out; a side without turns, or with no turns left, has an empty completion
and mask; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEARNED_ROLE = "assistant"


def rendered(turn):
    """One turn as text."""
    return F.concat(F.lit("<|"), turn.role, F.lit("|>\n"), turn.text, F.lit("<|end|>\n"))


def _mask(turns):
    """Ranges of learned characters, as ``start-end`` joined by commas."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state, turn):
        begin = state.at + F.length(turn.role) + 5  # the role between its marks, and a line end
        end = begin + F.length(turn.text) + 7  # with the closing mark
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        spans = F.when(turn.role == LEARNED_ROLE, F.concat(state.spans, F.array(span))).otherwise(state.spans)
        return F.struct((end + 1).cast("int").alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step, lambda s: s.spans), ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """``turns``: pair_id, chosen (boolean), turn, role, text.  Per pair: pair_id, n_prompt_turns, prompt,
    chosen, chosen_mask, rejected, rejected_mask."""
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sides = turns.filter("pair_id is not null and chosen is not null").groupBy("pair_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("chosen"), turn))).alias("c"),
        F.array_sort(F.collect_set(F.when(~F.col("chosen"), turn))).alias("r"),
    )
    same = F.zip_with("c", "r", lambda a, b: (a.role == b.role) & (a.text == b.text))
    differs = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), F.lit(False)).cast("int")
    n = F.when(differs > 0, differs - 1).otherwise(F.size("c"))
    cut = sides.withColumn("n", n).select(
        "pair_id",
        "n",
        F.slice("c", F.lit(1), F.col("n")).alias("p"),
        F.slice("c", F.col("n") + 1, F.size("c")).alias("c"),
        F.slice("r", F.col("n") + 1, F.size("r")).alias("r"),
    )
    text = lambda c: F.array_join(F.transform(c, rendered), "")
    return cut.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        text("p").alias("prompt"),
        text("c").alias("chosen"),
        _mask(F.col("c")).alias("chosen_mask"),
        text("r").alias("rejected"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Conversation 2i as chosen and 2i + 1 as rejected of pair i."""
    conv = F.col("conv_id")
    return conversations.select(F.floor(conv / 2).cast("long").alias("pair_id"), (F.pmod(conv, F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")
