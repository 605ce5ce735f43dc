"""Preference formatting of conversations, with DataFrame operations only.

A pair holds a chosen and a rejected conversation. Their longest common prefix of turns (equal role
and text) is rendered once as the prompt; the turns after it are the two completions. A completion's
mask says which characters are trained on: the text and end mark of assistant turns, "start-stop" in
characters of the completion. Turns of a conversation are gathered by one aggregation on its id; the
prompt is compared turn by turn, and no pair of conversations is formed but the given ones.

Defined cases: null role is rendered as "unknown", null text as empty; turns with equal numbers are
ordered by role, then text, and repeated rows are repeated turns; a null turn number comes first; rows
without conversation id belong to no pair; a pair of which one side has no rows has an empty prompt
and null for that side; equal conversations give empty completions; marks inside texts are broken up,
so a text cannot end its turn; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations_as_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns array<struct<role, text>> in order."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))
    body = F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    one = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), body.alias("text"))
    gathered = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["text"], F.lit(CLOSE + "\n"))), "")


def trained_spans(turns: str) -> Column:
    """"start-stop,..." of what is trained on in ``rendered(turns)``."""
    fixed = len(OPEN) + len(CLOSE) + 2
    return F.expr(
        f"""array_join(aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<string>)), (s, x) -> named_struct(
              'at', s.at + {fixed} + length(x.role) + length(x.text),
              'spans', if(x.role = 'assistant', array_append(s.spans, concat(s.at + {len(OPEN) + 1} + length(x.role), '-',
                          s.at + {len(OPEN) + len(CLOSE) + 1} + length(x.role) + length(x.text))), s.spans))).spans, ',')"""
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows (pair_id, turns) of both sides to pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    c = chosen.select("pair_id", F.col("turns").alias("c"))
    r = rejected.select("pair_id", F.col("turns").alias("r"))
    pairs = c.join(r, "pair_id", "full")
    differs = F.array_position(F.zip_with("c", "r", lambda x, y: x.eqNullSafe(y)), False)
    shorter = F.least(F.size("c"), F.size("r"))
    common = F.when(F.col("c").isNull() | F.col("r").isNull(), 0).when(differs > 0, (differs - 1).cast("int")).otherwise(shorter)
    p = pairs.withColumn("n", common)
    for side in "cr":
        p = p.withColumn(f"{side}_rest", F.when(F.size(side) > F.col("n"), F.slice(side, F.col("n") + 1, F.size(side) - F.col("n"))).when(F.col(side).isNotNull(), F.slice(side, 1, 0)))
    prompt = F.coalesce(rendered(F.slice("c", F.lit(1), F.col("n"))), F.lit(""))
    return p.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), prompt.alias("prompt"),
        rendered(F.col("c_rest")).alias("chosen"), trained_spans("c_rest").alias("chosen_mask"),
        rendered(F.col("r_rest")).alias("rejected"), trained_spans("r_rest").alias("rejected_mask"),
    )


def paired_by_id(turns: DataFrame, **columns) -> DataFrame:
    """Pairs of neighbouring conversation ids: 2k is the chosen one, 2k + 1 the rejected one, k the pair's id."""
    whole = conversations_as_turns(turns, **columns)
    side = whole.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("even"), "turns")
    return preference_pairs(side.where("even"), side.where("not even"))
