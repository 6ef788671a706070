"""Example formatting per tokenisation mode.

``format_example`` is the mode dispatch of the profiles: every mode is a pure
projection, so the whole dispatch stays one scan with no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions import text as tx

# Example formats; the tokenisation modes that use them go by their names too.
MODES = ("pre_training", "alpaca", "openassistant", "post_training_sft", "post_training_rl")


def select_text(df: DataFrame, keep: Sequence[str] = ("text",)) -> DataFrame:
    """Keep the text (and the given key columns); raw columns are dropped,
    so column pruning reaches the scan."""
    return df.select(*keep)


def format_example(df: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """P6, by mode:

    * ``pre_training``: text
    * ``alpaca`` / ``post_training_sft`` (instruction, input, output): prompt, completion
    * ``openassistant`` (context array<struct<role, text>>, accepted, rejected):
      the rendered turns + <MODEL> as prompts, accepted and rejected + </MODEL>
    * ``post_training_rl``: the same for rows whose prompts are rendered already"""
    keys = list(keys)
    if mode == "pre_training":
        return select_text(df, keys + ["text"])
    if mode in ("alpaca", "post_training_sft"):
        p, c = tx.format_instruction("instruction", "input", "output")
        return df.select(*keys, p.alias("prompt"), c.alias("completion"))
    if mode in ("openassistant", "post_training_rl"):
        prompts = F.col("prompts") if mode == "post_training_rl" else F.concat(
            F.array_join(F.transform("context", lambda t: tx.render_turn(t["role"], t["text"])), ""),
            F.lit(tx.MODEL_OPEN))
        return df.select(*keys, prompts.alias("prompts"), tx.close_model("accepted").alias("accepted"),
                         tx.close_model("rejected").alias("rejected"))
    raise ValueError(f"no example format for mode {mode!r} (known: {', '.join(MODES)})")
