"""End-to-end jobs over the partitioned layout (T5).

One Spark job per stage over the whole partitioned table: there is no loop
over datasets or splits (the reference tokenises one dataset at a time to
bound memory; here partitions bound it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from corpusprep.operators import stats, tokenise
from corpusprep.profiles import get_profile
from corpusprep.sources import io


def tokenize_all(spark: SparkSession, in_root: str, out_root: str, vocab: DataFrame,
                 names: str | Sequence[str] = "all", mode: str = "pre_training",
                 profile: str = "post_training_v1", splits: Sequence[str] = io.SPLITS) -> DataFrame:
    """T5: read every chosen dataset x split (S1) -> tokenise per mode
    (T2/T3/T4) -> write the tokenised table (K1) -> token statistics with the
    grand total (A2), computed from the written table."""
    p = get_profile(profile)
    p.check_mode(mode)
    src = io.read_splits(spark, in_root, names, splits)
    lk = tokenise.make_lookup(vocab)
    if mode == "pre_training":
        tok = tokenise.tokenize_pretrain(src, lk)
    elif mode == "post_training_sft":
        tok = tokenise.tokenize_sft(src, lk, p.specials)
    else:
        tok = tokenise.tokenize_preference(src, lk, p.specials)
    io.write_splits(tok, out_root)
    return stats.token_stats_total(io.read_splits(spark, out_root, names, splits))
