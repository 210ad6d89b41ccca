"""Amount and description patterns of single transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import PATTERN_B1, PATTERN_B2, PATTERN_FLAGS, WIN_PATTERN, Config

#: A word that every match of a pattern holds; finding it costs far less than the pattern.
_HOLDS = {WIN_PATTERN: "win", PATTERN_B1: "chuyen", PATTERN_B2: "chuyen"}


def _matches(text: Column, pattern: str) -> Column:
    word = _HOLDS.get(pattern)
    return text.rlike(pattern) if word is None else text.contains(word) & text.rlike(pattern)


def add_patterns(etl: DataFrame, cfg: Config) -> DataFrame:
    """Numeric amount, its last three digits and the four 0/1 pattern flags."""
    tail = F.pmod("amount", F.lit(1000))
    desc = F.col("desc_clean")
    plain = ~desc.contains(cfg.excluded_phrase)
    return (
        etl.withColumn("amount", F.col("amount").try_cast("bigint"))
        .withColumns(
            {
                "amount_tail3": tail.cast("short"),
                "is_bet_tail": tail.isin(*cfg.bet_tails).cast("byte"),
                "desc_has_win": _matches(desc, cfg.win_pattern).cast("byte"),
                "desc_match_b1": (_matches(desc, cfg.pattern_b1) & plain).cast("byte"),
                "desc_match_b2": (_matches(desc, cfg.pattern_b2) & plain).cast("byte"),
            }
        )
        .drop("desc_clean")
    )


def flag_summary(flagged: DataFrame) -> DataFrame:
    """One row per pattern flag with the number of transfers that carry it."""
    totals = flagged.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in PATTERN_FLAGS])
    return totals.unpivot([], list(PATTERN_FLAGS), "flag", "transfers")
