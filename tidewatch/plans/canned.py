"""Ready-made questions on the reports and the labelled transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import PATTERN_FLAGS, RULE_FLAGS, STR_FLAGS, Config
from tidewatch.functions.columns import ratio
from tidewatch.operators import str_flags as S
from tidewatch.operators.attach import attach
from tidewatch.operators.labels import label_received
from tidewatch.operators.profiles import identifiers, pairs
from tidewatch.sources.storage import materialize


def users_in_group(report: DataFrame, group: str) -> DataFrame:
    """Users carrying a group, alone or combined with others."""
    return report.where(F.array_contains(F.split("user_group", r"\|"), group)).select(
        "user_id", "user_group", "ml_score", "total_flagged_tx"
    )


def top_receivers(report: DataFrame, n: int = 10) -> DataFrame:
    return (
        report.orderBy(F.col("total_recv_amount").desc(), "user_id")
        .limit(n)
        .select("user_id", "total_recv_amount")
    )


def top_senders(labeled: DataFrame, n: int = 10) -> DataFrame:
    return (
        labeled.groupBy("userid")
        .agg(F.sum("amount").alias("total_sent"))
        .orderBy(F.col("total_sent").desc_nulls_last(), "userid")
        .limit(n)
    )


def risky_gamblers(report: DataFrame, above: float, n: int = 50) -> DataFrame:
    return (
        report.where((F.col("ml_score") > above) & (F.col("gambler_tx_count") > 0))
        .orderBy(F.col("ml_score").desc(), "user_id")
        .limit(n)
        .select("user_id", "ml_score", "gambler_tx_count")
    )


def flagged_by_day(labeled: DataFrame) -> DataFrame:
    return (
        labeled.where(F.col("hit_any_rule") == 1)
        .groupBy("dt")
        .agg(F.count(F.lit(1)).alias("transfers"), F.sum("amount").alias("amount"))
    )


def flagged_with_users(
    report: DataFrame, labeled: DataFrame, cfg: Config, side: str = "userid"
) -> DataFrame:
    """Every flagged transfer next to its sender's (or receiver's) group and score."""
    weight = "sent_rows" if side == "userid" else "recv_rows"
    users = report.select(
        F.col("user_id").alias(side), "user_group", F.col("ml_score").alias("user_score"), weight
    )
    rows = labeled.where(F.col("hit_any_rule") == 1)
    return attach(rows, users, side, weight, cfg).drop(weight).where(F.col(side).isNotNull())


def _both_sides(sent: DataFrame, received: DataFrame, *flags: Column) -> DataFrame:
    ratios = {"bet_tail": "is_bet_tail", "win_desc": "desc_has_win"}

    def side(other: str, prefix: str, partners: str, total: str) -> list:
        return [
            F.count(F.lit(1)).alias(f"{prefix}_tx_count"),
            F.count_distinct(other).alias(partners),
            F.sum("amount").alias(total),
            F.avg("amount").alias(f"{prefix}_avg_amount"),
            F.max("amount").alias(f"{prefix}_max_amount"),
            *[F.avg(c).alias(f"{prefix}_{n}_ratio") for n, c in ratios.items()],
        ]

    # one row each
    return sent.agg(*side("appuser", "sender", "sender_unique_receivers", "sender_total_sent"), *flags).crossJoin(
        received.agg(
            *side("userid", "recv", "recv_unique_senders", "recv_total_received"),
            F.max("is_bookie_tx").alias("is_bookie"),
            F.max("is_gambler_tx").alias("is_gambler"),
            F.max("hit_any_rule").alias("hit_any_rule"),
        )
    )


def profile_of(labeled: DataFrame, user: str) -> DataFrame:
    """One user seen as sender and as receiver, in one row."""
    sent, received = labeled.where(F.col("userid") == user), labeled.where(F.col("appuser") == user)
    return _both_sides(sent, received, *[F.max(c).alias(c) for c in STR_FLAGS])


def profile_of_unlabeled(flagged: DataFrame, user: str, cfg: Config) -> DataFrame:
    """The same from transfers that have pattern flags only; nobody else's transfers are labelled.

    Only the transfers from and to the user are stored.  What the flags need of the others is
    whether they use one of the user's addresses or devices; these are read as distinct values.
    """
    is_sender, is_receiver = F.col("userid").eqNullSafe(user), F.col("appuser").eqNullSafe(user)
    own = materialize(flagged.where(is_sender | is_receiver), "transfers-of-user")
    sent, received = own.where(is_sender), own.where(is_receiver)
    used = identifiers(sent).select("kind", "value")
    others = identifiers(flagged.where(~is_sender)).select("kind", "value").distinct()
    marks = [
        S.smurf_users(own, cfg).where(is_sender).agg(F.count(F.lit(1)).cast("byte").alias("str_smurfing")),
        S.rapid_users(sent, cfg).agg(F.count(F.lit(1)).cast("byte").alias("str_rapid_tx")),
    ]
    flags = S.identifier_flags_of(used, others, cfg)
    for mark in marks:
        flags = flags.crossJoin(mark)  # one row each
    none_sent = F.col("sender_tx_count") == 0
    labeled = label_received(received, sent, pairs(received), cfg)
    both = _both_sides(sent, labeled).crossJoin(flags)
    return both.withColumns({c: F.when(~none_sent, F.col(c)) for c in STR_FLAGS})


def user_assessment(report: DataFrame) -> DataFrame:
    """The score to judge a user by: as receiver if normal, else as sender."""
    normal = F.col("user_group") == "normal"
    return report.select(
        "user_id",
        "user_group",
        F.when(normal, F.col("ml_r")).otherwise(F.col("ml_s")).alias("score"),
        F.when(normal, "receiver").otherwise("sender").alias("judged_as"),
    )


def foreign_transfers(located: DataFrame, home: str = "VN") -> DataFrame:
    """Transfers per country other than ``home``; '' stands for an unknown address."""
    return (
        located.where(F.col("iploc") != home)
        .groupBy("iploc")
        .agg(F.count(F.lit(1)).alias("transfers"))
    )


def bet_tail_share(labeled: DataFrame) -> DataFrame:
    return labeled.agg(ratio(F.sum("is_bet_tail"), F.count("is_bet_tail")).alias("share"))


def transfers_per_flag(labeled: DataFrame) -> DataFrame:
    names = [*PATTERN_FLAGS, *RULE_FLAGS, "hit_any_rule"]
    totals = labeled.agg(*[F.count_if(F.col(c) == 1).alias(c) for c in names])
    return totals.unpivot([], names, "flag", "transfers")


def group_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("user_group").agg(F.count(F.lit(1)).alias("users"))
