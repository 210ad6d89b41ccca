"""Rule labels: weighted bookie score per user, flags per transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import RULE_FLAGS, Config
from tidewatch.functions.columns import ratio
from tidewatch.operators.attach import attach
from tidewatch.operators.profiles import add_profiles, fold


def _weighted(condition: Column, weight: float) -> Column:
    return condition.cast("double") * F.lit(float(weight))


def received_stats(flagged: DataFrame, pair: DataFrame) -> DataFrame:
    """What the score needs of a receiver."""
    rows = flagged.select("appuser", "amount", "is_bet_tail")
    measures = [F.count("amount").alias("recv_tx"), F.avg("is_bet_tail").alias("recv_bet_tail")]
    return fold(rows, "appuser", {"recv_src": pair}, *measures).withColumnRenamed("n", "recv_rows")


def sent_stats(flagged: DataFrame) -> DataFrame:
    """What the score needs of a sender."""
    return flagged.groupBy("userid").agg(
        F.count("amount").alias("send_tx"),
        F.avg("desc_has_win").alias("send_win_desc"),
        F.avg(1 - F.col("is_bet_tail")).alias("non_bet_tail_ratio"),
    )


def bookie_scores(received: DataFrame, sent: DataFrame, cfg: Config) -> DataFrame:
    """One row per receiver with the weighted score of the four conditions."""
    win_not_bet = (F.col("send_win_desc") > cfg.bookie_win_desc) & (
        F.col("non_bet_tail_ratio") > cfg.bookie_non_bet
    )
    score = (
        _weighted(F.col("recv_src") >= cfg.bookie_min_senders, cfg.weight_senders)
        + _weighted(F.col("recv_send_ratio") > cfg.bookie_flow_ratio, cfg.weight_flow_ratio)
        + _weighted(F.col("recv_bet_tail") > cfg.bookie_bet_tail, cfg.weight_bet_tail)
        + _weighted(win_not_bet, cfg.weight_win_non_bet)
    )
    return (
        received.join(sent.withColumnRenamed("userid", "appuser"), "appuser", "left")
        .fillna({"send_tx": 0, "send_win_desc": 0.0, "non_bet_tail_ratio": 0.0})
        .withColumn("recv_send_ratio", F.col("recv_tx") / (F.col("send_tx") + 1))
        .withColumn("bookie_score", score)
    )


def bookies(scores: DataFrame, cfg: Config) -> DataFrame:
    """Receivers whose score reaches the limit."""
    return scores.where(F.col("bookie_score") >= cfg.bookie_min_score)


def _is_bookie(cfg: Config) -> Column:
    reached = F.coalesce(F.col("bookie_score") >= cfg.bookie_min_score, F.lit(False))
    return reached.alias("is_bookie")


def _with_rules(rows: DataFrame) -> DataFrame:
    """Rule flags of transfers whose receiver carries ``is_bookie``, which is dropped."""
    bookie = F.col("is_bookie")
    flags = {
        "is_bookie_tx": bookie.cast("byte"),
        "is_gambler_tx": (bookie & (F.col("is_bet_tail") == 1)).cast("byte"),
    }
    for side in ("recipient", "depositor"):
        for kind in ("1", "2"):
            flags[f"is_{side}{kind}_tx"] = F.col(f"desc_match_b{kind}")
    return (
        rows.withColumns({name: flags[name] for name in RULE_FLAGS})
        .withColumn("hit_any_rule", F.greatest(*RULE_FLAGS))
        .drop("is_bookie")
    )


def rule_labels(flagged: DataFrame, pair: DataFrame, cfg: Config) -> DataFrame:
    """Rule labels alone, without profiles: one join with the receivers."""
    scores = bookie_scores(received_stats(flagged, pair), sent_stats(flagged), cfg)
    receivers = scores.select("appuser", "recv_rows", _is_bookie(cfg))
    return _with_rules(attach(flagged, receivers, "appuser", "recv_rows", cfg).drop("recv_rows"))


def label_received(received: DataFrame, sent: DataFrame, pair: DataFrame, cfg: Config) -> DataFrame:
    """Rule labels of the transfers to one user, from those transfers and the ones that the user sent.

    ``pair`` has the user's distinct senders.
    """
    scores = bookie_scores(received_stats(received, pair), sent_stats(sent), cfg).select("appuser", _is_bookie(cfg))
    # a single user, so a single row
    return _with_rules(received.join(F.broadcast(scores), "appuser"))


def scores_from_profiles(senders: DataFrame, receivers: DataFrame, cfg: Config) -> DataFrame:
    """The bookie score from profiles that exist already; the transfers are not read again."""
    received = receivers.select(
        "appuser",
        F.col("recv_tx_count").alias("recv_tx"),
        F.col("recv_unique_senders").alias("recv_src"),
        F.col("recv_bet_tail_ratio").alias("recv_bet_tail"),
    )
    sent = senders.select(
        "userid",
        F.col("sender_tx_count").alias("send_tx"),
        F.col("sender_win_desc_ratio").alias("send_win_desc"),
        (1 - F.col("sender_bet_tail_ratio")).alias("non_bet_tail_ratio"),
    )
    return bookie_scores(received, sent, cfg)


def label_transfers(
    flagged: DataFrame, senders: DataFrame, receivers: DataFrame, str_flags: DataFrame, cfg: Config
) -> DataFrame:
    """Profiles, suspicious-activity flags and rule labels on every transfer.

    Everything known about a user is put into one sender row and one receiver
    row first, so the transfers themselves are joined exactly twice.
    """
    marks = scores_from_profiles(senders, receivers, cfg).select("appuser", _is_bookie(cfg))
    rows = add_profiles(
        flagged,
        senders.join(str_flags, "userid", "left"),
        receivers.join(marks, "appuser", "left"),
        cfg,
    )
    return _with_rules(rows)


def label_summary(labeled: DataFrame) -> DataFrame:
    """Totals per rule, share of transfers, and the transfers no rule hits."""
    n = F.count(F.lit(1))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*RULE_FLAGS, "hit_any_rule")]
    totals = labeled.agg(n.alias("n"), *sums).withColumn(
        "non_rule", F.col("n") - F.col("hit_any_rule")
    )
    names = [*RULE_FLAGS, "hit_any_rule", "non_rule"]
    return totals.unpivot(["n"], names, "label", "transfers").select(
        "label", "transfers", (ratio("transfers", "n") * 100).alias("percent")
    )


def rule_user_counts(labeled: DataFrame) -> DataFrame:
    """Distinct bookies and gamblers with the transfers behind them."""

    def count(label: str, flag: str, user: str) -> DataFrame:
        return (
            labeled.where(F.col(flag) == 1)
            .groupBy(user)
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(
                F.count(F.lit(1)).alias("users"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("transfers"),
            )
            .select(F.lit(label).alias("label"), "users", "transfers")
        )

    return count("bookie", "is_bookie_tx", "appuser").unionByName(
        count("gambler", "is_gambler_tx", "userid")
    )
