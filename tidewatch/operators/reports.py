"""Per-user report, flagged transfers and the bookie report.

Each side of a user is one grouping of the scored transfers; the bookie report
is a selection of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Config
from tidewatch.functions.columns import ratio, sum0
from tidewatch.operators.profiles import fold

# Group names in the fixed order in which a user's groups are listed, with the
# flag that puts a user there and the side of the transfer the user is on.
GROUPS = {
    "bookie": ("is_bookie_tx", "recv"),
    "gambler": ("is_gambler_tx", "sent"),
    "recipient1": ("is_recipient1_tx", "recv"),
    "depositor1": ("is_depositor1_tx", "sent"),
    "recipient2": ("is_recipient2_tx", "recv"),
    "depositor2": ("is_depositor2_tx", "sent"),
}
GROUP_COUNTS = {g: f"{g}_tx_count" for g in GROUPS}
REPORT_COLUMNS = (
    "user_id",
    "user_group",
    "total_flagged_tx",
    "ml_score",
    *GROUP_COUNTS.values(),
    "total_sent_tx",
    "total_sent_amount",
    "unique_receivers",
    "total_recv_tx",
    "total_recv_amount",
    "unique_senders",
    "ml_s",
    "ml_r",
)
FLAGGED_COLUMNS = (
    "reqdate",
    "userid",
    "appuser",
    "amount",
    "desc_clean",
    "platform",
    "userip",
    "iploc",
    "is_bookie_tx",
    "is_gambler_tx",
    "is_recipient1_tx",
    "is_depositor1_tx",
    "is_recipient2_tx",
    "is_depositor2_tx",
    "hit_any_rule",
    "ml_score",
    "is_bet_tail",
    "amount_tail3",
    "desc_has_win",
    "desc_match_b1",
    "desc_match_b2",
)
# Users in exactly one of these groups stay out of the flagged-user report.
QUIET_GROUPS = ("normal", "depositor1", "depositor2", "gambler")


def _side(scored: DataFrame, pair: DataFrame, key: str, side: str) -> DataFrame:
    """One side of every user; a NULL id is listed but owns nothing."""
    partners, score = ("unique_receivers", "ml_s") if side == "sent" else ("unique_senders", "ml_r")
    flags = {GROUP_COUNTS[g]: flag for g, (flag, s) in GROUPS.items() if s == side}
    measures = [
        F.count("amount").alias(f"total_{side}_tx"),
        sum0("amount").alias(f"total_{side}_amount"),
        F.avg("ml_score").alias(score),
        *[F.count_if(F.col(flag) == 1).alias(name) for name, flag in flags.items()],
    ]
    rows = scored.select(key, "amount", "ml_score", *flags.values())
    folded = fold(rows, key, {partners: pair}, *measures).withColumnRenamed("n", f"{side}_rows")
    return folded.select(
        F.col(key).alias("user_id"),
        *[F.when(F.col(key).isNotNull(), F.col(c)).alias(c) for c in folded.columns if c != key],
    )


def user_report(scored: DataFrame, pair: DataFrame) -> DataFrame:
    """One row per id seen on either side, unsorted, with rows sent and received."""
    sent = _side(scored, pair, "userid", "sent")
    received = _side(scored, pair, "appuser", "recv")
    both = sent.unionByName(received, allowMissingColumns=True)
    totals = [c for c in both.columns if c not in ("user_id", "ml_s", "ml_r")]
    merged = both.groupBy("user_id").agg(
        *[sum0(c).alias(c) for c in totals],
        F.max("ml_s").alias("ml_s"),
        F.max("ml_r").alias("ml_r"),
    )
    scores = F.when(F.col("ml_s").isNotNull(), 1).otherwise(0) + F.when(
        F.col("ml_r").isNotNull(), 1
    ).otherwise(0)
    mean = ratio(F.coalesce("ml_s", F.lit(0.0)) + F.coalesce("ml_r", F.lit(0.0)), scores)
    names = [F.when(F.col(c) > 0, F.lit(g)) for g, c in GROUP_COUNTS.items()]
    flagged = sum((F.col(c) for c in GROUP_COUNTS.values()), F.lit(0))
    return (
        merged.withColumn("ml_score", F.coalesce(F.round(mean, 2), F.lit(0.0)))
        .withColumn("total_flagged_tx", flagged)
        .withColumn(
            "user_group",
            F.coalesce(F.nullif(F.concat_ws("|", *names), F.lit("")), F.lit("normal")),
        )
    )


def report_columns(report: DataFrame) -> DataFrame:
    return report.select(*REPORT_COLUMNS)


def ranked_users(report: DataFrame) -> DataFrame:
    """The published order: most flagged first, then by score."""
    return report_columns(report).orderBy(
        F.col("total_flagged_tx").desc(), F.col("ml_score").desc(), "user_id"
    )


def flagged_users(report: DataFrame) -> DataFrame:
    """Users worth a look: every combination of groups, but not the quiet ones alone."""
    return report_columns(report.where(~F.col("user_group").isin(*QUIET_GROUPS)))


def high_score_users(report: DataFrame, cfg: Config) -> DataFrame:
    """Normal users above the score limit, highest first."""
    normal = (F.col("user_group") == "normal") & (F.col("ml_score") > cfg.score_threshold)
    return report_columns(report.where(normal)).orderBy(F.col("ml_score").desc(), "user_id")


def flagged_transfers(scored: DataFrame) -> DataFrame:
    """Transfers a rule hits, with those of the wanted columns that exist."""
    return scored.where(F.col("hit_any_rule") == 1).select(
        *[c for c in FLAGGED_COLUMNS if c in scored.columns]
    )


def bookie_report(report: DataFrame) -> DataFrame:
    """Money in and out of every bookie; all of it is already in the user report."""
    return (
        report.where((F.col("bookie_tx_count") > 0) & F.col("user_id").isNotNull())
        .select(
            "user_id",
            F.col("recv_rows").alias("recv_tx_count"),
            F.col("unique_senders").alias("recv_unique_senders"),
            "total_recv_amount",
            F.col("sent_rows").alias("send_tx_count"),
            F.col("unique_receivers").alias("send_unique_receivers"),
            F.col("total_sent_amount").alias("total_send_amount"),
        )
        .withColumn(
            "recv_send_ratio",
            F.round(F.col("total_recv_amount") / (F.col("total_send_amount") + 1), 4),
        )
        .orderBy(F.col("total_recv_amount").desc(), "user_id")
    )
