"""Sender and receiver profiles.

Distinct partners and addresses are counted from tables of distinct pairs, in
which NULL is a value like any other.  The pairs join the plain sums in one
grouping per side, so nobody's transfers are ever gathered: a user with a third
of all transfers arrives as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import PATTERN_FLAGS, RECEIVER_FEATURES, SENDER_FEATURES, Config
from tidewatch.functions.columns import sum0
from tidewatch.operators.attach import attach


def pairs(txn: DataFrame) -> DataFrame:
    """Distinct (userid, appuser): the edges of the transfer graph."""
    return txn.select("userid", "appuser").distinct()


def identifiers(etl: DataFrame) -> DataFrame:
    """Distinct (userid, kind, value) over IP addresses and device ids."""
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"))
            for kind, c in (("ip", "userip"), ("device", "deviceid"))
        ]
    )
    return (
        etl.select("userid", F.explode(kinds).alias("i"))
        .select("userid", "i.kind", "i.value")
        .distinct()
    )


def fold(rows: DataFrame, key: str, counted: dict[str, DataFrame], *measures: Column) -> DataFrame:
    """``measures`` of ``rows`` per ``key``, and how often each key occurs in ``counted``."""
    both = rows.withColumn("_of", F.lit(""))
    for name, table in counted.items():
        tagged = table.select(key, F.lit(name).alias("_of"))
        both = both.unionByName(tagged, allowMissingColumns=True)
    return both.groupBy(key).agg(
        F.count_if(F.col("_of") == "").alias("n"),
        *measures,
        *[F.count_if(F.col("_of") == name).alias(name) for name in counted],
    )


def _measures(side: str, total: str) -> list[Column]:
    return [
        F.count("amount").alias(f"{side}_tx_count"),
        sum0("amount").alias(total),
        F.avg("amount").alias(f"{side}_avg_amount"),
        F.max("amount").alias(f"{side}_max_amount"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias(f"{side}_std_amount"),
        F.avg("is_bet_tail").alias(f"{side}_bet_tail_ratio"),
        F.avg("desc_has_win").alias(f"{side}_win_desc_ratio"),
        F.avg("desc_match_b1").alias(f"{side}_b1_ratio"),
        F.avg("desc_match_b2").alias(f"{side}_b2_ratio"),
    ]


def sender_profile(flagged: DataFrame, pair: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per sender: eleven measures and ``sender_rows``."""
    counted = {
        "sender_unique_receivers": pair,
        "sender_unique_ips": ids.where(F.col("kind") == "ip"),
    }
    rows = flagged.select("userid", "amount", *PATTERN_FLAGS)
    return fold(rows, "userid", counted, *_measures("sender", "sender_total_sent")).select(
        "userid", *SENDER_FEATURES, F.col("n").alias("sender_rows")
    )


def receiver_profile(flagged: DataFrame, pair: DataFrame) -> DataFrame:
    """One row per receiver: ten measures and ``recv_rows``."""
    rows = flagged.select("appuser", "amount", *PATTERN_FLAGS)
    measures = _measures("recv", "recv_total_received")
    return fold(rows, "appuser", {"recv_unique_senders": pair}, *measures).select(
        "appuser", *RECEIVER_FEATURES, F.col("n").alias("recv_rows")
    )


def flow_ratio() -> Column:
    """Receiver's share of the two parties' transfers in a row."""
    recv, sent = F.col("recv_tx_count"), F.col("sender_tx_count")
    return recv / (sent + recv + 1)


def add_profiles(
    flagged: DataFrame, senders: DataFrame, receivers: DataFrame, cfg: Config
) -> DataFrame:
    """Attach both profiles to each transfer and derive the flow ratio."""
    with_sender = attach(flagged, senders, "userid", "sender_rows", cfg).drop("sender_rows")
    with_both = attach(with_sender, receivers, "appuser", "recv_rows", cfg).drop("recv_rows")
    return with_both.withColumn("recv_send_tx_ratio", flow_ratio())
