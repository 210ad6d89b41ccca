"""Suspicious-activity flags per sender.

No step orders or collects the transfers of one user: identifiers are counted
as distinct pairs, and the gaps between transfers come from fixed time slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import STR_FLAGS, Config
from tidewatch.operators.attach import attach


def identifier_flags(ids: DataFrame, cfg: Config) -> DataFrame:
    """``str_ip_change`` and ``str_device_share`` per user from (userid, kind, value)."""
    tagged = ids.withColumn("token", F.concat("kind", F.lit(":"), "value"))
    owners = (
        tagged.where(F.col("token").isNotNull())
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n_users"))
        .where(F.col("n_users") > 1)
    )

    def kinds(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    changed = F.greatest(kinds("ip"), kinds("device")) >= cfg.str_change_min
    return (
        attach(tagged, owners, "token", "n_users", cfg)
        .groupBy("userid")
        .agg(
            changed.cast("byte").alias("str_ip_change"),
            F.max(F.col("n_users").isNotNull()).cast("byte").alias("str_device_share"),
        )
    )


def identifier_flags_of(own: DataFrame, others: DataFrame, cfg: Config) -> DataFrame:
    """The same two flags of one user, in one row without the user's name.

    ``own`` has the user's distinct (kind, value), ``others`` those of everybody else.
    """
    shared = own.join(others.select("kind", "value", F.lit(True).alias("shared")), ["kind", "value"], "left")
    counts = [F.count_if(F.col("kind") == kind) for kind in ("ip", "device")]
    return shared.agg(
        (F.greatest(*counts) >= cfg.str_change_min).cast("byte").alias("str_ip_change"),
        F.coalesce(F.max("shared"), F.lit(False)).cast("byte").alias("str_device_share"),
    )


def smurf_in_days(txn: DataFrame, cfg: Config) -> DataFrame:
    """Receiver days with more than ``smurf_senders`` distinct small-amount senders."""
    return (
        txn.where((F.col("amount") < cfg.smurf_in_amount) & F.col("dt").isNotNull())
        .select("appuser", "dt", "userid")
        .distinct()
        .groupBy("appuser", "dt")
        .agg(F.count(F.lit(1)).alias("senders"))
        .where(F.col("senders") > cfg.smurf_senders)
    )


def big_send_days(txn: DataFrame, cfg: Config) -> DataFrame:
    """Sender days with at least one large transfer."""
    return (
        txn.where((F.col("amount") > cfg.smurf_out_amount) & F.col("dt").isNotNull())
        .select("userid", "dt")
        .distinct()
    )


def smurf_users(txn: DataFrame, cfg: Config) -> DataFrame:
    """Users with a smurf-in day that is also a big-send day."""
    days_in = smurf_in_days(txn, cfg).select(F.col("appuser").alias("userid"), "dt")
    return days_in.join(big_send_days(txn, cfg), ["userid", "dt"]).select("userid").distinct()


def rapid_slot(cfg: Config) -> Column:
    """Slot of the day, as wide as the gap limit."""
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return F.floor(second / cfg.rapid_seconds).cast("int")


def rapid_slots(txn: DataFrame, cfg: Config) -> DataFrame:
    """Transfers per (userid, dt, slot) with the first and last time."""
    return (
        txn.where(F.col("ts").isNotNull())
        .groupBy("userid", "dt", rapid_slot(cfg).alias("slot"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )


def rapid_pairs(slots: DataFrame, cfg: Config) -> DataFrame:
    """Consecutive transfers closer than the limit, per (userid, dt).

    A slot is no wider than the limit, so all its ``n - 1`` neighbours are close
    enough; between slots only the last and the first transfer meet.  A user
    day has at most ``86400 / rapid_seconds`` slots, however many transfers.
    """
    day = Window.partitionBy("userid", "dt").orderBy("slot")
    gap = F.col("first_ts") - F.lag("last_ts").over(day)
    limit = F.make_dt_interval(secs=F.lit(cfg.rapid_seconds))
    crossing = F.when(gap < limit, 1).otherwise(0)
    return (
        slots.withColumn("crossing", crossing)
        .groupBy("userid", "dt")
        .agg(F.sum(F.col("n") - 1 + F.col("crossing")).alias("pairs"))
    )


def rapid_users(txn: DataFrame, cfg: Config) -> DataFrame:
    return (
        rapid_pairs(rapid_slots(txn, cfg), cfg)
        .where(F.col("pairs") >= cfg.rapid_min_pairs)
        .select("userid")
        .distinct()
    )


def user_flags(txn: DataFrame, ids: DataFrame, cfg: Config) -> DataFrame:
    """All four flags, one row per distinct sender (a NULL sender included)."""
    smurfs = smurf_users(txn, cfg).withColumn("str_smurfing", F.lit(1).cast("byte"))
    rapid = rapid_users(txn, cfg).withColumn("str_rapid_tx", F.lit(1).cast("byte"))
    return (
        identifier_flags(ids, cfg)
        .join(smurfs, "userid", "left")
        .join(rapid, "userid", "left")
        .select(
            "userid",
            *[F.coalesce(c, F.lit(0).cast("byte")).alias(c) for c in STR_FLAGS],
        )
    )


def str_summary(labeled: DataFrame) -> DataFrame:
    """Flagged users and their transfers for each flag."""
    per_user = labeled.groupBy("userid").agg(
        *[F.max(c).alias(c) for c in STR_FLAGS],
        *[F.sum(c).alias(f"n_{c}") for c in STR_FLAGS],
    )
    return (
        per_user.select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("flag"),
                            (F.col(c) == 1).alias("hit"),
                            F.col(f"n_{c}").alias("n"),
                        )
                        for c in STR_FLAGS
                    ]
                )
            ).alias("f")
        )
        .groupBy("f.flag")
        .agg(
            F.count_if("f.hit").alias("users"),
            F.coalesce(F.sum("f.n"), F.lit(0)).alias("transfers"),
        )
    )
