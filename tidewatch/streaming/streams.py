"""Incremental forms of the batch operators.

State is kept per fixed key and time slot, never as a list of transfers, and
every sink can be replayed: file sinks commit once per batch, and slot rows
merge by count, minimum and maximum, whichever batch they came from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.config import Config
from tidewatch.operators.etl import add_time, clean_transfers
from tidewatch.operators.scoring import Model, score_fixed
from tidewatch.operators.str_flags import rapid_pairs, rapid_slot
from tidewatch.sources.tables import publish_batch
from tidewatch.streaming.audit import cleaning_metrics, observed

WATERMARK = "1 day"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of later streams on disk instead of in executor memory."""
    spark.conf.set(
        _STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )


def _append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_clean(
    raw: DataFrame, ranges: DataFrame, path: str, checkpoint: str, cfg: Config
) -> StreamingQuery:
    """Landing folder to cleaned transfers, each file once; batches report rows and unmatched addresses."""
    clean = add_time(clean_transfers(raw, ranges, cfg))
    return _append(observed(clean, "cleaning", **cleaning_metrics(clean)), path, checkpoint)


def stream_score(
    labeled: DataFrame, model: Model, path: str, checkpoint: str, keep: Sequence[str] | None = None
) -> StreamingQuery:
    """``keep`` columns (default all) with scores on the scale fixed at training."""
    return _append(score_fixed(labeled, model, keep), path, checkpoint)


def score_batch(batch: DataFrame, batch_id: int, model: Model, table: str, keep: Sequence[str] | None = None) -> None:
    """Publish one micro-batch's scores; a repeated batch changes nothing."""
    publish_batch(score_fixed(batch, model, keep), table, batch_id)


def stream_score_published(
    labeled: DataFrame, model: Model, table: str, checkpoint: str, keep: Sequence[str] | None = None
) -> StreamingQuery:
    """Scores into a table of batches, whose readers see whole batches only."""
    return (
        labeled.writeStream.foreachBatch(lambda batch, batch_id: score_batch(batch, batch_id, model, table, keep))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_closed_smurf_days(
    txn: DataFrame, path: str, checkpoint: str, cfg: Config, delay: str = WATERMARK
) -> StreamingQuery:
    """Smurf-in days (``appuser, dt, senders``), each written once: when the watermark closes the day.

    A day is closed when a transfer came whose time is later than its end by ``delay``.
    Senders of an open day are kept once; transfers of closed days are dropped and counted
    as late in the stream's progress.
    """
    # the wall clock of the transfers as an instant, whatever the session's time zone
    instant = F.timestamp_seconds(
        F.unix_date(F.col("ts").cast("date")) * 86_400 + F.hour("ts") * 3_600 + F.minute("ts") * 60 + F.second("ts")
    )
    seen = (
        txn.where((F.col("amount") < cfg.smurf_in_amount) & F.col("ts").isNotNull())
        .select("appuser", "userid", instant.alias("at"))
        .withWatermark("at", delay)
        .select("appuser", "userid", F.window("at", "1 day").alias("day"))
        .dropDuplicates(["appuser", "userid", "day"])
    )
    dt = F.date_from_unix_date((F.unix_seconds("day.start") / 86_400).cast("int"))
    days = (
        seen.groupBy("appuser", "day")
        .agg(F.count(F.lit(1)).alias("senders"))
        .where(F.col("senders") > cfg.smurf_senders)
        .select("appuser", dt.alias("dt"), "senders")
    )
    return _append(days, path, checkpoint)


def stream_small_senders(
    txn: DataFrame, path: str, checkpoint: str, cfg: Config, watermark: str = WATERMARK
) -> StreamingQuery:
    """First sight of every (receiver, day, sender) with a small amount.

    The distinct count of a receiver's day is exact, because repeated senders
    are dropped by state that the watermark clears.
    """
    small = (
        txn.where(F.col("amount") < cfg.smurf_in_amount)
        .where(F.col("dt").isNotNull())
        .select("appuser", "dt", "userid", F.col("dt").cast("timestamp").alias("day"))
        .withWatermark("day", watermark)
        .dropDuplicates(["appuser", "dt", "userid", "day"])
        .drop("day")
    )
    return _append(small, path, checkpoint)


def smurf_in_days_seen(spark: SparkSession, path: str, cfg: Config) -> DataFrame:
    """Receiver days over the limit among everything streamed so far."""
    return (
        spark.read.parquet(path)
        .groupBy("appuser", "dt")
        .agg(F.count(F.lit(1)).alias("senders"))
        .where(F.col("senders") > cfg.smurf_senders)
    )


def stream_rapid_slots(
    txn: DataFrame, path: str, checkpoint: str, cfg: Config, watermark: str = WATERMARK
) -> StreamingQuery:
    """Time slots per (sender, day); changed slots are written again.

    Each batch owns a folder, so a repeated batch replaces its own output.
    """
    slots = (
        txn.where(F.col("ts").isNotNull())
        .select("userid", "ts", "dt", F.col("dt").cast("timestamp").alias("day"))
        .withWatermark("day", watermark)
        .groupBy("userid", "dt", "day", rapid_slot(cfg).alias("slot"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .drop("day")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        slots.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rapid_pairs_seen(spark: SparkSession, path: str, cfg: Config) -> DataFrame:
    """Close pairs per (userid, dt) among everything streamed so far.

    A slot only grows, so its latest state is its largest count and widest span.
    """
    slots = (
        spark.read.parquet(path)
        .groupBy("userid", "dt", "slot")
        .agg(
            F.max("n").alias("n"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
    )
    return rapid_pairs(slots, cfg)
