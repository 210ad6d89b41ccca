"""Rapid transfers of closed days, walked once when the watermark closes the day.

Transfers are first counted in slots of the day as wide as the gap limit, which is a plain
streaming aggregation: a busy sender is one partial row per task and slot before the shuffle.
The slots of a day leave that aggregation in the batch in which the watermark passes the day's
end, all of them at once.  So the walk needs no state of its own and no timer: it gets the whole
days of one bucket of senders at a time, a sender's day being ``86400 / rapid_seconds`` slots at most.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.config import Config
from tidewatch.operators.str_flags import rapid_slot
from tidewatch.streaming.streams import WATERMARK, _append

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Buckets of senders that a day is walked in; a call to Python and back is paid per bucket, not per sender.
BUCKETS = 4_096


class DayWalk(StatefulProcessor):
    """Counts neighbours closer than ``limit`` microseconds over the slots of a closed day's senders."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots = pd.concat(list(rows), ignore_index=True)
        # a NULL sender is a sender
        code, users = pd.factorize(slots["userid"], use_na_sentinel=False)
        first, last = slots["first"].to_numpy(np.int64), slots["last"].to_numpy(np.int64)
        order = np.lexsort((first, code))
        code, first, last = code[order], first[order], last[order]
        pairs = slots["n"].to_numpy(np.int64)[order] - 1
        pairs[1:] += (code[1:] == code[:-1]) & (first[1:] - last[:-1] < self.limit)
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        yield pd.DataFrame(
            {"userid": pd.Series(users, dtype=object), "dt": key[0], "pairs": np.add.reduceat(pairs, starts)}
        )


def wall_micros(ts: str) -> Column:
    """The wall clock of a time without zone, in microseconds since 1970."""
    seconds = F.unix_date(F.col(ts).cast("date")) * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds.cast("bigint") * 1_000_000 + F.expr(f"CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)")


def stream_rapid_days(
    txn: DataFrame, path: str, checkpoint: str, cfg: Config, delay: str = WATERMARK, buckets: int = BUCKETS
) -> StreamingQuery:
    """Close pairs (``userid, dt, pairs``) of each sender's day, written once: when the watermark closes the day.

    Transfers may come in any order up to ``delay``; those of a closed day are dropped and counted
    as late in the stream's progress.  Rows without a time are left out, as in the batch.  A NULL
    sender is a sender.  Needs the on-disk state store (``use_rocksdb``).
    """
    slots = (
        txn.where(F.col("ts").isNotNull())
        .select("userid", "dt", rapid_slot(cfg).alias("slot"), wall_micros("ts").alias("micros"))
        .withColumn("at", F.timestamp_micros("micros"))
        .withWatermark("at", delay)
        .groupBy("userid", "dt", "slot", F.window("at", "1 day"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("micros").alias("first"), F.max("micros").alias("last"))
    )
    bucket = F.pmod(F.xxhash64("userid"), F.lit(buckets)).cast("int")
    days = (
        slots.select("userid", "dt", bucket.alias("bucket"), F.window_time("window").alias("at"), "n", "first", "last")
        .groupBy("dt", "bucket")
        .transformWithStateInPandas(
            DayWalk(int(cfg.rapid_seconds * 1_000_000)), "userid string, dt date, pairs long", "Append", "eventTime"
        )
    )
    return _append(days, path, checkpoint)
