"""Profiles from mergeable day partials, so that new days never read old transfers.

Every batch of transfers leaves one small row per user and day (counts, exact sums and sums of
squares, extremes, distinct-count sketches) and its distinct pairs.  A profile is a fold of
these rows.  A batch owns its folders, so a repeated batch replaces its own rows, and rows of
one day may come in several batches: partials are added, pairs are made distinct again.

Exact distinct counts come from the pairs, one row per edge of the transfer graph;
``approx=True`` unites the stored sketches instead and reads only the day rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import PATTERN_FLAGS, RECEIVER_FEATURES, SENDER_FEATURES
from tidewatch.operators.profiles import fold
from tidewatch.sources.storage import materialize
from tidewatch.sources.tables import publish_batch, published, read_batches

#: Sketches of 2^14 registers are off by about 0.8 %; small sets are counted exactly in less space.
SKETCH_BITS = 14
_SIDES = {
    "sender": ("userid", "sender", {"sender_unique_receivers": "appuser", "sender_unique_ips": "userip"}),
    "receiver": ("appuser", "recv", {"recv_unique_senders": "userid"}),
}
_FEATURES = {"sender": SENDER_FEATURES, "receiver": RECEIVER_FEATURES}
_RATIOS = {"bet_tail_ratio": "is_bet_tail", "win_desc_ratio": "desc_has_win", "b1_ratio": "desc_match_b1", "b2_ratio": "desc_match_b2"}
_WHOLE = "decimal(38,0)"


def _value(column: str) -> Column:
    """The text of a value; NULL is a value like any other."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("~"))


def day_partials(flagged: DataFrame, side: str) -> DataFrame:
    """One row per user and day: what profiles need, in a form that can be added up."""
    key, _, distinct = _SIDES[side]
    amount = F.col("amount").cast(_WHOLE)
    return flagged.groupBy(key, "dt").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("amount").alias("amounts"),
        F.sum(amount).alias("total"),
        F.sum((amount * amount).cast(_WHOLE)).alias("squares"),
        F.max("amount").alias("most"),
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in PATTERN_FLAGS],
        *[F.count(c).alias(f"{c}_rows") for c in PATTERN_FLAGS],
        *[F.hll_sketch_agg(_value(c), F.lit(SKETCH_BITS)).alias(f"{name}_sketch") for name, c in distinct.items()],
    )


def _spread() -> Column:
    """Sample standard deviation from exact sums; 0 for fewer than two amounts."""
    n, total, squares = F.sum("amounts"), F.sum("total"), F.sum("squares")
    mean = total.cast("double") / n
    # around the mean's whole part the sums stay exact decimals, and nothing large is cancelled in doubles
    whole = F.floor(mean).cast(_WHOLE)
    moved = (squares - F.lit(2) * whole * total + whole * whole * n.cast(_WHOLE)).cast("double")
    rest = total.cast("double") - whole.cast("double") * n
    return F.when(n > 1, F.sqrt(F.greatest((moved - rest * rest / n) / (n - 1), F.lit(0.0)))).otherwise(0.0)


class DailyProfiles:
    """Day partials, pairs and addresses of all batches below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def add(self, flagged: DataFrame, batch: int, stored: bool = False) -> None:
        """Fold in new transfers, flagged and with their addresses; only these are read.

        They are read four times, so they are stored first, unless they are files of their own already (``stored``).
        """
        if f"batch-{batch:012d}" in published(self.spark, self._path("done")):
            return
        rows = flagged.select("userid", "appuser", "userip", "amount", "dt", *PATTERN_FLAGS)
        if not stored:
            rows = materialize(rows, "new-transfers")
        for side in _SIDES:
            publish_batch(day_partials(rows, side), self._path(f"{side}_days"), batch)
        publish_batch(rows.select("userid", "appuser").distinct(), self._path("pairs"), batch)
        publish_batch(rows.select("userid", "userip").distinct(), self._path("addresses"), batch)
        publish_batch(self.spark.range(1).coalesce(1), self._path("done"), batch)

    def days(self, side: str) -> DataFrame:
        return read_batches(self.spark, self._path(f"{side}_days"))

    def profile(self, side: str, approx: bool = False) -> DataFrame:
        """The columns of the profile of ``side``, and how many transfers stand behind it."""
        key, prefix, distinct = _SIDES[side]
        n = F.sum("n")
        total = "sender_total_sent" if side == "sender" else "recv_total_received"
        measures = {
            f"{prefix}_tx_count": F.sum("amounts"),
            total: F.coalesce(F.sum("total"), F.lit(0)).cast("bigint"),
            f"{prefix}_avg_amount": F.sum("total").cast("double") / F.nullif(F.sum("amounts"), F.lit(0)),
            f"{prefix}_max_amount": F.max("most"),
            f"{prefix}_std_amount": _spread(),
            **{
                f"{prefix}_{ratio}": F.sum(flag) / F.nullif(F.sum(f"{flag}_rows"), F.lit(0))
                for ratio, flag in _RATIOS.items()
            },
            f"{prefix}_rows": n,
        }
        columns = [c.alias(name) for name, c in measures.items()]
        wanted = (key, *_FEATURES[side], f"{prefix}_rows")
        days = self.days(side)
        if approx:
            counts = [F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(c) for c in distinct]
            return days.groupBy(key).agg(*columns, *counts).select(*wanted)
        pairs = read_batches(self.spark, self._path("pairs")).distinct()
        counted = {name: pairs for name, c in distinct.items() if c != "userip"}
        if "sender_unique_ips" in distinct:
            counted["sender_unique_ips"] = read_batches(self.spark, self._path("addresses")).distinct()
        slim = days.drop(*[f"{c}_sketch" for c in distinct])
        return fold(slim.withColumnRenamed("n", "n_day"), key, counted, *[
            F.sum("n_day").alias(name) if name == f"{prefix}_rows" else c.alias(name) for name, c in measures.items()
        ]).select(*wanted)
