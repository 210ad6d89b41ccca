"""Left join of a large row table with a table that has one row per key.

One key may hold a third of all rows.  A plain shuffle join would send those
rows to one task, and adaptive skew splitting does not apply when the key
table is an aggregate that already has the join's partitioning.  So, unless the
key table has at most ``broadcast_keys`` rows and is broadcast whole:

* keys with more rows than an average partition are broadcast; their rows are
  answered before the shuffle and then spread evenly;
* every other key goes through a shuffle join, without sorting unless a partition has more than
  ``broadcast_keys`` keys;
* rows with a NULL key match nothing and are spread the same way.

What is hot follows from the stored keys: those with ``hot_share`` times the rows of an
average partition.  There are at most ``partitions / hot_share`` of them, which bounds the
broadcast whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Config
from tidewatch.sources.storage import materialize

#: Salts for each shuffle partition; many, so that hashing deals them out evenly.
_SALTS = 32


def attach(rows: DataFrame, keyed: DataFrame, key: str, weight: str, cfg: Config) -> DataFrame:
    """``rows LEFT JOIN keyed USING (key)``; ``weight`` is the key's row count in ``keyed``.

    ``keyed`` is stored first, as it is read up to three times.
    """
    values = [c for c in keyed.columns if c != key]
    keyed = materialize(keyed.where(F.col(key).isNotNull()), "keyed")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    if n <= cfg.broadcast_keys:
        return rows.join(F.broadcast(keyed), key, "left").select(*rows.columns, *values)
    hot = (
        keyed.where(F.col(weight) >= max(1.0, cfg.hot_share * total / partitions))
        .select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    )
    spread = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    # the partition id keeps equal copies of a row apart and is the same on a retry
    row = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in rows.columns])
    salt = F.pmod(row, F.lit(_SALTS * partitions))
    tagged = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_join_key",
        F.when(spread, F.concat(F.lit("s"), salt.cast("string"))).otherwise(
            F.concat(F.lit("k"), F.col(key).cast("string"))
        ),
    )
    cold = keyed.select(
        F.concat(F.lit("k"), F.col(key).cast("string")).alias("_join_key"),
        *[F.col(c).alias(f"_cold_{c}") for c in values],
    )
    # keys are one row each: a partition's are looked up in memory, and the rows need not be sorted
    if n <= cfg.broadcast_keys * partitions:
        cold = cold.hint("shuffle_hash")
    return tagged.join(cold, "_join_key", "left").select(
        *[F.col(c) for c in rows.columns],
        *[F.coalesce(F.col("_hot")[c], F.col(f"_cold_{c}")).alias(c) for c in values],
    )
