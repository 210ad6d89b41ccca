"""Column helpers and stored intermediates shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.storage import materialize

__all__ = ["crc_mod", "few_each", "lowest", "materialize", "small", "text_key", "table"]

#: A side is broadcast only after it was counted and holds at most this many rows.
BROADCAST_ROWS = 100_000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; NULL for a NULL id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def text_key(text: Column) -> Column:
    """A NULL-safe 64-bit key that tells texts with the same id apart."""
    return F.xxhash64(text)


def small(stored: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if its counted rows stay within ``limit``."""
    return F.broadcast(stored) if stored.count() <= limit else stored


_ALL = 1 << 63


def hash_below(h: Column, share: float) -> Column:
    """Whether a 64-bit hash is among the lowest ``share`` of all, by its upper 63 bits."""
    if share >= 1:
        return F.lit(True)
    return F.shiftrightunsigned(h, 1) < F.lit(int(share * _ALL))


def lowest(frame: DataFrame, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` distinct rows of ``frame``, those of the lowest hashes of all columns.

    Rows are counted, and only those below a share that leaves clearly more than ``bound`` are
    compared; equal rows are one.  The answer does not depend on the order of rows.
    """
    share = (1.6 * bound + 100) / max(frame.count(), 1)
    hashed = frame.withColumn("_h", F.xxhash64(*frame.columns, F.lit(seed)))
    picked = hashed.where(hash_below(F.col("_h"), share)).dropDuplicates([frame.columns[0], "_h"])
    return picked.orderBy(F.shiftrightunsigned("_h", 1), "_h").limit(bound).drop("_h")


def few_each(frame: DataFrame, keys: list[str], bound: int, seed: int) -> DataFrame:
    """At most ``bound`` distinct rows of ``keys`` and ``text``, and at most eight of one key, by a hash of all."""
    hashed = frame.withColumn("h", F.xxhash64(*keys, "text", F.lit(seed)))
    few = hashed.groupBy(*keys, F.pmod("h", F.lit(8)).alias("part")).agg(F.min(F.struct("h", "text")).alias("m"))
    return few.select(*keys, "m.text", "m.h").orderBy("h", *keys).limit(bound).drop("h")
