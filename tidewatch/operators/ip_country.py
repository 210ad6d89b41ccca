"""IP address to country through an interval join on address buckets."""

from __future__ import annotations

import decimal
import ipaddress
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Config
from tidewatch.functions.ip import V4_DIGITS, V6_DIGITS, ip_bucket, parse_ip, parse_ipv4
from tidewatch.operators.attach import attach
from tidewatch.sources.storage import materialize

# functions travel with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Adaptive skew splitting does not reach streams, so a bucket's rows are dealt out by hand.
_STREAM_SALTS = 16
_BOUNDS = "country string, seq bigint, first string, last string"


def _bounds(ranges: DataFrame, ipv6_value: str) -> DataFrame:
    """First and last address of each range as hex; ``seq`` is the file order.

    ``value`` is a count (or a prefix length) as a number or as text.  A row of a known
    type that cannot be read is an error that shows the row; other types are left out.
    Python integers hold counts up to 2^128, and the rows are those of a reference file.
    """

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for country, kind, start, value, seq in batch.itertuples(index=False):
                v4 = kind == "ipv4"
                bits, digits = (32, V4_DIGITS) if v4 else (128, V6_DIGITS)
                try:
                    address = int((ipaddress.IPv4Address if v4 else ipaddress.IPv6Address)(start.strip()))
                    size = int(decimal.Decimal(value).to_integral_value(decimal.ROUND_HALF_UP)) if v4 else int(value)
                    if not v4 and ipv6_value == "prefix":
                        size = 1 << (bits - size)
                except (ValueError, AttributeError, TypeError, ArithmeticError) as e:
                    shown = ",".join("" if x is None else x for x in (country, kind, start, value))
                    raise ValueError(f"unreadable IP range: {shown}") from e
                end = min(address + size, 1 << bits) - 1
                # an empty range at the first address has no last one; it still cuts the range before
                last = f"{end:0{digits}x}" if end >= 0 else ""
                rows.append((country, seq, f"{address:0{digits}x}", last))
            yield pd.DataFrame(rows, columns=["country", "seq", "first", "last"])

    rows = ranges.select("country", "type", "start", F.col("value").cast("string").alias("value"), "seq")
    return rows.where(F.col("type").isin("ipv4", "ipv6")).mapInPandas(convert, _BOUNDS)


def disjoint_ranges(ranges: DataFrame, cfg: Config) -> DataFrame:
    """Cut every range at the next start, so that each address has one answer.

    The lookup only ever looks at the last start at or before an address (of
    equal starts, the last in the file), so a range ends where the next begins.
    The next start is found inside the start's bucket; only the last range of a
    bucket looks at the bucket heads, which are few.
    """
    # stored, for it is read twice and its addresses are compared many times
    bounds = (
        materialize(_bounds(ranges, cfg.ipv6_value), "ip-bounds")
        .withColumn("family", F.length("first"))
        .withColumn("bucket", ip_bucket("first"))
    )
    heads = (
        bounds.groupBy("family", "bucket")
        .agg(F.min("first").alias("head"))
        .withColumn(
            "next_head", F.lead("head").over(Window.partitionBy("family").orderBy("bucket"))
        )
        .drop("head")
    )
    in_bucket = Window.partitionBy("family", "bucket").orderBy("first", "seq")
    return (
        bounds.withColumn("next", F.lead("first").over(in_bucket))
        .join(heads, ["family", "bucket"])
        .withColumn("next", F.coalesce("next", "next_head"))
        .where(F.col("last") >= F.col("first"))
        .where(F.col("next").isNull() | (F.col("next") > F.col("first")))
        .select("country", "first", "last", "next")
    )


def bucketed_ranges(ranges: DataFrame, cfg: Config) -> DataFrame:
    """Disjoint ranges repeated once per bucket they touch."""
    end = F.least("last", "next")
    return disjoint_ranges(ranges, cfg).withColumn(
        "ip_bucket", F.explode(F.sequence(ip_bucket("first"), ip_bucket(end)))
    )


def _lookup(rows: DataFrame, buckets: DataFrame, address: Column, salts: int = 1) -> DataFrame:
    """``rows`` plus ``iploc``; a row matches at most one disjoint range.

    With ``salts`` the buckets are repeated so often and the rows of one bucket dealt out
    among the copies; rows without an address get buckets that no range has.
    """
    keyed = rows.withColumn("_ip", address).withColumn("_bucket", ip_bucket("_ip"))
    same = F.col("_bucket") == F.col("ip_bucket")
    if salts > 1:
        row = F.xxhash64(*[F.col(c) for c in rows.columns])
        keyed = keyed.withColumns(
            {
                "_salt": F.pmod(row, F.lit(salts)).cast("int"),
                "_bucket": F.coalesce("_bucket", -1 - F.pmod(row, F.lit(4096))),
            }
        )
        buckets = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        same = same & (F.col("_salt") == F.col("salt"))
    inside = (
        same
        & (F.col("_ip") >= F.col("first"))
        & (F.col("_ip") <= F.col("last"))
        & (F.col("next").isNull() | (F.col("_ip") < F.col("next")))
    )
    return keyed.join(buckets, inside, "left").select(
        *[F.col(c) for c in rows.columns], F.coalesce("country", F.lit("")).alias("iploc")
    )


def add_country(txn: DataFrame, ranges: DataFrame, cfg: Config, ip: str = "userip") -> DataFrame:
    """Add ``iploc``, the country of ``ip`` or ''.

    With a bucket table of checked size the buckets are broadcast and transfers
    are not shuffled at all.  A larger one is joined with the distinct
    addresses, and the answers are attached to the transfers by address.
    """
    buckets = materialize(bucketed_ranges(ranges, cfg), "ip-buckets")
    n, widest = buckets.agg(F.count(F.lit(1)), F.max(F.length("first"))).first()
    # without IPv6 ranges no IPv6 address has an answer, and the long expression is not needed
    address = parse_ip(ip) if widest == V6_DIGITS else parse_ipv4(ip)
    if n <= cfg.broadcast_buckets:
        return _lookup(txn, F.broadcast(buckets), address)
    if txn.isStreaming:
        return _lookup(txn, buckets, address, _STREAM_SALTS)
    addresses = txn.groupBy(ip).agg(F.count(F.lit(1)).alias("_ip_rows"))
    answers = _lookup(addresses, buckets, address)
    return (
        attach(txn, answers, ip, "_ip_rows", cfg)
        .withColumn("iploc", F.coalesce("iploc", F.lit("")))
        .drop("_ip_rows")
    )
