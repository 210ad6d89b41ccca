"""Raw transfers to clean transfers: device id, country, description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Config
from tidewatch.functions.columns import parse_reqdate
from tidewatch.functions.text import normalize_description
from tidewatch.operators.ip_country import add_country


def device_id() -> Column:
    """Device id, or ``userid-userip`` where it is missing."""
    part = {c: F.coalesce(F.col(c), F.lit("")) for c in ("userid", "userip")}
    return F.coalesce("deviceid", F.concat(part["userid"], F.lit("-"), part["userip"]))


def fill_device_id(raw: DataFrame) -> DataFrame:
    return raw.withColumn("deviceid", device_id())


def clean_description(raw: DataFrame) -> DataFrame:
    return raw.withColumn("desc_clean", normalize_description("description")).drop("description")


def clean_transfers(raw: DataFrame, ranges: DataFrame, cfg: Config) -> DataFrame:
    """All cleaning steps; ``iploc`` sits before ``deviceid``, ``desc_clean`` comes last."""
    located = add_country(raw, ranges, cfg)
    order: list[str] = []
    for c in raw.columns:
        if c == "deviceid":
            order.append("iploc")
        if c != "description":
            order.append(c)
    return clean_description(fill_device_id(located)).select(*order, "desc_clean")


def add_time(etl: DataFrame) -> DataFrame:
    """``ts`` and its day ``dt``, parsed once."""
    return etl.withColumn("ts", parse_reqdate("reqdate")).withColumn("dt", F.col("ts").cast("date"))
