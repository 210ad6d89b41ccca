"""Frames and brute-force answers shared by the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = "reqdate string, userid string, appuser string, amount string, userip string, deviceid string, platform string, description string"


def raw_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [f.split()[0] for f in RAW.split(", ")]
    base = {
        "reqdate": "2024-01-01 10:00:00",
        "userid": "a",
        "appuser": "b",
        "amount": "1000",
        "userip": "1.1.1.1",
        "deviceid": "d",
        "platform": "ios",
        "description": "",
    }
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], RAW)


def by(df: DataFrame, *keys: str) -> dict:
    """Rows as dicts, keyed by one or several columns."""
    out = {}
    for row in df.collect():
        d = row.asDict()
        out[tuple(d[k] for k in keys) if len(keys) > 1 else d[keys[0]]] = d
    return out
