"""Published tables in the order of columns: each file holds a range, and ranges do not overlap.

Spark samples the borders of the ranges, so files have about the same number of rows.  The
number of a row is the last border column: rows of one busy second, equal ones too, split over
files.  Inside a file rows are sorted, so its footer's least and greatest value bound it and
a filter on a stretch of time opens only the files of that stretch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.sources.tables import current_path, publish


def publish_ordered(df: DataFrame, table: str, by: Sequence[str], made_from: Mapping[str, str] | None = None) -> str:
    """Publish ``df`` in ascending order of ``by``, NULL first.

    ``df`` should read a stored table: it is evaluated twice, once for the borders, and a
    repeated task has to meet its rows in the same order.
    """
    order = [F.col(c).asc_nulls_first() for c in by]
    numbered = df.withColumn("_row", F.xxhash64(F.monotonically_increasing_id()))
    return publish(
        numbered.repartitionByRange(*order, "_row").sortWithinPartitions(*order).drop("_row"), table, made_from=made_from
    )


def file_ranges(spark: SparkSession, table: str, column: str) -> DataFrame:
    """Per data file: rows, least and greatest value, neighbours out of order, overlap with the next file.

    Ranges that only share a border value do not overlap.  NULL is below all values.
    """
    rows = spark.read.parquet(current_path(spark, table)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.struct(F.col(column).isNotNull().alias("some"), F.col(column).alias("value")).alias("v"),
    )
    before = F.lag("v").over(Window.partitionBy("file").orderBy("row"))
    files = (
        rows.withColumn("before", before)
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("v").alias("first"),
            F.max("v").alias("last"),
            F.count_if(F.col("before") > F.col("v")).alias("unordered"),
        )
    )
    # a row per file
    following = F.lead("first").over(Window.partitionBy().orderBy("first", "last", "file"))
    return files.select(
        "file",
        "rows",
        F.col("first.value").alias("first"),
        F.col("last.value").alias("last"),
        "unordered",
        F.coalesce(F.col("last") > following, F.lit(False)).alias("overlaps_next"),
    )
