"""Published tables: validated runs behind a pointer, and their health.

A table is a folder with one sub-folder per run and a folder ``_runs`` of empty files,
whose names are numbers and runs; readers see the run with the highest number.  Such a
file appears whole or not at all and replaces none, so a reader meets the run before or
the run after.  It is written only after the run's rows were counted in the files, so a
failed job never replaces good data, and no step depends on an atomic rename.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime, timezone

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.storage import shuffles_freed

_POINTERS = "_runs"
_SOURCES = "_made_from"
# what Spark raises for a failed job or a file it cannot read
SPARK_ERRORS = (PySparkException, Py4JJavaError)


def fs_path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = fs_path(spark, path)
    return bool(fs.exists(target))


def published(spark: SparkSession, table: str) -> list[str]:
    """Runs of a table, oldest first; one small file name each."""
    fs, folder = fs_path(spark, f"{table}/{_POINTERS}")
    if not fs.exists(folder):
        return []
    return [name.partition("-")[2] for name in sorted(f.getPath().getName() for f in fs.listStatus(folder))]


def current_path(spark: SparkSession, table: str) -> str:
    """Folder of the published run, or ``table`` itself if it is a plain Parquet path."""
    runs = published(spark, table)
    return f"{table}/{runs[-1]}" if runs else table


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(current_path(spark, table))


def publish(
    df: DataFrame, table: str, partition_by: Sequence[str] = (), made_from: Mapping[str, str] | None = None
) -> str:
    """Write a new run, count it in its files, then point the table at it.

    ``made_from`` names the runs that ``df`` was made from, by source table; see :func:`runs_of`.
    """
    run = f"run-{datetime.now(timezone.utc):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"
    return _publish_run(df, table, run, partition_by, made_from)


def publish_batch(df: DataFrame, table: str, batch_id: int) -> str:
    """Add one batch of a stream to a table of batches; a batch that is there already is left alone.

    A batch that died before its pointer was written is written anew.  Readers of
    :func:`read_batches` see whole batches only.
    """
    run = f"batch-{batch_id:012d}"
    if run in published(df.sparkSession, table):
        return f"{table}/{run}"
    return _publish_run(df, table, run, (), None)


def read_batches(spark: SparkSession, table: str) -> DataFrame:
    """All batches of a table."""
    runs = published(spark, table)
    if not runs:
        raise FileNotFoundError(f"{table} has no batch yet")
    return spark.read.parquet(*[f"{table}/{run}" for run in dict.fromkeys(runs)])


def _publish_run(
    df: DataFrame, table: str, run: str, partition_by: Sequence[str], made_from: Mapping[str, str] | None
) -> str:
    spark = df.sparkSession
    sent = Observation()
    path = f"{table}/{run}"
    counted = df.observe(sent, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.mode("overwrite").option("compression", "snappy")
    with shuffles_freed(spark):
        writer.partitionBy(*partition_by).parquet(path)
    found = spark.read.schema(df.schema).parquet(path).count()
    if found != sent.get["rows"]:
        raise OSError(f"{path} holds {found} of {sent.get['rows']} rows")
    if made_from is not None:
        sources = spark.createDataFrame(sorted(made_from.items()), "source string, run string")
        sources.coalesce(1).write.mode("overwrite").parquet(f"{table}/{_SOURCES}/{run}")
    number = len(published(spark, table))
    while True:
        fs, pointer = fs_path(spark, f"{table}/{_POINTERS}/{number:012d}-{run}")
        number += 1
        # two writers may take one number; the names then differ by run and both are kept
        if fs.createNewFile(pointer):
            return path


def runs_of(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, str]:
    """The published run of each table below ``root``; tables without runs are left out."""
    runs = {name: published(spark, f"{root}/{name}") for name in names}
    return {name: found[-1] for name, found in runs.items() if found}


def made_from(spark: SparkSession, table: str) -> dict[str, str] | None:
    """The runs that the published run of a table was made from, or None if it has no record."""
    runs = published(spark, table)
    if not runs or not exists(spark, f"{table}/{_SOURCES}/{runs[-1]}"):
        return None
    return {r["source"]: r["run"] for r in spark.read.parquet(f"{table}/{_SOURCES}/{runs[-1]}").collect()}


def outdated(spark: SparkSession, root: str, name: str) -> str | None:
    """The first source of a table that has a newer run by now, or whose own sources have; else None.

    Runs are compared, not file times, so copies and equal seconds do not mislead.  A table
    without a record is taken as current.
    """
    for source, run in sorted((made_from(spark, f"{root}/{name}") or {}).items()):
        if runs_of(spark, root, [source]).get(source) != run:
            return source
        if above := outdated(spark, root, source):
            return above
    return None


def lineage(spark: SparkSession, root: str, names: Iterable[str]) -> DataFrame:
    """(table_name, source, run, current) for every recorded source of the published runs."""
    rows = [
        (name, source, run, runs_of(spark, root, [source]).get(source) == run)
        for name in names
        for source, run in sorted((made_from(spark, f"{root}/{name}") or {}).items())
    ]
    return spark.createDataFrame(rows, "table_name string, source string, run string, current boolean")


def publish_csv(df: DataFrame, path: str) -> None:
    """CSV report, one file per partition."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").option("header", True).csv(path)


def table_error(spark: SparkSession, table: str) -> str | None:
    """Why a table cannot be read, or None."""
    if not exists(spark, table):
        return f"{table} does not exist"
    try:
        read_table(spark, table).limit(1).collect()
    except SPARK_ERRORS as e:
        return f"{table} is not readable Parquet: {str(e).splitlines()[0]}"
    return None


def validate_outputs(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """(table_name, ok, rows) per table; an unreadable one has no row count."""
    parts = []
    for name, table in sorted(tables.items()):
        if table_error(spark, table) is None:
            part = read_table(spark, table).agg(
                F.lit(name).alias("table_name"),
                F.lit(True).alias("ok"),
                F.count(F.lit(1)).alias("rows"),
            )
        else:
            part = spark.range(1).select(
                F.lit(name).alias("table_name"),
                F.lit(False).alias("ok"),
                F.lit(None).cast("bigint").alias("rows"),
            )
        parts.append(part)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def table_files(spark: SparkSession, table: str) -> DataFrame:
    """Data files of the published run from the listing alone."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(current_path(spark, table))
        .select("path", "length", "modificationTime")
    )


def table_freshness(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """(table_name, files, bytes, modified) for every table that exists."""
    result = None
    for name, table in sorted(tables.items()):
        if not exists(spark, table):
            continue
        part = table_files(spark, table).agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("files"),
            F.sum("length").alias("bytes"),
            F.max("modificationTime").alias("modified"),
        )
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise FileNotFoundError("none of the tables exists")
    return result


def modified(spark: SparkSession, table: str) -> datetime | None:
    """Newest file of a table, None if there is no table."""
    if not exists(spark, table):
        return None
    return table_files(spark, table).agg(F.max("modificationTime")).first()[0]
