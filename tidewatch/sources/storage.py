"""Where intermediate tables live, and how lineage is cut.

The folder comes from ``spark.checkpoint.dir``.  Only a local session, as in
tests, may fall back to a temporary folder of the machine.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dir: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and stream checkpoints."""
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    if "dir" not in _local_dir:
        _local_dir["dir"] = tempfile.mkdtemp(prefix="tidewatch-")
    return _local_dir["dir"]


_made = threading.local()


def new_path(spark: SparkSession, name: str) -> str:
    """A folder below the work dir that nothing else uses."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_made, "open", ()):
        paths.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the intermediate tables that this thread made inside.

    DataFrames that read them are of no use afterwards.
    """
    _made.open = [*getattr(_made, "open", ()), paths := []]
    try:
        yield
    finally:
        _made.open = _made.open[:-1]
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes inside remove their shuffle files when they end, not whenever the driver collects garbage.

    A write plans its frame anew, so no other job reads these files.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: later plans start at the files.

    With ``partition_by`` a filter on these columns reads the files of its values only.
    """
    path = new_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        # nobody else reads these files, so they are packed closer than published ones
        df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
