"""Raw CSV folder and the IP range reference file."""

from __future__ import annotations

import functools
import operator
import re
import uuid
from collections.abc import Collection
from datetime import datetime

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.storage import materialize
from tidewatch.sources.tables import fs_path

RAW_COLUMNS = (
    "reqdate",
    "userid",
    "appuser",
    "amount",
    "userip",
    "deviceid",
    "platform",
    "description",
)
RAW_SCHEMA = ", ".join(f"{c} STRING" for c in RAW_COLUMNS)
CSV_GLOB = "*.[cC][sS][vV]"

# Cell texts that mean "missing" in raw files.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def _odd(line: Column) -> Column:
    """Whether a line may be more than values between commas."""
    return line.contains('"') | line.contains("\0")


def _quote_open(line: Column) -> Column:
    """Whether a quoted value of a line does not end; most lines have no quote and are not matched."""
    return line.contains('"') & line.rlike(_OPEN_QUOTE)


def blank_to_null(df: DataFrame, columns: Collection[str] | None = None) -> DataFrame:
    """Missing-value texts to NULL in every column, or in the named ones."""
    return df.select(
        *[
            F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)).alias(c) if columns is None or c in columns else c
            for c in df.columns
        ]
    )


def csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files of a folder (any letter case) with size and time; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", CSV_GLOB)
        .load(folder)
        .select("path", "length", "modificationTime")
    )


def header(spark: SparkSession, folder: str) -> list[str]:
    """Column names of the first file by name; an empty folder is an error."""
    first = csv_files(spark, folder).agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(f"no CSV file in {folder}")
    return spark.read.option("header", True).csv(first).columns


def _checked_header(spark: SparkSession, folder: str) -> list[str]:
    columns = header(spark, folder)
    missing = [c for c in RAW_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"raw files lack columns: {', '.join(missing)}")
    return columns


def read_raw(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """All CSV files of a folder, every column as text.

    The header decides which columns exist; the ones the cleaning needs must be
    there, others are carried along, and a file with another header is an error.
    ``multi_line`` allows line breaks inside quotes, but then a file is one task.
    """
    columns = _checked_header(spark, folder)
    raw = (
        spark.read.schema(", ".join(f"`{c}` STRING" for c in columns))
        .options(header=True, multiLine=multi_line, quote='"', escape='"', enforceSchema=False)
        .option("pathGlobFilter", CSV_GLOB)
        .csv(folder)
    )
    return blank_to_null(raw)


#: Table of raw rows that could not be read.
REJECTED = "rejected"
_PLACE = ("source_file", "source_row")
_BROKEN = "_unread"
#: A row per file is broadcast up to so many.
_BROADCAST_FILES = 100_000
#: Whole values and commas, then a quoted value that does not end.
_OPEN_QUOTE = r"""^(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+,)*+"[^"]*+(?:""[^"]*+)*+$"""


def _parsed(lines: DataFrame, columns: list[str], odd: Column) -> DataFrame:
    """Place and values of each line, missing-value texts as NULL; the text of a line that cannot be read in one more column.

    A plain line is split at its commas; only an odd one needs the CSV parser.
    """
    schema = ", ".join(f"`{c}` STRING" for c in (*columns, _BROKEN))
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    text = F.col("value")
    row = F.from_csv(text, F.lit(schema), options)
    # by the text alone, so that a filter on this column does not split the lines a second time
    commas = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(","), F.lit("")))
    unread = F.when(odd, _quote_open(text) | row[_BROKEN].isNotNull()).otherwise(commas != len(columns) - 1)
    plain = F.col("_cells").isNotNull()
    values = [F.when(plain, F.get("_cells", F.lit(i))).otherwise(F.col(f"_row.`{c}`")) for i, c in enumerate(columns)]
    cut = lines.withColumns({"_row": F.when(odd, row), "_cells": F.when(~odd, F.split(text, ",", -1))})
    return blank_to_null(cut.select(*_PLACE, *[v.alias(c) for v, c in zip(values, columns, strict=True)], F.when(unread, text).alias(_BROKEN)), columns)


def _named(columns: list[str], odd: Column) -> Column:
    """Whether a line holds the names of the columns."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    row = F.from_csv("value", F.lit(schema), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    same = functools.reduce(operator.and_, [row[c].eqNullSafe(F.lit(c)) for c in columns])
    joined = ",".join(columns)
    # a name has no comma or quote in a plain line
    plain = (F.col("value") == joined) | F.col("value").startswith(f"{joined},")
    if '"' in joined or joined.count(",") != len(columns) - 1:
        return odd & same
    return F.when(odd, F.col("value").contains(columns[0]) & same).otherwise(plain)


def read_landing(spark: SparkSession, folder: str) -> DataFrame:
    """Like :func:`read_raw`, with the place of every row and the text of rows that cannot be read.

    ``source_row`` rises along a file; it is the byte at which a task's share of the file begins
    plus the line's number in the task.  A line with too few or too many columns, or with a quoted
    value that does not end, keeps its text in one more column, which is NULL for all others.
    Empty lines are left out; a file whose first line is another header is an error.

    The files are listed here, once, and their headers checked; the lines are not stored, as
    splitting them again costs less.  Each use of the result reads the same files.
    """
    columns = _checked_header(spark, folder)
    line_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = (
        spark.read.option("pathGlobFilter", CSV_GLOB)
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias(_PLACE[0]),
            (F.col("_metadata.file_block_start") + line_in_task).alias(_PLACE[1]),
            "value",
        )
        .where(F.trim("value") != "")
    )
    odd = _odd(F.col("value"))
    # a row per file
    heads = materialize(
        lines.groupBy(_PLACE[0]).agg(
            F.min(_PLACE[1]).alias(_PLACE[1]), F.min(F.when(_named(columns, odd), F.col(_PLACE[1]))).alias("first_named")
        ),
        "heads",
    )
    if other := heads.where(f"NOT (first_named <=> {_PLACE[1]})").select(_PLACE[0]).first():
        raise ValueError(f"{other[0]} has another header than the first file")
    few = F.broadcast(heads) if heads.count() <= _BROADCAST_FILES else heads
    return _parsed(lines, columns, odd).join(few.select(*_PLACE), list(_PLACE), "left_anti")


def accepted(landed: DataFrame, places: bool = False) -> DataFrame:
    """Raw transfers of :func:`read_landing`, with ``source_file`` and ``source_row`` if asked for."""
    return landed.where(F.col(_BROKEN).isNull()).drop(_BROKEN, *(() if places else _PLACE))


def rejected(landed: DataFrame) -> DataFrame:
    """``source_file, source_row, reason, text`` of the rows that could not be read."""
    text = F.col(_BROKEN)
    reason = F.when(_quote_open(text), "quote without end").otherwise("wrong number of columns")
    return landed.where(text.isNotNull()).select(*_PLACE, reason.alias("reason"), text.alias("text"))


def read_raw_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The same folder as a stream of files; each file is read once.

    As in a batch, the header of the first file decides the columns; a folder that is
    still empty gets the usual ones.
    """
    try:
        columns = _checked_header(spark, folder)
    except FileNotFoundError:
        columns = list(RAW_COLUMNS)
    raw = (
        spark.readStream.schema(", ".join(f"`{c}` STRING" for c in columns))
        .options(header=True, quote='"', escape='"', enforceSchema=False)
        .option("pathGlobFilter", CSV_GLOB)
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(folder)
    )
    return blank_to_null(raw)


def read_ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Range file with ``seq``, a number that grows in file order.

    The country code ``NA`` stays text.  ``value`` stays text, too: IPv6 ranges have more
    addresses than a 64-bit number can count.
    """
    row_in_split = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    columns = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    return (
        spark.read.schema(schema)
        .options(header=True, nullValue="\u0000")
        .csv(path)
        .select(
            "country",
            "type",
            F.trim("start").alias("start"),
            F.trim("value").alias("value"),
            (F.col("_metadata.file_block_start") + row_in_split).alias("seq"),
        )
    )


def landing_name(filename: str, taken: set[str], now: datetime) -> str:
    """Safe, unused name for a file dropped into the landing folder."""
    base = filename.replace("\\", "/").rsplit("/", 1)[-1]
    if not base.lower().endswith(".csv"):
        raise ValueError(f"{filename} is not a .csv file")
    stamp = now.strftime("%Y%m%d_%H%M%S")
    stem = re.sub(r"[^A-Za-z0-9._-]+", "_", base[:-4]).strip("._") or f"upload_{stamp}"
    name, counter = f"{stem}.csv", 0
    while name in taken:
        counter += 1
        name = f"{stem}_{stamp}_{counter}.csv"
    return name


def place_csv(spark: SparkSession, source: str, folder: str, filename: str | None = None, now: datetime | None = None) -> str:
    """Put one CSV file into the landing folder under a safe, unused name; returns its path.

    No file is ever overwritten, also not by two sessions at a time: a hidden claim on the name,
    which only one of them can create, is held until the file is there.  The bytes go to a hidden
    file first and are renamed, so a stream over the folder sees whole files only.  A claim that a
    lost session left behind just leads to the next name.  Like an upload, the copy goes through
    this process; it is streamed, never held.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    (from_fs, origin), (fs, target) = fs_path(spark, source), fs_path(spark, folder)
    now, wanted = now or datetime.now(), filename or origin.getName()
    landing_name(wanted, set(), now)  # refuses other kinds of files before anything is written
    if not fs.mkdirs(target):
        raise OSError(f"cannot make {folder}")
    hidden = hadoop.Path(target, f".{uuid.uuid4().hex}.uploading")
    hadoop.FileUtil.copy(from_fs, origin, fs, hidden, False, False, conf)
    taken = {f.getPath().getName() for f in fs.listStatus(target)}
    while True:
        name = landing_name(wanted, taken, now)
        placed, claim = hadoop.Path(target, name), hadoop.Path(target, f".{name}.claim")
        taken.add(name)
        if not _claimed(fs, claim):
            continue
        try:
            if fs.exists(placed):
                continue
            if not fs.rename(hidden, placed):
                raise OSError(f"cannot place {name} in {folder}")
            return placed.toString()
        finally:
            fs.delete(claim, False)


def _claimed(fs: JavaObject, claim: JavaObject) -> bool:
    """Whether the empty file was created by this call."""
    try:
        return bool(fs.createNewFile(claim))
    except Py4JJavaError:
        if fs.exists(claim):
            return False
        raise
