"""Removal of repeated passages by overlapping three-line windows.

Every run of three consecutive non-blank lines is one window.  A window that occurs
more than once in the corpus stays at its first place, in the order of id, text key and
line; the lines that its later occurrences cover are merged and removed.  The text of
every removed line survives at an earlier place, since each removal points to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, text_key

# A window for each run of non-blank lines; ``filled`` holds their places.  Both arrays are
# bound to a name by a lambda: a column could be replaced by its definition and then be
# evaluated for every element.
_WINDOWS = r"""
transform(array(split(text, '\n', -1)), lines ->
  transform(array(filter(sequence(0, size(lines) - 1), i -> trim(lines[i]) != '')), filled ->
    IF(size(filled) < {n}, NULL, transform(sequence(0, size(filled) - {n}), j -> struct(
      filled[j] AS first, filled[j + {n} - 1] AS last,
      transform(slice(filled, j + 1, {n}), i -> trim(lines[i])) AS run))))[0])[0]
"""
# The same with shorter runs that reach a number of words.
_PASSAGES = r"""
transform(array(split(text, '\n', -1)), lines ->
  transform(array(filter(sequence(0, size(lines) - 1), i -> trim(lines[i]) != '')), filled ->
    transform(array(transform(filled, i -> regexp_count(lines[i], '[^\\x20\\x09-\\x0D]+'))), words ->
      flatten(array({runs})))[0])[0])[0]
"""
_RUNS = r"""
IF(size(filled) < {n}, array(), transform(filter(sequence(0, size(filled) - {n}), j -> {enough}), j -> struct(
  filled[j] AS first, filled[j + {n} - 1] AS last, transform(slice(filled, j + 1, {n}), i -> trim(lines[i])) AS run)))
"""
_KEPT = r"""
transform(array(split(text, '\n', -1)), lines ->
  array_join(transform(array_except(sequence(0, size(lines) - 1), removed), i -> lines[i]), '\n'))[0]
"""


def _runs(window: int, passage_words: int | None) -> str:
    """SQL for the windows of a text."""
    if passage_words is None:
        return _WINDOWS.format(n=window)
    shorter = [(n, f"{' + '.join(f'words[j + {k}]' for k in range(n))} >= {int(passage_words)}") for n in range(1, window)]
    runs = [_RUNS.format(n=n, enough=enough) for n, enough in [*shorter, (window, "true")]]
    return _PASSAGES.format(runs=", ".join(runs))


def line_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, passage_words: int | None = None
) -> DataFrame:
    """``id, key, first, last, a, b``: a row per window; a and b are a 128-bit hash of its lines."""
    named = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    each = named.select("id", "key", F.explode(F.expr(_runs(window, passage_words))).alias("w"))
    return each.select(
        "id",
        "key",
        F.col("w.first").alias("first"),
        F.col("w.last").alias("last"),
        F.xxhash64("w.run").alias("a"),
        F.xxhash64(F.lit("second"), F.col("w.run")).alias("b"),
    )


def remove_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, passage_words: int | None = None
) -> DataFrame:
    """``id, text, n_lines, n_removed, removed`` per row of ``docs``.

    With ``passage_words``, a run of fewer than ``window`` non-blank lines is a window, too, if
    it has at least so many words.

    ``removed`` holds the removed line numbers from 0, in order; blank lines inside a
    covered run go with it.  Lines are compared without outer blanks.  Without ``passage_words``
    texts with fewer than ``window`` non-blank lines stay as they are.  NULL text stays NULL with 0 lines, an empty
    text has one (blank) line.  Rows equal in id and text count as one document and get
    the same result.  Later occurrences inside one document are removed, too.
    """
    windows = materialize(line_windows(docs, id_col, text_col, window, passage_words), "windows")
    at = F.struct("id", "key", "first")
    repeated = materialize(
        windows.groupBy("a", "b").agg(F.min(at).alias("origin"), F.count("*").alias("n")).where("n > 1"), "repeated"
    )
    covered = (
        windows.join(repeated, ["a", "b"])
        .where(at != F.col("origin"))
        .select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.explode(F.sequence("first", "last")).alias("i"))
        .groupBy("_id", "_key")
        .agg(F.array_sort(F.collect_set("i")).alias("covered"))
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    none = F.array().cast("array<int>")
    return (
        rows.join(covered, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
        .withColumn("removed", F.coalesce("covered", none))
        .select(
            "id",
            F.when(F.size("removed") == 0, F.col("text")).otherwise(F.expr(_KEPT)).alias("text"),
            # lines are separated by single bytes
            F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).alias("n_lines"),
            F.size("removed").alias("n_removed"),
            "removed",
        )
    )
