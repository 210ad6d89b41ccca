"""Connected components by alternating large-star and small-star steps.

Every step is a grouping with map-side partial minima and one join.  Tables are
stored after each step, so plans stay short and a lost executor costs one step.
No node's neighbours are gathered: only their minimum is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize


#: Rows of a stored file; a small graph is written in few files, whatever the shuffle partitions.
_FILE_ROWS = 200_000


def _stored(table: DataFrame, rows: int, name: str) -> DataFrame:
    """Stored in files sized by ``rows``; a join on it deals out both sides anew, so that a hub's rows can be split."""
    return materialize(table.coalesce(4 + rows // _FILE_ROWS), name)


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = _stored(least, rows, "least")
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u != v")
        .distinct()
    )


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _stored(down.groupBy("u").agg(F.min("v").alias("m")), rows, "least")
    return (
        down.join(least, "u")
        .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        .where("u != v")
        .distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)``, both bigint; root is the least node.

    Self loops and repeated edges are ignored; rows with a NULL end are dropped.  The
    number of rounds grows with the logarithm of the largest component.
    """
    now = materialize(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    state = _digest(now)
    while True:
        large = _stored(_large_star(now, state[0]), state[0], "large-star")
        now = _stored(_small_star(large, state[0]), state[0], "small-star")
        after = _digest(now)
        if after == state:
            break
        state = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)
