"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of the budget.  No source gives more than
``max_epochs`` times its size; what a capped source cannot give goes to the others in
proportion to their weights, until none is above its cap.  Whole repetitions of every
document plus a seeded selection for the fractional one reach the targets.

All of it is DataFrame operations.  Tables by source have a row per source; the order of
a source's documents is found in two levels of about the root of its size, so a source
that holds a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, small

WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """``source, size, weight`` to the same plus ``target``, one row per source.

    The budget is the sum of all sizes.  With sources in ascending order of cap by weight,
    those below the water level give their cap; the level is the rest of the budget over the
    rest of the weights.  Weights must be positive; a source of size 0 has target 0.
    """
    caps = sources.withColumn("cap", F.lit(max_epochs) * F.col("size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    # the first source whose cap is not below the level sets the level for itself and all after
    open_ = caps.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "weight", "source", "level"))).over(whole)
    return open_.withColumn("water", final["level"]).select(
        *sources.columns,
        F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).cast("double").alias("target"),
    )


def cycled_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Give sources the weights 1 to ``cycle``, repeating, by code point, NULL last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sizes.withColumn("weight", (F.pmod(rank - 1, F.lit(cycle)) + 1).cast("bigint"))


def epochs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: float = 3.0,
    seed: int = 7,
) -> DataFrame:
    """``id, source, size, source_size, target, times`` per row of ``docs``.

    ``size`` is the number of words, 0 for NULL and empty texts; NULL is a source of its
    own.  A document is taken ``times`` times: the whole part of its source's rate, and once
    more if it comes early enough in the source's order, which depends on id and seed only.
    Rows that share id and size are taken alike.  The extra sizes of a source miss the
    fraction by at most half of its last document.  An empty table gives an empty result.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    sized = materialize(named.select("id", "source", _size("text").alias("size"), _order("id", seed).alias("h")), "sized")
    plan = small(_plan(sized, max_epochs))
    return sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select(
        "id", "source", "size", "source_size", "target", _times().alias("times")
    )


def repeat(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: float = 3.0,
    seed: int = 7,
) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as :func:`epochs` takes it."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    id_, text, source = (F.col("_row")[c] for c in (id_col, text_col, source_col))
    sized = materialize(
        row.select(id_.alias("id"), source.alias("source"), _size(text).alias("size"), _order(id_, seed).alias("h")),
        "sized",
    )
    plan = small(_plan(sized, max_epochs))
    return (
        row.withColumns({"size": _size(text), "h": _order(id_, seed)})
        .join(plan, source.eqNullSafe(F.col("_source")))
        .where(_times() > 0)
        .select("_row", F.explode(F.array_repeat(F.lit(0), _times().cast("int"))))
        .select("_row.*")
    )


def _size(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _order(id_, seed: int) -> Column:
    id_ = F.col(id_) if isinstance(id_, str) else id_
    return F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))


def _slice() -> Column:
    """Equal ranges of the hash's first 32 bits, ``slices`` of them, in the hash's order."""
    return F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * F.col("slices"), 32)


def _times() -> Column:
    early = (_slice() < F.col("cut_slice")) | (
        (_slice() == F.col("cut_slice")) & (F.struct("h", "size") <= F.struct("cut_h", "cut_size"))
    )
    return F.col("whole") + F.when((F.col("extra") > 0) & early, F.lit(1)).otherwise(F.lit(0))


def _plan(sized: DataFrame, max_epochs: float) -> DataFrame:
    """A row per source: target, whole repetitions, and where the extra one ends."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    rates = materialize(
        water_fill(cycled_weights(sizes), max_epochs)
        .withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)))
        .select(
            F.col("source").alias("_source"),
            F.col("size").alias("source_size"),
            "target",
            F.col("whole").cast("bigint").alias("whole"),
            (F.col("target") - F.col("whole") * F.col("size")).alias("extra"),
            F.ceil(F.sqrt("n")).cast("bigint").alias("slices"),
        ),
        "rates",
    )
    same = F.col("source").eqNullSafe(F.col("_source"))
    classes = materialize(
        sized.join(small(rates.select("_source", "slices")), same)
        .withColumn("slice", _slice())
        .groupBy("source", "slice", "h", "size")
        .agg(F.sum("size").alias("mass")),
        "classes",
    )
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = classes.groupBy("source", "slice").agg(F.sum("mass").alias("mass")).withColumn("end", F.sum("mass").over(run))
    cut = materialize(
        ends.join(rates, same)
        .where(F.col("end") > F.col("extra"))
        .groupBy("_source")
        .agg(F.min_by(F.struct("slice", (F.col("end") - F.col("mass")).alias("start")), "slice").alias("c"))
        .select("_source", F.col("c.slice").alias("cut_slice"), "c.start"),
        "cut-slices",
    )
    before = Window.partitionBy("source").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("mass").over(before), F.lit(0))
    last = (
        classes.join(small(cut), same & (F.col("slice") == F.col("cut_slice")))
        .withColumn("at", at)
        .join(small(rates.select(F.col("_source").alias("_s"), "extra")), F.col("source").eqNullSafe(F.col("_s")))
        .where(F.col("at") + F.col("mass") / 2 <= F.col("extra"))
        .groupBy("source")
        .agg(F.max(F.struct("h", "size")).alias("m"))
        .select(F.col("source").alias("_l"), F.col("m.h").alias("cut_h"), F.col("m.size").alias("cut_size"))
    )
    plan = rates.join(cut.drop("start").withColumnRenamed("_source", "_c"), F.col("_source").eqNullSafe(F.col("_c")), "left")
    plan = plan.join(last, F.col("_source").eqNullSafe(F.col("_l")), "left").drop("_c", "_l")
    return materialize(plan.fillna({"cut_slice": -1, "cut_h": "", "cut_size": -1}), "mix-plan")
