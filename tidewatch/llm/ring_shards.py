"""Consistent-hash sharding with virtual nodes and bounded loads.

Every shard owns many points of a hash ring; a key belongs to the next point clockwise.
No shard takes more than its capacity: what does not fit continues clockwise to the next
point whose shard has room.  Capacities differ by at most one row and sum to the number of
rows, so shard sizes do, too; only the overflow leaves the shard of its arc.

The walk around the ring needs the number of keys of each arc only: one row with
``shards x points`` counts, whatever the data.  Places inside an arc are found in two
levels (cells of an arc, then keys of a cell), so no arc is sorted in one task.  Equal rows
are counted before they are shuffled, and their runs are cut before they are written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize

_RING_BITS = 60
#: Leading bits of a position that tell which part of the ring it lies in.
_PART_BITS = 12
#: Equal rows that are placed together; more of them are several runs.
_RUN = 4_096


def position(key: Column) -> Column:
    """The key's place on the ring, 0 to 2^60 - 1; NULL keys share one place."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def ring(spark: SparkSession, shards: int, points: int) -> DataFrame:
    """``arc, shard, low, high`` with arcs numbered clockwise; arc 0 wraps around and has two rows."""
    nodes = (
        spark.range(shards)
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .select(
            F.col("id").cast("int").alias("shard"),
            position(F.concat_ws("-", F.lit("shard"), F.col("id"), F.col("point"))).alias("high"),
        )
    )
    order = Window.orderBy("high", "shard")
    arcs = nodes.select(
        (F.row_number().over(order) - 1).cast("int").alias("arc"),
        "shard",
        (F.coalesce(F.lag("high").over(order), F.lit(-1)) + 1).alias("low"),
        "high",
        F.max("high").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"),
    )
    top = F.lit((1 << _RING_BITS) - 1).cast("bigint")
    wrap = arcs.where("arc = 0").select("arc", "shard", (F.col("last") + 1).alias("low"), top.alias("high"))
    return arcs.drop("last").unionByName(wrap).where("low <= high")


def _parts(arcs: DataFrame) -> DataFrame:
    """Arcs cut at the borders of the ring's parts, for an equality join on the part."""
    shift = _RING_BITS - _PART_BITS
    part = F.explode(F.sequence(F.shiftright("low", shift), F.shiftright("high", shift)))
    return arcs.select("arc", "low", "high", part.alias("part"))


# One step per point, two rounds.  A point first serves its own keys, then those that wait,
# oldest first; what it cannot serve of its own joins the waiting ones.  In the second round
# there are only waiting ones, and every shard with room is passed, so all are served.
_OWN = "least(n[i], s.room[shard[i]])"
_SERVED = f"least(s.room[shard[i]] - {_OWN}, s.waiting)"
_WALK = f"""
aggregate(sequence(0, size(shard) - 1),
  named_struct('room', room, 'waiting', 0L, 'served', 0L,
    'steps', CAST(array() AS array<struct<own:bigint, queued:bigint, served:bigint, before:bigint, slot:bigint>>)),
  (s, i) -> named_struct(
    'room', transform(s.room, (x, k) -> IF(k = shard[i], x - {_OWN} - {_SERVED}, x)),
    'waiting', s.waiting - {_SERVED} + n[i] - {_OWN},
    'served', s.served + {_SERVED},
    'steps', concat(s.steps, array(named_struct(
      'own', {_OWN}, 'queued', s.served + s.waiting, 'served', {_SERVED}, 'before', s.served,
      'slot', room[shard[i]] - s.room[shard[i]])))),
  s -> s.steps)
"""


def walk(counts: DataFrame, shards: int) -> DataFrame:
    """Arc counts ``arc, shard, n`` to segments ``arc, first, after, shard, slot``.

    Keys of an arc from rank ``first`` up to, but without, rank ``after`` lie in ``shard`` from
    ``slot`` on.  Works on one row of arrays whose length is set by the ring, not by the data.
    """
    rows = F.array_sort(F.collect_list(F.struct("arc", "shard", "n")))
    one = (
        counts.agg(rows.alias("r"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
        .withColumn("shard", F.expr("concat(r.shard, r.shard)"))
        .withColumn("n", F.expr("concat(r.n, transform(r.n, x -> 0L))"))
        .withColumn(
            "room",
            F.expr(f"transform(sequence(0, {shards - 1}), k -> total div {shards} + IF(k < total % {shards}, 1L, 0L))"),
        )
    )
    arcs = F.expr("size(shard) div 2").alias("arcs")
    steps = materialize(
        one.select("n", "shard", arcs, F.posexplode(F.expr(_WALK)).alias("i", "step")).select(
            (F.col("i") % F.col("arcs")).alias("arc"),
            F.expr("n[i]").alias("n"),
            F.expr("shard[i]").alias("shard"),
            "step.*",
        ),
        "ring-steps",
    )
    own = steps.where("own > 0").select(
        "arc", F.lit(0).cast("bigint").alias("first"), F.col("own").alias("after"), "shard", "slot"
    )
    # where a queue of overflowing keys and the steps that serve it are cut by each other's borders
    queued = steps.where("n > own").select(
        F.col("queued").alias("at"),
        F.struct("arc", "own", "queued").alias("q"),
        F.lit(None).cast("struct<shard:int,slot:bigint,before:bigint>").alias("t"),
        (F.col("queued") + F.col("n") - F.col("own")).alias("end"),
    )
    taken = steps.where("served > 0").select(
        F.col("before").alias("at"),
        F.lit(None).cast("struct<arc:int,own:bigint,queued:bigint>").alias("q"),
        F.struct("shard", (F.col("slot") + F.col("own")).alias("slot"), "before").alias("t"),
        (F.col("before") + F.col("served")).alias("end"),
    )
    order = Window.orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = (
        queued.unionByName(taken)
        .select(
            "at",
            F.last("q", ignorenulls=True).over(so_far).alias("q"),
            F.last("t", ignorenulls=True).over(so_far).alias("t"),
            F.coalesce(F.lead("at").over(order), F.max("end").over(whole)).alias("end"),
        )
        .where("end > at")
        .selectExpr(
            "q.arc",
            "q.own + at - q.queued AS first",
            "q.own + end - q.queued AS after",
            "t.shard",
            "t.slot + at - t.before AS slot",
        )
    )
    return own.unionByName(moved)


def assign(keys: DataFrame, shards: int = 16, points: int = 64) -> DataFrame:
    """``key`` and any further columns to the same plus ``shard, slot``; a row per row.

    ``slot`` counts from 0 without gaps in each shard.  Equal rows are alike: which of them
    gets which place is not told apart.  NULL keys are a key.  The result depends on the
    rows only, not on their order or partitions.  An empty table gives an empty result.
    """
    spark = keys.sparkSession
    columns = keys.columns
    arcs = materialize(ring(spark, shards, points), "ring")
    # 2^12 parts and shards x points arcs: a bound set by the parameters
    parts = F.broadcast(_parts(arcs).withColumnsRenamed({"arc": "_arc", "low": "_low", "high": "_high", "part": "_part"}))
    classes = (
        keys.groupBy(*columns)
        .agg(F.count("*").alias("_n"))
        .withColumn("_at", position(F.col("key")))
        .withColumn("_part", F.shiftright("_at", _RING_BITS - _PART_BITS))
        .join(parts, "_part")
        .where("_at BETWEEN _low AND _high")
        .drop("_part", "_low", "_high")
    )
    # a long run of equal rows goes on as pieces, which other cells and so other tasks take
    classes = classes.withColumn("_piece", F.explode(F.expr(f"sequence(0, (_n - 1) div {_RUN})"))).withColumn(
        "_n", F.least(F.lit(_RUN).cast("bigint"), F.col("_n") - F.col("_piece") * _RUN)
    )
    classes = materialize(classes.withColumn("_mix", F.xxhash64(*columns)), "ring-keys")
    # a cell has about as many keys as an arc has cells
    cells = int((classes.count() / (shards * points)) ** 0.5) + 1
    cell = F.pmod(F.pmod("_mix", F.lit(cells)) + F.col("_piece"), F.lit(cells))
    classes = classes.withColumn("_cell", cell)
    per_cell = materialize(classes.groupBy("_arc", "_cell").agg(F.sum("_n").alias("n")), "cells")
    before = Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        per_cell.select(
            F.col("_arc").alias("a"), F.col("_cell").alias("c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
        ),
        "cell-starts",
    )
    counts = (
        arcs.groupBy("arc")
        .agg(F.first("shard").alias("shard"))
        .join(per_cell.groupBy(F.col("_arc").alias("arc")).agg(F.sum("n").alias("n")), "arc", "left")
        .fillna(0, ["n"])
    )
    segments = materialize(walk(counts, shards), "segments")
    inside = Window.partitionBy("_arc", "_cell").orderBy("_mix", *columns, "_piece").rowsBetween(Window.unboundedPreceding, -1)
    ranked = classes.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    ranked = ranked.join(starts, (F.col("_arc") == F.col("a")) & (F.col("_cell") == F.col("c"))).withColumn(
        "_rank", F.col("start") + F.col("_in")
    )
    # a run of equal rows meets the segments it overlaps; at most three a point, set by the ring
    found = ranked.join(
        F.broadcast(segments.withColumnRenamed("arc", "_s").withColumnRenamed("slot", "_slot")),
        (F.col("_arc") == F.col("_s")) & (F.col("_rank") < F.col("after")) & (F.col("_rank") + F.col("_n") > F.col("first")),
    )
    low, high = F.greatest("_rank", "first"), F.least(F.col("_rank") + F.col("_n"), F.col("after"))
    return found.select(
        *columns,
        "shard",
        F.explode(F.sequence(F.col("_slot") + low - F.col("first"), F.col("_slot") + high - F.col("first") - 1)).alias("slot"),
    )


def place(docs: DataFrame, id_col: str = "doc_id", shards: int = 16, points: int = 64) -> DataFrame:
    """All rows and columns of ``docs`` plus ``shard, slot``; an older ``shard`` or ``slot`` column is replaced.

    The key is the id.  Equal rows are moved once and repeated where they are written.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"))
    keyed = row.select("_row", F.col("_row")[id_col].alias("key"), F.xxhash64("_row").alias("mark"))
    placed = assign(keyed.select("key", "mark"), shards, points).withColumnsRenamed({"key": "_key", "mark": "_mark"})
    distinct = keyed.dropDuplicates(["key", "mark"])
    return distinct.join(
        placed, F.col("key").eqNullSafe(F.col("_key")) & (F.col("mark") == F.col("_mark"))
    ).select("_row.*", "shard", "slot")
