"""Isolation forest: sampling and node tables in Spark, one small tree per task.

Every tree sees at most ``tree_rows`` transfers, so no group grows with the
data.  A tree is stored as a complete binary tree: ``2^depth - 1`` splits and
``2^depth`` leaves.  A branch that ends early repeats its leaf, which lets the
scorer walk all rows of an Arrow batch down one level at a time without
branching.  The forest has ``trees * 2^depth`` entries however many transfers
there are, which bounds what is sent to the executors.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import Config

# functions travel with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EULER = 0.5772156649015329
_CHUNK = 10_000  # rows walked together: an Arrow batch of the usual size
_TOP_LEVELS = 3  # levels of a tree whose nodes are compared with all rows
_NODES = "tree int, feature array<int>, threshold array<float>, path array<double>"


def mean_path(n: int | float) -> float:
    """Average depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def feature_array(features: tuple[str, ...]) -> Column:
    """Features as array<float>, NULL read as 0."""
    return F.array(*[F.coalesce(F.col(f).cast("float"), F.lit(0.0).cast("float")) for f in features])


def training_rows(labeled: DataFrame, cfg: Config, row_key: Column) -> DataFrame:
    """(key, x) of the transfers that no rule hits."""
    return labeled.where(F.col("hit_any_rule") == 0).select(
        row_key.alias("key"), feature_array(cfg.features).alias("x")
    )


def file_row_key() -> Column:
    """Identity of a row in a stored Parquet table; equal rows stay distinct."""
    return F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def _share(*parts: Column) -> Column:
    """Uniform number in [0, 1) that depends only on its inputs."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def sample_for_trees(rows: DataFrame, n: int, cfg: Config) -> DataFrame:
    """(tree, rank, x) with ``min(tree_rows, n)`` rows per tree, by one rule for every ``n``.

    Each tree is offered half as many rows again as it needs.  For that a row has
    ``copies`` chances (one, once there are enough rows), each for another tree: the
    trees follow from the row's hash in steps that share no divisor with their number.
    A chance passes by a hash, inside the scan; only those that pass are shuffled and
    ranked.  Rows are told apart by their key, so neither partitioning nor a retried
    task changes the sample.
    """
    wanted = 1.5 * cfg.trees * cfg.tree_rows
    copies = max(1, min(cfg.trees, math.ceil(wanted / n)))
    share = min(1.0, wanted / (n * copies))
    seed = F.lit(cfg.seed)
    steps = [k for k in range(1, cfg.trees + 1) if math.gcd(k, cfg.trees) == 1]
    step = F.element_at(
        F.array(*[F.lit(k) for k in steps]),
        (F.pmod(F.xxhash64("key", seed, F.lit("step")), F.lit(len(steps))) + 1).cast("int"),
    )
    first = F.pmod(F.xxhash64("key", seed, F.lit("tree")), F.lit(cfg.trees))
    passed = F.filter(
        F.sequence(F.lit(0), F.lit(copies - 1)), lambda c: _share(F.col("key"), c, seed) < share
    )
    candidates = (
        rows.withColumns({"_first": first, "_step": step})
        .withColumn("_copy", F.explode(passed))
        .select(
            "key", "x", F.pmod(F.col("_first") + F.col("_step") * F.col("_copy"), F.lit(cfg.trees)).alias("tree")
        )
    )
    ranked = candidates.withColumn("rank", F.xxhash64("key", "tree", seed, F.lit("rank")))
    lowest = (
        ranked.groupBy(F.col("tree").cast("int").alias("tree"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "key", "x"))).alias("picked"))
        .select("tree", F.explode(F.slice("picked", 1, cfg.tree_rows)).alias("p"))
    )
    return lowest.select("tree", "p.rank", "p.x")


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int):
    splits, leaves = (1 << depth) - 1, 1 << depth
    feature = np.zeros(splits, dtype=np.int32)
    threshold = np.full(splits, np.inf, dtype=np.float32)
    path = np.zeros(leaves)
    stack = [(0, 0, x)]
    while stack:
        node, level, part = stack.pop()
        low, high = (part.min(0), part.max(0)) if len(part) else (None, None)
        usable = np.flatnonzero(high > low) if len(part) > 1 else ()
        if level == depth or len(usable) == 0:
            # an infinite threshold sends every row left, down to this leaf
            leaf = ((node + 1) << (depth - level)) - (1 << depth)
            path[leaf] = level + mean_path(len(part))
            continue
        f = int(rng.choice(usable))
        cut = np.float32(rng.uniform(low[f], high[f]))
        if cut >= high[f]:
            cut = low[f]
        feature[node], threshold[node] = f, cut
        right = part[:, f] > cut
        stack.append((2 * node + 2, level + 1, part[right]))
        stack.append((2 * node + 1, level + 1, part[~right]))
    return feature, threshold, path


def grow_trees(sample: DataFrame, cfg: Config, rows_per_tree: int) -> DataFrame:
    """Node table with one row per tree."""
    depth = max(1, math.ceil(math.log2(max(2, rows_per_tree))))
    seed = cfg.seed

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", kind="stable")
        tree = int(group["tree"].iloc[0])
        grown = _grow(np.stack(group["x"].to_numpy()), np.random.default_rng([seed, tree]), depth)
        return pd.DataFrame([(tree, *(a.tolist() for a in grown))],
                            columns=["tree", "feature", "threshold", "path"])

    return sample.groupBy("tree").applyInPandas(build, _NODES)


def _merged(moments: Iterator[tuple[int, np.ndarray, np.ndarray]], width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and sums of squared deviations of all parts, from those of each; equal means stay exactly equal."""
    n, mean, m2 = 0, np.zeros(width), np.zeros(width)
    for k, part_mean, part_m2 in moments:
        if k:
            off, total = part_mean - mean, n + k
            mean = mean + off * (k / total)
            m2 = m2 + part_m2 + off * off * (n * (k / total))
            n = total
    return n, mean, m2


def scaler_stats(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Mean and population deviation per feature, and the number of rows; the scale of a constant is 1.

    Rows are reduced batch by batch, all features at once, to one row a task: as aggregates of Spark, the
    features would need too many columns for generated code.
    """
    width = len(features)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
                    mean = x.mean(axis=0)
                    yield len(x), mean, np.square(x - mean).sum(axis=0)

        n, mean, m2 = _merged(each(), width)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "mean": [mean.tolist()], "m2": [m2.tolist()]})

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (p for batch in batches for p in batch.to_pylist())
        n, mean, m2 = _merged(((p["n"], np.array(p["mean"]), np.array(p["m2"])) for p in parts), width)
        known = n > 0
        yield pa.RecordBatch.from_pydict(
            {
                "feature": list(features),
                "mean": pa.array(mean.tolist() if known else [None] * width, pa.float64()),
                "std": pa.array(np.sqrt(m2 / n).tolist() if known else [None] * width, pa.float64()),
                "rows": pa.array([n] * width, pa.int64()),
            }
        )

    nothing = F.array(*[F.lit(0.0)] * width)
    # a part without rows, so that an empty table has an answer too
    empty = rows.sparkSession.range(0, 1, 1, 1).select(F.lit(0).cast("bigint").alias("n"), nothing.alias("mean"), nothing.alias("m2"))
    parts = rows.select("x").mapInArrow(moments, "n bigint, mean array<double>, m2 array<double>").unionByName(empty)
    # one row a task meets here
    return (
        parts.repartition(1)
        .mapInArrow(told, "feature string, mean double, std double, rows bigint")
        .withColumn("scale", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))
        .select("feature", "mean", "scale", "rows")
    )


@dataclass(frozen=True)
class Forest:
    """Node tables as arrays, small enough for any driver: trees * 2^depth entries."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    rows_per_tree: int

    @classmethod
    def from_nodes(cls, nodes: DataFrame, rows_per_tree: int) -> Forest:
        table = nodes.orderBy("tree").toPandas()
        stack = {c: np.stack(table[c].to_numpy()) for c in ("feature", "threshold", "path")}
        return cls(
            stack["feature"].astype(np.intp),
            stack["threshold"].astype(np.float32),
            stack["path"].astype(np.float64),
            rows_per_tree,
        )


def _first_levels(columns: np.ndarray, feature: np.ndarray, threshold: np.ndarray, levels: int) -> np.ndarray:
    """Position of every row among the nodes below the first ``levels`` levels of one tree.

    So few nodes are compared with all rows at once; a row then picks its own node's answer
    by the answers above it, the nearest one first.
    """
    answers: list[np.ndarray] = []
    place = np.zeros(columns.shape[1], dtype=np.intp)
    for level in range(levels):
        first = (1 << level) - 1
        bits = [columns[feature[i]] > threshold[i] for i in range(first, 2 * first + 1)]
        for above in reversed(answers):
            bits = [left ^ ((left ^ right) & above) for left, right in zip(bits[::2], bits[1::2])]
        answers.append(bits[0])
        place += place
        place += bits[0]
    return place


def anomaly(
    trees: tuple[np.ndarray, np.ndarray, np.ndarray], norm: float, x: np.ndarray
) -> np.ndarray:
    """2^(-E[path] / c(n)): near 1 for outliers, below 0.5 for the crowd."""
    depth = trees[2].shape[1].bit_length() - 1
    top = min(_TOP_LEVELS, depth)
    total = np.zeros(len(x))
    for start in range(0, len(x), _CHUNK):
        # a column per feature, so that neighbouring rows at one node read neighbouring values
        columns = np.ascontiguousarray(x[start : start + _CHUNK].T)
        n = columns.shape[1]
        values, base, sums = columns.ravel(), np.arange(n), total[start : start + n]
        at = np.empty_like(base)
        value, cut = np.empty((2, n), dtype=values.dtype)
        above, length = np.empty(n, dtype=bool), np.empty(n)
        for feature, threshold, begin, path in zip(trees[0], trees[1], trees[0] * n, trees[2]):
            place = _first_levels(columns, feature, threshold, top)
            for level in range(top, depth):
                nodes = slice((1 << level) - 1, (2 << level) - 1)
                # "clip" skips the bounds check; every index is in range anyway
                np.take(begin[nodes], place, out=at, mode="clip")
                at += base
                np.take(values, at, out=value, mode="clip")
                np.take(threshold[nodes], place, out=cut, mode="clip")
                np.greater(value, cut, out=above)
                place += place
                place += above
            np.take(path, place, out=length, mode="clip")
            sums += length
    return 2.0 ** (-(total / len(trees[2])) / norm)


def raw_score(forest: Forest, spark: SparkSession, x: Column) -> Column:
    """Anomaly of the feature array ``x``; NULL where ``x`` is NULL.

    Only that array crosses to Python; the other columns stay in the JVM.
    """
    trees = (forest.feature, forest.threshold, forest.path)
    shared = spark.sparkContext.broadcast(trees)
    norm = max(mean_path(forest.rows_per_tree), 1e-12)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = shared.value
        for batch in batches:
            known = batch.is_valid().to_numpy(zero_copy_only=False)
            out = np.full(len(batch), np.nan)
            if known.any():
                values = batch.drop_null().flatten().to_numpy(zero_copy_only=False)
                out[known] = anomaly(trees, norm, values.reshape(int(known.sum()), -1))
            yield pa.array(out, mask=~known)

    return score(x)
