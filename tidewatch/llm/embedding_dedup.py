"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned so that their leading dimensions carry most of
the variance.  Two tiles are compared by adding up the products of a few leading
dimensions at a time; by Cauchy-Schwarz the rest of a product is at most the product of
the two suffix norms, so a pair whose partial sum plus that bound stays below the threshold
can never reach it, and a tile pair stops when no such pair is left.  What survives is
verified with the given components in double precision.

Tiles travel on shelves, so a vector is sent once for each shelf it may meet and not once for
each tile.  Shelves, then tiles, are compared only if the boxes of their leading dimensions
come within the distance of linked vectors.

Turning by any orthogonal matrix keeps all products, so the sample on which it is fitted
changes the time only.  Exact copies are collapsed to one weighted vector first.  A tile
pair returns a count and one tie to the least relative per vector, never its pairs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.llm.common import materialize, small
from tidewatch.llm.components import components

#: Rows of a tile at most, and vectors that the rotation is fitted on.
TILE_ROWS = 1_000
PCA_ROWS = 20_000
#: Dimensions added up between two looks at the bound.
_BLOCK = 8
#: Tiles that travel together, and the bytes that they may take as doubles.
_SHELF_TILES = 8
_SHELF_BYTES = 1 << 23
#: Turned dimensions that boxes are made of, and cuts between the root and a cell.
_LEADING = 16
_DEPTH = 10
#: Heads of shelves that one share of a label's pairs is made from.
_HEADS = 2_000
#: Allowance for rounding before the exact check.
_SLACK = 1e-6
_CHECKED = 1 << 14


_USABLE = (
    "label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0"
    " AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    " AND exists(vector, x -> x != 0)"
)


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``id, a, b`` and weighted distinct vectors ``node, label, dim, vector, weight, first_id``."""
    usable = vectors.where(_USABLE).withColumns({"a": F.xxhash64("label", "vector"), "b": F.xxhash64(F.lit("second"), F.col("label"), F.col("vector"))})
    members = materialize(usable.select("id", "a", "b"), "members")
    grouped = usable.groupBy("a", "b").agg(
        F.any_value("label").alias("label"),
        F.any_value("vector").alias("vector"),
        F.count("*").alias("weight"),
        F.min("id").alias("first_id"),
    )
    stored = materialize(
        grouped.withColumns(
            {
                "node": F.monotonically_increasing_id(),
                "dim": F.size("vector"),
                "top": F.expr("array_max(transform(vector, x -> abs(CAST(x AS DOUBLE))))"),
            }
        ),
        "classes",
    )
    return members, stored


class Axes(NamedTuple):
    """Principal axes as columns, largest variance first, and a tree of cuts in the leading dimensions.

    Node ``k`` of the tree cuts turned dimension ``at[k]`` at ``value[k]``; its children are 2k+1 and 2k+2.
    """

    turn: np.ndarray
    at: np.ndarray
    value: np.ndarray


def fitted(classes: DataFrame, rows: int = PCA_ROWS) -> dict[int, Axes]:
    """Axes by number of dimensions, from a bounded sample.  They change the time only, never a result."""
    sample = classes.select("vector").orderBy(F.xxhash64("node")).limit(rows).collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["vector"]), []).append(r["vector"])
    found = {}
    for size, values in by_size.items():
        x = unit(np.array(values, dtype=np.float64))
        turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        found[size] = Axes(turn, *_cuts(x @ turn[:, :_LEADING]))
    return found


def _cuts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the widest dimension, ``_DEPTH`` times over; a node without points cuts at zero."""
    at, value = np.zeros((1 << _DEPTH) - 1, np.int64), np.zeros((1 << _DEPTH) - 1)
    held = {0: np.arange(len(points))}
    for k in range(len(at)):
        own = held.pop(k, [])
        if len(own) < 2:
            continue
        at[k] = points[own].var(axis=0).argmax()
        along = points[own, at[k]]
        value[k] = np.median(along)
        held[2 * k + 1], held[2 * k + 2] = own[along <= value[k]], own[along > value[k]]
    return at, value


def _paths(points: np.ndarray, axes: Axes) -> np.ndarray:
    """Number of the leaf that each point falls into; its upper bits are the path from the root."""
    node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
    for _ in range(_DEPTH):
        node = 2 * node + 1 + (points[rows, axes.at[node]] > axes.value[node])
    return node - ((1 << _DEPTH) - 1)


def _halves(points: np.ndarray, limit: int) -> list[np.ndarray]:
    """Row numbers of tiles of at most ``limit`` rows, halved along the widest leading dimension."""
    open_, done = [np.arange(len(points))], []
    while open_:
        own = open_.pop()
        if len(own) <= limit:
            done.append(own)
            continue
        order = own[np.argsort(points[own, points[own].var(axis=0).argmax()], kind="stable")]
        open_ += [order[: len(order) // 2], order[len(order) // 2 :]]
    return done


def _near(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, reach: float) -> np.ndarray:
    """Which of the boxes come within the square root of ``reach`` of one box."""
    gap = np.maximum(0, np.maximum(lows - high, low - highs))
    return (gap * gap).sum(axis=1) <= reach


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Turned(NamedTuple):
    """Unit rows as given, turned, and the norms of what follows each turned dimension."""

    rows: np.ndarray
    turned: np.ndarray
    rest: np.ndarray

    def of(self, index: np.ndarray) -> Turned:
        return Turned(self.rows[index], self.turned[index], self.rest[index])


def turned(rows: np.ndarray, turn: np.ndarray) -> Turned:
    b = rows @ turn
    return Turned(rows, b, np.sqrt(np.maximum(np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1], 0)))


def linked_pairs(left: Turned, right: Turned, threshold: float):
    """Yield index arrays of the pairs of unit rows whose cosine reaches ``threshold``."""
    (_, a, rest_a), (_, b, rest_b) = left, right
    if not len(a) or not len(b):
        return
    rows, cols = np.arange(len(a)), np.arange(len(b))
    part = np.zeros((len(a), len(b)))
    size = a.shape[1]
    for at in range(0, size, _BLOCK):
        end = min(at + _BLOCK, size)
        part += a[rows, at:end] @ b[cols, at:end].T
        if end == size:
            break
        alive = part + rest_a[rows, end, None] * rest_b[cols, end][None, :] >= threshold - _SLACK
        r, c = alive.any(axis=1), alive.any(axis=0)
        if not r.any():
            return
        if r.sum() * c.sum() < 0.7 * part.size:
            rows, cols, part = rows[r], cols[c], part[np.ix_(r, c)]
    i, j = np.nonzero(part >= threshold - _SLACK)
    i, j = rows[i], cols[j]
    for at in range(0, len(i), _CHECKED):
        p, q = i[at : at + _CHECKED], j[at : at + _CHECKED]
        keep = np.einsum("ij,ij->i", left.rows[p], right.rows[q]) >= threshold
        yield p[keep], q[keep]


def _shelves(classes: DataFrame, axes: dict[int, Axes], tile_rows: int) -> DataFrame:
    """One row per shelf: up to about ``_SHELF_TILES`` tiles of one label, with the box of its leading dimensions.

    A label with many vectors is cut along the tree; a cell that is still too large is dealt
    out by the vector's number.  Inside a shelf, ``pack`` puts rows of one tile together.
    """

    def locate(batches):
        for batch in batches:
            paths = np.zeros(batch.num_rows, np.int64)
            sizes = np.asarray(batch["dim"])
            for size, known in axes.items():
                own = np.flatnonzero(sizes == size)
                if len(own):
                    flat = batch["vector"].take(pa.array(own)).flatten()
                    x = unit(np.asarray(flat, dtype=np.float64).reshape(-1, size))
                    paths[own] = _paths(x @ known.turn[:, :_LEADING], known)
            yield batch.append_column("path", pa.array(paths))

    schema = StructType([*classes.select("node", "label", "dim", "vector", "weight").schema, StructField("path", LongType())])
    placed = materialize(classes.select("node", "label", "dim", "vector", "weight").mapInArrow(locate, schema), "paths")
    # vectors of a shelf, fewer for long vectors
    held = F.least(F.lit(_SHELF_TILES * tile_rows), F.greatest(F.lit(1), F.floor(F.lit(_SHELF_BYTES / 8) / F.col("dim"))))
    in_label = (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim"))
    keys = [F.col("label").alias("_label"), F.col("dim").alias("_dim")]
    levels = materialize(
        placed.groupBy("label", "dim")
        .agg(F.count("*").alias("n"))
        .select(*keys, F.least(F.lit(_DEPTH), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / held)))).cast("int").alias("level")),
        "levels",
    )
    cut = placed.join(small(levels), in_label).withColumn("cell", F.expr(f"shiftright(path, {_DEPTH} - level)"))
    cut = materialize(cut.drop("_label", "_dim", "level", "path"), "cells")
    sizes = materialize(
        cut.groupBy("label", "dim", "cell")
        .agg(F.count("*").alias("n"))
        .select(*keys, F.col("cell").alias("_cell"), F.ceil(F.col("n") / held).cast("bigint").alias("parts")),
        "cell-sizes",
    )
    dealt = cut.join(small(sizes), in_label & (F.col("cell") == F.col("_cell"))).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts"))
    )

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = np.array(pdf["vector"].tolist(), dtype=np.float64)
        ahead = unit(matrix) @ _turn(axes, int(key[1]))[:, :_LEADING]
        tiles = _halves(ahead, tile_rows)
        order = np.concatenate(tiles)
        matrix = matrix[order]
        return pd.DataFrame(
            {
                "label": [key[0]],
                "dim": [key[1]],
                "cell": [key[2]],
                "part": [key[3]],
                "low": [ahead.min(axis=0)],
                "high": [ahead.max(axis=0)],
                "ends": [np.cumsum([len(t) for t in tiles])],
                "nodes": [pdf["node"].to_numpy()[order].astype("<i8").tobytes()],
                "weights": [pdf["weight"].to_numpy()[order].astype("<i8").tobytes()],
                "matrix": [matrix.astype("<f4" if (matrix.astype("<f4") == matrix).all() else "<f8").tobytes()],
            }
        )

    packed = dealt.groupBy("label", "dim", "cell", "part").applyInPandas(
        pack,
        f"label {classes.schema['label'].dataType.simpleString()}, dim int, cell bigint, part bigint, low array<double>, "
        "high array<double>, ends array<bigint>, nodes binary, weights binary, matrix binary",
    )
    return materialize(packed.withColumn("shelf", F.monotonically_increasing_id()), "shelves")


def _turn(axes: dict[int, Axes], size: int) -> np.ndarray:
    """A number of dimensions that the sample lacks keeps its own axes."""
    return axes[size].turn if size in axes else np.eye(size)


def _shelf_pairs(shelves: DataFrame, reach: float) -> DataFrame:
    """``left, right`` of the shelves of a label whose boxes come near enough, each pair once."""
    heads = materialize(shelves.select("shelf", "label", "dim", "low", "high"), "shelf-heads")
    # the shelves of one label are dealt out too, each meets all shares
    shares = heads.count() // _HEADS + 1
    x = heads.withColumn("share", F.pmod(F.xxhash64("shelf"), F.lit(shares))).alias("x")
    y = heads.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).alias("y")
    gaps = "zip_with(zip_with(x.low, y.high, (p, q) -> greatest(p - q, 0D)), zip_with(y.low, x.high, (p, q) -> greatest(p - q, 0D)), (p, q) -> p * p + q * q)"
    near = f"aggregate({gaps}, 0D, (s, g) -> s + g) <= {reach}"
    same = "x.label = y.label AND x.dim = y.dim AND x.share = y.share AND x.shelf <= y.shelf"
    pairs = x.join(y, F.expr(f"{same} AND {near}")).select(F.col("x.shelf").alias("left"), F.col("y.shelf").alias("right"))
    return materialize(pairs, "shelf-pairs")


def _compare(shelves: DataFrame, axes: dict[int, Axes], threshold: float) -> DataFrame:
    """``node, n, tie``: weighted links of a vector in one shelf pair, and its least relative there."""
    # unit vectors with cosine t lie within sqrt(2 - 2t) of each other
    reach = max(0.0, 2 - 2 * threshold) + _SLACK
    pairs = _shelf_pairs(shelves, reach)
    body = shelves.select("shelf", "dim", "ends", "nodes", "weights", "matrix")
    side = lambda p: body.select(*[F.col(c).alias(f"{p}_{c}") for c in body.columns])
    both = pairs.join(side("l"), F.col("left") == F.col("l_shelf")).join(side("r"), F.col("right") == F.col("r_shelf"))
    both = both.drop("l_shelf", "r_shelf", "r_dim")

    def compare(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                same, turn = row["left"] == row["right"], _turn(axes, row["l_dim"])
                left = _side(row, "l", turn)
                right = left if same else _side(row, "r", turn)
                nodes, counts, root = _links(left, right, same, threshold, reach)
                hit = counts > 0
                if hit.any():
                    yield pa.record_batch(
                        [pa.array(nodes[hit]), pa.array(counts[hit]), pa.array(nodes[root[hit]])], names=["node", "n", "tie"]
                    )

    return both.mapInArrow(compare, "node bigint, n bigint, tie bigint")


class Shelf(NamedTuple):
    nodes: np.ndarray
    weights: np.ndarray
    tiles: list[np.ndarray]
    lows: np.ndarray
    highs: np.ndarray
    vectors: Turned


def _side(row: dict, side: str, turn: np.ndarray) -> Shelf:
    nodes = np.frombuffer(row[f"{side}_nodes"], "<i8")
    packed = row[f"{side}_matrix"]
    width = len(packed) // (len(nodes) * row["l_dim"])
    matrix = np.frombuffer(packed, f"<f{width}").reshape(len(nodes), -1).astype(np.float64)
    vectors = turned(unit(matrix), turn)
    tiles = np.split(np.arange(len(nodes)), row[f"{side}_ends"][:-1])
    boxes = [vectors.turned[t, :_LEADING] for t in tiles]
    lows, highs = np.array([b.min(axis=0) for b in boxes]), np.array([b.max(axis=0) for b in boxes])
    return Shelf(nodes, np.frombuffer(row[f"{side}_weights"], "<i8"), tiles, lows, highs, vectors)


def _links(left: Shelf, right: Shelf, same: bool, threshold: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of two shelves, the weighted links of each, and the index of the least relative of each.

    Tiles are compared one pair at a time, and a pair of tiles leaves one tie for each of its
    linked rows, so memory does not grow with the number of links.
    """
    nodes = left.nodes if same else np.concatenate([left.nodes, right.nodes])
    weights = left.weights if same else np.concatenate([left.weights, right.weights])
    shift = 0 if same else len(left.nodes)
    counts, ties = np.zeros(len(nodes), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for p, rows in enumerate(left.tiles):
        near = _near(left.lows[p], left.highs[p], right.lows, right.highs, reach)
        for q in np.flatnonzero(near):
            if same and q < p:
                continue
            cols, found = right.tiles[q], []
            for i, j in linked_pairs(left.vectors.of(rows), right.vectors.of(cols), threshold):
                if same and p == q:
                    i, j = i[i < j], j[i < j]
                # places of both tiles in one row of numbers
                found.append((i.astype(np.int32), (j if same and p == q else j + len(rows)).astype(np.int32)))
            if not found:
                continue
            i, j = (np.concatenate(f) for f in zip(*found, strict=True))
            own = rows if same and p == q else np.concatenate([rows, cols + shift])
            n = np.bincount(i, weights[own[j]], len(own)) + np.bincount(j, weights[own[i]], len(own))
            counts[own] += n.astype(np.int64)
            linked = np.flatnonzero(n)
            ties.append((own[linked], own[_forest(len(own), i, j)[linked]]))
    root = _forest(len(nodes), *(np.concatenate(t) for t in zip(*ties, strict=True)))
    return nodes, counts, root


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each index's component among some links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, root[i], low)
        np.minimum.at(after, root[j], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``id, n_links, component_id, kept`` per row.

    Vectors link if their labels are equal, their lengths are equal and their cosine is at
    least ``threshold``.  NULL labels and vectors, empty and zero vectors, and such with NULL
    or non-finite components link with nothing and are kept.  ``component_id`` is the least
    id reachable by links; NULL ids count only where there is no other.  Repeated rows are
    vectors of their own.  An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    members, classes = _classes(rows)
    axes = fitted(classes)
    tied = materialize(_compare(_shelves(classes, axes, tile_rows), axes, threshold), "tied")
    roots = materialize(components(tied.select(F.col("node").alias("u"), F.col("tie").alias("v"))), "roots")
    others = materialize(tied.groupBy("node").agg(F.sum("n").alias("n")), "others")
    placed = materialize(
        classes.select("a", "b", F.col("node").alias("_node"), "weight", "first_id")
        .join(others, F.col("_node") == F.col("node"), "left")
        .drop("node")
        .join(roots, F.col("_node") == F.col("node"), "left")
        .select(
            "a",
            "b",
            "first_id",
            F.coalesce("root", "_node").alias("root"),
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        ),
        "placed",
    )
    least = materialize(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    answer = materialize(placed.join(least, "root").select("a", "b", "n_links", "component_id"), "answer")
    linked = members.join(answer, ["a", "b"]).select("id", "n_links", "component_id")
    alone = rows.where(f"NOT coalesce({_USABLE}, false)").select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
