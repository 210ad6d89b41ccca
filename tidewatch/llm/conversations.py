"""Repair of conversation structure: cheapest edits that make the roles ``(s?(ua)+)?``.

Rows of a conversation are kept (0), given the role user or assistant (2), deleted (3) or
preceded by an inserted empty turn (2); a truncated row that stays costs 1 more, blank rows and
repetitions have to go.  Of the cheapest lists of edits the one whose initials come first is
taken.

A conversation may hold any share of all rows, so it is cut into parts of at most
``PART_ROWS`` rows in order.  The edits walk over four states (nothing yet, last role s, u, a).
A part is a 4 x 4 matrix of costs, and a scan over these matrices tells each part the cheapest
rest behind it.  Inside a part the cost table gives the optimal arcs, which are the nodes of the
ranking: the rank of an arc by the first edit of its audit is refined to 2, 4, 8, ... edits by
joining its rank with that of the arc its pointer reaches, and pointers double with it.  Each
state's arc of least rank begins its least path, which is read out through the doubled pointers.
A second scan, over where parts lead to, tells each part its first state.

Defined cases: NULL ids, turns, roles and texts are one blank wherever they are spelled, and NULL
ids are one conversation.  Rows of one turn follow each other by role, by the first 32
characters of the text and by its hash.  Equal rows are all kept in the table and repeat each
other.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize

#: Rows of a part are at most 2 to this power.
PART_BITS = 12
#: Parts whose matrices are multiplied in one group.
_FAN = 1024
_BLANKS = " \t\n\x0b\x0c\r"

_INF = 1 << 40
#: States: nothing yet, last role s, u, a.  Where an edit leads to, by state; -1 where it must not be.
_INSERT = np.array([2, 2, 3, 2])
_KEEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
_STATE = np.arange(4)
#: Edits in the order of their initials.
_DELETED, _INSERTED, _KEPT, _REROLED = range(4)
_INITIALS = np.frombuffer(b"DIKR", np.uint8)
#: Codes of rows: role initial s, u, a, other in two bits, then "must go", then "truncated".
_MUST_GO, _TRUNCATED = 4, 8
_ROLES = {"u": "user", "a": "assistant"}


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by a hash of id and turn: dropped, emptied, cut, repeated or of another role."""
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1]).cast("binary")) % 20
    text = (
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(spelled[3], "[.!?]", "")).otherwise(spelled[3])
    )
    return (
        conversations.select(
            "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(spelled[2]).alias("role"), text.alias("text"), kind.alias("k")
        )
        .where("k != 0")
        .withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .drop("k", "copy")
    )


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("~"))


def ordered(rows: DataFrame) -> DataFrame:
    """Stored rows with ``key`` and ``pos``, a number that rises along each conversation.

    Ranges of the order are sorted each on its own, so a long conversation goes to several
    tasks; the last range key tells equal rows apart, which may be very many.
    """
    order = [
        F.col("key"),
        F.col("turn").asc_nulls_first(),
        F.col("role"),
        F.substring("text", 1, 32),
        F.col("h1"),
    ]
    spread = rows.select(
        _key("conv_id").alias("key"),
        F.col("turn").cast("bigint").alias("turn"),
        "role",
        "text",
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(1), F.col("text")).alias("h2"),
        F.monotonically_increasing_id().alias("salt"),
    )
    return materialize(
        spread.repartitionByRange(*order, F.xxhash64("salt"))
        .sortWithinPartitions(*order)
        .drop("salt")
        .withColumn("pos", F.monotonically_increasing_id()),
        "conversations",
    )


def faults(rows: DataFrame) -> DataFrame:
    """``key, part, pos, turn, initial, blank, duplicate, truncated``; the first fault of a row counts.

    The first of equal rows is found by grouping and met again by its position, so a text that
    fills a conversation is no hot join key.
    """
    first = rows.groupBy("key", "role", "h1", "h2").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    shown = F.rtrim(F.col("text"), F.lit(_BLANKS))
    initial = F.substring("role", 1, 1)
    slim = rows.select(
        "key",
        F.shiftright("pos", PART_BITS).alias("part"),
        "pos",
        "turn",
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        (shown == "").alias("blank"),
        (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    repeated = ~F.col("blank") & F.col("first").isNull()
    return slim.join(first, "pos", "left").select(
        "key",
        "part",
        "pos",
        "turn",
        "initial",
        "blank",
        repeated.alias("duplicate"),
        (~F.col("blank") & F.col("first").isNotNull() & F.col("open")).alias("truncated"),
    )


def parts_of(marked: DataFrame) -> DataFrame:
    """Stored parts: ``key, part, first_pos``, the rows' codes in order, and the part's number among ``n``."""
    code = (
        F.col("initial")
        + F.when(F.col("blank") | F.col("duplicate"), _MUST_GO).otherwise(0)
        + F.when(F.col("truncated"), _TRUNCATED).otherwise(0)
    )
    rows = F.array_sort(F.collect_list(F.struct("pos", code.cast("int").alias("code"))))
    parts = marked.groupBy("key", "part").agg(F.min("pos").alias("first_pos"), rows.alias("rows"))
    by_key = Window.partitionBy("key")
    return materialize(
        parts.select(
            "key",
            "part",
            "first_pos",
            F.col("rows.code").alias("codes"),
            (F.row_number().over(by_key.orderBy("part")) - 1).cast("bigint").alias("k"),
            F.count("*").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
        ),
        "parts",
    )


# --- cost tables -------------------------------------------------------------------------


def _closed(costs: np.ndarray) -> np.ndarray:
    """Costs by state (last axis) when turns may be inserted first; more than two never pay."""
    once = costs[..., _INSERT]
    return np.minimum(np.minimum(costs, 2 + once), 4 + once[..., _INSERT])


class _Tables:
    """Costs to go of many parts at once.  Layer i of a part comes before its row i; layers are rows of ``costs``."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, ends: np.ndarray, last: np.ndarray) -> None:
        """``ends``: costs behind each part by state, ``last``: parts behind which only insertions follow."""
        self.sizes, self.last = sizes, last
        self.base = np.concatenate([[0], (sizes + 1).cumsum()])
        n_layers = self.base[-1]
        self.end = np.zeros(n_layers, bool)
        self.end[self.base[1:] - 1] = True
        self.code = np.zeros(n_layers, np.int64)
        self.code[~self.end] = codes
        wrap = (slice(None),) + (None,) * (ends.ndim - 1)
        self.costs = np.empty((n_layers, *ends.shape[1:]), np.int64)
        order = np.argsort(-sizes, kind="stable")
        self.costs[self.base[1:] - 1] = np.where(last[wrap], _closed(ends), ends)
        reach = sizes[order]
        for t in range(1, int(sizes.max(initial=0)) + 1):
            layers = self.base[1:][order[: np.searchsorted(-reach, -t, "right")]] - 1 - t
            self.costs[layers] = _closed(self._row(layers))

    def _row(self, layers: np.ndarray) -> np.ndarray:
        kept, reroled, deleted = self._options(layers)
        return np.minimum(np.minimum(kept, reroled), deleted)

    def _options(self, layers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs of keeping, changing and deleting the row behind each layer, by state."""
        behind, code = self.costs[layers + 1], self.code[layers]
        shape = (len(layers),) + (1,) * (behind.ndim - 1)
        extra = (np.where(code & _TRUNCATED, 1, 0) + np.where(code & _MUST_GO, _INF, 0)).reshape(shape)
        to = _KEEP[code & 3].reshape((len(layers),) + (1,) * (behind.ndim - 2) + (4,))
        kept = np.take_along_axis(behind, np.broadcast_to(np.maximum(to, 0), behind.shape), -1)
        kept = np.minimum(np.where(to < 0, _INF, kept + extra), _INF)
        return kept, np.minimum(behind[..., _INSERT] + 2 + extra, _INF), np.minimum(behind + 3, _INF)

    def starts(self) -> np.ndarray:
        return self.costs[self.base[:-1]]

    def arcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Optimal arcs as (node, edit, next node), by node and edit; node = 4 * layer + state."""
        inner = np.flatnonzero(~self.end)
        some = self.costs[inner]
        found = []
        for edit, cost, to in zip(
            (_KEPT, _REROLED, _DELETED),
            self._options(inner),
            (_KEEP[self.code[inner] & 3], np.broadcast_to(_INSERT, some.shape), np.broadcast_to(_STATE, some.shape)),
            strict=True,
        ):
            at, state = np.nonzero((cost == some) & (some < _INF))
            found.append((4 * inner[at] + state, np.full(len(at), edit), 4 * (inner[at] + 1) + to[at, state]))
        open_layer = ~self.end
        open_layer[(self.base[1:] - 1)[self.last]] = True
        at, state = np.nonzero((2 + self.costs[:, _INSERT] == self.costs) & (self.costs < _INF) & open_layer[:, None])
        found.append((4 * at + state, np.full(len(at), _INSERTED), 4 * at + _INSERT[state]))
        node, edit, to = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((edit, node))
        return node[order], edit[order], to[order]


def least_paths(
    n_nodes: int, node: np.ndarray, edit: np.ndarray, to: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Arcs of the path with the least edits from each start, behind each other, and where each path ends.

    Arcs are sorted by node and edit.  Arcs of one node differ in their edits, so the first is the
    one that a pointer follows.
    """
    n = len(node)
    none = n  # the arc behind the last one; its rank is below all others
    first = np.full(n_nodes, none)
    first[node[::-1]] = np.arange(n)[::-1]
    jump = np.append(first[to], none)
    rank = np.append(edit + 1, 0)
    length = np.append(np.ones(n, np.int64), 0)
    jumps = []
    while (jump != none).any():
        jumps.append(jump)
        rank = np.unique(rank * (n + 2) + rank[jump], return_inverse=True)[1]  # the end alone stays 0
        length = length + length[jump]
        jump = jump[jump]
    jumps.append(jump)
    order = np.lexsort((rank[:-1], node))
    best = np.full(n_nodes, none)
    best[node[order][::-1]] = order[::-1]
    begin = best[starts]
    lengths = length[begin]
    ends = lengths.cumsum()
    step = np.arange(lengths.sum()) - np.repeat(ends - lengths, lengths)
    path = np.repeat(begin, lengths)
    for k, jump in enumerate(jumps):
        far = (step >> k) & 1 == 1
        path[far] = jump[path[far]]
    return path, ends


# --- scans over the parts of long conversations ------------------------------------------


def _times(row: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return np.minimum((row[..., :, None] + matrix).min(axis=-2), _INF)


def _matrices(frame: pd.DataFrame) -> list[np.ndarray]:
    ordered_frame = frame.sort_values("k")
    return [np.array(m, np.int64).reshape(4, 4) for m in ordered_frame["m"]]


def _scan(parts: DataFrame, start: list[int], longest: int) -> DataFrame:
    """``key, k, v``: ``start`` times the matrices before number k of the key, costs added and minima taken.

    ``parts`` has ``key, k, m`` with numbers below ``longest``.  Groups hold at most ``_FAN`` parts:
    their products are scanned first, then each group goes on from its own start.
    """
    from_key = longest <= _FAN

    def go_on(frame: pd.DataFrame) -> pd.DataFrame:
        now = np.array(start if from_key else frame["v"].iloc[0], np.int64)
        out = []
        for m in _matrices(frame):
            out.append(now.tolist())
            now = _times(now, m)
        return pd.DataFrame({"key": frame["key"].iloc[0], "k": sorted(frame["k"]), "v": out})

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        now = np.where(np.eye(4, dtype=bool), 0, _INF)
        for m in _matrices(frame):
            now = _times(now, m)
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "k": [frame["g"].iloc[0]], "m": [now.ravel().tolist()]})

    schema = "key string, k bigint, v array<bigint>"
    if from_key:
        return parts.groupBy("key").applyInPandas(go_on, schema)
    grouped = parts.withColumn("g", F.floor(F.col("k") / _FAN).cast("bigint"))
    above = materialize(grouped.groupBy("key", "g").applyInPandas(product, "key string, k bigint, m array<bigint>"), "products")
    before = materialize(_scan(above, start, -(-longest // _FAN)), "scanned").withColumnRenamed("k", "g")
    return grouped.join(before, ["key", "g"]).groupBy("key", "g").applyInPandas(go_on, schema)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _part_matrices(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's costs from its first state (row) to its last one (column), transposed as the scan goes backwards."""
    unit = np.where(np.eye(4, dtype=bool), 0, _INF)
    for f in frames:
        codes = f.column("codes")
        sizes = np.diff(codes.offsets.to_numpy())
        # one cost table for each last state: axis 1
        tables = _Tables(_flat(codes), sizes, np.broadcast_to(unit, (len(sizes), 4, 4)), np.zeros(len(sizes), bool))
        yield pa.RecordBatch.from_arrays(
            [f.column("key"), f.column("k"), pa.array(tables.starts().reshape(-1, 16).tolist(), pa.list_(pa.int64()))],
            ["key", "k", "m"],
        )


def _solved(f: pa.RecordBatch, starts: np.ndarray | None) -> tuple:
    """Tables, arcs and least paths of parts from ``starts``, or from all four states."""
    codes = f.column("codes")
    sizes = np.diff(codes.offsets.to_numpy())
    last = np.array(f.column("last").to_pylist(), bool)
    tables = _Tables(_flat(codes), sizes, _flat(f.column("v")).reshape(-1, 4), last)
    node, edit, to = tables.arcs()
    begin = 4 * tables.base[:-1, None] + (_STATE[None, :] if starts is None else starts[:, None])
    path, ends = least_paths(4 * tables.base[-1], node, edit, to, begin.ravel())
    return tables, node, edit, to, path, ends, begin.ravel()


def _part_functions(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which state each first state's least path leads to, as a matrix of 0 and infinity."""
    for f in frames:
        tables, _, _, to, path, ends, begin = _solved(f, None)
        lengths = np.diff(ends, prepend=0)
        final = begin % 4
        final[lengths > 0] = to[path[ends[lengths > 0] - 1]] % 4
        m = np.where(final.reshape(-1, 4)[:, :, None] == _STATE, 0, _INF)
        yield pa.RecordBatch.from_arrays(
            [f.column("key"), f.column("k"), pa.array(m.reshape(-1, 16).tolist(), pa.list_(pa.int64()))], ["key", "k", "m"]
        )


_EDITS = (
    "key string, part bigint, first_pos bigint, k bigint, cost bigint, audit string, fates string, inserted array<string>, "
    "first int, last int, illegal bigint"
)


def _part_edits(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least path of each part: its audit, every row's fate and the turns inserted before each row and at the end."""
    legal = np.zeros((4, 4), bool)
    legal[[0, 1, 2], [1, 2, 1]] = True
    for f in frames:
        starts = np.array(f.column("start").to_pylist(), np.int64)
        tables, node, edit, to, path, ends, _ = _solved(f, starts)
        edits, states, layers = edit[path], to[path] % 4, node[path] // 4
        audit = _INITIALS[edits].tobytes().decode()
        letters = np.array(list("?sua"))[states]
        fates = np.full(tables.base[-1], "-")
        fates[layers[edits == _KEPT]] = "="
        fates[layers[edits == _REROLED]] = letters[edits == _REROLED]
        inserted = np.full(tables.base[-1], "", object)
        for at in np.flatnonzero(edits == _INSERTED):
            inserted[layers[at]] += letters[at]
        begins = np.concatenate([[0], ends[:-1]])
        first, stop = tables.base[:-1], tables.base[1:]
        initials = tables.code & 3
        wrong = np.concatenate([~legal[initials[:-1], initials[1:]] & ~tables.end[:-1] & ~tables.end[1:], [False]])
        illegal = np.add.reduceat(wrong.astype(np.int64), first) if len(first) else []
        yield pa.RecordBatch.from_arrays(
            [
                *[f.column(c) for c in ("key", "part", "first_pos", "k")],
                pa.array(tables.starts()[np.arange(len(starts)), starts], pa.int64()),
                pa.array([audit[x:y] for x, y in zip(begins, ends, strict=True)], pa.string()),
                pa.array(["".join(fates[x : y - 1].tolist()) for x, y in zip(first, stop, strict=True)], pa.string()),
                pa.array([inserted[x:y].tolist() for x, y in zip(first, stop, strict=True)], pa.list_(pa.string())),
                pa.array(initials[first], pa.int32()),
                pa.array(initials[stop - 2], pa.int32()),
                pa.array(illegal, pa.int64()),
            ],
            ["key", "part", "first_pos", "k", "cost", "audit", "fates", "inserted", "first", "last", "illegal"],
        )


def edits_of(parts: DataFrame) -> DataFrame:
    """Stored edits of every part; parts of long conversations learn their surroundings by two scans."""
    accepted = F.array(*[F.lit(c).cast("bigint") for c in (0, _INF, _INF, 0)])
    ready = parts.where("n = 1").select("*", accepted.alias("v"), F.lit(True).alias("last"), F.lit(0).cast("bigint").alias("start"))
    long = parts.where("n > 1")
    longest = long.agg(F.max("n")).first()[0]
    if longest:
        m = long.select("key", (F.col("n") - 1 - F.col("k")).alias("k"), "codes").mapInArrow(
            _part_matrices, "key string, k bigint, m array<bigint>"
        )
        rest = _scan(materialize(m, "matrices"), _closed(np.array([0, _INF, _INF, 0])).tolist(), longest)
        rest = rest.withColumnRenamed("k", "back")
        # the last part inserts its own trailing turns, so it gets the plain costs of stopping
        known = long.withColumn("back", F.col("n") - 1 - F.col("k")).join(rest, ["key", "back"]).drop("back")
        known = known.withColumn("last", F.col("k") == F.col("n") - 1)
        known = materialize(known.withColumn("v", F.when(F.col("last"), accepted).otherwise(F.col("v"))), "known")
        functions = known.select("key", "k", "codes", "v", "last").mapInArrow(_part_functions, "key string, k bigint, m array<bigint>")
        begins = _scan(materialize(functions, "functions"), [0, _INF, _INF, _INF], longest)
        start = F.array_position(F.col("begin"), F.lit(0).cast("bigint")) - 1
        ready = ready.unionByName(
            known.join(begins.withColumnRenamed("v", "begin"), ["key", "k"]).withColumn("start", start).drop("begin")
        )
    return materialize(ready.mapInArrow(_part_edits, _EDITS), "edits")


# --- repaired conversations --------------------------------------------------------------


def _rewrite(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of rows in order; the edits of a part come right before its rows."""
    fates, inserted, first = "", [""], 0
    for f in frames:
        out: list[tuple] = []
        for key, pos, role, text, new_fates, new_inserted in zip(*(c.to_pylist() for c in f.columns[:2] + f.columns[3:]), strict=True):
            if new_fates is not None:
                fates, inserted, first = new_fates, new_inserted, pos
                continue
            at = pos - first
            out.extend((key, pos, _ROLES[r], "") for r in inserted[at])
            if fates[at] != "-":
                out.append((key, pos, _ROLES.get(fates[at], role), text))
            if at == len(fates) - 1:
                out.extend((key, pos, _ROLES[r], "") for r in inserted[-1])
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "pos", "role", "text"]
        )


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Turns of the repaired conversations ``key, pos, role, text``.

    Partitions hold whole conversations, each in its order; they are streamed, not gathered.
    """
    nothing = F.lit(None).cast("string")
    both = rows.select(
        "key", "pos", F.lit(1).alias("kind"), "role", "text", nothing.alias("fates"), F.lit(None).cast("array<string>").alias("inserted")
    ).union(edits.select("key", F.col("first_pos"), F.lit(0), nothing, nothing, "fates", "inserted"))
    return (
        both.repartition("key")
        .sortWithinPartitions("key", "pos", "kind")
        .mapInArrow(_rewrite, "key string, pos bigint, role string, text string")
    )


def _hashed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(key: str, sha) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["key", "sha"])

    now, sha = None, None
    for f in frames:
        for key, role, text in zip(*(c.to_pylist() for c in (f.column("key"), f.column("role"), f.column("text"))), strict=True):
            if key != now:
                if now is not None:
                    yield one(now, sha)
                now, sha = key, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
    if now is not None:
        yield one(now, sha)


def digests(turns: DataFrame) -> DataFrame:
    """sha256 of each conversation of :func:`repaired`, fed turn by turn: this hash knows no other order."""
    return turns.mapInArrow(_hashed, "key string, sha string")


def audit(conversations: DataFrame) -> DataFrame:
    """Counts, cost, least audit and digest of the repaired text of every damaged conversation."""
    rows = ordered(damage(conversations))
    marked = materialize(faults(rows), "faults")
    edits = edits_of(parts_of(marked))
    counts = marked.groupBy("key").agg(
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.max("turn") - F.min("turn") + 1).alias("span"),
    )
    turns = marked.select("key", "turn").distinct().groupBy("key").agg(F.count("turn").alias("turns"))
    piece = F.struct("k", "cost", "audit", "first", "last", "illegal")
    joined = edits.groupBy("key").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    between = F.zip_with(
        F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))),
        F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))),
        lambda x, y: F.when(
            (x["last"] == 0) & (y["first"] == 1) | (x["last"] == 1) & (y["first"] == 2) | (x["last"] == 2) & (y["first"] == 1), 0
        ).otherwise(1),
    )
    zero = F.lit(0).cast("bigint")
    told = joined.select(
        "key",
        F.col("p")[0]["cost"].alias("cost"),
        F.array_join("p.audit", "").alias("audit"),
        F.aggregate(F.concat("p.illegal", between.cast("array<bigint>")), zero, lambda x, y: x + y).alias("illegal"),
    )
    every = conversations.select("conv_id").distinct().withColumn("key", _key("conv_id"))
    found = every
    for side in (counts, turns, told, digests(repaired(rows, edits))):
        found = found.join(side, "key", "left")
    return found.select(
        "conv_id",
        F.coalesce(F.col("span") - F.col("turns"), zero).alias("gaps"),
        *[F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
