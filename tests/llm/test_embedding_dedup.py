import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<double>, label int"


def slow(rows, threshold=0.93):
    """All pairs, in double precision."""
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        (_, a, x), (_, b, y) = rows[i], rows[j]
        if x is None or x != y or not good(a) or not good(b) or len(a) != len(b):
            continue
        a, b = np.array(a, float), np.array(b, float)
        if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
            n[i], n[j] = n[i] + 1, n[j] + 1
            root[find(i)] = find(j)
    best = {}
    for i, (id_, _, _) in enumerate(rows):
        if id_ is not None:
            best[find(i)] = min(best.get(find(i), id_), id_)
    return sorted((str(r[0]), n[i], best.get(find(i)), r[0] == best.get(find(i))) for i, r in enumerate(rows))


def told(df):
    return sorted((str(r["id"]), r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


def clustered(rng, n, dim=24, labels=3):
    centres = rng.normal(size=(12, dim))
    rows = []
    for k in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.02, 0.25, 0.5, 2.0])
        rows.append((k, (v * rng.uniform(0.1, 9)).tolist(), int(rng.integers(labels))))
    return rows


@pytest.mark.parametrize("tile_rows", [2, 20, 1_000])
def test_equals_all_pairs(spark, tile_rows):
    rows = clustered(np.random.default_rng(1), 300)
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(30)]  # exact copies
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(ed.near_duplicates(df, tile_rows=tile_rows)) == slow(rows)


def test_edge_rows(spark):
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, float("nan")], 0), (5, [1.0, None], 0), (6, [float("inf"), 1.0], 0),
        (7, [1.0, 0.0], None), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 0), (10, [5.0, 0.0], 0), (11, [1.0, 0.0], 1),
        (12, [1.0, 0.0, 0.0], 0), (9, [1.0, 0.0], 0), (None, [1.0, 0.01], 0), (13, [1e200, 0.0], 0), (14, [1e-200, 0.0], 0), (15, [-1.0, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumns({c: F.lit(1) for c in ("id", "node", "a", "b", "tile", "weight", "n", "component_id")})
    got = told(ed.near_duplicates(df))
    linked = {"9", "10", "None", "13", "14"}
    assert {g[0] for g in got if g[1] > 0} == linked
    assert all(g[1] == 5 and g[2] == 9 for g in got if g[0] in linked)
    assert len(got) == len(rows) and all(g[3] for g in got if g[0] not in linked)


def test_empty_table(spark):
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bound_loses_no_pair():
    rng = np.random.default_rng(3)
    a = ed.unit(rng.normal(size=(80, 40)))
    b = ed.unit(np.concatenate([a[:40] + rng.normal(size=(40, 40)) * 0.06, rng.normal(size=(30, 40))]))
    for turn in (np.eye(40), np.linalg.qr(rng.normal(size=(40, 40)))[0]):
        got = {(int(i), int(j)) for x in ed.linked_pairs(ed.turned(a, turn), ed.turned(b, turn), 0.9) for i, j in zip(*x, strict=True)}
        assert got == {(int(i), int(j)) for i, j in np.argwhere(a @ b.T >= 0.9)} and got


def test_label_of_any_type_and_floats(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [1.0, 0.1], "x"), (3, [1.0, 0.0], "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    assert told(ed.near_duplicates(df)) == [("1", 1, 1, True), ("2", 1, 1, False), ("3", 0, 3, True)]


def test_shelves_of_one_label_meet_once():
    """Cut into shelves by any borders, each pair of rows is counted once."""
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    rows = ed.unit(np.array([v for _, v, _ in clustered(rng, 240)]))
    good = np.triu(rows @ rows.T >= 0.93, 1)
    assert good.sum() > 200

    def shelf(own):
        lead = rows[own] @ axes[:, : ed._LEADING]
        tiles = ed._halves(lead, 7)
        order = np.concatenate(tiles)
        packed = {"l_nodes": own[order].astype("<i8").tobytes(), "l_weights": np.ones(len(own), "<i8").tobytes(), "l_dim": 24}
        packed |= {"l_matrix": rows[own][order].astype("<f8").tobytes(), "l_ends": list(np.cumsum([len(t) for t in tiles]))}
        return ed._side(packed, "l", axes)

    shelves = [shelf(own) for own in np.split(np.arange(240), [50, 51, 170])]
    counts = np.zeros(240, np.int64)
    for k, left in enumerate(shelves):
        for right in shelves[k:]:
            nodes, n, root = ed._links(left, right, left is right, 0.93, 0.14 + ed._SLACK)
            np.add.at(counts, nodes, n)
            assert (n[root[n > 0]] > 0).all()
    assert (counts == good.sum(axis=0) + good.sum(axis=1)).all()


def test_boxes_part_only_what_cannot_link():
    rng = np.random.default_rng(6)
    a, b = (ed.unit(rng.normal(size=(30, 8)) * [4, 3, 1, 1, 0.2, 0.2, 0.1, 0.1]) for _ in range(2))
    for i in range(30):
        near = ed._near(a[i], a[i], b, b, 0.14)
        assert not ((a[i] @ b.T >= 0.93) & ~near).any()
    assert not ed._near(a[0], a[0], -a[:1], -a[:1], 0.14).any()


def test_cuts_halve_points_and_paths_follow_them():
    rng = np.random.default_rng(7)
    points = rng.normal(size=(4_000, 4)) * [1, 5, 2, 1]
    axes = ed.Axes(np.eye(4), *ed._cuts(points))
    paths = ed._paths(points, axes)
    assert axes.at[0] == 1
    sizes = np.bincount(paths >> (ed._DEPTH - 4), minlength=16)
    assert sizes.min() > 200 and sizes.sum() == 4_000
    assert (np.bincount(paths >> (ed._DEPTH - 1)) == 2_000).all()
