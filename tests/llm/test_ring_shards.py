from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import ring_shards as rs


def keys(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "key long")


def told(df):
    return sorted((str(r["key"]), r["shard"], r["slot"]) for r in df.collect())


def slow(spark, ids, shards, points):
    """Walk the ring key by key: how many keys of each arc each shard takes."""
    arcs = sorted((r["high"], r["arc"], r["shard"]) for r in rs.ring(spark, shards, points).collect() if r["high"] != (1 << 60) - 1)
    places = [r[0] for r in keys(spark, ids).select(rs.position(F.col("key"))).collect()]
    waiting = {arc: sum(1 for p in places if (p <= high and (k == 0 or p > arcs[k - 1][0])) or (k == 0 and p > arcs[-1][0])) for k, (high, arc, _) in enumerate(arcs)}
    room = [len(ids) // shards + (k < len(ids) % shards) for k in range(shards)]
    queue, took = [], Counter()
    for _ in range(2):
        for _, arc, shard in arcs:
            own = min(waiting[arc], room[shard])
            room[shard] -= own
            took[shard, arc] += own
            while queue and room[shard]:
                took[shard, queue.pop(0)] += 1
                room[shard] -= 1
            queue += [arc] * (waiting[arc] - own)
            waiting[arc] = 0
    return took


@pytest.mark.parametrize("n,shards,points", [(1000, 16, 8), (37, 5, 3), (3, 16, 4), (500, 1, 4), (2000, 7, 64)])
def test_counts_slots_and_walk(spark, n, shards, points):
    ids = [k * 7 + 1 for k in range(n)]
    rows = rs.assign(keys(spark, ids), shards, points).collect()
    assert sorted(r["key"] for r in rows) == sorted(ids)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    arcs = {r["arc"]: r["shard"] for r in rs.ring(spark, shards, points).collect()}
    parts = rs.ring(spark, shards, points)
    homes = {r["key"]: r["arc"] for r in keys(spark, ids).join(parts, rs.position(F.col("key")).between(F.col("low"), F.col("high"))).collect()}
    assert Counter((r["shard"], homes[r["key"]]) for r in rows) == +slow(spark, ids, shards, points)
    # only overflow leaves its own shard
    stays = sum(arcs[homes[r["key"]]] == r["shard"] for r in rows)
    natural = Counter(arcs[homes[i]] for i in ids)
    assert stays <= sum(min(natural[k], -(-n // shards)) for k in range(shards))


def test_same_rows_same_result(spark):
    ids = list(range(300))
    a = told(rs.assign(keys(spark, ids).repartition(7), 6))
    assert a == told(rs.assign(keys(spark, ids[::-1]).coalesce(1), 6))


def test_repeated_and_null_keys(spark):
    ids = [5] * 400 + [None] * 100 + list(range(10, 110))
    rows = rs.assign(keys(spark, ids), 8).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert Counter(r["key"] for r in rows) == Counter(ids)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


@pytest.mark.parametrize("run", [7, 4_096])
def test_hot_key_is_cut_into_runs(spark, monkeypatch, run):
    """A third of all rows share a key; the walk by arcs is the same, whatever the length of a run."""
    monkeypatch.setattr(rs, "_RUN", run)
    n = 300 if run == 7 else 15_000
    ids = [5] * n + list(range(10, 10 + 2 * n))
    rows = rs.assign(keys(spark, ids), 6, 8).collect()
    assert Counter(r["key"] for r in rows) == Counter(ids)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(ids) // 6)) for s in slots.values()) and len(slots) == 6
    parts = rs.ring(spark, 6, 8)
    near = rs.position(F.col("key")).between(F.col("low"), F.col("high"))
    homes = {r["key"]: r["arc"] for r in keys(spark, sorted(set(ids))).join(parts, near).collect()}
    assert Counter((r["shard"], homes[r["key"]]) for r in rows) == +slow(spark, ids, 6, 8)
    assert told(rs.assign(keys(spark, ids[::-1]).repartition(5), 6, 8)) == told(rs.assign(keys(spark, ids), 6, 8))


def test_one_more_shard_moves_a_limited_share(spark):
    ids = list(range(6000))
    a = {r["key"]: r["shard"] for r in rs.assign(keys(spark, ids), 16).collect()}
    b = {r["key"]: r["shard"] for r in rs.assign(keys(spark, ids), 17).collect()}
    moved = sum(a[k] != b[k] for k in ids)
    assert moved < 0.4 * len(ids)  # dealing out by a remainder moves 16 of 17


def test_place_keeps_rows_and_columns(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, None, "y"), (2, "", None), (1, "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    docs = docs.withColumns({"shard": F.lit("old"), "_row": F.lit(1), "mark": F.lit(2)})
    got = rs.place(docs, shards=2)
    assert got.columns == ["doc_id", "text", "key", "_row", "mark", "shard", "slot"]
    assert sorted(map(str, [(r["doc_id"], r["text"], r["key"]) for r in got.collect()])) == sorted(map(str, rows))
    assert sorted(Counter(r["shard"] for r in got.collect()).values()) == [2, 3]


def test_empty_table(spark):
    assert rs.assign(keys(spark, [])).collect() == []
    assert rs.place(spark.createDataFrame([], "doc_id long, text string")).collect() == []
