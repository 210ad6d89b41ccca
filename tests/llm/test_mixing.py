import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing


def targets(sizes, weights, epochs=3.0):
    """Clamp and share out again until nothing is above."""
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in sizes if s not in capped]
        level = (total - sum(epochs * sizes[s] for s in capped)) / sum(weights[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weights[s] > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in capped else level * weights[s] for s in sizes}
        capped |= over


def slow(rows, seed=7):
    """``rows`` of (id, text, source) to (id, source, size, times) with sorting source by source."""
    sized = [(i, s, len((t or "").split())) for i, t, s in rows]
    sources = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(n for _, x, n in sized if x == s) for s in sources}
    want = targets(sizes, {s: k % 3 + 1 for k, s in enumerate(sources)})
    out = []
    for s in sources:
        whole = int(want[s] // sizes[s]) if sizes[s] else 0
        extra, at = want[s] - whole * sizes[s], 0
        classes = defaultdict(list)
        for i, x, n in sized:
            if x == s:
                classes[hashlib.md5(f"{'null' if i is None else i}:{seed}".encode()).hexdigest(), n].append(i)
        for (_, n), ids in sorted(classes.items()):
            more = extra > 0 and at + n * len(ids) / 2 <= extra
            out += [(i, s, n, (whole + more) * n) for i in ids]
            at += n * len(ids)
    return want, out


def corpus(n, sources, size=lambda k: k % 40 + 1):
    return [(k, "w " * size(k), sources(k)) for k in range(n)]


CASES = {
    "hot source": corpus(400, lambda k: "a" if k % 3 == 0 else f"s{k % 7}"),
    "small sources are capped": corpus(300, lambda k: "big" if k % 25 else f"t{k % 4}"),
    "null source and empty texts": corpus(60, lambda k: [None, "a", "é", "Z"][k % 4], lambda k: k % 5),
    "one source": corpus(10, lambda k: "a"),
    "one long text": [(1, "x " * 30_000, "a"), (2, "y", "b"), (3, "z z", "b")],
}


def frame(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return made.withColumns({c: F.lit(1) for c in ("id", "size", "h", "_row", "slice", "target", "_source")})


@pytest.mark.parametrize("name", CASES)
def test_equals_sorting(spark, name):
    want, rows = slow(CASES[name])
    got = mixing.epochs(frame(spark, CASES[name])).collect()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert r["times"] <= 3
    told = [(r["id"], r["source"], r["size"], r["size"] * r["times"]) for r in got]
    assert sorted(told, key=str) == sorted(rows, key=str)


def test_taken_words_come_near_the_target(spark):
    rows = CASES["hot source"]
    taken, want = defaultdict(int), {}
    for r in mixing.epochs(frame(spark, rows)).collect():
        taken[r["source"]] += r["size"] * r["times"]
        want[r["source"]] = r["target"]
    assert all(abs(taken[s] - want[s]) <= 20 for s in want)


def test_repeat_returns_rows_as_often(spark):
    rows = CASES["null source and empty texts"]
    docs = frame(spark, rows)
    got = mixing.repeat(docs)
    assert got.columns == docs.columns
    words = sum(len(r["text"].split()) for r in got.collect())
    assert words == sum(n for *_, n in slow(rows)[1])


def test_edge_rows(spark):
    rows = [(None, None, None), (1, "a b", "x"), (1, "a b", "x"), (None, "c", "x"), (2, "", "y")]
    got = sorted(map(str, [(r["id"], r["source"], r["size"], r["size"] * r["times"]) for r in mixing.epochs(frame(spark, rows)).collect()]))
    assert got == sorted(map(str, slow(rows)[1]))


def test_nothing_to_mix(spark):
    assert mixing.epochs(frame(spark, CASES["one source"]).where("false")).collect() == []
    assert mixing.repeat(frame(spark, CASES["one source"]).where("false")).collect() == []
    only_empty = [(1, "", "a"), (2, None, "b")]
    assert {r["target"] for r in mixing.epochs(frame(spark, only_empty)).collect()} == {0.0}
