import itertools
import os

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import simhash
from tidewatch.llm.components import components

SF = "/root/testdata/sf0.001"


def slow_print(text):
    """Bit by bit, from the definition."""
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """ids by union of all pairs at most 3 bits apart; ``prints`` is a list of (id, print)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
            root[find(i)] = find(j)
    best = {}
    for i, (id_, _) in enumerate(prints):
        best[find(i)] = min(best.get(find(i), id_), id_)
    return [(id_, best[find(i)]) for i, (id_, _) in enumerate(prints)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def frame_of(spark, prints):
    return spark.createDataFrame([(i, signed(p)) for i, p in prints], "id long, fp long")


def linked(spark, prints):
    found = components(simhash.links(frame_of(spark, prints).select("fp").distinct()))
    roots = {r["node"]: r["root"] for r in found.collect()}
    groups = {}
    for i, p in prints:
        groups.setdefault(roots.get(signed(p), signed(p)), []).append(i)
    return sorted((i, min(g)) for g in groups.values() for i in g)


@pytest.mark.parametrize(
    "text", ["", None, " \t\n", "One", "one two", "A b C d", "É À x É", "a b c", "x" * 5000, "to be " * 50_000]
)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_print(text)


def test_spark_hashes_equal_the_library(spark):
    texts = ["", "a b c", "é" * 40, "x" * 1000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert got == [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in texts]


def test_links_of_every_shape(spark):
    base = 0x0123456789ABCDEF
    flips = [0, 1, 1 << 63, 3, 7, 15, 1 << 31 | 1 << 32, 7 << 40, 15 << 40, 1 | 1 << 20 | 1 << 50, 0x1F << 30, 1 << 5 | 1 << 6 | 1 << 45 | 1 << 46]
    prints = [(k, base ^ f) for k, f in enumerate(flips)] + [(100, 0), (101, 1 << 7), (102, 0xFF << 8), (103, (1 << 64) - 1)]
    assert linked(spark, prints) == sorted(slow_components(prints))


def test_dense_group_and_random_prints(spark):
    import random

    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = [(k, rng.getrandbits(64)) for k in range(150)]
    for k in range(150, 400):
        p = centre
        for _ in range(rng.randrange(7)):
            p ^= 1 << rng.randrange(64)
        prints.append((k, p))
    assert linked(spark, prints) == sorted(slow_components(prints))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_whole_table_equals_brute_force(spark):
    from tidewatch.llm.queries import op3_simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(slow_components([(r["doc_id"], slow_print(r["text"])) for r in docs]))
    got = op3_simhash(spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {r["doc_id"]: f"{slow_print(r['text']):016x}" for r in docs}


ROWS = [(5, "a b c d"), (3, "A b\tc d"), (9, None), (7, ""), (None, "q r s"), (8, "q r s"), (5, "a b c d"), (2, "other words here now")]


def odd(spark, rows):
    """Extra columns with names that the operators use inside."""
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.withColumns({n: F.lit(n) for n in ("id", "fp", "t", "key", "node", "root", "_row", "component_id")})


def test_edge_rows(spark):
    got = sorted((str(r["id"]), r["component_id"]) for r in simhash.near_duplicates(odd(spark, ROWS)).collect())
    assert got == sorted([("5", 3), ("3", 3), ("9", 7), ("7", 7), ("None", 8), ("8", 8), ("5", 3), ("2", 2)])


def test_representatives_keep_one_row_and_all_columns(spark):
    docs = odd(spark, ROWS)
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.select("doc_id", "text").collect()) == [
        ("2", "other words here now"),
        ("3", "A b\tc d"),
        ("7", ""),
        ("None", "q r s"),
    ]


def test_empty_table(spark):
    docs = odd(spark, ROWS).where("false")
    assert simhash.near_duplicates(docs).collect() == [] and simhash.representatives(docs).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7), (None, 3), (2000, 1999), (2000, 1999)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(80)}, 1999: 1999, 2000: 1999}
