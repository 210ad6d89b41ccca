import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate as dc


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def slow(docs, items, least=15):
    """Every alignment of every document and item."""
    found = {}
    for (i, text), (k, item) in itertools.product(docs, items):
        a, b = words(text), words(item)
        if not b:
            continue
        size = min(least, len(b))
        for shift in range(-len(b) + 1, len(a)):
            lo, hi = max(0, -shift), min(len(b), len(a) - shift)
            hits = [a[p + shift] == b[p] for p in range(lo, hi)]
            good = [p for p in range(len(hits) - size + 1) if 5 * sum(hits[p : p + size]) >= 4 * size]
            if good:
                covered = len({q for p in good for q in range(p, p + size)})
                best = max(sum(hits[p : p + size]) for p in good)
                found[i, k] = max(found.get((i, k), (0, 0)), (covered, best))
    return found


def test_masks_hit_every_stretch_of_15_with_3_replaced_words():
    for replaced in itertools.combinations(range(15), 3):
        assert any(
            all(at + k not in replaced for k in mask) for mask in dc.MASKS for at in range(15 - mask[-1])
        ), replaced


def test_short_masks_hit_every_allowed_replacement():
    for n in range(1, 15):
        for replaced in itertools.combinations(range(n), n // 5):
            assert any(not set(mask) & set(replaced) for mask in dc.short_masks(n)), (n, replaced)
        assert all(len(mask) >= min(n, 4) for mask in dc.short_masks(n))


def test_short_items_are_found_with_every_allowed_replacement(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 15)]
    docs, want = [], set()
    for n, text in items:
        for more in (0, 1):
            for replaced in itertools.combinations(range(n), n // 5 + more):
                said = ["x" if k in replaced else w for k, w in enumerate(text.split())]
                i = len(docs)
                # at the begin, at the end and inside of a text
                docs.append((i, " ".join(["before"] * (i % 3) + said + ["after"] * (i % 2))))
                if not more:
                    want.add((i, n, n, n - len(replaced)))
    assert {tuple(r) for r in dc.contaminated(*frames(spark, docs, items)).collect()} == want


def test_short_item_of_a_common_word_is_one_hit(spark):
    docs = [(1, "the " * 20_000), (2, "THE"), (3, "then")]
    assert sorted(tuple(r) for r in dc.overlaps(*frames(spark, docs, [(7, "the"), (8, "今天天气")])).drop("key").collect()) == [
        (1, 7, 0, 1, 1),
        (2, 7, 0, 1, 1),
    ]


def frames(spark, docs, items):
    clash = {c: F.lit(1) for c in ("id", "key", "item", "seed", "at", "shift", "_row", "doc_words", "least", "hits", "found")}
    return (
        spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash),
        spark.createDataFrame(items, "item_id long, text string").withColumns(clash),
    )


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 11, 14, 15, 22, 40])))) for k in range(14)]
    docs = []
    for k in range(40):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(120))]
        if k % 2:
            item = words(rng.choice(items)[1])
            item = item[rng.randrange(3) :]
            item = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.1, 0.2, 0.3]) else w for w in item]
            at = rng.randrange(len(text) + 1)
            text[at:at] = item
        docs.append((k, ", ".join(text).upper()))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_alignments(spark, seed):
    docs, items = made(seed)
    got = {(r["id"], r["item"]): (r["overlap_words"], r["best_equal"]) for r in dc.contaminated(*frames(spark, docs, items)).collect()}
    want = slow(docs, items)
    assert got == want


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (None, f"see {ITEM}!"), (3, ITEM.replace("four", "4")), (3, ITEM.replace("four", "4")), (4, "one two three four"), (5, "filler " * 30_000 + ITEM)]
    items = [(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "one two"), (None, ITEM + " more")]
    got = sorted(str((r["id"], r["item"])) for r in dc.contaminated(*frames(spark, docs, items)).collect())
    assert got == sorted([str((i, k)) for i in (None, 3, 5) for k in (1, None, 4)] + [str((4, 4))])
    kept = dc.decontaminate(*frames(spark, docs, items))
    assert kept.columns == frames(spark, docs, items)[0].columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_many_items_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dc, "small", lambda df, *_: df)
    docs, items = made(1)
    got = {(r["id"], r["item"]) for r in dc.contaminated(*frames(spark, docs, items)).collect()}
    assert got == set(slow(docs, items))


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, ITEM)], [(1, ITEM)])
    assert dc.contaminated(docs.where("false"), items).collect() == []
    assert dc.contaminated(docs, items.where("false")).collect() == []
    assert dc.decontaminate(docs, items.where("false")).count() == 1


def test_planted_passages_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    runs = {tuple(w[k : k + 12]) for w in items for k in range(len(w) - 11)}
    want = {i for i, t in docs if any(tuple(w[k : k + 12]) in runs for w in [words(t)] for k in range(len(w) - 11))}
    from tidewatch.llm.queries import op10_decontamination

    assert {r["doc_id"] for r in op10_decontamination(spark, sf).collect()} == want and want
