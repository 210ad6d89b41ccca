import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import toxicity as tx

CFG = tx.Settings(rounds=300)


def texts(n, seed, bad):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(800)]
    out = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 200))]
        if bad(k):
            for w in rng.sample(["vile", "awful!", "Nasty,"], rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), w)
        out.append(" ".join(text))
    return out


def ids(some):
    return [np.array(sorted(tx.word_ids(t)), dtype=np.int64) for t in some]


def chance(model, text):
    return 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(w, 0) for w in tx.word_ids(text)))))


def test_learns_from_positive_and_unlabelled_texts_only():
    positive, unlabelled = texts(150, 1, lambda k: True), texts(1500, 2, lambda k: k % 10 == 0)
    model = tx.fit(ids(positive), ids(unlabelled), 0.1, CFG)
    assert np.mean([chance(model, t) >= 0.5 for t in texts(200, 3, lambda k: True)]) > 0.95
    assert np.mean([chance(model, t) >= 0.5 for t in texts(400, 4, lambda k: False)]) < 0.02


def test_risk_does_not_fall_below_zero_for_long():
    """Treating all unlabelled texts as clean scores hidden positives low; the corrected risk does not."""
    positive, unlabelled = texts(150, 1, lambda k: True), texts(600, 2, lambda k: k % 2 == 0)
    model = tx.fit(ids(positive), ids(unlabelled), 0.5, CFG)
    hidden = [chance(model, t) for k, t in enumerate(unlabelled) if k % 2 == 0]
    assert np.mean(np.array(hidden) >= 0.5) > 0.9


def test_evidence_is_the_likelihood_ratio():
    got = tx._evidence(np.array([30, 10, 0]), 100, np.array([10, 10, 0]), 100)
    p = np.array([0.3, 0.7, 0.1, 0.9])
    want = 2 * (np.array([30, 70, 10, 90]) * np.log(p / np.array([0.2, 0.8, 0.2, 0.8]))).sum()
    assert got == pytest.approx([want, 0, 0], abs=1e-6)


def test_training_and_edge_rows(spark):
    made = texts(600, 5, lambda k: k % 6 == 0)
    rows = [(k, t) for k, t in enumerate(made)] + [(900, None), (901, ""), (None, "vile awful"), (3, made[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "score", "f", "toxic")})
    marks = [(k, int(k % 6 == 0)) for k in range(300)] + [(None, 1), (5, None), (100_000, 1), (900, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int").withColumn("id", F.lit(0))
    model = tx.learn(docs, labels, F.col("doc_id") % 5 != 0, cfg=CFG)
    again = tx.learn(docs.repartition(5), labels, F.col("doc_id") % 5 != 0, cfg=CFG)
    assert model == again
    got = docs.select("doc_id", "text", tx.score(F.col("text"), model).alias("s")).collect()
    assert len(got) == len(rows) and all(0 <= r["s"] <= 1 for r in got)
    assert all(r["s"] == pytest.approx(chance(model, r["text"])) for r in got)
    held = [(r["doc_id"], r["s"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 5 == 0]
    assert np.mean([(s >= 0.5) == (k % 6 == 0) for k, s in held]) > 0.95


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for d, la in ((docs, labels), (docs.where("false"), labels), (docs, labels.where("false"))):
        model = tx.learn(d, la, F.lit(True))
        assert all(r[0] < 0.5 for r in docs.select(tx.score(F.col("text"), model)).collect())


def test_held_out_documents(spark):
    from tidewatch.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op2_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    hit = [r["predicted"] for r in rows if truth[r["doc_id"]] == 1]
    miss = [r["predicted"] for r in rows if truth[r["doc_id"]] == 0]
    assert np.mean(hit) > 0.75 and np.mean(miss) < 0.01
