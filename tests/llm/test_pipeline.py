import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import slow as slow_overlaps
from tests.llm.test_decontaminate import words
from tests.llm.test_mixing import slow as slow_mix
from tests.llm.test_simhash import slow_components, slow_print
from tidewatch.llm import toxicity
from tidewatch.llm.common import crc_mod

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    # the classifier itself is tested elsewhere; here its scores decide
    model = toxicity.learn(whole, labels, crc_mod("doc_id", 5) != 0)
    score = lambda t: model.bias + sum(model.weights.get(w, 0) for w in toxicity.word_ids(t))
    clean = [r for r in whole.collect() if score(r["text"]) < 0]
    assert sorted(clean) == sorted(rows["toxicity"])
    groups = slow_components([(r["doc_id"], slow_print(r["text"])) for r in clean])
    single = sorted(r for r in clean if r["doc_id"] in {c for _, c in groups})
    assert single == sorted(rows["simhash_dedup"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 5]) for w in (words(t) for _, t in items) for k in range(len(w) - 4)}
    near = [r for r in single if any(tuple(w[k : k + 5]) in grams for w in [words(r["text"])] for k in range(len(w) - 4))]
    bad = {i for i, _ in slow_overlaps([(r["doc_id"], r["text"]) for r in near], items)}
    apart = [r for r in single if r["doc_id"] not in bad]
    assert apart == sorted(rows["decontamination"])
    times = {i: taken // n if n else None for i, _, n, taken in slow_mix([(r["doc_id"], r["text"], r["source"]) for r in apart])[1]}
    count = Counter(r["doc_id"] for r in rows["mixing"])
    assert all(count[r["doc_id"]] == times[r["doc_id"]] for r in apart if times[r["doc_id"]] is not None)
    sizes = Counter(r["shard"] for r in rows["sharding"])
    assert Counter(r["doc_id"] for r in rows["sharding"]) == count
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) <= set(range(16))
    assert all(sorted(r["slot"] for r in rows["sharding"] if r["shard"] == s) == list(range(n)) for s, n in sizes.items())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_run_equals_its_stages_and_reruns(spark):
    once = corpus_pipeline.run(spark, SF)
    told = sorted((r["doc_id"], r["shard"], r["slot"]) for r in once.collect())
    assert told == sorted((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, SF).collect())


def test_empty_and_odd_documents(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "some words of a benchmark item")], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b c d e f", None, "s", 1), (3, "x " * 40_000, "en", "s", 2)]
    for k, (rows, least) in enumerate((([], 0), (odd, 1))):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}/documents.parquet")
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}/{n}")
            docs = spark.read.parquet(f"{tmp_path}/{k}/{n}")
        assert (docs.count() >= least) and {"shard", "slot"} <= set(docs.columns)


def test_nothing_else_imports_the_package():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(top, "tidewatch")):
        for name in names:
            if name.endswith(".py") and f"{os.sep}llm" not in folder:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert not re.search(r"tidewatch\.llm|corpus_pipeline", f.read()), name
