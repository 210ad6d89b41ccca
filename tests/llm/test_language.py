import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import language

TEXTS = {
    "aa": ["the cat sat on the mat", "that hat", "tea at ten", "the été that they ate"],
    "bb": ["zug und berg", "und das ist gut", "über den berg"],
    "cc": ["日本語の文", "日本"],
}


def model(order=3):
    counts = {}
    for lang, texts in TEXTS.items():
        grams = Counter()
        for t in texts:
            raw = b"\0" * order + t.encode()
            for k in range(order, len(raw)):
                grams[int.from_bytes(raw[k - order : k + 1], "big")] += 1
        counts[lang] = (np.array(list(grams)), np.array(list(grams.values())))
    return language.fit(counts, order)


def slow_bits(lang, text, order=3):
    """Code length byte by byte, from counts in dictionaries."""
    seen = defaultdict(Counter)
    for t in TEXTS[lang]:
        raw = b"\0" * order + t.encode()
        for k in range(order, len(raw)):
            for length in range(order + 1):
                seen[raw[k - length : k]][raw[k]] += 1
    raw, bits = b"\0" * order + text.encode(), 0.0
    for k in range(order, len(raw)):
        for length in range(order, -1, -1):
            after = seen.get(raw[k - length : k])
            if not after:
                continue
            total = sum(after.values()) + len(after)
            if raw[k] in after:
                bits -= math.log2(after[raw[k]] / total)
                break
            bits -= math.log2(len(after) / total)
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [0, 1, 3])
@pytest.mark.parametrize("text", ["the hat", "gut", "", "日 the", "\x01\x02 unseen Ж", "x" * 3000])
def test_code_lengths(text, order):
    made = model(order)
    want = [slow_bits(lang, text, order) for lang in made.langs]
    assert language.code_lengths(made, text.encode()) == pytest.approx(want, rel=1e-4, abs=1e-4)
    both = list(language._lengths(made, [b"other words", text.encode(), b""]))
    assert both[1] == pytest.approx(want, rel=1e-4, abs=1e-3) and not both[2].any()


def test_long_texts_are_scored_whole(monkeypatch):
    made, text = model(), "the cat and the berg 日 " * 400
    whole = language.code_lengths(made, text.encode())
    monkeypatch.setattr(language, "_PIECE", 100)
    assert language.code_lengths(made, text.encode()) == pytest.approx(whole)


def frame(spark, rows):
    made = spark.createDataFrame(rows, "id long, text string, lang string")
    return made.withColumns({c: F.lit(1) for c in ("n", "gram", "share", "score")})


def test_predictions_and_edge_rows(spark):
    rows = [(k, t, lang) for k, (lang, t) in enumerate((la, t) for la, ts in TEXTS.items() for t in ts)]
    made = language.train(frame(spark, [*rows, (None, "x", "aa"), (99, None, "bb"), (98, "y", None)]))
    assert made.langs == ("aa", "bb", "cc")
    ask = [(1, "the mat"), (2, "und über"), (3, None), (4, ""), (5, "12 .,!"), (6, "日"), (7, "the " * 40_000), (1, "the mat")]
    told = spark.createDataFrame(ask, "id long, text string").withColumn("p", language.predict(F.col("text"), made))
    got = sorted((r["id"], r["p"]["lang"]) for r in told.collect())
    assert got == [(1, "aa"), (1, "aa"), (2, "bb"), (3, "und"), (4, "und"), (5, "und"), (6, "cc"), (7, "aa")]
    assert all(0 <= r["p"]["score"] <= 1 and (r["p"]["score"] == 0) == (r["p"]["lang"] == "und") for r in told.collect())


def test_nothing_to_learn(spark):
    made = language.train(frame(spark, [(1, "a", "x")]).where("false"))
    told = spark.createDataFrame([("some words",), (None,)], "text string").select(language.predict(F.col("text"), made).alias("p"))
    assert [(r["p"]["lang"], r["p"]["score"]) for r in told.collect()] == [("und", 0.0)] * 2


def test_held_out_accuracy(spark):
    from tidewatch.llm.queries import op8_language

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_language(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and len(held) > 200
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
