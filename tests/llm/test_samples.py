import numpy as np

from pyspark.sql import functions as F

from tidewatch.llm import language, quality, toxicity
from tidewatch.llm.common import few_each, hash_below, lowest

CFG = toxicity.Settings(positives=50, unlabelled=200)


def ids(df):
    return sorted((r["id"], r["text"]) for r in df.collect())


def hot(spark):
    """600 texts of 600 ids, 300 texts of one id, and 300 copies of one row."""
    rows = [(k, f"text {k}") for k in range(600)] + [(9000, f"hot {k}") for k in range(300)] + [(9001, "copy")] * 300
    return rows, spark.createDataFrame(rows, "id long, text string")


def test_sample_ignores_row_order_and_shares_of_one_id(spark):
    rows, docs = hot(spark)
    for seed in range(4):
        cfg = toxicity.Settings(positives=50, unlabelled=200, seed=seed)
        got = ids(lowest(docs, 200, cfg.seed))
        assert got == ids(lowest(spark.createDataFrame(rows[::-1], docs.schema).repartition(5), 200, cfg.seed))
        assert len(got) == 200 and len(set(got)) == len(got)
        assert 10 < sum(i == 9000 for i, _ in got) < len(got) / 2


def test_positives_of_one_id_are_few(spark):
    rows, docs = hot(spark)
    got = ids(few_each(docs, ["id"], 2000, CFG.seed))
    assert sum(i == 9000 for i, _ in got) == 8 and sum(i == 9001 for i, _ in got) == 1 and len(got) == 609
    again = ids(few_each(docs.repartition(7), ["id"], 100, CFG.seed))
    assert again == ids(few_each(docs.orderBy("text"), ["id"], 100, CFG.seed)) and len(again) == 100


def test_quality_model_ignores_row_order_and_copies(spark):
    rows = [(k, f"good words here {k}" if k % 2 else f"bad junk there {k}", k % 2) for k in range(200)]
    rows += [(9000, f"good text {k}", 1) for k in range(200)]
    schema = "id long, text string, grade int"
    cfg = quality.Settings(texts=60)
    one = quality.train(spark.createDataFrame(rows, schema), cfg)
    two = quality.train(spark.createDataFrame(rows[::-1], schema).repartition(6), cfg)
    assert np.array_equal(one.weights, two.weights) and np.count_nonzero(one.weights) > 0


def test_shares_far_below_a_millionth_pick_some(spark):
    """3,000,000 rows and a share of 2^-20 or less: the old rule on 20 bits took none."""
    many = spark.range(3_000_000).select("id")
    assert lowest(many, 1, 3).count() == 1
    assert lowest(spark.range(9_000_000).select("id"), 5, 3).count() == 5
    h = spark.range(1).select(F.lit(2).cast("bigint").alias("h"), F.lit(-1).cast("bigint").alias("top"))
    row = h.select(hash_below(F.col("h"), 2.0**-40).alias("a"), hash_below(F.col("top"), 0.999).alias("b"), hash_below(F.col("top"), 1.0).alias("c"))
    assert tuple(row.first()) == (True, False, True)


def test_quality_reads_texts_of_chosen_ratings_only(spark):
    docs = [(k, f"good words here {k}" if k % 2 else f"bad junk there {k}") for k in range(300)]
    docs += [(7, f"other text {k}") for k in range(200)] + [(9, "copy")] * 200 + [(None, "x"), (5, None)]
    ratings = [(k, k % 2) for k in range(0, 300, 3)] + [(7, 1), (9, 1), (9, 1), (None, 1), (11, None), (4000, 0)]
    cfg = quality.Settings(texts=60)
    d, r = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(ratings, "id long, grade int")
    one = quality.learn(d, r, cfg)
    two = quality.learn(spark.createDataFrame(docs[::-1], d.schema).repartition(7), r.repartition(3), cfg)
    assert np.array_equal(one.weights, two.weights) and np.count_nonzero(one.weights) > 0
    assert quality.learn(d.where("false"), r, cfg).grades == (0,)


def test_language_sample_is_bounded_by_language(spark):
    rows = [(k, f"aaa bbb {k}", "x") for k in range(400)] + [(1, f"ccc ddd {k}", "y") for k in range(400)]
    rows += [(2, "eee fff", "z")] * 300
    frame = spark.createDataFrame(rows, "id long, text string, lang string")
    cfg = language.Settings(texts=40)
    one, two = language.train(frame, cfg), language.train(frame.orderBy("text").repartition(5), cfg)
    assert one.langs == two.langs == ("x", "y", "z")
    assert all(np.array_equal(a, b) for a, b in zip(one.cost, two.cost, strict=True))
