import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import FALLBACK_FEATURES, Config
from tidewatch.contract import queries
from tidewatch.operators import forest
from tidewatch.operators import scoring as M
from tidewatch.operators.forest import (
    Forest,
    anomaly,
    file_row_key,
    mean_path,
    sample_for_trees,
    scaler_stats,
    training_rows,
)

SMALL = Config(features=("f1", "f2", "f3"), trees=40, tree_rows=64, min_train_rows=1)


def test_scaler_over_many_parts(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(5, 2, 5000), np.full(5000, 0.1), 1e9 + rng.integers(0, 50, 5000) * 64]).astype(np.float32)
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<float>").repartition(7).union(spark.createDataFrame([], "x array<float>"))
    stats = scaler_stats(rows, SMALL.features)
    got = {r["feature"]: r for r in stats.collect()}
    for i, name in enumerate(SMALL.features):
        assert got[name]["rows"] == 5000
        assert got[name]["mean"] == pytest.approx(x[:, i].astype(float).mean(), rel=1e-12)
    assert got["f1"]["scale"] == pytest.approx(x[:, 0].astype(float).std(), rel=1e-12)
    assert got["f2"]["scale"] == 1.0 and got["f2"]["mean"] == float(np.float32(0.1))
    assert got["f3"]["scale"] == pytest.approx(x[:, 2].astype(float).std(), rel=1e-9)
    # features are no columns of an aggregate, however many there are
    assert "Aggregate" not in stats._jdf.queryExecution().optimizedPlan().toString()
    none = scaler_stats(rows.where("false"), SMALL.features).collect()
    assert [(r["feature"], r["mean"], r["scale"], r["rows"]) for r in none] == [(f, None, 1.0, 0) for f in SMALL.features]


def test_scaler_query_stores_what_labels_need(spark, monkeypatch):
    stored = []
    rows = spark.createDataFrame([(1.0, 0)], "amount double, hit_any_rule int")
    monkeypatch.setattr(queries, "etl", lambda *_: spark.createDataFrame([], ", ".join(f"{c} string" for c in (*queries.LABEL_COLUMNS, "platform", "reqdate"))))
    monkeypatch.setattr(queries, "label_stored", lambda clean, _: stored.append(clean.columns) or rows)
    monkeypatch.setattr(queries, "CFG", Config(features=("amount",)))
    assert [tuple(r) for r in queries.scaler_stats(spark, "").collect()] == [("amount", 1.0, 1.0)]
    assert stored == [list(queries.LABEL_COLUMNS)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """3,000 ordinary transfers, 5 far away, 100 hit by a rule; f3 never varies."""
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), 1.0, 0) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))]
    rows += [(3000 + i, 9.0 + i, -9.0, 1.0, 0) for i in range(5)]
    rows += [(4000 + i, None, 0.0, 1.0, 1) for i in range(100)]
    path = str(tmp_path_factory.mktemp("forest") / "t")
    df = spark.createDataFrame(rows, "id long, f1 double, f2 double, f3 double, hit_any_rule int")
    (
        df.withColumn("is_bookie_tx", F.col("hit_any_rule"))
        .withColumn("appuser", F.lit("b"))
        .write.parquet(path)
    )
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def model(table):
    return M.train(table, SMALL, F.xxhash64("id"))


def scores(df):
    return {r["id"]: r["ml_score"] for r in df.collect()}


def test_outliers_rank_first_and_rules_are_not_scored(table, model):
    got = scores(M.score(table, model))
    free = {i: s for i, s in got.items() if i < 4000}
    assert all(got[i] is None for i in got if i >= 4000)
    assert min(free.values()) == 0 and max(free.values()) == pytest.approx(100, abs=0.01)
    top = sorted(free, key=free.get, reverse=True)[: len(free) // 100]
    assert {3000, 3001, 3002, 3003, 3004} <= set(top)


def test_partitioning_does_not_change_the_scores(table, model):
    again = M.train(table.repartition(13, "f1"), SMALL, F.xxhash64("id"))
    assert scores(M.score(table, model)) == scores(M.score(table.repartition(5), again))


def test_another_seed_gives_another_forest(table, model):
    other = M.train(table, Config(**{**vars(SMALL), "seed": 7}), F.xxhash64("id"))
    assert scores(M.score(table, other)) != scores(M.score(table, model))


def test_saved_model_scores_the_same(spark, table, model, tmp_path):
    model.save(str(tmp_path))
    loaded = M.Model.load(spark, str(tmp_path))
    assert loaded.cfg == SMALL and loaded.rows == 3005
    assert loaded.bookies.collect()[0]["user_id"] == "b"
    assert scores(M.score(table, loaded)) == scores(M.score(table, model))
    assert scores(M.score_fixed(table, loaded)) == scores(M.score(table, model))


def test_a_model_without_features_falls_back(spark, model, tmp_path):
    bare = M.Model(**{**vars(model), "cfg": Config(**{**vars(SMALL), "features": ()})})
    bare.save(str(tmp_path))
    assert M.Model.load(spark, str(tmp_path)).cfg.features == FALLBACK_FEATURES
    assert len(FALLBACK_FEATURES) == 23 and len(Config().features) == 29


def test_a_constant_feature_is_never_split(model):
    forest = model.forest()
    split = np.isfinite(forest.threshold)
    assert not (forest.feature[split] == 2).any()
    assert forest.path.shape == (40, 64)


# 2,560 rows fill 40 trees of 64; with 3,840 every row has one chance
@pytest.mark.parametrize("n", [1, 50, 63, 64, 65, 96, 2_000, 2_559, 2_560, 2_561, 3_072, 3_840, 3_841, 40_000])
def test_every_tree_gets_its_rows(spark, n):
    rows = spark.range(n).select(F.xxhash64("id").alias("key"), F.array(F.lit(1.0)).alias("x"))
    counts = sample_for_trees(rows, n, SMALL).groupBy("tree").count().collect()
    assert len(counts) == SMALL.trees
    assert {r["count"] for r in counts} == {min(n, SMALL.tree_rows)}


def test_copies_of_a_row_are_sampled_one_by_one(spark, tmp_path):
    spark.range(9_000).select(F.lit(1.0).alias("f1"), F.lit(0).alias("hit_any_rule")).write.parquet(
        str(tmp_path / "copies")
    )
    stored = spark.read.parquet(str(tmp_path / "copies"))
    rows = training_rows(stored, Config(features=("f1",)), file_row_key())
    assert rows.select("key").distinct().count() == 9_000
    sample = sample_for_trees(rows, 9_000, SMALL)
    assert sample.count() == SMALL.trees * SMALL.tree_rows


def test_paths_match_a_plain_walk():
    rng = np.random.default_rng(2)
    depth, trees = 4, 6
    feature = rng.integers(0, 3, (trees, 15)).astype(np.intp)
    threshold = rng.normal(size=(trees, 15)).astype(np.float32)
    path = rng.uniform(1, 9, (trees, 16))
    x = rng.normal(size=(50, 3)).astype(np.float32)
    got = anomaly((feature, threshold, path), mean_path(16), x)
    for row, value in zip(x, got):
        total = 0.0
        for t in range(trees):
            node = 0
            for _ in range(depth):
                node = 2 * node + (2 if row[feature[t, node]] > threshold[t, node] else 1)
            total += path[t, node - 15]
        assert value == pytest.approx(2 ** (-(total / trees) / mean_path(16)))


def test_rows_of_several_chunks_score_like_single_rows(monkeypatch):
    """Also trees with fewer levels than those compared with all rows, NaN and infinite thresholds."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(forest, "_CHUNK", 16)
    for depth in (1, 2, 3, 5):
        splits = (1 << depth) - 1
        feature = rng.integers(0, 4, (3, splits))
        threshold = rng.normal(size=(3, splits)).astype(np.float32)
        threshold[0, 0] = np.inf
        path = rng.random((3, splits + 1))
        x = rng.normal(size=(50, 4)).astype(np.float32)
        x[3, 1] = np.nan
        got = anomaly((feature, threshold, path), 2.0, x)
        for row, score in zip(x, got):
            lengths = []
            for f, t, p in zip(feature, threshold, path):
                node = 0
                for _ in range(depth):
                    node = 2 * node + (2 if row[f[node]] > t[node] else 1)
                lengths.append(p[node - splits])
            assert score == pytest.approx(2.0 ** (-np.mean(lengths) / 2.0))


def test_the_first_levels_are_not_looked_up_by_row(monkeypatch):
    """They are compared with whole columns, a batch at a time."""
    taken = []
    real = np.take
    monkeypatch.setattr(forest.np, "take", lambda *a, **k: taken.append(1) or real(*a, **k))
    depth, trees, rng = 8, 5, np.random.default_rng(1)
    feature = rng.integers(0, 3, (trees, 255))
    anomaly((feature, rng.random((trees, 255)).astype(np.float32), rng.random((trees, 256))), 2.0,
            rng.random((10_000, 3)).astype(np.float32))
    assert len(taken) <= trees * (3 * (depth - 2) + 1)


def test_scaler_uses_population_deviation(table):
    rows = training_rows(table, SMALL, F.lit(0))
    got = {r["feature"]: r for r in scaler_stats(rows, SMALL.features).collect()}
    f1 = np.array([r[0] for r in table.where("hit_any_rule = 0").select("f1").collect()], np.float32)
    assert got["f1"]["scale"] == pytest.approx(f1.astype(float).std())
    assert (got["f3"]["mean"], got["f3"]["scale"]) == (1.0, 1.0)


def test_no_free_transfer(table, model):
    ruled = table.where("hit_any_rule = 1")
    assert M.score(ruled, model).where("ml_score is not null").count() == 0
    with pytest.raises(ValueError):
        M.train(ruled, SMALL, F.xxhash64("id"))


def test_equal_scores_are_zero(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None)], "id int, raw double")
    assert scores(M.normalize(df)) == {1: 0.0, 2: 0.0, 3: None}


def test_statistics(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "ml_score double")
    row = M.train_stats(df).first()
    assert (row["rows"], row["mean"], row["p95"], row["max"]) == (101, 50.0, 95.0, 100.0)


def test_forest_reads_its_nodes_in_tree_order(model):
    shuffled = Forest.from_nodes(model.nodes.repartition(7), model.rows_per_tree)
    assert (shuffled.path == model.forest().path).all()
