"""Training, scoring and the 0-100 scale."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import FALLBACK_FEATURES, Config
from tidewatch.operators.forest import (
    Forest,
    feature_array,
    grow_trees,
    raw_score,
    sample_for_trees,
    scaler_stats,
    training_rows,
)
from tidewatch.sources.storage import materialize

log = logging.getLogger(__name__)
__all__ = ["Model", "fit", "normalize", "score", "score_fixed", "train", "train_stats"]

_EPS = 1e-9
_META = "rows bigint, rows_per_tree int, low double, high double, trained_at string, config string"


def scaled(raw: Column, low: Column, high: Column) -> Column:
    """Raw anomaly to 0-100, two decimals, half to even."""
    share = (raw - low) / (high - low + F.lit(_EPS)) * 100
    clipped = F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0))
    return F.when(raw.isNotNull(), F.bround(clipped, 2))


def normalize(scored: DataFrame) -> DataFrame:
    """``raw`` to ``ml_score`` relative to the batch's own extremes.

    ``raw`` grows with the anomaly, so the lowest value becomes 0.  The two
    extremes are the only values fetched; ``scored`` should be a stored table.
    """
    low, high = scored.agg(F.min("raw"), F.max("raw")).first()
    bounds = [F.lit(v).cast("double") for v in (low, high)]
    return scored.withColumn("ml_score", scaled(F.col("raw"), *bounds)).drop("raw")


@dataclass(frozen=True)
class Model:
    """A trained model as tables: nodes, scaler, bookies, statistics and one row of metadata."""

    nodes: DataFrame
    scaler: DataFrame
    bookies: DataFrame
    stats: DataFrame
    rows: int
    rows_per_tree: int
    low: float
    high: float
    trained_at: str
    cfg: Config

    def forest(self) -> Forest:
        return Forest.from_nodes(self.nodes, self.rows_per_tree)

    def meta(self, spark: SparkSession) -> DataFrame:
        row = (self.rows, self.rows_per_tree, self.low, self.high, self.trained_at,
               json.dumps(asdict(self.cfg)))
        return spark.createDataFrame([row], _META)

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
        self.bookies.write.mode("overwrite").parquet(f"{path}/bookies")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        self.meta(self.nodes.sparkSession).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        meta = spark.read.parquet(f"{path}/meta").first()
        settings = json.loads(meta["config"])
        settings["features"] = settings.get("features") or FALLBACK_FEATURES
        return cls(
            spark.read.parquet(f"{path}/nodes"),
            spark.read.parquet(f"{path}/scaler"),
            spark.read.parquet(f"{path}/bookies"),
            spark.read.parquet(f"{path}/stats"),
            meta["rows"],
            meta["rows_per_tree"],
            meta["low"],
            meta["high"],
            meta["trained_at"],
            Config.from_mapping(settings),
        )


def train(labeled: DataFrame, cfg: Config, row_key: Column) -> Model:
    """Fit the forest on the transfers no rule hits.

    ``labeled`` is scanned once for row count and scaler, once for the sample and once
    for the raw scores, from which extremes and statistics follow, so it should be a
    stored table.  ``row_key`` must tell rows apart, equal ones too; see ``file_row_key``.
    """
    return fit(labeled, cfg, row_key)[0]


def fit(
    labeled: DataFrame, cfg: Config, row_key: Column, keep: Sequence[str] = ()
) -> tuple[Model, DataFrame]:
    """The model, and the stored raw scores of its own batch with the ``keep`` columns.

    The second serves to score the training batch without another walk of the forest.
    """
    spark = labeled.sparkSession
    rows = training_rows(labeled, cfg, row_key)
    scaler = materialize(scaler_stats(rows, cfg.features), "scaler")
    n = scaler.first()["rows"]
    if not n:
        raise ValueError("every transfer is hit by a rule: nothing to train on")
    if n < cfg.min_train_rows:
        log.warning("only %d transfers to train on", n)
    rows_per_tree = min(cfg.tree_rows, n)
    trees = grow_trees(sample_for_trees(rows, n, cfg), cfg, rows_per_tree)
    nodes = materialize(trees, "forest-nodes")
    forest = Forest.from_nodes(nodes, rows_per_tree)
    x = F.when(F.col("hit_any_rule") == 0, feature_array(cfg.features))
    raw = labeled.withColumn("raw", raw_score(forest, spark, x)).select(*keep, "raw")
    raw = materialize(raw, "training-scores")
    low, high, now = raw.agg(F.min("raw"), F.max("raw"), F.current_timestamp().cast("string")).first()
    scores = raw.select(scaled(F.col("raw"), F.lit(low), F.lit(high)).alias("ml_score"))
    bookies = labeled.where(F.col("is_bookie_tx") == 1).select(F.col("appuser").alias("user_id"))
    model = Model(
        nodes,
        scaler.drop("rows"),
        bookies.distinct(),
        materialize(train_stats(scores), "training-stats"),
        n,
        rows_per_tree,
        low,
        high,
        now,
        cfg,
    )
    return model, raw


def raw_scores(labeled: DataFrame, model: Model) -> DataFrame:
    """``labeled`` plus ``raw``, NULL on transfers a rule hits."""
    x = F.when(F.col("hit_any_rule") == 0, feature_array(model.cfg.features))
    return labeled.withColumn("raw", raw_score(model.forest(), labeled.sparkSession, x))


def score(labeled: DataFrame, model: Model, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) plus ``ml_score``, relative to this batch.

    The raw scores are written once, because the scale needs their extremes
    before the first row can be answered.
    """
    columns = labeled.columns if keep is None else [c for c in keep if c in labeled.columns]
    raw = raw_scores(labeled, model).select(*columns, "raw")
    return normalize(materialize(raw, "raw-scores"))


def score_fixed(labeled: DataFrame, model: Model, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) plus ``ml_score`` on the scale fixed at training; works on streams."""
    low, high = F.lit(model.low), F.lit(model.high)
    columns = labeled.columns if keep is None else keep
    return raw_scores(labeled, model).select(*columns, scaled(F.col("raw"), low, high).alias("ml_score"))


def train_stats(scored: DataFrame) -> DataFrame:
    """Rows, mean, 95th percentile and maximum of the scores.

    Scores have two decimals, so the exact percentile counts at most 10,001 values.
    """
    return scored.agg(
        F.count("ml_score").alias("rows"),
        F.avg("ml_score").alias("mean"),
        F.percentile("ml_score", 0.95).alias("p95"),
        F.max("ml_score").alias("max"),
    )
