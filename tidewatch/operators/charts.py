"""The numbers behind the six report charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.columns import sum0
from tidewatch.operators.reports import GROUP_COUNTS, GROUPS

# Chart captions, and the bands with their limits and labels.
CHARTS = {
    "score_histogram": "Number of transfers by model score",
    "risk_scatter": "Model score against rule hits of flagged users, sized by amount sent;"
    " top right is high risk, bottom left low, the other corners call for a rule review",
    "top_bookies": "Twenty bookies paid by the most senders",
    "group_volume": "Amount by rule group",
    "bookie_flow": "Money in and out of all bookies, with profit bands",
    "gambler_tails": "Gambling transfers by amount tail",
}
BANDS = (
    ("1. Significantly lose (<0.8x)", None, 0.80),
    ("2. Slightly lose (0.81x-0.99x)", 0.81, 0.99),
    ("3. Slightly win (1.0x-1.10x)", 1.00, 1.10),
    ("4. Significantly win (1.10x-1.20x)", 1.10, 1.20),
    ("5. Substantially win  (>1.20x)", None, None),
)
BINS = 60
BILLION = 1e9


def score_histogram(scored: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width bins over the scores, the last one closed, empty bins included."""
    # scores repeat, so they are counted before the extremes are known
    counts = (
        scored.where(F.col("ml_score").isNotNull())
        .groupBy("ml_score")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ends = counts.agg(F.min("ml_score").alias("low"), F.max("ml_score").alias("high")).select(
        F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(F.col("low") == F.col("high"), F.col("high") + 0.5)
        .otherwise(F.col("high"))
        .alias("high"),
    )
    step = (F.col("high") - F.col("low")) / bins
    position = F.floor((F.col("ml_score") - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    filled = (
        counts.crossJoin(F.broadcast(ends))
        .groupBy(F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.sum("n").alias("transfers"))
    )
    empty = ends.where(F.col("low").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "low", step.alias("step")
    )
    return empty.join(filled, "bin", "left").select(
        "bin",
        (F.col("low") + F.col("bin") * F.col("step")).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * F.col("step")).alias("bin_end"),
        F.coalesce("transfers", F.lit(0)).alias("transfers"),
    )


def risk_scatter(report: DataFrame) -> DataFrame:
    return report.where(F.col("user_group") != "normal").select(
        "user_id", "total_flagged_tx", "ml_score", "total_sent_amount", "user_group"
    )


def top_bookies(report: DataFrame, n: int = 20) -> DataFrame:
    return (
        report.where(F.col("bookie_tx_count") > 0)
        .orderBy(F.col("unique_senders").desc(), "user_id")
        .limit(n)
        .select("user_id", "unique_senders")
    )


def group_volume(report: DataFrame) -> DataFrame:
    """Received for receiving groups, sent for sending ones; users count in each of theirs."""
    totals = report.agg(
        *[
            F.coalesce(
                F.sum(F.when(F.col(GROUP_COUNTS[g]) > 0, F.col(f"total_{side}_amount"))), F.lit(0)
            ).alias(g)
            for g, (_, side) in GROUPS.items()
        ]
    )
    return totals.unpivot([], list(GROUPS), "user_group", "amount")


def bookie_flow(bookies: DataFrame) -> DataFrame:
    """All bookies in one row, amounts in billions."""
    money_in, money_out = sum0("total_recv_amount"), sum0("total_send_amount")
    return bookies.agg(
        (money_in / BILLION).alias("total_in_bil"),
        (money_out / BILLION).alias("total_out_bil"),
        F.count(F.lit(1)).alias("num_bookies"),
        sum0("recv_unique_senders").alias("total_gamblers"),
        (money_in / (money_out + 1)).alias("avg_in_out_ratio"),
    )


def pnl_bands(bookies: DataFrame, gapless: bool = False) -> DataFrame:
    """Bookies per in/out band.

    The published limits leave [0.80, 0.81) and (0.99, 1.00) to the last band;
    ``gapless`` closes those gaps.
    """
    r = F.col("recv_send_ratio")
    if gapless:
        limits = [r < 0.80, r < 1.00, r <= 1.10, r <= 1.20]
    else:
        limits = [r < 0.80] + [r.between(low, high) for _, low, high in BANDS[1:4]]
    band = F.lit(BANDS[4][0])
    for (label, _, _), test in reversed(list(zip(BANDS, limits))):
        band = F.when(test, label).otherwise(band)
    return bookies.groupBy(band.alias("behavior_group")).agg(F.count(F.lit(1)).alias("bookies"))


def gambler_tails(scored: DataFrame) -> DataFrame:
    """Gambling transfers by tail; users are folded first, so no distinct set is collected."""
    tail = F.when(F.col("amount_tail3") == 11, "011").otherwise("012")
    per_user = (
        scored.where(F.col("is_gambler_tx") == 1)
        .groupBy(tail.alias("bet_tail_type"), "userid")
        .agg(F.count("amount").alias("tx"), F.sum("amount").alias("amount"))
    )
    return per_user.groupBy("bet_tail_type").agg(
        F.sum("tx").alias("tx_count"),
        sum0("amount").alias("total_amount"),
        F.count(F.lit(1)).alias("unique_gamblers"),
        F.try_divide(F.sum("amount").cast("double"), F.sum("tx")).alias("avg_amount"),
    )


def chart_catalog(spark: SparkSession) -> DataFrame:
    """Chart name and caption, for joining to the published datasets."""
    return spark.createDataFrame(list(CHARTS.items()), "chart string, caption string")
