"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import PATTERN_FLAGS, RULE_FLAGS, STR_FLAGS, Config
from tidewatch.operators import charts as C
from tidewatch.operators import daily as daily_profiles
from tidewatch.operators import chatlog as G
from tidewatch.operators import etl as E
from tidewatch.operators import labels as L
from tidewatch.operators import patterns as P
from tidewatch.operators import profiles as R
from tidewatch.operators import reports as RP
from tidewatch.operators import scoring as M
from tidewatch.operators import str_flags as S
from tidewatch.operators.forest import scaler_stats as forest_scaler_stats
from tidewatch.operators.forest import training_rows
from tidewatch.operators.ip_country import add_country
from tidewatch.plans import canned
from tidewatch.plans.catalog import Catalog
from tidewatch.plans.stages import DROPPED, Pipeline, label_stored
from tidewatch.sources import fixtures, landing, ordered, tables
from tidewatch.sources.fixtures import TXN_COLUMNS
from tidewatch.sources.storage import materialize, new_path, scratch
from tidewatch.streaming import audit, rapid_days, streams

CFG = Config()
ROW_ID = ("l_orderkey AS ok", "l_linenumber AS ln")


def plain(df: DataFrame) -> DataFrame:
    """Flags and short counters as INT, so that both engines show one type."""
    narrow = (T.ByteType, T.ShortType)
    return df.select(
        *[
            F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, narrow) else f.name
            for f in df.schema.fields
        ]
    )


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def day_text(df: DataFrame) -> DataFrame:
    return df.withColumn("dt", F.col("dt").cast("string"))


def etl(spark: SparkSession, sf: str) -> DataFrame:
    """Clean transfers without the country, which no later step reads."""
    raw = fixtures.transfers(spark, sf, *ROW_ID)
    return E.add_time(E.clean_description(E.fill_device_id(raw)))


def located(spark: SparkSession, sf: str) -> DataFrame:
    """Clean transfers as the pipeline stores them, with row ids."""
    raw = fixtures.transfers(spark, sf, *ROW_ID)
    return E.add_time(E.clean_transfers(raw, fixtures.ip_ranges(spark, sf), CFG))


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return P.add_patterns(etl(spark, sf), CFG)


def ids(spark: SparkSession, sf: str) -> DataFrame:
    """Stored, as owners and users both come from them."""
    raw = fixtures.transfers(spark, sf)
    return materialize(R.identifiers(E.fill_device_id(raw)), "identifiers")


def stored_etl(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned transfers as a table, for queries that read them more than once."""
    return materialize(etl(spark, sf), "etl")


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    return label_stored(etl(spark, sf), CFG)


def receivers(spark: SparkSession, sf: str) -> DataFrame:
    clean = stored_etl(spark, sf)
    return R.receiver_profile(P.add_patterns(clean, CFG), R.pairs(clean))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.add_patterns(stored_etl(spark, sf), CFG)
    return L.bookie_scores(L.received_stats(rows, R.pairs(rows)), L.sent_stats(rows), CFG)


def ruled(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.add_patterns(stored_etl(spark, sf), CFG)
    return L.rule_labels(rows, R.pairs(rows), CFG)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Rule labels with the deterministic stand-in score."""
    return fixtures.standin_score(ruled(spark, sf))


REPORT_COLUMNS = ("userid", "appuser", "amount", *PATTERN_FLAGS)


def report_of(rows: DataFrame, pair: DataFrame | None = None) -> DataFrame:
    """The user report; only what it reads of the scored transfers is stored, and their pairs once."""
    stored = materialize(rows.select("userid", "appuser", "amount", "ml_score", *RULE_FLAGS), "scored")
    return RP.user_report(stored, materialize(R.pairs(stored), "pairs") if pair is None else pair)


def report(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns are matched once: the flagged transfers are stored, in the columns that rules and report read."""
    rows = materialize(flagged(spark, sf).select(*REPORT_COLUMNS), "flagged")
    pair = materialize(R.pairs(rows), "pairs")
    return report_of(fixtures.standin_score(L.rule_labels(rows, pair, CFG)), pair)


def bookie_rows(spark: SparkSession, sf: str) -> DataFrame:
    return RP.bookie_report(report(spark, sf))


# --- cleaning


def etl_device_fill(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixtures.transfers(spark, sf, *ROW_ID)
    return E.fill_device_id(raw).select("ok", "ln", "deviceid")


def etl_desc_clean(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixtures.transfers(spark, sf, *ROW_ID)
    return E.clean_description(raw).select("ok", "ln", "desc_clean")


def etl_desc_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The description cleaner on the long multi-lingual texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = fixtures.spread(docs, "doc_id").withColumnRenamed("text", "description")
    return E.clean_description(docs).select(
        "doc_id", F.md5("desc_clean").alias("digest"), F.length("desc_clean").alias("n_chars")
    )


def etl_ip_country(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixtures.transfers(spark, sf, *ROW_ID)
    return add_country(raw, fixtures.ip_ranges(spark, sf), CFG).select(
        "ok", "ln", "userip", "iploc"
    )


def etl_ip6_country(spark: SparkSession, sf: str) -> DataFrame:
    """IPv6 addresses by customer, ranges of 2^64 and 2^80 addresses by nation."""
    users = fixtures.ip6_users(spark, sf)
    return add_country(users, fixtures.ip6_ranges(spark, sf), CFG).select("c_custkey", "userip", "iploc")


def etl_transfers(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixtures.transfers(spark, sf)
    return E.clean_transfers(raw, fixtures.ip_ranges(spark, sf), CFG)


# --- patterns and profiles


def pattern_flags(spark: SparkSession, sf: str) -> DataFrame:
    return plain(
        flagged(spark, sf).select("ok", "ln", "amount", "amount_tail3", *PATTERN_FLAGS)
    )


def flag_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.flag_summary(flagged(spark, sf))


def sender_profile(spark: SparkSession, sf: str) -> DataFrame:
    clean = stored_etl(spark, sf)
    rows = P.add_patterns(clean, CFG)
    profile = R.sender_profile(rows, R.pairs(clean), R.identifiers(clean)).drop("sender_rows")
    return rounded(profile, {"sender_std_amount": 0})


def receiver_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = receivers(spark, sf).drop("recv_rows")
    return rounded(profile, {"recv_std_amount": 0})


def receiver_count(spark: SparkSession, sf: str) -> DataFrame:
    receivers_only = fixtures.transfers(spark, sf).select("appuser").distinct()
    return receivers_only.agg(F.count(F.lit(1)).alias("receivers"))


def txn_features(spark: SparkSession, sf: str) -> DataFrame:
    clean = stored_etl(spark, sf)
    rows = P.add_patterns(clean, CFG)
    pair = materialize(R.pairs(clean), "pairs")
    featured = R.add_profiles(
        rows.select("ok", "ln", "userid", "appuser"),
        materialize(R.sender_profile(rows, pair, R.identifiers(clean)), "senders"),
        materialize(R.receiver_profile(rows, pair), "receivers"),
        CFG,
    )
    return rounded(featured, {"sender_std_amount": 0, "recv_std_amount": 0})


# --- suspicious-activity flags


def str_ip_change(spark: SparkSession, sf: str) -> DataFrame:
    return plain(S.identifier_flags(ids(spark, sf), CFG).select("userid", "str_ip_change"))


def str_device_share_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a limit so low that most keys go the way of hot ones."""
    hot = Config(hot_share=0.001)
    return plain(S.identifier_flags(ids(spark, sf), hot).select("userid", "str_device_share"))


def str_device_share(spark: SparkSession, sf: str) -> DataFrame:
    return plain(S.identifier_flags(ids(spark, sf), CFG).select("userid", "str_device_share"))


def smurf_in_days(spark: SparkSession, sf: str) -> DataFrame:
    return day_text(S.smurf_in_days(flagged(spark, sf), CFG))


def str_smurfing(spark: SparkSession, sf: str) -> DataFrame:
    return S.smurf_users(flagged(spark, sf), CFG)


def rapid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return day_text(S.rapid_pairs(S.rapid_slots(flagged(spark, sf), CFG), CFG))


def str_rapid_tx(spark: SparkSession, sf: str) -> DataFrame:
    return S.rapid_users(flagged(spark, sf), CFG)


def str_flags(spark: SparkSession, sf: str) -> DataFrame:
    clean = stored_etl(spark, sf)
    return plain(S.user_flags(P.add_patterns(clean, CFG), R.identifiers(clean), CFG))


def str_summary(spark: SparkSession, sf: str) -> DataFrame:
    return S.str_summary(labeled(spark, sf).select("userid", *STR_FLAGS))


# --- rule labels


def bookie_score(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).drop("recv_rows")


def bookies(spark: SparkSession, sf: str) -> DataFrame:
    return L.bookies(scores(spark, sf), CFG).select("appuser", "bookie_score")


def txn_labels(spark: SparkSession, sf: str) -> DataFrame:
    return plain(labeled(spark, sf).select("ok", "ln", *STR_FLAGS, *RULE_FLAGS, "hit_any_rule"))


def labeled_transfers(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled table as the pipeline publishes it, with the country."""
    rows = label_stored(located(spark, sf), CFG).drop(*DROPPED, "dt")
    return plain(rounded(rows, {"sender_std_amount": 0, "recv_std_amount": 0}))


def label_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.label_summary(ruled(spark, sf)), {"percent": 6})


def label_user_counts(spark: SparkSession, sf: str) -> DataFrame:
    return L.rule_user_counts(ruled(spark, sf))


# --- anomaly model

#: What labels and features follow from; the rest of a transfer need not be stored for the scaler.
LABEL_COLUMNS = ("userid", "appuser", "amount", "userip", "deviceid", "ts", "dt", "desc_clean")


def scaler_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Seven significant digits, as sums of doubles depend on their order."""
    rows = training_rows(label_stored(etl(spark, sf).select(*LABEL_COLUMNS), CFG), CFG, F.lit(0))
    stats = forest_scaler_stats(rows, CFG.features).drop("rows")
    return stats.withColumns(
        {c: F.format_string("%.6e", c).cast("double") for c in ("mean", "scale")}
    )


def _trained(spark: SparkSession, sf: str) -> tuple[DataFrame, M.Model, DataFrame]:
    """Stored labelled transfers (what a model reads of them), a model, and their raw scores from the training."""
    needed = dict.fromkeys(("ok", "ln", "reqdate", "userid", "appuser", *CFG.features, "hit_any_rule", "is_bookie_tx"))
    rows = materialize(labeled(spark, sf).select(*needed), "labeled")
    key = F.xxhash64("ok", "ln", "reqdate", "userid", "appuser", "amount")
    return rows, *M.fit(rows, CFG, key, keep=("ok", "ln", "hit_any_rule"))


def iforest_train_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _trained(spark, sf)[1].stats


def iforest_train_rows(spark: SparkSession, sf: str) -> DataFrame:
    """How many transfers the model was trained on, and whether its statistics are in order."""
    stats = iforest_train_stats(spark, sf)
    return stats.select("rows", (F.col("mean") < F.col("p95")).alias("mean_below_p95"), (F.col("p95") <= F.col("max")).alias("p95_in_range"))


def iforest_scores(spark: SparkSession, sf: str) -> DataFrame:
    return M.normalize(_trained(spark, sf)[2])


def iforest_scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Which transfers get a score."""
    return iforest_scores(spark, sf).select("ok", "ln", F.col("ml_score").isNotNull().alias("scored"))


def iforest_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the batch's scores fill the scale from 0 to 100."""
    ends = iforest_scores(spark, sf).agg(F.min("ml_score").alias("low"), F.max("ml_score").alias("high"))
    return ends.select((F.col("low") == 0).alias("lowest_is_0"), (F.col("high") >= 99.99).alias("highest_is_100"))


def score_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """The 0-100 scale on a stand-in for the raw anomaly."""
    raw = scored(spark, sf).withColumn("raw", F.col("ml_score") / 404 + 0.3).drop("ml_score")
    return M.normalize(materialize(raw.select("ok", "ln", "raw"), "raw"))


def score_p95(spark: SparkSession, sf: str) -> DataFrame:
    return M.train_stats(scored(spark, sf))


# --- reports


def user_report(spark: SparkSession, sf: str) -> DataFrame:
    return RP.ranked_users(report(spark, sf))


def flagged_users(spark: SparkSession, sf: str) -> DataFrame:
    return RP.flagged_users(report(spark, sf))


def high_score_users(spark: SparkSession, sf: str) -> DataFrame:
    return RP.high_score_users(report(spark, sf), CFG)


def flagged_txns(spark: SparkSession, sf: str) -> DataFrame:
    """From the columns the labelled table has, as the pipeline publishes them."""
    clean = materialize(located(spark, sf), "etl")
    rows = P.add_patterns(clean, CFG)
    ruled_rows = L.rule_labels(rows, R.pairs(rows), CFG).drop(*DROPPED)
    return plain(RP.flagged_transfers(fixtures.standin_score(ruled_rows)))


def bookie_report(spark: SparkSession, sf: str) -> DataFrame:
    return bookie_rows(spark, sf)


# --- chart datasets


def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    histogram = C.score_histogram(materialize(scored(spark, sf).select("ml_score"), "scores"))
    return rounded(histogram, {"bin_start": 6, "bin_end": 6})


def risk_scatter(spark: SparkSession, sf: str) -> DataFrame:
    return C.risk_scatter(report(spark, sf))


def top_bookies(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_bookies(report(spark, sf))


def group_volume(spark: SparkSession, sf: str) -> DataFrame:
    return C.group_volume(report(spark, sf))


def bookie_flow(spark: SparkSession, sf: str) -> DataFrame:
    return C.bookie_flow(bookie_rows(spark, sf))


def bookie_pnl_bands(spark: SparkSession, sf: str) -> DataFrame:
    """On transfers of which suppliers pay out more, so that bookies fall into all bands."""
    rows = fixtures.generous_suppliers(spark, sf, scored(spark, sf))
    return C.pnl_bands(RP.bookie_report(report_of(rows)))


def gambler_tails(spark: SparkSession, sf: str) -> DataFrame:
    return C.gambler_tails(scored(spark, sf))


# --- questions


def users_in_group(spark: SparkSession, sf: str) -> DataFrame:
    return canned.users_in_group(report(spark, sf), "bookie")


def top_receivers(spark: SparkSession, sf: str) -> DataFrame:
    return canned.top_receivers(report(spark, sf))


def top_senders(spark: SparkSession, sf: str) -> DataFrame:
    return canned.top_senders(flagged(spark, sf))


def risky_gamblers(spark: SparkSession, sf: str) -> DataFrame:
    return canned.risky_gamblers(report(spark, sf), 40.0)


def flagged_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return day_text(canned.flagged_by_day(scored(spark, sf)))


def user_txn_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(scored(spark, sf), "scored")
    users = materialize(RP.user_report(rows, R.pairs(rows)), "user-report")
    joined = canned.flagged_with_users(users, rows, CFG)
    return joined.select("ok", "ln", "userid", "amount", "user_group", "user_score")


def user_profile_360(spark: SparkSession, sf: str) -> DataFrame:
    """From the transfers of that user; the others are not labelled."""
    return plain(canned.profile_of_unlabeled(flagged(spark, sf), "u10", CFG))


def user_assessment(spark: SparkSession, sf: str) -> DataFrame:
    return canned.user_assessment(report(spark, sf))


def foreign_ip_txns(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixtures.transfers(spark, sf)
    return canned.foreign_transfers(add_country(raw, fixtures.ip_ranges(spark, sf), CFG), "C3")


def bet_tail_share(spark: SparkSession, sf: str) -> DataFrame:
    return canned.bet_tail_share(flagged(spark, sf))


def transfers_per_flag(spark: SparkSession, sf: str) -> DataFrame:
    return canned.transfers_per_flag(ruled(spark, sf))


def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return canned.group_counts(report(spark, sf))


# --- table health

GIVEN = ("customer", "lineitem", "nation", "orders", "supplier")


def validate_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.validate_outputs(spark, {t: f"{sf}/{t}.parquet" for t in GIVEN})


def table_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table_freshness(spark, {t: f"{sf}/{t}.parquet" for t in GIVEN})


def table_freshness_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each table has files, and is older than a table derived from it just now."""
    path = new_path(spark, "derived")
    spark.read.parquet(f"{sf}/nation.parquet").write.parquet(path)
    seen = tables.table_freshness(spark, {"derived": path, **{t: f"{sf}/{t}.parquet" for t in GIVEN}})
    newest = F.max(F.when(F.col("table_name") == "derived", F.col("modified"))).over(Window.partitionBy())
    verdicts = seen.select("table_name", (F.col("files") > 0).alias("has_files"), (F.col("modified") < newest).alias("older"))
    return verdicts.where("table_name != 'derived'")


# --- streams


def raw_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Transfers with line items read as a stream of files, day by day in several batches."""
    streams.use_rocksdb(spark)
    lines = fixtures.spread(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey", "l_partkey")
    path = new_path(spark, "line-items")
    for days in ((0, 1), (2, 3), (4, 5, 6)):
        lines.where((F.col("l_orderkey") % 7).isin(*days)).write.mode("append").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    # every batch has files for all cores
    lines = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(path)
    return fixtures.transfers_from(lines, spark.read.parquet(f"{sf}/orders.parquet"), *ROW_ID)


def flagged_stream(spark: SparkSession, sf: str) -> DataFrame:
    return P.add_patterns(E.add_time(E.clean_description(raw_stream(spark, sf))), CFG)


def stream_etl(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "stream-etl")
    ranges = materialize(fixtures.ip_ranges(spark, sf), "ip-ranges")
    raw = raw_stream(spark, sf).drop("ok", "ln")
    streams.stream_clean(raw, ranges, path, new_path(spark, "state"), CFG).awaitTermination()
    return spark.read.parquet(path).drop("ts", "dt")


def stream_smurf_days(spark: SparkSession, sf: str) -> DataFrame:
    path, state = new_path(spark, "stream-smurf"), new_path(spark, "state")
    streams.stream_small_senders(flagged_stream(spark, sf), path, state, CFG).awaitTermination()
    return day_text(streams.smurf_in_days_seen(spark, path, CFG))


def stream_rapid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    path, state = new_path(spark, "stream-rapid"), new_path(spark, "state")
    streams.stream_rapid_slots(flagged_stream(spark, sf), path, state, CFG).awaitTermination()
    return day_text(streams.rapid_pairs_seen(spark, path, CFG))


SCORE_COLUMNS = ("ok", "ln", "hit_any_rule")


def _file_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A stored table as a stream of its files in three batches, so that every batch has files for all cores."""
    files = rows.inputFiles()
    source = files[0].rpartition("/")[0]
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-len(files) // 3)).parquet(source)


def _stream_scored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, M.Model]:
    """Labelled transfers scored as a stream of their files; the transfers and the model."""
    rows, model, _ = _trained(spark, sf)
    path = new_path(spark, "stream-score")
    streams.stream_score(_file_stream(spark, rows), model, path, new_path(spark, "state"), SCORE_COLUMNS).awaitTermination()
    return spark.read.parquet(path), rows, model


def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    return _stream_scored(spark, sf)[0].select("ok", "ln", "hit_any_rule", "ml_score")


def stream_score_agrees(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose streamed score equals the batch's on the same scale, and all rows."""
    streamed, rows, model = _stream_scored(spark, sf)
    batch = M.score_fixed(rows, model, SCORE_COLUMNS)
    told = [df.select("ok", "ln", "ml_score", F.lit(sign).alias("sign")) for df, sign in ((streamed, 1), (batch, -1))]
    apart = told[0].unionByName(told[1]).groupBy("ok", "ln", "ml_score").agg(
        F.count_if(F.col("sign") == 1).alias("n"), F.sum("sign").alias("more")
    )
    return apart.agg(F.sum(F.col("n") - F.greatest("more", F.lit(0))).alias("equal"), F.sum("n").alias("rows"))


def _closed_days(spark: SparkSession, sf: str, reports: audit.StreamAudit) -> str:
    """Smurf-in days closed by a stream that ran four times: three parts of the week, then the first day again.

    The last part has other senders; its day is closed by then.
    """
    streams.use_rocksdb(spark)
    rows = materialize(flagged(spark, sf).select("userid", "appuser", "amount", "ts"), "in-time")
    source, path, state = (new_path(spark, name) for name in ("weeks", "closed-days", "state"))
    stream, day = spark.readStream.schema(rows.schema).parquet, F.dayofmonth("ts")
    late = rows.where(day == 1).withColumn("userid", F.concat(F.lit("late-"), "userid"))
    for part in (rows.where(day <= 2), rows.where(day.between(3, 4)), rows.where(day > 4), late):
        part.write.mode("append").parquet(source)
        reports.wait(streams.stream_closed_smurf_days(stream(source), path, state, CFG))
    return path


def stream_closed_days(spark: SparkSession, sf: str) -> DataFrame:
    """Smurf-in days that a watermark of one day has closed; late transfers change none."""
    with audit.StreamAudit(spark) as reports:
        return day_text(spark.read.parquet(_closed_days(spark, sf, reports)))


def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """How many transfers came after their day was closed."""
    with audit.StreamAudit(spark) as reports:
        _closed_days(spark, sf, reports)
    return reports.table().where("metric = 'late'").agg(F.sum("value").alias("late"))


def stream_rapid_days(spark: SparkSession, sf: str) -> DataFrame:
    """Close pairs of each sender's closed day; four runs, half of each day's transfers come with the next day's."""
    streams.use_rocksdb(spark)
    rows = materialize(flagged(spark, sf).where("ts IS NOT NULL").select("userid", "ts", "dt", "ln"), "in-time")
    source, path, state = (new_path(spark, name) for name in ("weeks", "rapid-days", "state"))
    stream, comes = spark.readStream.schema(rows.schema).parquet, F.dayofmonth("ts") + F.col("ln") % 2
    # a transfer of a later week closes all days
    after = rows.agg(F.max("ts").alias("ts")).select(
        F.lit("clock").alias("userid"), (F.col("ts") + F.expr("INTERVAL 7 DAY")).alias("ts")
    )
    clock = after.select("userid", "ts", F.col("ts").cast("date").alias("dt"), F.lit(0).alias("ln"))
    for part in (rows.where(comes <= 3), rows.where(comes.between(4, 5)), rows.where(comes > 5), clock):
        part.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]).write.mode("append").parquet(source)
        rapid_days.stream_rapid_days(stream(source), path, state, CFG).awaitTermination()
    return day_text(spark.read.parquet(path))


def stream_etl_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that went through the cleaning stream's batches, and their addresses without a country."""
    ranges = materialize(fixtures.ip_ranges(spark, sf), "ip-ranges")
    raw = raw_stream(spark, sf).drop("ok", "ln")
    with audit.StreamAudit(spark) as reports:
        reports.wait(streams.stream_clean(raw, ranges, new_path(spark, "stream-etl"), new_path(spark, "state"), CFG))
    told = reports.table().where("metric IN ('rows_out', 'unmatched')")
    return told.groupBy("metric").agg(F.sum("value").alias("value"))


def stream_score_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the published scores before and after the last batch was sent again, and its batches."""
    rows, model, _ = _trained(spark, sf)
    table = new_path(spark, "scores")
    stream = _file_stream(spark, rows)
    streams.stream_score_published(stream, model, table, new_path(spark, "state"), SCORE_COLUMNS).awaitTermination()
    once = tables.read_batches(spark, table).agg(F.count(F.lit(1)).alias("rows"))
    last = len(tables.published(spark, table)) - 1
    streams.score_batch(rows, last, model, table, SCORE_COLUMNS)
    again = tables.read_batches(spark, table).agg(
        F.count(F.lit(1)).alias("rows_again"), F.count_if(F.col("ml_score").isNotNull()).alias("scored")
    )
    return once.crossJoin(again)


# --- day partials


def daily(spark: SparkSession, sf: str) -> daily_profiles.DailyProfiles:
    """Day partials of three batches of days; the second is added twice."""
    needed = ("ok", "userid", "appuser", "userip", "amount", "dt", *PATTERN_FLAGS)
    day = F.col("ok") % 7
    part = F.when(day.isin(0, 1), 0).when(day.isin(2, 3), 1).when(day.isin(4, 5, 6), 2)
    rows = flagged(spark, sf).select(*needed).withColumn("part", part).where("part IS NOT NULL").drop("ok")
    rows = materialize(rows, "flagged", "part")  # a batch reads its own files
    store = daily_profiles.DailyProfiles(spark, new_path(spark, "daily"))
    for batch in (0, 1, 1, 2):
        store.add(rows.where(F.col("part") == batch), batch, stored=True)
    return store


def sender_profile_daily(spark: SparkSession, sf: str) -> DataFrame:
    profile = daily(spark, sf).profile("sender").drop("sender_rows")
    return rounded(profile, {"sender_std_amount": 0})


def receiver_profile_daily(spark: SparkSession, sf: str) -> DataFrame:
    profile = daily(spark, sf).profile("receiver").drop("recv_rows")
    return rounded(profile, {"recv_std_amount": 0})


def profile_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Users by side, and whether the united sketches are within 3 % of every exact distinct count."""
    store = daily(spark, sf)
    told = []
    for side, key, names in (
        ("sender", "userid", ("sender_unique_receivers", "sender_unique_ips")),
        ("receiver", "appuser", ("recv_unique_senders",)),
    ):
        exact, near = (store.profile(side, approx).select(key, *names) for approx in (False, True))
        both = exact.join(near.select(F.col(key).alias("k"), *[F.col(n).alias(f"{n}_near") for n in names]), F.col(key).eqNullSafe(F.col("k")))
        off = F.greatest(*[F.abs(F.col(f"{n}_near") - F.col(n)) / F.col(n) for n in names], F.lit(0.0))
        told.append(both.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("users"), (F.max(off) <= 0.03).alias("close")))
    return told[0].unionByName(told[1])


# --- the pipeline and its catalog, from CSV files of the given transfers


def _csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def _landed(spark: SparkSession, sf: str) -> str:
    """A folder of CSV files: the given transfers, and one broken line for each nation."""
    folder = _csv(fixtures.transfers(spark, sf), new_path(spark, "landing"))
    nations = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey")
    broken = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("short,u"), "n_nationkey")).otherwise(
        F.concat(F.lit('x,u,"open '), "n_nationkey")
    )
    head = spark.createDataFrame([(0, ",".join(TXN_COLUMNS))], "at int, value string")
    lines = head.unionByName(nations.select((F.col("n_nationkey") + 1).cast("int").alias("at"), broken.alias("value")))
    text = new_path(spark, "broken")
    lines.coalesce(1).sortWithinPartitions("at").select("value").write.text(text)
    fs = spark._jvm.org.apache.hadoop.fs
    source, conf = fs.Path(text), spark._jsc.hadoopConfiguration()
    system = source.getFileSystem(conf)
    part = next(f.getPath() for f in system.listStatus(source) if f.getPath().getName().startswith("part-"))
    fs.FileUtil.copy(system, part, system, fs.Path(f"{folder}/broken.csv"), False, conf)
    return folder


def landing_transfers(spark: SparkSession, sf: str) -> DataFrame:
    """Transfers read back from CSV files; rows that cannot be read are not among them."""
    return landing.accepted(landing.read_landing(spark, _landed(spark, sf)))


def landing_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """The broken lines with their reason, by file."""
    bad = landing.rejected(landing.read_landing(spark, _landed(spark, sf)))
    files = F.regexp_extract("source_file", r"([^/]+)$", 1)
    return bad.select(files.alias("file"), "reason", "text")


def landing_placed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and parts placed under names that clash, read back by file."""
    folder, now = new_path(spark, "drop"), datetime(2024, 1, 2, 3, 4, 5)
    drops = (("orders", "o_orderkey", "../Giao dịch (1).CSV"), ("part", "p_partkey", "Giao_d_ch_1.csv"), ("orders", "o_orderkey", "é.csv"))
    for name, key, wanted in drops:
        rows = spark.read.parquet(f"{sf}/{name}.parquet").select(F.lit(name).alias("kind"), F.col(key).alias("key"))
        # each part file of a table is dropped under the same name
        for path in sorted(r["path"] for r in landing.csv_files(spark, _csv(rows, new_path(spark, name))).select("path").collect()):
            landing.place_csv(spark, path, folder, wanted, now)
    read = spark.read.schema("kind string, key bigint").option("header", True).csv(folder)
    # parts of a table get numbered names; how many there are depends on the session
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return read.select(F.regexp_replace(name, r"(_20240102_030405(_\d+)?)*\.csv$", "").alias("stem"), "kind", "key")


def _pipeline(spark: SparkSession, sf: str, *stages: str) -> Pipeline:
    """A pipeline whose cleaned transfers are published from CSV files, and the named stages after it."""
    ranges = fixtures.ip_ranges(spark, sf).orderBy("seq").drop("seq").coalesce(1)
    pipe = Pipeline(spark, new_path(spark, "root"), CFG)
    with scratch(spark):  # no stage reads the files again
        pipe.etl(_landed(spark, sf), _csv(ranges, new_path(spark, "ranges")))
    for stage in stages:
        getattr(pipe, stage)()
    return pipe


def pipeline_labeled(spark: SparkSession, sf: str) -> DataFrame:
    """The published labels, read through the catalog: transfers and users of every rule."""
    sql = Catalog(spark, _pipeline(spark, sf, "features").root)
    return sql.sql("SELECT * FROM maindb").select("userid", "appuser", "reqdate", "amount", *[F.col(c).cast("int").alias(c) for c in (*PATTERN_FLAGS, *STR_FLAGS, *RULE_FLAGS, "hit_any_rule")])


def sql_group_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals by receiver, by day and of everything in one pass, through the catalog."""
    sql = Catalog(spark, _pipeline(spark, sf, "features").root)
    query = """SELECT appuser, CAST(dt AS STRING) AS dt, CAST(grouping_id() AS INT) AS level, count(*) AS transfers,
      sum(amount) AS total FROM transactions GROUP BY GROUPING SETS ((appuser), (dt), ())"""
    return sql.sql_safe(query).data


def export_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A result exported as CSV, and saved as Parquet, read back."""
    sql = Catalog(spark, _pipeline(spark, sf, "features").root)
    query = "SELECT userid, count(*) AS transfers, max(amount) AS most FROM maindb GROUP BY userid"
    csv = spark.read.option("header", True).schema("userid string, transfers bigint, most bigint").csv(
        sql.export_csv(query, datetime(2024, 1, 2, 3, 4, 5))
    )
    path = new_path(spark, "saved")
    sql.save_safe(query, path)
    kinds = (("csv", csv), ("parquet", spark.read.parquet(path)))
    told = [df.select(F.lit(kind).alias("kind"), "userid", "transfers", "most") for kind, df in kinds]
    return told[0].unionByName(told[1])


def _reported(spark: SparkSession, sf: str) -> Pipeline:
    return _pipeline(spark, sf, "features", "training", "promote", "reports")


def pipeline_report(spark: SparkSession, sf: str) -> DataFrame:
    """The published bookie report and user groups, as far as no model decides them, through the catalog."""
    sql = Catalog(spark, _reported(spark, sf).root)
    sql.register("bookies", "report_bookie")
    return sql.sql("""SELECT r.user_id, user_group, total_sent_tx, total_sent_amount, r.total_recv_tx, unique_senders,
      b.user_id IS NOT NULL AS in_bookie_report FROM rpt_users r LEFT JOIN bookies b ON b.user_id = r.user_id""")


def chart_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Published captions, and whether each one's dataset has rows."""
    pipe = _reported(spark, sf)
    captions = pipe.table("charts/captions")
    filled = None
    for name in C.CHARTS:
        one = pipe.table(f"charts/{name}").agg(F.lit(name).alias("chart"), (F.count(F.lit(1)) > 0).alias("filled"))
        filled = one if filled is None else filled.unionByName(one)
    return captions.join(filled, "chart")


def registration_results(spark: SparkSession, sf: str) -> DataFrame:
    """What became of registering the given tables, a missing one and one of damaged files; rows by SQL."""
    damaged = new_path(spark, "damaged")
    spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").cast("string").alias("value")).coalesce(1).write.text(damaged)
    sql = Catalog(spark, new_path(spark, "root"), {})
    names = {t: f"{sf}/{t}.parquet" for t in GIVEN} | {"absent": f"{sf}/absent.parquet", "damaged": damaged}
    told = None
    for name, outcome in sql.register_all_safe(names).items():
        counted = sql.sql(f"SELECT count(*) AS rows FROM {name}") if outcome.success else spark.range(1).select(F.lit(None).cast("bigint").alias("rows"))
        one = counted.select(F.lit(name).alias("table_name"), F.lit(outcome.success).alias("success"), "rows")
        told = one if told is None else told.unionByName(one)
    return told


def preflight_results(spark: SparkSession, sf: str) -> DataFrame:
    """Which queries the catalog runs: by the tables that they read, their runs and their SQL."""
    root = new_path(spark, "root")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    tables.publish(orders, f"{root}/etl")
    tables.publish(orders, f"{root}/labeled", made_from=tables.runs_of(spark, root, ["etl"]))
    users = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total_flagged_tx"))
    tables.publish(users, f"{root}/report_users", made_from=tables.runs_of(spark, root, ["labeled"]))
    sql = Catalog(spark, root)
    queries_ = {
        "column named like a table": "SELECT total_flagged_tx FROM rpt_users",
        "by alias": "SELECT * FROM transactions",
        "missing table": "SELECT * FROM txn_flg",
        "defined in the query": "WITH txn_flg AS (SELECT 1 AS n FROM maindb) SELECT * FROM txn_flg",
        "unknown column": "SELECT nothing FROM maindb",
    }
    found = [(name, "before", sql.sql_safe(q)) for name, q in queries_.items()]
    tables.publish(orders.where("false"), f"{root}/etl")
    found += [(name, "after new transfers", sql.sql_safe(q)) for name, q in queries_.items()]
    return spark.createDataFrame(
        [(name, moment, r.success, r.rows) for name, moment, r in found],
        "query string, moment string, success boolean, rows bigint",
    )


def pipeline_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of the published tables, current and after new transfers were published."""
    pipe = _reported(spark, sf)
    names = ("labeled", "scored", "report_users", "report_bookie")
    sql = Catalog(spark, pipe.root)
    before = [(n, sql.stale(n) is None) for n in ("maindb", "rpt_users")]
    first = materialize(tables.lineage(spark, pipe.root, names).drop("run"), "lineage")
    tables.publish(pipe.table("etl"), pipe.path("etl"))
    after = [(n, sql.stale(n) is None) for n in ("maindb", "rpt_users")]
    second = tables.lineage(spark, pipe.root, names).drop("run")
    checks = spark.createDataFrame(
        [(n, moment, ok) for moment, seen in (("stale before", before), ("stale after", after)) for n, ok in seen],
        "table_name string, source string, current boolean",
    )
    told = [df.withColumn("moment", F.lit(m)) for df, m in ((first, "before"), (second, "after"), (checks, "catalog"))]
    return told[0].unionByName(told[1]).unionByName(told[2])


def scored_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Scored transfers published in time order: their files' rows, overlaps and rows out of order."""
    path = new_path(spark, "scored")
    ordered.publish_ordered(materialize(scored(spark, sf), "standin"), path, ["reqdate"])
    files = ordered.file_ranges(spark, path, "reqdate")
    return files.agg(
        F.sum("rows").alias("rows"),
        F.count_if("overlaps_next").alias("overlapping"),
        F.sum("unordered").alias("unordered"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


# --- chat log

# Phrases that occur in the given conversations.
SPOKEN = G.Vocabulary(
    meta=("help", "thre"),
    complaint_steps=("der ", "die "),
    complaint_marks=("ung", "ver"),
    next=("the be", "the the"),
    pipeline=(("etl", ("ble ", "ea of")), ("features", ("queeau",)), ("reports", ("ción",))),
    report=("ou ",),
    transaction=("th", "é"),
    correction=("en",),
    general=("the",),
    specific=("ing",),
    done=("the",),
    negative=("ing",),
    steps=((3, ("shre",), (), ("thble",)), (2, ("of a",), ("eau",), ()), (1, ("in",), ("on",), ())),
)


def chats(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def intent_tags(spark: SparkSession, sf: str) -> DataFrame:
    return G.intent_tags(chats(spark, sf), SPOKEN)


def intent_counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.intent_counts(G.intent_tags(chats(spark, sf), SPOKEN))


def recent_turns(spark: SparkSession, sf: str) -> DataFrame:
    return G.recent_turns(chats(spark, sf))


def worded_chats(spark: SparkSession, sf: str, phrases: list[str] = G.phrases(G.DEFAULT)) -> DataFrame:
    """The given turns, each with one of the real phrases put behind its text."""
    pick = F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7, F.lit(len(phrases)))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.get(F.array(*[F.lit(p) for p in phrases]), pick.cast("int")))
    return chats(spark, sf).withColumn("text", said)


def intent_tags_worded(spark: SparkSession, sf: str) -> DataFrame:
    return G.intent_tags(worded_chats(spark, sf))


def ambiguous_turns(spark: SparkSession, sf: str) -> DataFrame:
    return G.ambiguous_turns(worded_chats(spark, sf))


def last_step(spark: SparkSession, sf: str) -> DataFrame:
    return G.last_step(chats(spark, sf), SPOKEN)


def last_step_worded(spark: SparkSession, sf: str) -> DataFrame:
    return G.last_step(worded_chats(spark, sf, G.step_reports(G.DEFAULT)))


QUERIES = {
    f.__name__: f
    for f in (
        etl_device_fill,
        etl_desc_clean,
        etl_desc_documents,
        etl_ip_country,
        etl_ip6_country,
        etl_transfers,
        pattern_flags,
        flag_summary,
        sender_profile,
        receiver_profile,
        receiver_count,
        txn_features,
        str_ip_change,
        str_device_share,
        str_device_share_hot,
        smurf_in_days,
        str_smurfing,
        rapid_pairs,
        str_rapid_tx,
        str_flags,
        str_summary,
        bookie_score,
        bookies,
        txn_labels,
        labeled_transfers,
        label_summary,
        label_user_counts,
        scaler_stats,
        iforest_train_stats,
        iforest_train_rows,
        iforest_scores,
        iforest_scored_rows,
        iforest_scale,
        score_normalize,
        score_p95,
        user_report,
        flagged_users,
        high_score_users,
        flagged_txns,
        bookie_report,
        score_histogram,
        risk_scatter,
        top_bookies,
        group_volume,
        bookie_flow,
        bookie_pnl_bands,
        gambler_tails,
        users_in_group,
        top_receivers,
        top_senders,
        risky_gamblers,
        flagged_by_day,
        user_txn_join,
        user_profile_360,
        user_assessment,
        foreign_ip_txns,
        bet_tail_share,
        transfers_per_flag,
        group_counts,
        validate_outputs,
        table_freshness,
        table_freshness_verdicts,
        stream_etl,
        stream_smurf_days,
        stream_rapid_pairs,
        stream_rapid_days,
        stream_score,
        stream_score_agrees,
        stream_closed_days,
        stream_late_rows,
        stream_etl_audit,
        stream_score_repeated,
        sender_profile_daily,
        receiver_profile_daily,
        profile_sketches,
        landing_transfers,
        landing_rejected,
        pipeline_labeled,
        sql_group_totals,
        export_round_trip,
        pipeline_report,
        chart_captions,
        registration_results,
        preflight_results,
        pipeline_lineage,
        scored_in_order,
        intent_tags,
        intent_counts,
        recent_turns,
        intent_tags_worded,
        ambiguous_turns,
        last_step,
        last_step_worded,
        landing_placed,
    )
}
