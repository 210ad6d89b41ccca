"""The four stages.  They meet at published tables below one root folder."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import Config
from tidewatch.operators import reports as RP
from tidewatch.operators import str_flags as S
from tidewatch.operators.charts import (
    bookie_flow,
    chart_catalog,
    gambler_tails,
    group_volume,
    pnl_bands,
    risk_scatter,
    score_histogram,
    top_bookies,
)
from tidewatch.operators.etl import add_time, clean_transfers
from tidewatch.operators.forest import file_row_key
from tidewatch.operators.labels import label_summary, label_transfers, rule_user_counts
from tidewatch.operators.patterns import add_patterns, flag_summary
from tidewatch.operators.profiles import identifiers, pairs, receiver_profile, sender_profile
from tidewatch.operators.scoring import Model, score, train, train_stats
from tidewatch.sources.landing import REJECTED, accepted, read_ip_ranges, read_landing, rejected
from tidewatch.sources.ordered import publish_ordered
from tidewatch.sources.storage import materialize, scratch
from tidewatch.sources.tables import (
    current_path,
    made_from,
    modified,
    outdated,
    publish,
    publish_csv,
    published,
    read_table,
    runs_of,
    table_error,
    validate_outputs,
)

log = logging.getLogger(__name__)

DROPPED = ("userip", "deviceid", "platform", "ts")
REPORTS = ("transactions_flagged", "report_users", "report_high_score_users", "report_bookie")
STAGES = ("etl", "features", "reports", "training")


def label_stored(etl: DataFrame, cfg: Config, dropped: Sequence[str] = ()) -> DataFrame:
    """Labelled transfers from cleaned ones, which are read once and need not be stored.

    Amounts and pattern flags are evaluated once and stored, for they are read six times.
    The user level frames are written, too: each is used several times and is far smaller
    than the transfers.

    ``dropped`` names columns that the result leaves out.  With them ``etl`` has to be a stored
    table: users' flags read these columns there, and they are not stored a second time.
    """
    patterned = add_patterns(etl, cfg)
    flagged = materialize(patterned.drop(*dropped), "flagged")
    # no pattern is matched again, as the flags below use none
    whole = patterned if dropped else flagged
    pair = materialize(pairs(flagged), "pairs")
    ids = materialize(identifiers(whole), "identifiers")
    senders = materialize(sender_profile(flagged, pair, ids), "senders")
    receivers = materialize(receiver_profile(flagged, pair), "receivers")
    flags = materialize(S.user_flags(whole, ids, cfg), "user-flags")
    return label_transfers(flagged, senders, receivers, flags, cfg)


def _stage(method):
    """A stage leaves its published tables only."""

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        with scratch(self.spark):
            return method(self, *args, **kwargs)

    return run


class Pipeline:
    """Raw transfers to reports, one stage at a time."""

    def __init__(self, spark: SparkSession, root: str, cfg: Config | None = None):
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), cfg or Config()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path(name))

    # --- order of the stages

    def blocked(self, stage: str) -> str | None:
        """Why a stage cannot run yet, or None."""
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage}")
        if stage == "etl":
            return None
        if table_error(self.spark, self.path("etl")):
            return "no cleaned transfers yet: run etl first"
        if stage == "features":
            return None
        if table_error(self.spark, self.path("labeled")):
            return "no labelled transfers yet: run features first"
        if self._labels_outdated():
            return "labelled transfers are older than the cleaned ones: run features first"
        if stage == "reports" and not published(self.spark, self.path("models/active")):
            return "no active model: run training and promote it"
        return None

    def next_stage(self) -> str:
        """The first of etl, features, reports whose input is newer than its output."""
        if modified(self.spark, self.path("etl")) is None:
            return "etl"
        no_labels = modified(self.spark, self.path("labeled")) is None
        return "features" if no_labels or self._labels_outdated() else "reports"

    def _labels_outdated(self) -> bool:
        """By the recorded runs; by file times for labels that have no record."""
        if made_from(self.spark, self.path("labeled")) is not None:
            return outdated(self.spark, self.root, "labeled") is not None
        return modified(self.spark, self.path("labeled")) < modified(self.spark, self.path("etl"))

    def _runs(self, *names: str) -> dict[str, str]:
        return runs_of(self.spark, self.root, names)

    def _require(self, stage: str) -> None:
        if reason := self.blocked(stage):
            raise RuntimeError(reason)

    # --- stages

    @_stage
    def etl(self, raw_dir: str, ip_ranges: str) -> dict[str, int]:
        """Raw folder to cleaned transfers; returns the row counts in, out and rejected.

        Rows that do not have the header's columns go to the table ``rejected`` with a reason.
        """
        started = time.time()
        read, written = Observation("read"), Observation("written")
        landed = read_landing(self.spark, raw_dir)
        bad = rejected(landed)
        publish(bad, self.path(REJECTED))
        raw = accepted(landed).observe(read, F.count(F.lit(1)).alias("rows"))
        ranges = materialize(read_ip_ranges(self.spark, ip_ranges), "ip-ranges")
        clean = add_time(clean_transfers(raw, ranges, self.cfg))
        clean = clean.observe(written, F.count(F.lit(1)).alias("rows"))
        publish(clean, self.path("etl"))
        log.info("etl took %.1f s", time.time() - started)
        return {"rows_in": read.get["rows"], "rows_out": written.get["rows"], "rows_rejected": self.table(REJECTED).count()}

    @_stage
    def features(self, by_day: bool = False) -> str:
        """Cleaned transfers to labelled transfers.

        ``by_day`` writes one folder per day.  It costs a shuffle that splits
        large days and merges small ones; without it every task would write a
        file per day.
        """
        self._require("features")
        started = time.time()
        sources = self._runs("etl")
        labeled = label_stored(self.table("etl"), self.cfg, DROPPED)
        if by_day:
            path = publish(labeled.hint("rebalance", "dt"), self.path("labeled"), ["dt"], sources)
        else:
            path = publish(labeled, self.path("labeled"), made_from=sources)
        log.info("features took %.1f s", time.time() - started)
        return path

    def summaries(self) -> dict[str, DataFrame]:
        """Totals a human compares after the features stage."""
        labeled = self.table("labeled")
        return {
            "flags": flag_summary(labeled),
            "suspicious": S.str_summary(labeled),
            "labels": label_summary(labeled),
            "users": rule_user_counts(labeled),
        }

    @_stage
    def training(self) -> Model:
        """Fit a candidate model; it is used only after ``promote``."""
        self._require("training")
        labeled = self.spark.read.parquet(current_path(self.spark, self.path("labeled")))
        model = train(labeled, self.cfg, file_row_key())
        run = f"run-{model.trained_at.replace(' ', 'T').replace(':', '')}"
        model.save(self.path(f"models/candidates/{run}"))
        publish(
            self.spark.createDataFrame([(run,)], "run string").coalesce(1),
            self.path("models/latest"),
        )
        return Model.load(self.spark, self.path(f"models/candidates/{run}"))

    def promote(self) -> str:
        """Make the latest candidate the active model."""
        run = self.table("models/latest").first()["run"]
        publish(
            self.spark.createDataFrame([(run,)], "run string").coalesce(1),
            self.path("models/active"),
        )
        return run

    def active_model(self) -> Model:
        run = self.table("models/active").first()["run"]
        return Model.load(self.spark, self.path(f"models/candidates/{run}"))

    @_stage
    def reports(self) -> DataFrame:
        """Score the labelled transfers and publish all reports and chart datasets."""
        self._require("reports")
        started = time.time()
        sources = self._runs("labeled", "models/active")
        with scratch(self.spark):  # the raw scores are not needed any more once they are published in order
            scored = score(self.table("labeled"), self.active_model(), keep=RP.FLAGGED_COLUMNS)
            publish_ordered(scored, self.path("scored"), ["reqdate"], sources)
        scored = self.table("scored")
        report = materialize(RP.user_report(scored, materialize(pairs(scored), "pairs")), "user-report")
        high = RP.high_score_users(report, self.cfg).withColumn(
            "threshold", F.lit(float(self.cfg.score_threshold))
        )
        bookies = RP.bookie_report(report)
        publish(RP.flagged_transfers(scored), self.path("transactions_flagged"), made_from=sources)
        publish(RP.ranked_users(report), self.path("report_users"), made_from=sources)
        publish(high, self.path("report_high_score_users"), made_from=sources)
        publish(bookies, self.path("report_bookie"), made_from=sources)
        publish_csv(RP.flagged_users(report), self.path("csv/report_flagged_users"))
        publish_csv(high, self.path("csv/report_high_score_users"))
        publish_csv(bookies, self.path("csv/report_bookie"))
        charts = {
            "score_histogram": score_histogram(scored),
            "score_stats": train_stats(scored),
            "risk_scatter": risk_scatter(report),
            "top_bookies": top_bookies(report),
            "group_volume": group_volume(report),
            "bookie_flow": bookie_flow(bookies),
            "bookie_pnl_bands": pnl_bands(bookies),
            "gambler_tails": gambler_tails(scored),
        }
        for name, data in charts.items():
            publish(data, self.path(f"charts/{name}"), made_from=sources)
        publish(chart_catalog(self.spark).coalesce(1), self.path("charts/captions"))
        log.info("reports took %.1f s", time.time() - started)
        return validate_outputs(self.spark, {t: self.path(t) for t in REPORTS})
