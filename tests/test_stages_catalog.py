import glob
import os
import pathlib
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.config import Config
from tidewatch.contract import queries
from tidewatch.plans.catalog import Catalog, clean_sql, show, split_export
from tidewatch.operators.etl import add_time, clean_description, fill_device_id
from tidewatch.plans import stages
from tidewatch.plans.stages import REPORTS, Pipeline
from tidewatch.sources.landing import csv_files, landing_name, place_csv, read_ip_ranges, read_raw
from tidewatch.sources import storage
from tidewatch.sources.tables import publish, publish_csv, read_table, table_error, validate_outputs

HEADER = "reqdate,userid,appuser,amount,userip,deviceid,platform,description\n"
CFG = Config(trees=20, tree_rows=32, min_train_rows=1)


def write_raw(folder, name, n, seed):
    rnd = random.Random(seed)
    lines = []
    for i in range(n):
        ts = datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(3 * 86400))
        bet = rnd.random() < 0.3
        receiver = "bookie" if bet else f"u{rnd.randrange(30)}"
        amount = rnd.randrange(1, 900) * 1000 + (11 if bet else rnd.randrange(20, 999))
        note = rnd.choice(["Chuyển khoản 123456", "ăn trưa", "", '"WIN99, nhé"', "NULL"])
        ip = rnd.choice(["1.2.3.4", "9.9.9.9", "", "2001:db8::5"])
        lines.append(f"{ts},u{rnd.randrange(30)},{receiver},{amount},{ip},{rnd.choice(['', 'd1'])},ios,{note}\n")
    (folder / name).write_text(HEADER + "".join(lines), encoding="utf-8")


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("run")
    raw = base / "raw"
    raw.mkdir()
    write_raw(raw, "a.csv", 300, 1)
    write_raw(raw, "b.CSV", 200, 2)
    (raw / "notes.txt").write_text("not a transfer")
    ranges = base / "ranges.csv"
    ranges.write_text("country,type,start,value\nVN,ipv4,1.0.0.0,16777216\nNA,ipv6,2001:db8::,16\n")
    pipe = Pipeline(spark, str(base / "out"), CFG)
    before = {s: pipe.blocked(s) for s in ("features", "reports", "training")}
    counts = pipe.etl(str(raw), str(ranges))
    pipe.features()
    no_model = pipe.blocked("reports")
    pipe.training()
    still_no_model = pipe.blocked("reports")
    pipe.promote()
    checked = pipe.reports()
    return {
        "pipe": pipe, "raw": str(raw), "ranges": str(ranges), "counts": counts, "before": before,
        "no_model": no_model, "still": still_no_model,
        "checked": {r["table_name"]: (r["ok"], r["rows"]) for r in checked.collect()},
    }


def test_stage_order(run):
    assert all(run["before"].values())
    assert "model" in run["no_model"] and "model" in run["still"]
    assert run["pipe"].blocked("reports") is None and run["pipe"].next_stage() == "reports"
    with pytest.raises(ValueError):
        run["pipe"].blocked("nothing")


def test_cleaning_keeps_every_row(run):
    assert run["counts"] == {"rows_in": 500, "rows_out": 500, "rows_rejected": 0}
    etl = run["pipe"].table("etl")
    assert etl.columns == [
        "reqdate", "userid", "appuser", "amount", "userip", "iploc", "deviceid", "platform",
        "desc_clean", "ts", "dt",
    ]
    assert {r[0] for r in etl.select("iploc").distinct().collect()} == {"", "VN", "NA"}
    notes = {r[0] for r in etl.select("desc_clean").distinct().collect()}
    assert notes == {"chuyen khoan 123456", "an trua", "", "win99 nhe"}, "NULL text is missing"
    assert etl.where("deviceid is null").count() == 0


def test_labelled_table(run):
    labeled = run["pipe"].table("labeled")
    assert labeled.count() == 500 and len(labeled.columns) == 44
    assert not {"userip", "deviceid", "platform", "desc_clean"} & set(labeled.columns)
    totals = {k: df.count() for k, df in run["pipe"].summaries().items()}
    assert totals == {"flags": 4, "suspicious": 4, "labels": 8, "users": 2}


def test_labelled_table_by_day(run, tmp_path):
    pipe = Pipeline(run["pipe"].spark, str(tmp_path), CFG)
    publish(run["pipe"].table("etl"), pipe.path("etl"))
    path = pipe.features(by_day=True)
    assert len(list((tmp_path / "labeled").glob("run-*/dt=*"))) == 3 and path
    assert pipe.table("labeled").count() == 500


def test_reports_are_published(run):
    assert set(run["checked"]) == set(REPORTS) and all(ok for ok, _ in run["checked"].values())
    flagged = run["pipe"].table("transactions_flagged")
    assert flagged.where("ml_score is not null or hit_any_rule <> 1").count() == 0
    scored = 500 - flagged.count()
    histogram = run["pipe"].table("charts/score_histogram")
    assert histogram.agg(F.sum("transfers")).first()[0] == scored
    assert run["pipe"].table("report_bookie").where("user_id = 'bookie'").count() == 1


def test_sql_on_the_published_tables(run, spark):
    cat = Catalog(spark, run["pipe"].root)
    assert cat.registered == {"rpt_users", "txn_flg", "highmls", "maindb"}
    result = cat.sql_safe("SELECT count(*) AS n FROM rpt_users WHERE user_group LIKE '%bookie%'")
    assert result.success and result.rows == 1 and show(result.data, 1).startswith("n: ")
    both = cat.sql_safe("SELECT * FROM total_flagged_tx JOIN transactions USING (userid) LIMIT 3")
    assert both.success and both.rows == 3
    assert "3 rows" in show(both.data, both.rows)
    assert not cat.sql_safe("SELECT nothing FROM rpt_users").success
    assert cat.referenced("select * from RPT_USERS, total_flagged_tx") == ["rpt_users", "txn_flg"]
    assert cat.sql("WITH a AS (SELECT 1 AS x) SELECT x FROM a").first()[0] == 1


def test_saving_and_exporting(run, spark, tmp_path):
    cat = Catalog(spark, run["pipe"].root)
    out = str(tmp_path / "q")
    assert cat.save_safe("SELECT user_id FROM rpt_users", out).success
    assert spark.read.parquet(out).count() == cat.sql("SELECT * FROM rpt_users").count()
    assert not cat.save_safe("SELECT x FROM rpt_users", out).success
    path = cat.export_csv("SELECT user_id FROM rpt_users", datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("query/export_20240102_030405")
    assert spark.read.option("header", True).csv(path).columns == ["user_id"]


def test_time_limit(run, spark):
    cat = Catalog(spark, run["pipe"].root)
    slow = "SELECT id FROM range(10000000000000) WHERE sqrt(id) < 0"
    result = cat.sql_safe(slow, timeout=3)
    assert not result.success and "longer than 3 s" in result.error
    assert cat.sql_safe("SELECT 1", timeout=60).rows == 1


def test_registering(run, spark, tmp_path):
    cat = Catalog(spark, str(tmp_path), {})
    assert not cat.register_safe("none", "missing").success
    with pytest.raises(ValueError):
        cat.register("none", "missing")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    details = cat.register_all_safe({"bad": "bad", "good": f"{run['pipe'].root}/report_users"})
    assert not details["bad"].success and details["good"].success
    spark.range(3).write.parquet(str(tmp_path / "three"))
    cat.register("good", "three")
    assert cat.sql("SELECT * FROM good").count() != 3, "a registered name is kept"
    cat.register("good", "three", overwrite=True)
    assert cat.sql("SELECT * FROM good").count() == 3
    assert "not ready" in cat.sql_safe("SELECT * FROM bad").error


def test_tables_from_the_environment(run, spark, monkeypatch):
    monkeypatch.setenv("TIDEWATCH_TABLES", '{"people": "report_users"}')
    assert Catalog(spark, run["pipe"].root).registered == {"people"}


def test_stale_tables_are_refused(run, spark):
    pipe = run["pipe"]
    cat = Catalog(spark, pipe.root)
    assert cat.preflight("SELECT * FROM maindb, rpt_users") is None
    time.sleep(1.1)
    publish(pipe.table("etl"), pipe.path("etl"))
    assert "older" in cat.sql_safe("SELECT * FROM maindb").error
    assert "older" in cat.sql_safe("SELECT * FROM highmls").error
    assert "older" in pipe.blocked("reports") and pipe.next_stage() == "features"
    with pytest.raises(RuntimeError):
        pipe.reports()


def test_a_failed_run_keeps_the_published_one(spark, tmp_path):
    table = str(tmp_path / "t")
    publish(spark.range(5), table)
    with pytest.raises(Exception):
        publish(spark.range(5).selectExpr("raise_error('stop') AS x"), table)
    assert read_table(spark, table).count() == 5
    publish(spark.range(2), table)
    assert read_table(spark, table).count() == 2
    got = {r[0]: (r[1], r[2]) for r in validate_outputs(spark, {"t": table, "u": table + "x"}).collect()}
    assert got == {"t": (True, 2), "u": (False, None)}
    assert "not exist" in table_error(spark, table + "x")


def test_raw_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_raw(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text(HEADER.replace("description", "note") + "1,2,3,4,5,6,7,8\n")
    with pytest.raises(ValueError, match="description"):
        read_raw(spark, str(tmp_path))
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.csv").write_text(
        "x," + HEADER + "1,n/a,None,NULL,nan,,NA,#N/A,<NA>\n" + '2,a,b,c,007,"q ""z"", w",e,f,g\n'
    )
    rows = read_raw(spark, str(good)).orderBy("x").collect()
    assert all(v is None for v in rows[0][1:]) and rows[1]["amount"] == "007"
    assert rows[1]["userip"] == 'q "z", w'
    (good / "b.csv").write_text("y," + HEADER + "1,2,3,4,5,6,7,8,9\n")
    with pytest.raises(Exception):
        read_raw(spark, str(good)).collect()


def test_range_file_keeps_order_and_namibia(run, spark):
    rows = read_ip_ranges(spark, run["ranges"]).orderBy("seq").collect()
    assert [r["country"] for r in rows] == ["VN", "NA"]


def test_landing_names():
    now = datetime(2024, 1, 2, 3, 4, 5)
    assert landing_name("../Giao dịch (1).CSV", set(), now) == "Giao_d_ch_1.csv"
    assert landing_name("a.csv", {"a.csv"}, now) == "a_20240102_030405_1.csv"
    assert landing_name("a.csv", {"a.csv", "a_20240102_030405_1.csv"}, now).endswith("_2.csv")
    assert landing_name("é.csv", set(), now) == "upload_20240102_030405.csv"
    with pytest.raises(ValueError):
        landing_name("a.exe", set(), now)


def test_sql_text():
    assert clean_sql("```sql\n-- hi\nWITH a AS (SELECT 1)\nSELECT * FROM a\n```") == (
        "WITH a AS (SELECT 1) SELECT * FROM a"
    )
    assert clean_sql("Here: SELECT 1") == "SELECT 1"
    assert split_export("[query] SELECT 1 [e] ") == ("SELECT 1", True)
    assert split_export("SELECT 1") == ("SELECT 1", False)


def test_config():
    assert Config.from_json('{"bet_tails": [7], "seed": 1}').bet_tails == (7,)
    with pytest.raises(ValueError):
        Config.from_mapping({"nope": 1})
    with pytest.raises(ValueError):
        Config(ipv6_value="x")


def test_stages_leave_no_intermediate_tables(run, spark):
    import os

    from tidewatch.sources.storage import materialize, scratch, work_dir

    folder = work_dir(spark)
    before = set(os.listdir(folder))
    run["pipe"].features()
    run["pipe"].training()
    run["pipe"].reports()  # they are of the new labels, as later tests ask for them
    assert set(os.listdir(folder)) == before
    with scratch(spark):
        inside = materialize(spark.range(3), "inside")
        with scratch(spark):
            materialize(spark.range(3), "deeper")
        assert inside.count() == 3 and len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before


def test_model_keeps_its_statistics(run):
    stats = run["pipe"].training().stats.first()
    assert stats["rows"] > 0 and 0 <= stats["mean"] <= stats["p95"] <= stats["max"] <= 100


def test_readers_see_whole_runs_only(spark, tmp_path):
    table = str(tmp_path / "t")
    publish(spark.range(5), table)
    # files of a run that was never pointed at, as a lost job leaves them
    spark.range(7).write.parquet(f"{table}/run-lost")
    assert read_table(spark, table).count() == 5
    publish(spark.range(9), table)
    assert read_table(spark, table).count() == 9
    names = sorted(p.name for p in (tmp_path / "t" / "_runs").iterdir() if not p.name.endswith(".crc"))
    assert [n[:13] for n in names] == ["000000000000-", "000000000001-"]


def test_checked_query_runs_once_and_is_stored(run, spark):
    cat = Catalog(spark, run["pipe"].root)
    result = cat.sql_safe("SELECT user_id, user_id, ml_score, NULL AS gap FROM rpt_users")
    assert result.success, result.error
    assert result.data.columns == ["user_id", "user_id", "ml_score", "gap"]
    # what is shown comes from the stored result, not from the reports again
    assert all("query-result" in f for f in result.data.inputFiles())
    assert show(result.data, result.rows).startswith(f"{result.rows} rows")


def test_every_action_has_a_time_limit(run, spark, tmp_path):
    cat = Catalog(spark, run["pipe"].root)
    slow = "SELECT count(*) AS n FROM range(0, 100000000000, 1, 8) WHERE sqrt(id) < 0"
    assert "ran longer" in cat.save_safe(slow, str(tmp_path / "slow"), timeout=2).error
    with pytest.raises(ValueError, match="ran longer"):
        cat.export_csv(slow, datetime(2024, 1, 1), timeout=2)
    with pytest.raises(ValueError):
        cat.export_csv("SELECT nothing FROM rpt_users", datetime(2024, 1, 1))


def test_placed_files_never_overwrite(spark, tmp_path):
    """Clashing names, a name that another session has claimed, and a file of another kind."""
    now, folder = datetime(2024, 1, 2, 3, 4, 5), tmp_path / "drop"
    source = tmp_path / "in.csv"
    for text, name in (("a\n1\n", "x.csv"), ("a\n2\n", "x.CSV"), ("a\n3\n", "deep/x.csv")):
        source.write_text(text)
        place_csv(spark, str(source), str(folder), name, now)
    (folder / ".y.csv.claim").write_text("")
    assert place_csv(spark, str(source), str(folder), "y.csv", now).endswith("/y_20240102_030405_1.csv")
    assert place_csv(spark, str(source), str(folder), now=now).endswith("/in.csv")
    with pytest.raises(ValueError):
        place_csv(spark, str(source), str(folder), "x.exe", now)
    got = {p.name: p.read_text() for p in folder.iterdir() if not p.name.startswith(".")}
    assert got["x.csv"] == "a\n1\n" and got["x_20240102_030405_1.csv"] == "a\n2\n" and got["x_20240102_030405_2.csv"] == "a\n3\n"
    assert len(got) == 5 == csv_files(spark, str(folder)).count()
    assert not [p for p in folder.iterdir() if p.name.endswith(".uploading")]


def test_labels_read_the_cleaned_transfers_once(spark, tmp_path, monkeypatch):
    """Pairs and identifiers come from the stored flags, so cleaned transfers need not be stored for them."""
    raw = spark.createDataFrame(
        [("2024-01-01 10:00:00", "u1", "r1", "5", "1.0.0.1", None, "ios", "x"), (None, None, "r1", "7", None, "d", "ios", None)],
        "reqdate string, userid string, appuser string, amount string, userip string, deviceid string, platform string, description string",
    )
    path, sources = str(tmp_path / "etl"), []
    add_time(clean_description(fill_device_id(raw))).write.parquet(path)
    store = stages.materialize
    monkeypatch.setattr(stages, "materialize", lambda df, name: (sources.append((name, df.inputFiles())), store(df, name))[1])
    assert stages.label_stored(spark.read.parquet(path), CFG).count() == 2
    assert [name for name, files in sources if any(path in f for f in files)] == ["flagged"]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    """A kept reference holds back the collection of garbage, as a busy driver's does."""
    kept = spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("id").alias("n"))
    before, setting = shuffle_files(spark), spark.conf.get(storage._FREED, None)
    storage.materialize(kept, "freed")
    publish(kept, str(tmp_path / "t"))
    publish_csv(kept, str(tmp_path / "csv"))
    for _ in range(50):  # executors remove the files a moment later
        # the count of the published rows may leave some of one row
        left = shuffle_files(spark) - before
        if len({name.split("_")[1] for name in left}) <= 1:
            break
        time.sleep(0.1)
    assert len({name.split("_")[1] for name in left}) <= 1
    assert spark.conf.get(storage._FREED, None) == setting


def test_columns_that_labels_leave_out_are_not_stored_again(run, spark, monkeypatch):
    etl, store, stored = run["pipe"].table("etl"), stages.materialize, {}
    monkeypatch.setattr(stages, "materialize", lambda df, name: (stored.setdefault(name, df.columns), store(df, name))[1])
    narrow = stages.label_stored(etl, CFG, stages.DROPPED)
    assert not set(stored["flagged"]) & {*stages.DROPPED, "desc_clean"}
    whole = stages.label_stored(etl, CFG).drop(*stages.DROPPED)
    assert narrow.columns == whole.columns
    assert sorted(map(str, narrow.collect())) == sorted(map(str, whole.collect()))


def test_raw_scores_are_gone_before_the_reports(run, monkeypatch):
    seen, rank = [], stages.RP.user_report
    monkeypatch.setattr(stages.RP, "user_report", lambda *args: (seen.append(glob.glob(f"{storage.work_dir(run['pipe'].spark)}/raw-scores-*".removeprefix("file:"))), rank(*args))[1])
    before = glob.glob(f"{storage.work_dir(run['pipe'].spark)}/raw-scores-*".removeprefix("file:"))
    run["pipe"].reports()
    assert seen == [before]


def test_files_that_a_query_lands_are_gone_after_the_cleaning(spark, monkeypatch):
    landed = []
    monkeypatch.setattr(queries, "_landed", lambda spark, _: landed.append(storage.new_path(spark, "landing")) or write_landing(landed[0]))
    monkeypatch.setattr(queries.fixtures, "ip_ranges", lambda spark, _: spark.createDataFrame([("VN", "ipv4", "1.0.0.0", "256", 0)], "country string, type string, start string, value string, seq int"))
    pipe = queries._pipeline(spark, "")
    assert not os.path.exists(landed[0]) and pipe.table("etl").count() == 40


def write_landing(folder):
    os.makedirs(folder)
    write_raw(pathlib.Path(folder), "a.csv", 40, 7)
    return folder
