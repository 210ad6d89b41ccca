import os
import random
import re
import shutil
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.config import PATTERN_FLAGS, Config
from tidewatch.contract import queries
from tidewatch.operators import daily, profiles
from tidewatch.plans.catalog import Catalog, relations
from tidewatch.sources import landing, ordered, tables
from tidewatch.sources.storage import work_dir
from tidewatch.streaming import audit, streams


def test_ordered_files_do_not_overlap(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None if k % 50 == 0 else f"2024-01-{rng.randrange(1, 29):02d}", k) for k in range(4000)]
    rows += [("2024-01-15", -1)] * 4000  # a busy second of equal rows
    df = spark.createDataFrame(rows, "at string, n int").repartition(6)
    path = str(tmp_path / "t")
    source = str(tmp_path / "s")
    df.write.parquet(source)
    spark.conf.set("spark.sql.adaptive.enabled", False)  # small partitions are not merged
    try:
        ordered.publish_ordered(spark.read.parquet(source), path, ["at"])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = ordered.file_ranges(spark, path, "at").collect()
    assert len(files) == 8 and sum(f["rows"] for f in files) == len(rows)
    assert not any(f["overlaps_next"] or f["unordered"] for f in files)
    assert max(f["rows"] for f in files) < len(rows) / 4
    assert Counter(map(tuple, tables.read_table(spark, path).collect())) == Counter(rows)
    # a table that is not ordered is told
    plain = str(tmp_path / "p")
    tables.publish(spark.read.parquet(source), plain)
    assert any(f["unordered"] for f in ordered.file_ranges(spark, plain, "at").collect())
    assert any(f["overlaps_next"] for f in ordered.file_ranges(spark, plain, "at").collect())
    empty = str(tmp_path / "e")
    ordered.publish_ordered(df.where("false"), empty, ["at"])
    assert tables.read_table(spark, empty).count() == 0 and ordered.file_ranges(spark, empty, "at").collect() == []


def test_staleness_follows_runs_and_not_times(spark, tmp_path):
    root = str(tmp_path / "root")
    tables.publish(spark.range(3), f"{root}/etl")
    tables.publish(spark.range(3), f"{root}/labeled", made_from=tables.runs_of(spark, root, ["etl"]))
    tables.publish(spark.range(2), f"{root}/report_users", made_from=tables.runs_of(spark, root, ["labeled", "none"]))
    assert tables.outdated(spark, root, "report_users") is None
    # file times say nothing: the sources look newer than what was made from them
    later = datetime.now().timestamp() + 9000
    for folder, _, names in os.walk(f"{root}/etl"):
        for name in names:
            os.utime(os.path.join(folder, name), (later, later))
    assert tables.outdated(spark, root, "labeled") is None
    assert Catalog(spark, root, {"rpt_users": "report_users", "maindb": "labeled"}).stale("maindb") is None
    # a copied root keeps its record
    copy = str(tmp_path / "copy")
    shutil.copytree(root, copy)
    assert tables.outdated(spark, copy, "report_users") is None
    tables.publish(spark.range(4), f"{root}/etl")
    assert tables.outdated(spark, root, "labeled") == "etl"
    assert tables.outdated(spark, root, "report_users") == "etl"
    cat = Catalog(spark, root, {"rpt_users": "report_users", "maindb": "labeled"})
    assert "run features" in cat.stale("maindb") and "etl has a newer run" in cat.stale("rpt_users")
    told = {(r["table_name"], r["source"]): r["current"] for r in tables.lineage(spark, root, ["labeled", "report_users", "etl"]).collect()}
    assert told == {("labeled", "etl"): False, ("report_users", "labeled"): True}


@pytest.mark.parametrize(
    "sql, names",
    [
        ("SELECT total_flagged_tx FROM rpt_users", {"rpt_users"}),
        ("SELECT * FROM a JOIN spark_catalog.d.b ON a.x = b.x", {"a", "b"}),
        ("WITH a AS (SELECT * FROM b) SELECT * FROM a", {"b"}),
        ("WITH a AS (SELECT * FROM a) SELECT * FROM a", {"a"}),
        ("WITH x AS (SELECT 1), y AS (SELECT * FROM x, c) SELECT * FROM y", {"c"}),
        ("SELECT (SELECT max(v) FROM c) FROM a WHERE EXISTS (SELECT 1 FROM b) AND k IN (SELECT k FROM d)", {"a", "b", "c", "d"}),
        ("SELECT * FROM (WITH a AS (SELECT 1) SELECT * FROM a) JOIN a", {"a"}),
        ("SELECT 'from z' -- from y\n FROM `Odd` UNION ALL SELECT * FROM b", {"odd", "b"}),
        ("SELECT 1", set()),
        ("no sql at all", set()),
        ("SELECT appuser, sum(v) FROM m GROUP BY GROUPING SETS ((appuser), ()) HAVING sum(v) > (SELECT avg(v) FROM n)", {"m", "n"}),
    ],
)
def test_tables_of_a_query(spark, sql, names):
    assert relations(spark, sql) == names


def flagged_rows(spark, n, seed, users=9):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        day = rng.choice([None, *(datetime(2024, 1, d).date() for d in (1, 2, 3))])
        flags = [rng.choice([0, 1, None]) for _ in PATTERN_FLAGS]
        amount = rng.choice([None, rng.randrange(10**9), 10**9 + 7])
        rows.append((rng.choice([None, *(f"u{k}" for k in range(users))]), f"r{rng.randrange(4)}", rng.choice([None, "1.1.1.1", "2.2.2.2"]), amount, day, *flags))
    return spark.createDataFrame(rows, "userid string, appuser string, userip string, amount bigint, dt date, " + ", ".join(f"{f} int" for f in PATTERN_FLAGS))


def test_profiles_of_appended_batches(spark, tmp_path):
    parts = [flagged_rows(spark, 300, 1), flagged_rows(spark, 200, 2), flagged_rows(spark, 1, 3), flagged_rows(spark, 50, 4).where("false")]
    store = daily.DailyProfiles(spark, str(tmp_path))
    for k in (0, 1, 1, 2, 3, 0):  # repeated batches change nothing
        store.add(parts[k], k)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    pair, ids = profiles.pairs(whole), whole.select("userid", F.lit("ip").alias("kind"), F.col("userip").alias("value")).distinct()
    for side, expect in (("sender", profiles.sender_profile(whole, pair, ids)), ("receiver", profiles.receiver_profile(whole, pair))):
        for approx in (False, True):
            got = store.profile(side, approx)
            assert got.columns == expect.columns
            a, b = (sorted(df.collect(), key=lambda r: str(r[0])) for df in (got, expect))
            assert len(a) == len(b)
            for x, y in zip(a, b, strict=True):
                for c in got.columns:
                    assert x[c] == y[c] or x[c] == pytest.approx(y[c], rel=1e-9), (side, approx, c, x[c], y[c])


def test_stored_transfers_are_not_stored_again(spark, tmp_path, monkeypatch):
    rows = flagged_rows(spark, 100, 5)
    once, again = (daily.DailyProfiles(spark, str(tmp_path / name)) for name in ("once", "again"))
    again.add(rows, 0)
    monkeypatch.setattr(daily, "materialize", lambda *_: pytest.fail("stored a second time"))
    once.add(rows, 0, stored=True)
    for side in ("sender", "receiver"):
        a, b = (sorted(map(str, store.profile(side).collect())) for store in (once, again))
        assert a == b


def test_batches_of_the_daily_queries_read_their_own_files(spark, monkeypatch):
    added = []
    rows = flagged_rows(spark, 90, 6).withColumn("ok", F.monotonically_increasing_id() % 9 - 1)  # some in no batch
    monkeypatch.setattr(queries, "flagged", lambda *_: rows)
    monkeypatch.setattr(daily.DailyProfiles, "add", lambda self, part, batch, stored=False: added.append((batch, part, stored)))
    queries.daily(spark, "")
    days = {0: (0, 1), 1: (2, 3), 2: (4, 5, 6)}
    assert [batch for batch, _, _ in added] == [0, 1, 1, 2]
    for batch, part, stored in added:
        scan = part._jdf.queryExecution().executedPlan().toString()
        assert stored and re.search(rf"PartitionFilters: \[[^]]*\(part#\d+ = {batch}\)", scan)
        mine = rows.where((F.col("ok") % 7).isin(*days[batch])).select("userid", "appuser", "amount")
        assert sorted(map(str, part.select(*mine.columns).collect())) == sorted(map(str, mine.collect()))


def test_sketches_of_many_partners(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.lit("hot").alias("userid"), F.concat(F.lit("r"), F.col("id") % 40_000).alias("appuser"), F.lit("1").alias("userip"),
        F.lit(5).cast("bigint").alias("amount"), F.make_date(F.lit(2024), F.lit(1), (F.col("id") % 5 + 1).cast("int")).alias("dt"),
        *[F.lit(0).alias(f) for f in PATTERN_FLAGS],
    )
    store = daily.DailyProfiles(spark, str(tmp_path))
    store.add(rows, 0)
    near = store.profile("sender", approx=True).first()
    assert near["sender_unique_receivers"] == pytest.approx(40_000, rel=0.03) and near["sender_unique_ips"] == 1
    assert store.profile("sender").first()["sender_unique_receivers"] == 40_000


def test_places_and_rejected_rows(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    head = ",".join(landing.RAW_COLUMNS)
    lines = ["2024,u1,u2,5,1.1.1.1,d,ios,hi", "short,row", 'a,b,c,1,2,3,4,"open', "a,b,c,1,2,3,4,5,6", 'a,b,c,NA,2,3,,"x, ""y"""', ""]
    (folder / "a.csv").write_text("\n".join([head, *lines]))
    (folder / "b.CSV").write_text("\n".join([head, "z,u1,u2,5,1.1.1.1,d,ios,"]))
    (folder / "c.txt").write_text("no")
    (folder / "d.csv").write_text("\n".join([head, "y,u1,u2,5,1.1.1.1,d,ios,", head]))  # a header again is a row
    landed = landing.read_landing(spark, str(folder))
    good = landing.accepted(landed, places=True).orderBy("source_file", "source_row").collect()
    assert [(r["source_file"][-5:], r["reqdate"], r["amount"], r["description"]) for r in good] == [
        ("a.csv", "2024", "5", "hi"), ("a.csv", "a", None, 'x, "y"'), ("b.CSV", "z", "5", None),
        ("d.csv", "y", "5", None), ("d.csv", "reqdate", "amount", "description"),
    ]
    assert good[0]["source_row"] < good[1]["source_row"]
    bad = {(r["reason"], r["text"]) for r in landing.rejected(landed).collect()}
    assert bad == {("wrong number of columns", lines[1]), ("quote without end", lines[2]), ("wrong number of columns", lines[3])}
    assert landing.accepted(landed).columns == list(landing.RAW_COLUMNS)
    (folder / "e.csv").write_text("\n".join([head.replace("amount", "sum"), "y,u1,u2,5,1.1.1.1,d,ios,"]))
    with pytest.raises(ValueError, match="another header"):
        landing.read_landing(spark, str(folder))


def test_repeated_batch_is_published_once(spark, tmp_path):
    table = str(tmp_path / "t")
    tables.publish_batch(spark.range(5), table, 0)
    tables.publish_batch(spark.range(9), table, 0)
    tables.publish_batch(spark.range(2), table, 1)
    # a batch that died before its pointer was written
    spark.range(7).write.parquet(f"{table}/batch-000000000002")
    assert tables.read_batches(spark, table).count() == 7
    tables.publish_batch(spark.range(3), table, 2)
    assert tables.read_batches(spark, table).count() == 10
    with pytest.raises(FileNotFoundError):
        tables.read_batches(spark, str(tmp_path / "none"))


def test_days_are_closed_once_and_late_rows_counted(spark, tmp_path):
    streams.use_rocksdb(spark)
    cfg = Config(smurf_senders=2)
    start = datetime(2024, 3, 30)
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "userid string, appuser string, amount bigint, ts timestamp_ntz"

    def rows(day, users, amount=10):
        return [(u, "r", amount, start + timedelta(days=day, hours=23, minutes=59)) for u in users]

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # the clock changes on the 31st
    try:
        with audit.StreamAudit(spark) as reports:
            seen = []
            for part in (
                rows(0, "aab"),
                rows(0, "bc") + rows(1, "xyz"),
                rows(3, "k") + rows(1, "w") + [("q", "r", None, None)],
                rows(0, "defg") + rows(1, "v") + rows(9, "k", 10**9),
            ):
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
                stream = spark.readStream.schema(schema).parquet(source)
                reports.wait(streams.stream_closed_smurf_days(stream, path, state, cfg))
                seen.append(sorted((str(r["dt"]), r["senders"]) for r in spark.read.parquet(path).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert seen[0] == seen[1] == [] and seen[2] == seen[3] == [("2024-03-30", 3), ("2024-03-31", 4)]
    told = reports.table().where("metric = 'late'").agg(F.sum("value")).first()[0]
    assert told == 5


def test_only_lines_with_a_quote_are_matched_for_an_open_one(spark):
    lines = ['a,b', '"a",b', 'a,"b', '"a ""b",c', 'a"b,c', 'a,"b ""', '', '"', None, 'a,b"c"', ',,"x']
    told = spark.createDataFrame([(v,) for v in lines], "v string").select(
        landing._quote_open(F.col("v")).alias("got"), F.col("v").rlike(landing._OPEN_QUOTE).alias("want")
    )
    rows = told.collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert {r["got"] for r in rows} == {True, False, None}


def test_plain_lines_are_split_like_the_parser_reads_them(spark, tmp_path):
    """Odd characters, quotes and broken text, against the CSV parser line by line; nothing is stored but the headers."""
    rng = random.Random(5)
    bits = ["a", "NA", " ", "\t", '"', '""', ",", "é", " ", "\x85", "\0", "﻿", "#", "\\", "'", "\x0b", "\U0001f600", "\xa0", "-nan"]
    folder = tmp_path / "raw"
    folder.mkdir()
    for name in "ab":
        lines = [landing.RAW_COLUMNS]
        for _ in range(1500):
            lines.append(["".join(rng.choice(bits) for _ in range(rng.randrange(3))) for _ in range(rng.choice([8, 8, 8, 7, 9]))])
        raw = [",".join(line).encode() for line in lines]
        raw = [r[:3] + b"\xff\xc3" + r[3:] if k % 40 == 39 else r for k, r in enumerate(raw)]
        (folder / f"{name}.csv").write_bytes(b"\n".join([b"", *raw]))
    before = set(os.listdir(work_dir(spark).removeprefix("file:")))
    landed = landing.read_landing(spark, str(folder))
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(work_dir(spark).removeprefix("file:"))) - before} == {"heads"}
    schema = ", ".join(f"{c} string" for c in (*landing.RAW_COLUMNS, "unread"))
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unread"}
    lines = spark.read.text(str(folder)).where("trim(value) != ''").withColumn("r", F.from_csv("value", F.lit(schema), options))
    lines = lines.where(F.col("value") != ",".join(landing.RAW_COLUMNS))
    wrong = F.col("r.unread").isNotNull() | F.col("value").rlike(landing._OPEN_QUOTE)
    want = landing.blank_to_null(lines.where(~wrong).select("r.*").drop("unread"))
    assert Counter(map(tuple, landing.accepted(landed).collect())) == Counter(map(tuple, want.collect()))
    bad = landing.rejected(landed).select("text")
    assert Counter(bad.collect()) == Counter(lines.where(wrong).select("value").collect())
    assert want.count() > 500 and bad.count() > 500
