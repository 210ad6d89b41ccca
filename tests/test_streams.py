import os
from collections import defaultdict
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import by
from tidewatch.config import Config
from tidewatch.operators import str_flags as S
from tidewatch.operators.etl import add_time, clean_description, clean_transfers, fill_device_id
from tidewatch.operators.patterns import add_patterns
from tidewatch.sources.landing import read_raw, read_raw_stream
from tidewatch.streaming import rapid_days, streams

CFG = Config(smurf_senders=3)
HEADER = "reqdate,userid,appuser,amount,userip,deviceid,platform,description\n"


def lines(day, n, step):
    return [
        f"2024-01-{day:02d} 10:{i * step // 60 % 60:02d}:{i * step % 60:02d},u{i % 7},r{i % 2},{1000 + i},1.0.0.{i},,ios,Tiền {i}"
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    """One file per day in time order, then a late file for the first day."""
    folder = tmp_path_factory.mktemp("landing")
    days = {1: lines(1, 40, 1), 2: lines(2, 30, 4), 5: lines(5, 30, 2)}
    for at, (day, rows) in enumerate(days.items()):
        path = folder / f"{day}.csv"
        path.write_text(HEADER + "\n".join(rows) + "\n")
        os.utime(path, (1_700_000_000 + at * 100,) * 2)
    late = folder / "late.csv"
    late.write_text(HEADER + "2024-01-01 10:00:00,late,r0,5,1.0.0.1,,ios,x\n")
    os.utime(late, (1_700_001_000,) * 2)
    return str(folder)


@pytest.fixture(scope="module")
def ranges(spark):
    row = [("VN", "ipv4", "1.0.0.0", 20, 0)]
    return spark.createDataFrame(row, "country string, type string, start string, value bigint, seq bigint")


def prepared(raw):
    return add_patterns(add_time(clean_description(fill_device_id(raw))), CFG)


def test_cleaning_stream_equals_batch_and_restarts(spark, landing, ranges, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # the second start finds nothing new
        raw = read_raw_stream(spark, landing, files_per_trigger=1)
        streams.stream_clean(raw, ranges, out, state, CFG).awaitTermination()
    batch = add_time(clean_transfers(read_raw(spark, landing), ranges, CFG))
    got = spark.read.parquet(out)
    assert got.columns == batch.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_streamed_smurf_days_drop_only_late_data(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    txn = prepared(read_raw_stream(spark, landing, files_per_trigger=1))
    streams.stream_small_senders(txn, out, str(tmp_path / "state"), CFG).awaitTermination()
    seen = spark.read.parquet(out)
    assert seen.count() == seen.distinct().count() and seen.where("userid = 'late'").count() == 0
    on_time = prepared(read_raw(spark, landing)).where("userid <> 'late'")
    want = by(S.smurf_in_days(on_time, CFG), "appuser", "dt")
    assert by(streams.smurf_in_days_seen(spark, out, CFG), "appuser", "dt") == want and want


def test_streamed_rapid_pairs_equal_batch(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    txn = prepared(read_raw_stream(spark, landing, files_per_trigger=1))
    streams.stream_rapid_slots(txn, out, str(tmp_path / "state"), CFG).awaitTermination()
    batch = prepared(read_raw(spark, landing)).where("userid <> 'late'")
    want = by(S.rapid_pairs(S.rapid_slots(batch, CFG), CFG), "userid", "dt")
    assert by(streams.rapid_pairs_seen(spark, out, CFG), "userid", "dt") == want


def test_slots_of_one_day_merge_across_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = lines(1, 60, 1)
    for i in range(3):
        (folder / f"{i}.csv").write_text(HEADER + "\n".join(rows[i::3]) + "\n")
    out = str(tmp_path / "out")
    txn = prepared(read_raw_stream(spark, str(folder), files_per_trigger=1))
    streams.stream_rapid_slots(txn, out, str(tmp_path / "state"), CFG).awaitTermination()
    per_user = defaultdict(int)
    for i in range(60):
        per_user[f"u{i % 7}"] += 1
    got = by(streams.rapid_pairs_seen(spark, out, CFG), "userid")
    assert {u: r["pairs"] for u, r in got.items()} == {u: n - 1 for u, n in per_user.items()}
    batches = spark.read.parquet(out).select(F.col("batch")).distinct().count()
    assert batches == 3


def test_stream_takes_columns_from_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER.strip() + ",branch\n2024-01-01 10:00:00,u1,r0,5,1.0.0.1,,ios,x,north\n")
    assert read_raw_stream(spark, str(tmp_path)).columns == read_raw(spark, str(tmp_path)).columns
    (tmp_path / "empty").mkdir()
    assert len(read_raw_stream(spark, str(tmp_path / "empty")).columns) == 8
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="lack columns"):
        read_raw_stream(spark, str(tmp_path / "bad"))


def test_heavy_and_missing_addresses_in_a_stream(spark, landing, ranges, tmp_path):
    """The way for bucket tables too large to broadcast gives the same countries."""
    big = Config(smurf_senders=3, broadcast_buckets=0)
    raw = read_raw_stream(spark, landing, files_per_trigger=1)
    streams.stream_clean(raw, ranges, str(tmp_path / "o"), str(tmp_path / "s"), big).awaitTermination()
    batch = add_time(clean_transfers(read_raw(spark, landing), ranges, CFG))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "o")).collect())) == sorted(map(str, batch.collect()))


def test_rapid_days_are_written_once_when_closed(spark, tmp_path):
    """Out of order over batches, a NULL sender, gaps at the limit, midnight, a late transfer."""
    fields = "userid string, ts timestamp_ntz, dt date"
    at = lambda day, clock: f"2024-01-{day:02d} {clock}"
    batches = [
        [("a", at(1, "23:59:58")), ("a", at(1, "10:00:09.5")), (None, at(1, "08:00:00")), ("b", at(1, "09:00:00"))],
        [("a", at(1, "10:00:00")), ("a", at(2, "00:00:01")), (None, at(1, "08:00:05")), ("b", at(1, "09:00:10"))],
        [("a", at(1, "10:00:19.499999")), ("a", at(2, "00:00:01")), ("b", at(1, "09:00:19.999999")), ("c", None)],
        [("z", at(20, "00:00:00"))],
        [("a", at(1, "10:00:01"))],  # its day is closed
    ]
    frames = [
        spark.createDataFrame([(u, t) for u, t in b], "userid string, t string")
        .selectExpr("userid", "to_timestamp_ntz(t) AS ts", "CAST(to_timestamp_ntz(t) AS DATE) AS dt")
        for b in batches
    ]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    old = spark.conf.get(streams._STORE, None)
    streams.use_rocksdb(spark)
    try:
        for frame in frames:
            frame.write.mode("append").parquet(source)
            stream = spark.readStream.schema(fields).parquet(source)
            query = rapid_days.stream_rapid_days(stream, out, state, CFG)
            query.awaitTermination()
    finally:
        spark.conf.unset(streams._STORE) if old is None else spark.conf.set(streams._STORE, old)
    on_time = frames[0].unionByName(frames[1]).unionByName(frames[2])
    want = by(S.rapid_pairs(S.rapid_slots(on_time, CFG), CFG), "userid", "dt")
    assert by(spark.read.parquet(out), "userid", "dt") == want and len(want) == 4
    assert spark.read.parquet(out).count() == 4
    walked = [s for s in query.lastProgress.stateOperators if s.operatorName.startswith("transformWithState")]
    assert [s.numRowsTotal for s in walked] == [0]


def test_one_call_walks_all_senders_of_a_bucket():
    """Rows of a day come in any order and in several chunks; no state is asked for."""
    day = date(2024, 1, 1)
    slots = [("b", 1, 100, 100), (None, 2, 5, 9), ("a", 1, 40, 40), ("b", 3, 0, 9), ("a", 1, 50, 50), (None, 1, 18, 18)]
    chunks = [pd.DataFrame(part, columns=["userid", "n", "first", "last"]) for part in (slots[:2], slots[2:])]
    got = pd.concat(rapid_days.DayWalk(10).handleInputRows((day, 7), iter(chunks), None))
    assert set(got["dt"]) == {day}
    pairs = {None if pd.isna(user) else user: n for user, n in zip(got["userid"], got["pairs"], strict=True)}
    assert pairs == {"a": 0, "b": 2, None: 2}


def test_file_stream_has_three_batches_of_a_stored_table(spark, tmp_path):
    """However many files; batches of three files left most cores idle."""
    from tidewatch.contract.queries import _file_stream

    path = str(tmp_path / "rows")
    spark.range(0, 1200, 1, 12).write.parquet(path)
    stream = _file_stream(spark, spark.read.parquet(path))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [400, 400, 400]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1200
