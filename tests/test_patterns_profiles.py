import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.helpers import by, raw_frame
from tidewatch.config import Config
from tidewatch.operators.etl import add_time, clean_description, fill_device_id
from tidewatch.operators.patterns import add_patterns, flag_summary
from tidewatch.operators.profiles import (
    add_profiles,
    identifiers,
    pairs,
    receiver_profile,
    sender_profile,
)

CFG = Config()


def flagged_frame(spark, rows):
    return add_patterns(add_time(clean_description(fill_device_id(raw_frame(spark, rows)))), CFG)


@pytest.mark.parametrize(
    "amount, value, tail, bet",
    [
        ("123.0", None, None, None),
        ("1e3", None, None, None),
        (" 5 ", 5, 5, 0),
        ("x", None, None, None),
        (None, None, None, None),
        ("-989", -989, 11, 1),
        ("11", 11, 11, 1),
        ("1012", 1012, 12, 1),
        ("1013", 1013, 13, 0),
    ],
)
def test_amounts(spark, amount, value, tail, bet):
    row = flagged_frame(spark, [{"amount": amount}]).first()
    assert (row["amount"], row["amount_tail3"], row["is_bet_tail"]) == (value, tail, bet)


@pytest.mark.parametrize(
    "text, win, b1, b2",
    [
        ("WIN5", 1, 0, 0),
        ("win٣", 1, 0, 0),
        ("đwin5", 0, 0, 0),
        ("a_win5", 0, 0, 0),
        ("5win", 0, 0, 0),
        ("Chuyển khoản 123456", 0, 1, 0),
        ("chuyển   tiền: 123456 !", 0, 1, 0),
        ("chuyen tien 12345", 0, 0, 1),
        ("chuyen tien 1234567", 0, 0, 0),
        ("chuyen tien 12345 x", 0, 0, 0),
        ("Dùng ZaloPay chuyển tiền 123456", 0, 0, 0),
        (None, 0, 0, 0),
    ],
)
def test_descriptions(spark, text, win, b1, b2):
    row = flagged_frame(spark, [{"description": text}]).first()
    assert (row["desc_has_win"], row["desc_match_b1"], row["desc_match_b2"]) == (win, b1, b2)


def test_patterns_are_tried_where_their_word_is_found(spark):
    rows = raw_frame(spark, [{"description": d} for d in ("win1", "gain 7", "chuyen tien 12345", "chuyen khoan 123456")])
    etl = clean_description(rows)
    plan = add_patterns(etl, CFG)._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"Contains(desc_clean" in plan and f", {word})" in plan for word in ("win", "chuyen"))
    # the word of another pattern is not known, so it is tried on every text
    other = add_patterns(etl, replace(CFG, win_pattern=r"gain \d", pattern_b1="^win"))
    got = [(r["desc_has_win"], r["desc_match_b1"], r["desc_match_b2"]) for r in other.collect()]
    assert got == [(0, 1, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0)]


def test_missing_device_uses_user_and_address(spark):
    rows = [
        {"deviceid": None},
        {"deviceid": None, "userid": None},
        {"deviceid": None, "userip": None},
        {"deviceid": "x"},
    ]
    got = [r["deviceid"] for r in fill_device_id(raw_frame(spark, rows)).collect()]
    assert got == ["a-1.1.1.1", "-1.1.1.1", "a-", "x"]


def test_flag_summary_of_nothing_is_zero(spark):
    empty = flagged_frame(spark, [{}]).where("false")
    assert {r["flag"]: r["transfers"] for r in flag_summary(empty).collect()} == {
        "is_bet_tail": 0,
        "desc_has_win": 0,
        "desc_match_b1": 0,
        "desc_match_b2": 0,
    }


ROWS = [
    {"userid": "a", "appuser": "b", "amount": "11", "userip": "1.1.1.1"},
    {"userid": "a", "appuser": "b", "amount": "5000", "userip": None},
    {"userid": "a", "appuser": None, "amount": "bad", "userip": "1.1.1.1"},
    {"userid": "c", "appuser": "b", "amount": "7"},
    {"userid": "d", "appuser": "e", "amount": "bad"},
    {"userid": None, "appuser": "b", "amount": "3", "userip": "2.2.2.2"},
    {"userid": None, "appuser": "e", "amount": "4", "userip": "3.3.3.3"},
]


def profiles(spark, rows):
    flagged = flagged_frame(spark, rows)
    pair, ids = pairs(flagged), identifiers(flagged)
    return flagged, sender_profile(flagged, pair, ids), receiver_profile(flagged, pair)


def test_sender_profile(spark):
    _, senders, _ = profiles(spark, ROWS)
    got = by(senders, "userid")
    a = got["a"]
    assert a["sender_tx_count"] == 2 and a["sender_rows"] == 3
    assert a["sender_unique_receivers"] == 2, "NULL counts as a receiver"
    assert a["sender_unique_ips"] == 2, "NULL counts as an address"
    assert a["sender_total_sent"] == 5011 and a["sender_max_amount"] == 5000
    assert a["sender_std_amount"] == pytest.approx(statistics.stdev([11, 5000]))
    assert a["sender_bet_tail_ratio"] == 0.5
    assert got["c"]["sender_std_amount"] == 0, "one transfer has no deviation"
    d = got["d"]
    assert (d["sender_tx_count"], d["sender_total_sent"], d["sender_avg_amount"]) == (0, 0, None)
    assert got[None]["sender_unique_ips"] == 2 and got[None]["sender_unique_receivers"] == 2


def test_receiver_profile(spark):
    _, _, receivers = profiles(spark, ROWS)
    got = by(receivers, "appuser")
    assert got["b"]["recv_unique_senders"] == 3, "a, c and NULL"
    assert got["b"]["recv_tx_count"] == 4 and got["b"]["recv_total_received"] == 5021
    assert got[None]["recv_tx_count"] == 0


def test_features_keep_every_row_and_null_ids_get_nothing(spark):
    flagged, senders, receivers = profiles(spark, ROWS)
    rows = add_profiles(flagged, senders, receivers, CFG).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r["sender_tx_count"] is None) == (r["userid"] is None)
        assert (r["recv_tx_count"] is None) == (r["appuser"] is None)
    one = next(r for r in rows if r["userid"] == "c")
    assert one["recv_send_tx_ratio"] == pytest.approx(4 / (1 + 4 + 1))


def test_a_hot_sender_gets_the_same_features(spark):
    rows = [{"userid": "hot", "appuser": f"r{i % 50}", "amount": str(i % 5)} for i in range(600)]
    rows += [{"userid": f"u{i}", "appuser": "hot", "amount": str(i)} for i in range(300)]
    flagged, senders, receivers = profiles(spark, rows)
    tiny = Config(hot_share=0.1)
    normal = add_profiles(flagged, senders, receivers, CFG)
    split = add_profiles(flagged, senders, receivers, tiny)
    assert sorted(map(str, normal.collect())) == sorted(map(str, split.collect()))
    hot = split.where(F.col("userid") == "hot").first()
    assert hot["sender_tx_count"] == 600 and hot["sender_unique_receivers"] == 50
