import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from tests.helpers import by
from tests.test_patterns_profiles import flagged_frame
from tidewatch.config import Config
from tidewatch.operators import str_flags as S
from tidewatch.operators.profiles import identifiers

CFG = Config()


def flags(spark, rows, cfg=CFG):
    txn = flagged_frame(spark, rows)
    return by(S.user_flags(txn, identifiers(txn), cfg), "userid")


def test_address_or_device_change(spark):
    got = flags(
        spark,
        [
            {"userid": "one", "userip": "1", "deviceid": "o"},
            {"userid": "one", "userip": "1", "deviceid": "o"},
            {"userid": "ip", "userip": "2", "deviceid": "p"},
            {"userid": "ip", "userip": None, "deviceid": "p"},
            {"userid": "dev", "userip": "3", "deviceid": "q"},
            {"userid": "dev", "userip": "3", "deviceid": "r"},
        ],
    )
    assert {u: r["str_ip_change"] for u, r in got.items()} == {"one": 0, "ip": 1, "dev": 1}


@pytest.mark.parametrize("hot", [1, 10**6])
def test_shared_device_or_address(spark, hot):
    rows = [
        {"userid": "a", "userip": "1", "deviceid": "x"},
        {"userid": "b", "userip": "2", "deviceid": "x"},
        {"userid": "c", "userip": "2", "deviceid": "y"},
        {"userid": "d", "userip": "4", "deviceid": "z"},
        {"userid": "e", "userip": None, "deviceid": "1"},  # a device named like an address
        {"userid": "f", "userip": None, "deviceid": "w"},
        {"userid": None, "userip": "4", "deviceid": "v"},
    ]
    got = flags(spark, rows, Config(hot_share=hot))
    shared = {u: r["str_device_share"] for u, r in got.items()}
    assert shared == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 0, "f": 0, None: 1}


def smurf(receiver, n, amount="499999", day="01", start=0):
    return [
        {"userid": f"s{i}", "appuser": receiver, "amount": amount, "reqdate": f"2024-01-{day} 01:00:00"}
        for i in range(start, start + n)
    ]


def big(sender, amount="5000001", day="01"):
    return [{"userid": sender, "appuser": "z", "amount": amount, "reqdate": f"2024-01-{day} 02:00:00"}]


def test_smurfing_limits_are_strict_and_days_must_agree(spark):
    rows = (
        smurf("yes", 11) + big("yes")
        + smurf("ten", 10) + big("ten")
        + smurf("amount", 11, "500000") + big("amount")
        + smurf("send", 11) + big("send", "5000000")
        + smurf("day", 11) + big("day", day="02")
        + smurf("again", 5) + smurf("again", 5) + big("again")
        + smurf("undated", 11) + [{"userid": "undated", "amount": "9000000", "reqdate": "n/a"}]
    )
    got = flags(spark, rows)
    assert {u for u, r in got.items() if r["str_smurfing"]} == {"yes"}


def times(user, *texts):
    return [{"userid": user, "reqdate": t} for t in texts]


def test_rapid_transfers(spark):
    rows = (
        times("yes", "2024-01-01 10:00:00", "2024-01-01 10:00:09.999", "2024-01-01 10:00:19")
        + times("gap10", "2024-01-01 10:00:00", "2024-01-01 10:00:10", "2024-01-01 10:00:19")
        + times("same", *["2024-01-01 10:00:00"] * 3)
        + times("one", "2024-01-01 10:00:00", "2024-01-01 10:00:05")
        + times("midnight", "2024-01-01 23:59:55", "2024-01-01 23:59:58", "2024-01-02 00:00:01")
        + times("bad", "n/a", "n/a", "n/a", "2024-01-01")
    )
    got = flags(spark, rows)
    assert {u for u, r in got.items() if r["str_rapid_tx"]} == {"yes", "same"}


@pytest.mark.parametrize("seconds", [1, 7, 10, 60])
def test_rapid_pairs_equal_a_sorted_walk(spark, seconds):
    rnd = random.Random(seconds)
    base, rows, days = datetime(2024, 1, 1), [], defaultdict(list)
    for _ in range(3000):
        user = "hot" if rnd.random() < 0.4 else f"u{rnd.randrange(20)}"
        spread = rnd.choice([40_000_000, 3 * 86_400_000_000])
        ts = base + timedelta(microseconds=rnd.randrange(spread))
        if rnd.random() < 0.3:
            ts = ts.replace(microsecond=0)
        rows.append({"userid": user, "reqdate": ts.strftime("%Y-%m-%d %H:%M:%S.%f")})
        days[(user, ts.date())].append(ts)
    cfg = Config(rapid_seconds=seconds)
    got = by(S.rapid_pairs(S.rapid_slots(flagged_frame(spark, rows), cfg), cfg), "userid", "dt")
    for key, stamps in days.items():
        stamps.sort()
        want = sum((b - a).total_seconds() < seconds for a, b in zip(stamps, stamps[1:]))
        assert got[key]["pairs"] == want, key
    assert len(got) == len(days)
