import bisect
import ipaddress
import random

import pytest

from tidewatch.config import Config
from tidewatch.operators.ip_country import add_country, disjoint_ranges

RANGE = "country string, type string, start string, value bigint, seq bigint"
BROADCAST = Config()
SHUFFLED = Config(broadcast_buckets=0, hot_share=0.01)


def expected(ranges, ip, prefix=False):
    """Last start at or before the address, then a containment check."""
    if ip is None:
        return ""
    try:
        address = ipaddress.ip_address(ip.strip())
    except ValueError:
        return ""
    kind = f"ipv{address.version}"
    known = sorted(
        (
            (int(ipaddress.ip_address(s.strip())), 2 ** (128 - v) if prefix and k == "ipv6" else v, c)
            for c, k, s, v, _ in ranges
            if k == kind
        ),
        key=lambda r: r[0],
    )
    at = bisect.bisect_right([r[0] for r in known], int(address)) - 1
    if at < 0:
        return ""
    start, value, country = known[at]
    return country if int(address) <= start + value - 1 else ""


def check(spark, ranges, ips, cfg, prefix=False):
    table = spark.createDataFrame(ranges, RANGE)
    rows = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, userip string")
    got = add_country(rows, table, cfg).collect()
    assert len(got) == len(ips)
    for row in got:
        assert row["iploc"] == expected(ranges, row["userip"], prefix), row


@pytest.mark.parametrize("cfg", [BROADCAST, SHUFFLED], ids=["broadcast", "shuffled"])
def test_hand_made_ranges(spark, cfg):
    ranges = [
        ("AA", "ipv4", "1.0.0.0", 2**24, 0),
        ("BB", "ipv4", "1.0.0.10", 11, 1),  # inside AA: cuts it for good
        ("CC", "ipv4", "2.0.0.0", 100, 2),
        ("DD", "ipv4", "2.0.0.0", 10, 3),  # same start, later in the file
        ("NA", "ipv4", "3.0.0.0", 1, 4),  # a code, not a missing value
        ("EE", "ipv4", "4.0.0.0", 0, 5),  # empty, but still a start
        ("FF", "ipv4", "255.255.255.0", 256, 6),
        ("XX", "asn", "5", 1, 7),
        ("V6", "ipv6", "2001:db8::", 32, 8),
    ]
    ips = [
        "1.0.0.0", "1.0.0.9", "1.0.0.10", "1.0.0.20", "1.0.0.21", "1.200.0.0", "2.0.0.9",
        "2.0.0.10", "3.0.0.0", "3.0.0.1", "4.0.0.0", "0.255.255.255", "255.255.255.255",
        "2001:db8::", "2001:db8::1f", "2001:db8::20", "::ffff:1.0.0.1", "bad", None, None, None,
        None, "01.0.0.1", " 1.0.0.5 ",
    ]
    check(spark, ranges, ips, cfg)


def test_ipv6_value_as_prefix(spark):
    ranges = [("V6", "ipv6", "2001:db8::", 32, 0), ("W6", "ipv6", "2001:db8:8000::", 33, 1)]
    ips = ["2001:db8::ffff", "2001:db8:7fff::1", "2001:db8:ffff::1", "2001:db9::1", "2001:db7::1"]
    check(spark, ranges, ips, Config(ipv6_value="prefix"), prefix=True)


@pytest.mark.parametrize("cfg", [BROADCAST, SHUFFLED], ids=["broadcast", "shuffled"])
def test_random_overlapping_ranges(spark, cfg):
    rnd = random.Random(11)
    ranges, ips = [], []
    for n in range(300):
        start = rnd.randrange(0, 2**24) << rnd.choice([0, 4, 8])
        ranges.append((f"c{n}", "ipv4", str(ipaddress.IPv4Address(start)), rnd.choice([1, 7, 256, 70_000, 2**20]), n))
        ips += [str(ipaddress.IPv4Address(min(max(start + d, 0), 2**32 - 1))) for d in (-1, 0, 1, 255, 256, 70_000)]
    check(spark, ranges, ips, cfg)


def test_disjoint_ranges_never_overlap(spark):
    rnd = random.Random(5)
    ranges = [
        (f"c{n}", "ipv4", str(ipaddress.IPv4Address(rnd.randrange(2**20))), rnd.randrange(1, 5000), n)
        for n in range(500)
    ]
    cut = disjoint_ranges(spark.createDataFrame(ranges, RANGE), Config()).orderBy("first").collect()
    for one, two in zip(cut, cut[1:]):
        assert one["first"] < two["first"] and one["next"] <= two["first"]


@pytest.mark.parametrize("mode", ["count", "prefix"])
def test_range_file_with_ranges_larger_than_64_bits(spark, tmp_path, mode):
    from tidewatch.sources.landing import read_ip_ranges

    sizes = {"count": (2**96, 2**64), "prefix": (32, 64)}[mode]
    path = tmp_path / "ranges.csv"
    path.write_text(
        f"country,type,start,value\nAA,ipv6,2001:db8::,{sizes[0]}\nBB,ipv6,2001:db9:0:1::,{sizes[1]}\nCC,ipv4,1.0.0.0,256\n"
    )
    rows = [(n, ip) for n, ip in enumerate(
        ["2001:db8::1", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "2001:db9::1", "2001:db9:0:1:ffff::", "2001:db9:0:2::", "1.0.0.255", "1.0.1.0"]
    )]
    df = spark.createDataFrame(rows, "i int, userip string")
    got = {r["i"]: r["iploc"] for r in add_country(df, read_ip_ranges(spark, str(path)), Config(ipv6_value=mode)).collect()}
    assert [got[i] for i in range(7)] == ["AA", "AA", "", "BB", "", "CC", ""]


@pytest.mark.parametrize("row", ["XX,ipv6,1.2.3.4,5", "XX,ipv4,2001:db8::,5", "XX,ipv4,1.2.3.4,many", "XX,ipv6,2001:db8::,"])
def test_unreadable_range_is_named(spark, tmp_path, row):
    from tidewatch.sources.landing import read_ip_ranges

    path = tmp_path / "ranges.csv"
    path.write_text(f"country,type,start,value\n{row}\n")
    df = spark.createDataFrame([("1.2.3.4",)], "userip string")
    with pytest.raises(Exception, match="unreadable IP range: XX"):
        add_country(df, read_ip_ranges(spark, str(path)), Config()).collect()


def test_lookup_plan_stays_small(spark):
    """The bounds are stored, so their expressions are not repeated by the interval cuts."""
    ranges = spark.createDataFrame([("A", "ipv4", "1.0.0.0", 256, 0), ("B", "ipv4", "1.0.0.128", 64, 1)], RANGE)
    plan = disjoint_ranges(ranges, BROADCAST)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000
