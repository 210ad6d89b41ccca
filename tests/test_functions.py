import ipaddress
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.columns import parse_reqdate
from tidewatch.functions.ip import ip_bucket, parse_ip, parse_ipv4
from tidewatch.functions.text import normalize_description, strip_accents


def expected_clean(text):
    text = unicodedata.normalize("NFD", (text or "").lower())
    text = "".join(c for c in text if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text)).strip()


def sample_texts():
    rnd = random.Random(7)
    pools = [
        "abc XYZ 019 _-#!\t\n",
        "Chuyển khoản tiền đồng ĐẶNG ăn Ướt",
        "한국어 각 힣 가",
        "हिन्दी देवनागरी का",
        "①②½ ŒÆß İı Σς",
        "éộ ṩ ཱ",
        "العربية עברית 日本語 ガギ",
        "ஔ ᬆ ൊ 𝅗𝅥   \x1c",
    ]
    texts = [None, "", "  ", *pools]
    for _ in range(400):
        texts.append("".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(1, 25))))
    return texts


def test_description_matches_unicode_rules(spark):
    texts = sample_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", normalize_description("t")).collect())
    wrong = [(texts[i], got[i], expected_clean(texts[i])) for i in got if got[i] != expected_clean(texts[i])]
    assert not wrong


def test_every_composed_letter_is_folded(spark):
    letters = [
        chr(cp)
        for cp in range(0xC0, 0x2000)
        if unicodedata.normalize("NFD", chr(cp)) != chr(cp)
        and unicodedata.category(chr(cp))[0] == "L"
    ]
    df = spark.createDataFrame([(c,) for c in letters], "t string")
    for c, got in df.select("t", strip_accents(F.col("t"))).collect():
        nfd = unicodedata.normalize("NFD", c)
        assert got == "".join(x for x in nfd if unicodedata.category(x) != "Mn"), hex(ord(c))


def test_long_text_is_cleaned_to_its_end(spark):
    text = "Tiền ăn " * 50_000 + "CUỐI"
    got = spark.createDataFrame([(text,)], "t string").select(normalize_description("t")).first()[0]
    assert got == expected_clean(text) and got.endswith("cuoi")


IPS = [
    "0.0.0.0", "255.255.255.255", "1.2.3.4", " 9.9.9.9 ", "01.2.3.4", "1.2.3", "1.2.3.256",
    "1.2.3.4.5", "", " ", "x", None, "::", "::1", "1::", "2001:db8::1", "2001:DB8:0:0:0:0:0:1",
    "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3",
    ":::", "12345::", "g::", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4",
    "::1.2.3.256", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", ":1", "1:", "1:2:3:4:5:6:7:8::",
    "::1:2:3:4:5:6:7:8", "\t10.0.0.1\n", "1.2.3.4/8", "١.2.3.4", "nan",
]


def expected_ip(text):
    text = (text or "").strip()
    try:
        if ":" in text:
            return f"{int(ipaddress.IPv6Address(text)):032x}"
        return f"{int(ipaddress.IPv4Address(text)):08x}"
    except ValueError:
        return None


def test_ip_text_matches_the_standard_parser(spark):
    rnd = random.Random(3)
    texts = list(IPS)
    for _ in range(300):
        texts.append(str(ipaddress.IPv6Address(rnd.getrandbits(128) & rnd.getrandbits(128))))
        texts.append(str(ipaddress.IPv4Address(rnd.getrandbits(32))))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for i, got in df.select("i", parse_ip("t")).collect():
        assert got == expected_ip(texts[i]), texts[i]


def test_buckets_of_both_families_are_apart(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("::1",), ("ffff::",)], "t string")
    got = [r[0] for r in df.select(ip_bucket(parse_ip("t"))).collect()]
    assert got == [0x0102, 1 << 16, (1 << 16) + 0xFFFF00]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-02 03:04:05", "2024-01-02 03:04:05"),
        ("2024-01-02 03:04:05.5", "2024-01-02 03:04:05.5"),
        ("2024-01-02 03:04:05.123456", "2024-01-02 03:04:05.123456"),
        ("2024-01-02 03:04:05.123456789", "2024-01-02 03:04:05.123456"),
        ("2024-01-02", None),
        ("2024-02-30 00:00:00", None),
        ("2024-01-02 25:00:00", None),
        ("n/a", None),
        (None, None),
    ],
)
def test_request_time(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_reqdate("t").cast("string")).first()[0] == expected


def test_dotted_addresses_are_split_once(spark):
    """Four splits of each text made whole stages too long to be compiled."""
    df = spark.createDataFrame([("1.2.3.4",), ("255.255.255.255",), ("0.0.0.0",), ("1.2.3",), (None,)], "ip string")
    found = df.select("ip", parse_ip("ip").alias("hex"))
    assert [r["hex"] for r in found.collect()] == ["01020304", "ffffffff", "00000000", None, None]
    plan = df.select(parse_ipv4("ip").alias("hex"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2
