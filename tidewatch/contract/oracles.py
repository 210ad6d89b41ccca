"""Independent DuckDB SQL for the registered queries."""

from __future__ import annotations

import dataclasses

from tidewatch.operators.charts import CHARTS
from tidewatch.operators.chatlog import DEFAULT, Vocabulary, phrases, step_reports

TXN = """
txn AS (
  SELECT
    l_orderkey AS ok, l_linenumber AS ln,
    CASE WHEN l_partkey % 89 = 0 THEN 'n/a' ELSE strftime(TIMESTAMP '2024-01-01 00:00:00'
      + to_days(CAST(o_orderkey % 7 AS INT))
      + to_seconds(CASE WHEN o_custkey % 4 = 0 THEN (o_orderkey * 37) % 80000 + l_linenumber * 3
          ELSE (o_orderkey * 37 + l_partkey * 13 + l_suppkey * 101) % 80000 END),
      '%Y-%m-%d %H:%M:%S') END AS reqdate,
    'u' || o_custkey AS userid,
    'u' || l_suppkey AS appuser,
    CASE WHEN l_partkey % 97 = 0 THEN 'bad' ELSE CAST(
      (CAST(floor(l_quantity * l_quantity * 3) AS BIGINT)
        + CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE 600 END) * 1000
      + CASE WHEN l_suppkey % 10 = 0 AND l_partkey % 10 < 6 THEN 11 + l_partkey % 2
        ELSE l_partkey % 1000 END AS VARCHAR) END AS amount,
    CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_custkey % 40 = 0 THEN '9.9.9.9'
      ELSE concat_ws('.', 1 + o_custkey % 30,
        CASE WHEN o_custkey % 6 = 0 THEN l_linenumber * 30 ELSE (o_custkey * 7) % 256 END,
        (o_custkey // 7) % 256, o_custkey % 200) END AS userip,
    CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 50 = 1 THEN 'shared'
      ELSE 'd' || o_custkey END AS deviceid,
    CASE WHEN o_orderkey % 2 = 0 THEN 'ios' ELSE 'android' END AS platform,
    CASE
      WHEN l_partkey % 11 = 0 AND o_orderkey % 6 = 0
        THEN 'Chuyển khoản ' || lpad(CAST(l_partkey AS VARCHAR), 6, '0')
      WHEN l_partkey % 11 = 1 AND o_orderkey % 6 = 1
        THEN 'Chuyển  tiền: ' || lpad(CAST(l_partkey AS VARCHAR), 5, '0')
      WHEN l_partkey % 3 = 2 AND o_custkey % 9 = 0 THEN 'WIN' || l_partkey || ' nhé!'
      WHEN l_partkey % 11 = 3
        THEN 'Dùng ZaloPay chuyển tiền ' || lpad(CAST(l_partkey AS VARCHAR), 6, '0')
      WHEN l_partkey % 11 = 4 THEN NULL
      ELSE 'Trả tiền ăn #' || l_linenumber END AS description
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

ETL = (
    TXN
    + """,
etl AS (
  SELECT ok, ln, reqdate, userid, appuser, amount, userip, platform,
    coalesce(deviceid, coalesce(userid, '') || '-' || coalesce(userip, '')) AS deviceid,
    trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce(description, ''))),
      '[^\\w\\s\\p{L}\\p{N}]', ' ', 'g'), '\\s+', ' ', 'g')) AS desc_clean,
    TRY_CAST(CASE WHEN regexp_full_match(reqdate, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}(\\.\\d+)?')
      THEN reqdate END AS TIMESTAMP) AS ts
  FROM txn
)"""
)

FLAGGED = (
    ETL
    + """,
amounts AS (
  SELECT * REPLACE (CASE WHEN regexp_full_match(amount, '-?\\d+') THEN CAST(amount AS BIGINT) END AS amount),
    CAST(ts AS DATE) AS dt
  FROM etl
),
flagged AS (
  SELECT ok, ln, reqdate, userid, appuser, userip, deviceid, platform, amount, ts, dt,
    ((amount % 1000) + 1000) % 1000 AS amount_tail3,
    CAST((((amount % 1000) + 1000) % 1000) IN (11, 12) AS INT) AS is_bet_tail,
    CAST(regexp_matches(desc_clean, '\\bwin\\d+') AS INT) AS desc_has_win,
    CAST(NOT contains(desc_clean, 'dung zalopay chuyen tien')
      AND regexp_matches(desc_clean, 'chuyen\\s+(khoan|tien)\\s+\\d{6}\\s*$') AS INT) AS desc_match_b1,
    CAST(NOT contains(desc_clean, 'dung zalopay chuyen tien')
      AND regexp_matches(desc_clean, 'chuyen\\s+(khoan|tien)\\s+\\d{5}\\s*$') AS INT) AS desc_match_b2
  FROM amounts
)"""
)


def _profile(prefix: str, key: str, partner: str, partners: str, total: str, extra: str = "") -> str:
    return f"""
  SELECT {key}, count(amount) AS {prefix}_tx_count,
    count(DISTINCT {partner}) + max(CASE WHEN {partner} IS NULL THEN 1 ELSE 0 END) AS {partners},
    coalesce(sum(amount), 0) AS {total},
    avg(amount) AS {prefix}_avg_amount, max(amount) AS {prefix}_max_amount,
    coalesce(stddev_samp(amount), 0) AS {prefix}_std_amount, {extra}
    avg(is_bet_tail) AS {prefix}_bet_tail_ratio, avg(desc_has_win) AS {prefix}_win_desc_ratio,
    avg(desc_match_b1) AS {prefix}_b1_ratio, avg(desc_match_b2) AS {prefix}_b2_ratio
  FROM flagged GROUP BY {key}"""


PROFILES = (
    FLAGGED
    + ",\nsenders AS ("
    + _profile(
        "sender",
        "userid",
        "appuser",
        "sender_unique_receivers",
        "sender_total_sent",
        "count(DISTINCT userip) + max(CASE WHEN userip IS NULL THEN 1 ELSE 0 END)"
        " AS sender_unique_ips,",
    )
    + "\n),\nreceivers AS ("
    + _profile("recv", "appuser", "userid", "recv_unique_senders", "recv_total_received")
    + "\n)"
)

STR = """,
u AS (SELECT DISTINCT userid FROM flagged),
ip_change AS (
  SELECT userid, CAST(
    count(DISTINCT userip) + max(CASE WHEN userip IS NULL THEN 1 ELSE 0 END) >= 2
    OR count(DISTINCT deviceid) + max(CASE WHEN deviceid IS NULL THEN 1 ELSE 0 END) >= 2 AS INT)
    AS str_ip_change
  FROM flagged GROUP BY userid
),
shared_dev AS (SELECT deviceid FROM flagged GROUP BY deviceid HAVING count(DISTINCT userid) > 1),
shared_ip AS (SELECT userip FROM flagged GROUP BY userip HAVING count(DISTINCT userid) > 1),
device_share AS (
  SELECT userid, max(CASE WHEN deviceid IN (SELECT deviceid FROM shared_dev)
    OR userip IN (SELECT userip FROM shared_ip WHERE userip IS NOT NULL) THEN 1 ELSE 0 END)
    AS str_device_share
  FROM flagged GROUP BY userid
),
smurf_in AS (
  SELECT appuser, dt, count(DISTINCT userid) AS senders FROM flagged
  WHERE amount < 500000 AND dt IS NOT NULL GROUP BY appuser, dt HAVING count(DISTINCT userid) > 10
),
smurfs AS (
  SELECT DISTINCT i.appuser AS userid FROM smurf_in i
  JOIN flagged f ON f.userid = i.appuser AND f.dt = i.dt AND f.amount > 5000000
),
gaps AS (
  SELECT userid, dt, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY userid, dt ORDER BY ts)) AS gap
  FROM flagged WHERE ts IS NOT NULL
),
pairs AS (
  SELECT userid, dt, count(*) FILTER (gap < 10) AS pairs FROM gaps GROUP BY userid, dt
),
rapid AS (SELECT DISTINCT userid FROM pairs WHERE pairs >= 2),
str AS (
  SELECT u.userid, str_ip_change, str_device_share,
    CAST(u.userid IN (SELECT userid FROM smurfs) AS INT) AS str_smurfing,
    CAST(u.userid IN (SELECT userid FROM rapid) AS INT) AS str_rapid_tx
  FROM u JOIN ip_change USING (userid) JOIN device_share USING (userid)
)"""

BOOKIES = """,
bk AS (
  SELECT r.appuser, r.recv_tx_count AS recv_tx, r.recv_unique_senders AS recv_src,
    r.recv_bet_tail_ratio AS recv_bet_tail,
    coalesce(s.sender_tx_count, 0) AS send_tx, coalesce(s.sender_win_desc_ratio, 0) AS send_win_desc,
    coalesce(nb.non_bet, 0) AS non_bet_tail_ratio
  FROM receivers r LEFT JOIN senders s ON s.userid = r.appuser
  LEFT JOIN (SELECT userid, avg(1 - is_bet_tail) AS non_bet FROM flagged GROUP BY userid) nb
    ON nb.userid = r.appuser
),
scored_bk AS (
  SELECT *, recv_tx / (send_tx + 1) AS recv_send_ratio,
    CAST(recv_src >= 10 AS DOUBLE) * 1 + CAST(recv_tx / (send_tx + 1) > 1.0 AS DOUBLE) * 2
    + CAST(recv_bet_tail > 0.30 AS DOUBLE) * 5
    + CAST(send_win_desc > 0.10 AND non_bet_tail_ratio > 0.70 AS DOUBLE) * 5 AS bookie_score
  FROM bk
),
bookie_set AS (SELECT appuser FROM scored_bk WHERE bookie_score >= 5.0)"""

LABELED = (
    PROFILES
    + STR
    + BOOKIES
    + """,
labeled0 AS (
  SELECT f.*, s.* EXCLUDE (userid), r.* EXCLUDE (appuser),
    recv_tx_count / (sender_tx_count + recv_tx_count + 1) AS recv_send_tx_ratio,
    str.* EXCLUDE (userid),
    CAST(f.appuser IN (SELECT appuser FROM bookie_set) AS INT) AS is_bookie_tx,
    CAST(f.appuser IN (SELECT appuser FROM bookie_set) AND is_bet_tail = 1 AS INT) AS is_gambler_tx,
    desc_match_b1 AS is_recipient1_tx, desc_match_b1 AS is_depositor1_tx,
    desc_match_b2 AS is_recipient2_tx, desc_match_b2 AS is_depositor2_tx
  FROM flagged f LEFT JOIN senders s ON s.userid = f.userid
  LEFT JOIN receivers r ON r.appuser = f.appuser LEFT JOIN str ON str.userid = f.userid
),
labeled AS (
  SELECT *, greatest(is_bookie_tx, is_gambler_tx, is_recipient1_tx, is_depositor1_tx,
    is_recipient2_tx, is_depositor2_tx) AS hit_any_rule,
    CASE WHEN greatest(is_bookie_tx, is_gambler_tx, is_recipient1_tx, is_depositor1_tx,
      is_recipient2_tx, is_depositor2_tx) = 0
    THEN CAST(CAST(substr(userid, 2) AS BIGINT) * 37 % 101 AS DOUBLE) END AS ml_score
  FROM labeled0
)"""
)

RANGES = """,
ranges AS (
  SELECT 'C' || n_nationkey AS country, (n_nationkey + 1) * 16777216 AS first,
    (n_nationkey + 1) * 16777216 + CASE n_nationkey % 3 WHEN 0 THEN 16777216
      WHEN 1 THEN 8388608 ELSE 33554432 END - 1 AS last
  FROM nation
),
located AS (
  SELECT x.userip, (
    SELECT CASE WHEN x.ip <= arg_max(r.last, r.first) THEN arg_max(r.country, r.first) END
    FROM ranges r WHERE r.first <= x.ip) AS country
  FROM (
    SELECT DISTINCT userip, CAST(split_part(userip, '.', 1) AS BIGINT) * 16777216
      + CAST(split_part(userip, '.', 2) AS BIGINT) * 65536
      + CAST(split_part(userip, '.', 3) AS BIGINT) * 256
      + CAST(split_part(userip, '.', 4) AS BIGINT) AS ip
    FROM txn WHERE userip IS NOT NULL
  ) x
)"""

_FEATURES = """sender_tx_count, sender_unique_receivers,
  CAST(sender_total_sent AS BIGINT) AS sender_total_sent, sender_avg_amount, sender_max_amount,
  round(sender_std_amount, 0) AS sender_std_amount, sender_unique_ips, sender_bet_tail_ratio,
  sender_win_desc_ratio, sender_b1_ratio, sender_b2_ratio"""
_RECV = """recv_tx_count, recv_unique_senders, CAST(recv_total_received AS BIGINT) AS recv_total_received,
  recv_avg_amount, recv_max_amount, round(recv_std_amount, 0) AS recv_std_amount,
  recv_bet_tail_ratio, recv_win_desc_ratio, recv_b1_ratio, recv_b2_ratio"""
_RULES = """is_bookie_tx, is_gambler_tx, is_recipient1_tx, is_depositor1_tx, is_recipient2_tx,
  is_depositor2_tx, hit_any_rule"""
_STR = "str_ip_change, str_device_share, str_smurfing, str_rapid_tx"


def _long(source: str, names: tuple[str, ...], label: str, value: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS {label}, CAST(coalesce(sum({n}), 0) AS BIGINT) AS {value}{extra.format(n)}"
        f" FROM {source}"
        for n in names
    )


_RULE_NAMES = (
    "is_bookie_tx",
    "is_gambler_tx",
    "is_recipient1_tx",
    "is_depositor1_tx",
    "is_recipient2_tx",
    "is_depositor2_tx",
    "hit_any_rule",
)

ORACLES = {
    "etl_device_fill": f"WITH {ETL} SELECT ok, ln, deviceid FROM etl",
    "etl_desc_clean": f"WITH {ETL} SELECT ok, ln, desc_clean FROM etl",
    "etl_desc_documents": """SELECT doc_id, md5(clean) AS digest, CAST(length(clean) AS INT) AS n_chars
      FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce(text, ''))),
        '[^\\w\\s\\p{L}\\p{N}]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM documents)""",
    "etl_ip_country": f"""WITH {TXN}{RANGES}
      SELECT ok, ln, txn.userip, coalesce(country, '') AS iploc
      FROM txn LEFT JOIN located ON located.userip = txn.userip""",
    "etl_transfers": f"""WITH {ETL}{RANGES}
      SELECT reqdate, userid, appuser, amount, etl.userip, coalesce(country, '') AS iploc,
        deviceid, platform, desc_clean
      FROM etl LEFT JOIN located ON located.userip = etl.userip""",
    "pattern_flags": f"""WITH {FLAGGED} SELECT ok, ln, amount, CAST(amount_tail3 AS INT) AS amount_tail3,
      is_bet_tail, desc_has_win, desc_match_b1, desc_match_b2 FROM flagged""",
    "flag_summary": f"WITH {FLAGGED} "
    + _long(
        "flagged",
        ("is_bet_tail", "desc_has_win", "desc_match_b1", "desc_match_b2"),
        "flag",
        "transfers",
    ),
    "sender_profile": f"WITH {PROFILES} SELECT userid, {_FEATURES} FROM senders",
    "receiver_profile": f"WITH {PROFILES} SELECT appuser, {_RECV} FROM receivers",
    "receiver_count": f"WITH {FLAGGED} SELECT count(DISTINCT appuser) AS receivers FROM flagged",
    "txn_features": f"""WITH {LABELED} SELECT ok, ln, userid, appuser, {_FEATURES}, {_RECV},
      recv_send_tx_ratio FROM labeled""",
    "str_ip_change": f"WITH {FLAGGED}{STR} SELECT userid, str_ip_change FROM str",
    "str_device_share": f"WITH {FLAGGED}{STR} SELECT userid, str_device_share FROM str",
    "smurf_in_days": f"WITH {FLAGGED}{STR} SELECT appuser, CAST(dt AS VARCHAR) AS dt, senders FROM smurf_in",
    "str_smurfing": f"WITH {FLAGGED}{STR} SELECT userid FROM smurfs",
    "rapid_pairs": f"WITH {FLAGGED}{STR} SELECT userid, CAST(dt AS VARCHAR) AS dt, pairs FROM pairs",
    "str_rapid_tx": f"WITH {FLAGGED}{STR} SELECT userid FROM rapid",
    "str_flags": f"WITH {FLAGGED}{STR} SELECT userid, {_STR} FROM str",
    "str_summary": f"WITH {LABELED} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS flag, count(DISTINCT userid) FILTER ({n} = 1) AS users,"
        f" CAST(sum({n}) AS BIGINT) AS transfers FROM labeled"
        for n in ("str_ip_change", "str_device_share", "str_smurfing", "str_rapid_tx")
    ),
    "bookie_score": f"WITH {PROFILES}{BOOKIES} SELECT * FROM scored_bk",
    "bookies": f"""WITH {PROFILES}{BOOKIES} SELECT appuser, bookie_score FROM scored_bk
      WHERE bookie_score >= 5.0""",
    "txn_labels": f"WITH {LABELED} SELECT ok, ln, {_STR}, {_RULES} FROM labeled",
    "labeled_transfers": f"""WITH {LABELED}{RANGES} SELECT ok, ln, reqdate, userid, appuser, amount,
      coalesce(country, '') AS iploc, CAST(amount_tail3 AS INT) AS amount_tail3, is_bet_tail, desc_has_win, desc_match_b1,
      desc_match_b2, {_FEATURES}, {_RECV}, recv_send_tx_ratio, {_STR}, {_RULES}
      FROM labeled LEFT JOIN located ON located.userip = labeled.userip""",
    "label_summary": f"WITH {LABELED} SELECT label, transfers, round(transfers * 100.0 / n, 6) AS percent FROM ("
    + _long("labeled", _RULE_NAMES, "label", "transfers", ", count(*) AS n")
    + """ UNION ALL SELECT 'non_rule', CAST(count(*) - sum(hit_any_rule) AS BIGINT), count(*)
      FROM labeled)""",
    "label_user_counts": f"""WITH {LABELED}
      SELECT 'bookie' AS label, count(DISTINCT appuser) AS users, count(*) AS transfers
      FROM labeled WHERE is_bookie_tx = 1
      UNION ALL SELECT 'gambler', count(DISTINCT userid), count(*)
      FROM labeled WHERE is_gambler_tx = 1""",
}

_GROUPS = {
    "bookie": ("is_bookie_tx", "appuser", "recv"),
    "gambler": ("is_gambler_tx", "userid", "sent"),
    "recipient1": ("is_recipient1_tx", "appuser", "recv"),
    "depositor1": ("is_depositor1_tx", "userid", "sent"),
    "recipient2": ("is_recipient2_tx", "appuser", "recv"),
    "depositor2": ("is_depositor2_tx", "userid", "sent"),
}
_COUNTS = ", ".join(f"{g}_tx_count" for g in _GROUPS)

REPORT = (
    LABELED
    + """,
users AS (SELECT userid AS user_id FROM labeled UNION SELECT appuser FROM labeled),
"""
    + ",\n".join(
        f"c_{g} AS (SELECT {key} AS user_id, count(*) AS {g}_tx_count FROM labeled"
        f" WHERE {flag} = 1 GROUP BY {key})"
        for g, (flag, key, _) in _GROUPS.items()
    )
    + """,
s_ml AS (SELECT userid AS user_id, avg(ml_score) AS ml_s FROM labeled
  WHERE ml_score IS NOT NULL GROUP BY userid),
r_ml AS (SELECT appuser AS user_id, avg(ml_score) AS ml_r FROM labeled
  WHERE ml_score IS NOT NULL GROUP BY appuser),
sent AS (SELECT userid AS user_id, count(amount) AS total_sent_tx, sum(amount) AS total_sent_amount,
  count(DISTINCT appuser) AS unique_receivers, count(*) AS sent_rows FROM labeled GROUP BY userid),
recv AS (SELECT appuser AS user_id, count(amount) AS total_recv_tx, sum(amount) AS total_recv_amount,
  count(DISTINCT userid) AS unique_senders, count(*) AS recv_rows FROM labeled GROUP BY appuser),
report0 AS (
  SELECT user_id, """
    + ", ".join(f"coalesce({g}_tx_count, 0) AS {g}_tx_count" for g in _GROUPS)
    + """,
    coalesce(total_sent_tx, 0) AS total_sent_tx,
    CAST(coalesce(total_sent_amount, 0) AS BIGINT) AS total_sent_amount,
    coalesce(unique_receivers, 0) AS unique_receivers,
    coalesce(total_recv_tx, 0) AS total_recv_tx,
    CAST(coalesce(total_recv_amount, 0) AS BIGINT) AS total_recv_amount,
    coalesce(unique_senders, 0) AS unique_senders,
    coalesce(sent_rows, 0) AS sent_rows, coalesce(recv_rows, 0) AS recv_rows,
    ml_s, ml_r
  FROM users """
    + " ".join(f"LEFT JOIN c_{g} USING (user_id)" for g in _GROUPS)
    + """ LEFT JOIN s_ml USING (user_id) LEFT JOIN r_ml USING (user_id)
    LEFT JOIN sent USING (user_id) LEFT JOIN recv USING (user_id)
),
report AS (
  SELECT *, """
    + " + ".join(f"{g}_tx_count" for g in _GROUPS)
    + """ AS total_flagged_tx,
    CAST(round(CAST(CASE WHEN ml_s IS NULL AND ml_r IS NULL THEN 0
      WHEN ml_s IS NULL THEN ml_r WHEN ml_r IS NULL THEN ml_s
      ELSE (ml_s + ml_r) / 2 END AS DECIMAL(20, 10)), 2) AS DOUBLE) AS ml_score,
    coalesce(nullif(concat_ws('|', """
    + ", ".join(f"CASE WHEN {g}_tx_count > 0 THEN '{g}' END" for g in _GROUPS)
    + """), ''), 'normal') AS user_group
  FROM report0
),
bookie_rep AS (
  SELECT user_id, recv_rows AS recv_tx_count, unique_senders AS recv_unique_senders,
    total_recv_amount, sent_rows AS send_tx_count, unique_receivers AS send_unique_receivers,
    total_sent_amount AS total_send_amount,
    CAST(round(CAST(total_recv_amount / (total_sent_amount + 1) AS DECIMAL(30, 12)), 4) AS DOUBLE)
      AS recv_send_ratio
  FROM report WHERE bookie_tx_count > 0
)"""
)
_REPORT_COLUMNS = f"""user_id, user_group, total_flagged_tx, ml_score, {_COUNTS}, total_sent_tx,
  total_sent_amount, unique_receivers, total_recv_tx, total_recv_amount, unique_senders, ml_s, ml_r"""

_SCALER_FEATURES = """sender_tx_count sender_unique_receivers sender_total_sent sender_avg_amount
sender_max_amount sender_std_amount sender_unique_ips sender_bet_tail_ratio sender_win_desc_ratio
sender_b1_ratio sender_b2_ratio recv_tx_count recv_unique_senders recv_total_received
recv_avg_amount recv_max_amount recv_std_amount recv_bet_tail_ratio recv_win_desc_ratio
recv_b1_ratio recv_b2_ratio recv_send_tx_ratio amount is_bet_tail desc_has_win str_ip_change
str_device_share str_smurfing str_rapid_tx""".split()


def _sig(expr: str) -> str:
    return f"CAST(format('{{:.6e}}', CAST({expr} AS DOUBLE)) AS DOUBLE)"


def _scaler(feature: str) -> str:
    v = f"CAST(CAST(coalesce({feature}, 0) AS FLOAT) AS DOUBLE)"
    std = f"stddev_pop({v})"
    return (
        f"SELECT '{feature}' AS feature, {_sig(f'avg({v})')} AS mean,"
        f" {_sig(f'CASE WHEN {std} > 0 THEN {std} ELSE 1 END')} AS scale"
        " FROM labeled WHERE hit_any_rule = 0"
    )


_ACCENT_FREE = (
    "lower(replace(replace(strip_accents(coalesce(text, '')), 'đ', 'd'), 'Đ', 'D'))"
)
_PLAIN = f"trim(regexp_replace({_ACCENT_FREE}, '\\s+', ' ', 'g'))"


def _says(text: str, *phrases: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def _quoted(phrases) -> tuple[str, ...]:
    return tuple(p.replace("'", "''") for p in phrases)


def _intent(words: Vocabulary, chats: str) -> str:
    """CTEs ``turns`` and ``tags`` over the relation ``chats``."""
    pipeline = " ".join(
        f"WHEN {_says('lo', *_quoted(phrases))} THEN 'pipeline:{stage}'" for stage, phrases in words.pipeline
    )
    following = ", ".join(f"'{p}'" for p in _quoted(words.next))
    return f"""
turns AS (
  SELECT conv_id, turn, trim(text, E' \\t\\n\\r') AS raw, lower(trim(text, E' \\t\\n\\r')) AS lo,
    {_PLAIN} AS plain
  FROM {chats} WHERE role = 'user'
),
tags AS (
  SELECT conv_id, turn, CASE
    WHEN starts_with(raw, '?') THEN 'question'
    WHEN starts_with(lo, '[query]') THEN 'sql'
    WHEN {_says("lo", *_quoted(words.meta))} THEN 'meta'
    WHEN {_says("plain", *_quoted(words.complaint_steps))}
      AND {_says("plain", *_quoted(words.complaint_marks))} THEN 'complaint'
    WHEN trim(plain, ' .!?,') IN ({following}) THEN 'next'
    {pipeline}
    WHEN {_says("lo", *_quoted(words.report))} THEN 'report'
    WHEN {_says("lo", *_quoted(words.transaction))} THEN 'transaction'
    WHEN {_says("lo", *_quoted(words.correction))} THEN 'correction'
    ELSE 'other' END AS intent
  FROM turns
)"""


# Phrases that occur in the given conversations; only their lists for the intent matter here.
_SPOKEN = dataclasses.replace(
    DEFAULT,
    meta=("help", "thre"),
    complaint_steps=("der ", "die "),
    complaint_marks=("ung", "ver"),
    next=("the be", "the the"),
    pipeline=(("etl", ("ble ", "ea of")), ("features", ("queeau",)), ("reports", ("ción",))),
    report=("ou ",),
    transaction=("th", "é"),
    correction=("en",),
)
INTENT = _intent(_SPOKEN, "conversations")
_PHRASES = phrases(DEFAULT)


def _words_behind(name: str, words: list[str]) -> str:
    return f"""{name} AS (
  SELECT * REPLACE (coalesce(text, '') || ' '
    || [{", ".join(f"'{p}'" for p in _quoted(words))}][(conv_id * 31 + turn * 7) % {len(words)} + 1] AS text)
  FROM conversations)"""


_WORDED = _words_behind("worded", _PHRASES)

# The report on the table ``paid`` instead of ``labeled``.
_PAID_REPORT = REPORT.removeprefix(LABELED).replace("FROM labeled", "FROM paid")
_FLAG_NAMES = ("is_bet_tail", "desc_has_win", "desc_match_b1", "desc_match_b2", *_RULE_NAMES)

ORACLES |= {
    "scaler_stats": f"WITH {LABELED} " + " UNION ALL ".join(_scaler(f) for f in _SCALER_FEATURES),
    "score_normalize": f"""WITH {LABELED},
      raw AS (SELECT ok, ln, ml_score / 404 + 0.3 AS raw FROM labeled),
      ends AS (SELECT min(raw) AS low, max(raw) AS high FROM raw)
      SELECT ok, ln, round_even(least(greatest((raw - low) / (high - low + 1e-9) * 100, 0), 100), 2)
        + CASE WHEN raw IS NULL THEN NULL ELSE 0 END AS ml_score FROM raw, ends""",
    "score_p95": f"""WITH {LABELED} SELECT count(ml_score) AS rows, avg(ml_score) AS mean,
      quantile_cont(ml_score, 0.95) AS p95, max(ml_score) AS max FROM labeled""",
    "user_report": f"WITH {REPORT} SELECT {_REPORT_COLUMNS} FROM report",
    "flagged_users": f"""WITH {REPORT} SELECT {_REPORT_COLUMNS} FROM report
      WHERE user_group NOT IN ('normal', 'depositor1', 'depositor2', 'gambler')""",
    "high_score_users": f"""WITH {REPORT} SELECT {_REPORT_COLUMNS} FROM report
      WHERE user_group = 'normal' AND ml_score > 70""",
    "flagged_txns": f"""WITH {LABELED}{RANGES} SELECT reqdate, userid, appuser, amount,
      coalesce(country, '') AS iploc, {_RULES}, ml_score, is_bet_tail, CAST(amount_tail3 AS INT) AS amount_tail3,
      desc_has_win, desc_match_b1, desc_match_b2
      FROM labeled LEFT JOIN located ON located.userip = labeled.userip WHERE hit_any_rule = 1""",
    "bookie_report": f"WITH {REPORT} SELECT * FROM bookie_rep",
    "score_histogram": f"""WITH {LABELED},
      ends AS (SELECT min(ml_score) AS low, max(ml_score) AS high FROM labeled),
      filled AS (SELECT least(CAST(floor((ml_score - low) / (high - low) * 60) AS INT), 59) AS bin,
        count(*) AS transfers FROM labeled, ends WHERE ml_score IS NOT NULL GROUP BY 1)
      SELECT CAST(b AS INT) AS bin, round(low + b * ((high - low) / 60), 6) AS bin_start,
        round(low + (b + 1) * ((high - low) / 60), 6) AS bin_end, coalesce(transfers, 0) AS transfers
      FROM range(60) t(b) CROSS JOIN ends LEFT JOIN filled ON filled.bin = b""",
    "risk_scatter": f"""WITH {REPORT} SELECT user_id, total_flagged_tx, ml_score, total_sent_amount,
      user_group FROM report WHERE user_group <> 'normal'""",
    "top_bookies": f"""WITH {REPORT} SELECT user_id, unique_senders FROM report
      WHERE bookie_tx_count > 0 ORDER BY unique_senders DESC, user_id LIMIT 20""",
    "group_volume": f"WITH {REPORT} "
    + " UNION ALL ".join(
        f"SELECT '{g}' AS user_group, CAST(coalesce(sum(total_{side}_amount), 0) AS BIGINT) AS amount"
        f" FROM report WHERE {g}_tx_count > 0"
        for g, (_, _, side) in _GROUPS.items()
    ),
    "bookie_flow": f"""WITH {REPORT} SELECT sum(total_recv_amount) / 1e9 AS total_in_bil,
      sum(total_send_amount) / 1e9 AS total_out_bil, count(*) AS num_bookies,
      CAST(sum(recv_unique_senders) AS BIGINT) AS total_gamblers,
      sum(total_recv_amount) / (sum(total_send_amount) + 1) AS avg_in_out_ratio FROM bookie_rep""",
    "bookie_pnl_bands": f"""WITH {LABELED}, paid AS (
        SELECT * REPLACE (amount * coalesce((SELECT 4 + s_suppkey % 21 FROM supplier
          WHERE 'u' || s_suppkey = userid), 1) AS amount) FROM labeled){_PAID_REPORT}
      SELECT CASE WHEN r < 0.80 THEN '1. Significantly lose (<0.8x)'
        WHEN r BETWEEN 0.81 AND 0.99 THEN '2. Slightly lose (0.81x-0.99x)'
        WHEN r BETWEEN 1.00 AND 1.10 THEN '3. Slightly win (1.0x-1.10x)'
        WHEN r BETWEEN 1.10 AND 1.20 THEN '4. Significantly win (1.10x-1.20x)'
        ELSE '5. Substantially win  (>1.20x)' END AS behavior_group, count(*) AS bookies
      FROM (SELECT recv_send_ratio AS r FROM bookie_rep) GROUP BY 1""",
    "gambler_tails": f"""WITH {LABELED} SELECT CASE WHEN amount_tail3 = 11 THEN '011' ELSE '012' END
      AS bet_tail_type, count(amount) AS tx_count, CAST(sum(amount) AS BIGINT) AS total_amount,
      count(DISTINCT userid) AS unique_gamblers, avg(amount) AS avg_amount
      FROM labeled WHERE is_gambler_tx = 1 GROUP BY 1""",
    "users_in_group": f"""WITH {REPORT} SELECT user_id, user_group, ml_score, total_flagged_tx
      FROM report WHERE user_group LIKE '%bookie%'""",
    "top_receivers": f"""WITH {REPORT} SELECT user_id, total_recv_amount FROM report
      ORDER BY total_recv_amount DESC, user_id LIMIT 10""",
    "top_senders": f"""WITH {FLAGGED} SELECT userid, CAST(sum(amount) AS BIGINT) AS total_sent
      FROM flagged GROUP BY userid ORDER BY total_sent DESC NULLS LAST, userid LIMIT 10""",
    "risky_gamblers": f"""WITH {REPORT} SELECT user_id, ml_score, gambler_tx_count FROM report
      WHERE ml_score > 40 AND gambler_tx_count > 0 ORDER BY ml_score DESC, user_id LIMIT 50""",
    "flagged_by_day": f"""WITH {LABELED} SELECT CAST(dt AS VARCHAR) AS dt, count(*) AS transfers,
      CAST(sum(amount) AS BIGINT) AS amount FROM labeled WHERE hit_any_rule = 1 GROUP BY dt""",
    "user_txn_join": f"""WITH {REPORT} SELECT ok, ln, l.userid, amount, user_group,
      r.ml_score AS user_score FROM labeled l JOIN report r ON r.user_id = l.userid
      WHERE hit_any_rule = 1""",
    "user_profile_360": f"""WITH {LABELED},
      s AS (SELECT count(*) AS sender_tx_count, count(DISTINCT appuser) AS sender_unique_receivers,
        CAST(sum(amount) AS BIGINT) AS sender_total_sent, avg(amount) AS sender_avg_amount,
        max(amount) AS sender_max_amount, avg(is_bet_tail) AS sender_bet_tail_ratio,
        avg(desc_has_win) AS sender_win_desc_ratio, max(str_ip_change) AS str_ip_change,
        max(str_device_share) AS str_device_share, max(str_smurfing) AS str_smurfing,
        max(str_rapid_tx) AS str_rapid_tx FROM labeled WHERE userid = 'u10'),
      r AS (SELECT count(*) AS recv_tx_count, count(DISTINCT userid) AS recv_unique_senders,
        CAST(sum(amount) AS BIGINT) AS recv_total_received, avg(amount) AS recv_avg_amount,
        max(amount) AS recv_max_amount, avg(is_bet_tail) AS recv_bet_tail_ratio,
        avg(desc_has_win) AS recv_win_desc_ratio, max(is_bookie_tx) AS is_bookie,
        max(is_gambler_tx) AS is_gambler, max(hit_any_rule) AS hit_any_rule
        FROM labeled WHERE appuser = 'u10')
      SELECT * FROM s CROSS JOIN r""",
    "user_assessment": f"""WITH {REPORT} SELECT user_id, user_group,
      CASE WHEN user_group = 'normal' THEN ml_r ELSE ml_s END AS score,
      CASE WHEN user_group = 'normal' THEN 'receiver' ELSE 'sender' END AS judged_as FROM report""",
    "foreign_ip_txns": f"""WITH {TXN}{RANGES} SELECT coalesce(country, '') AS iploc,
      count(*) AS transfers FROM txn LEFT JOIN located ON located.userip = txn.userip
      WHERE coalesce(country, '') <> 'C3' GROUP BY 1""",
    "bet_tail_share": f"WITH {FLAGGED} SELECT avg(is_bet_tail) AS share FROM flagged",
    "transfers_per_flag": f"WITH {LABELED} " + _long("labeled", _FLAG_NAMES, "flag", "transfers"),
    "group_counts": f"WITH {REPORT} SELECT user_group, count(*) AS users FROM report GROUP BY 1",
    "validate_outputs": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, true AS ok, count(*) AS rows FROM {t}"
        for t in ("customer", "lineitem", "nation", "orders", "supplier")
    ),
    "str_device_share_hot": ORACLES["str_device_share"],
    "etl_ip6_country": """WITH users AS (
        SELECT c_custkey, CASE WHEN c_custkey % 50 <> 7 THEN printf('2001:%x:%x:%x::%x', c_custkey % 30,
          c_custkey % 3, c_custkey % 5, c_custkey) END AS userip,
          CAST(c_custkey % 30 AS HUGEINT) * 281474976710656 * 281474976710656
          + CAST(c_custkey % 3 AS HUGEINT) * 4294967296 * 281474976710656
          + CAST(c_custkey % 5 AS HUGEINT) * 65536 * 281474976710656 + c_custkey AS ip FROM customer),
      starts AS (
        SELECT 'C' || n_nationkey AS country, CAST(n_nationkey AS HUGEINT) * 281474976710656 * 281474976710656
          + CAST(n_nationkey % 2 AS HUGEINT) * 4294967296 * 281474976710656 AS first,
          CASE WHEN n_nationkey % 3 = 0 THEN CAST(18446744073709551616 AS HUGEINT)
            ELSE CAST(1208925819614629174706176 AS HUGEINT) END AS size FROM nation)
      SELECT c_custkey, userip, coalesce((SELECT CASE WHEN u.ip < max(first) + arg_max(size, first)
        THEN arg_max(country, first) END FROM starts WHERE first <= u.ip AND u.userip IS NOT NULL), '') AS iploc
      FROM users u""",
    "iforest_train_rows": f"""WITH {LABELED} SELECT count(*) AS rows, true AS mean_below_p95,
      true AS p95_in_range FROM labeled WHERE hit_any_rule = 0""",
    "iforest_scored_rows": f"WITH {LABELED} SELECT ok, ln, hit_any_rule = 0 AS scored FROM labeled",
    "iforest_scale": "SELECT true AS lowest_is_0, true AS highest_is_100",
    "stream_score_agrees": f"WITH {TXN} SELECT count(*) AS equal, count(*) AS rows FROM txn",
    "table_freshness_verdicts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) > 0 AS has_files, true AS older FROM {t}"
        for t in ("customer", "lineitem", "nation", "orders", "supplier")
    ),
    "stream_etl": ORACLES["etl_transfers"],
    "stream_closed_days": f"""WITH {FLAGGED}{STR} SELECT appuser, CAST(dt AS VARCHAR) AS dt, senders
      FROM smurf_in WHERE dt < DATE '2024-01-06'""",
    "stream_late_rows": f"""WITH {FLAGGED} SELECT CAST(count(*) AS BIGINT) AS late FROM flagged
      WHERE amount < 500000 AND dt = DATE '2024-01-01'""",
    "stream_etl_audit": f"""WITH {TXN}{RANGES}, l AS (SELECT coalesce(country, '') AS iploc FROM txn
        LEFT JOIN located ON located.userip = txn.userip)
      SELECT 'rows_out' AS metric, CAST(count(*) AS BIGINT) AS value FROM l
      UNION ALL SELECT 'unmatched', CAST(count(*) AS BIGINT) FROM l WHERE iploc = ''""",
    "stream_score_repeated": f"""WITH {LABELED} SELECT count(*) AS rows, count(*) AS rows_again,
      count(*) FILTER (hit_any_rule = 0) AS scored FROM labeled""",
    "sender_profile_daily": ORACLES["sender_profile"],
    "receiver_profile_daily": ORACLES["receiver_profile"],
    "profile_sketches": f"""WITH {FLAGGED} SELECT 'sender' AS side, count(*) AS users, true AS close
      FROM (SELECT DISTINCT userid FROM flagged) UNION ALL SELECT 'receiver', count(*), true FROM (SELECT DISTINCT appuser FROM flagged)""",
    "landing_transfers": f"""WITH {TXN} SELECT nullif(reqdate, 'n/a') AS reqdate, userid, appuser, amount, userip, deviceid,
      platform, description FROM txn""",
    "landing_rejected": """SELECT 'broken.csv' AS file, CASE WHEN n_nationkey % 2 = 0 THEN 'wrong number of columns'
      ELSE 'quote without end' END AS reason, CASE WHEN n_nationkey % 2 = 0 THEN 'short,u' || n_nationkey
      ELSE 'x,u,"open ' || n_nationkey END AS text FROM nation""",
    "pipeline_labeled": f"""WITH {LABELED} SELECT userid, appuser, nullif(reqdate, 'n/a') AS reqdate, amount, is_bet_tail, desc_has_win,
      desc_match_b1, desc_match_b2, {_STR}, {_RULES} FROM labeled""",
    "sql_group_totals": f"""WITH {FLAGGED} SELECT appuser, CAST(dt AS VARCHAR) AS dt, CAST(grouping_id(appuser, dt) AS INT) AS level,
      count(*) AS transfers, CAST(sum(amount) AS BIGINT) AS total FROM flagged GROUP BY GROUPING SETS ((appuser), (dt), ())""",
    "export_round_trip": f"""WITH {FLAGGED}, r AS (SELECT userid, count(*) AS transfers, max(amount) AS most FROM flagged
      GROUP BY userid) SELECT 'csv' AS kind, * FROM r UNION ALL SELECT 'parquet', * FROM r""",
    "pipeline_report": f"""WITH {REPORT} SELECT user_id, user_group, total_sent_tx, total_sent_amount, total_recv_tx,
      unique_senders, user_id IN (SELECT user_id FROM bookie_rep) AS in_bookie_report FROM report""",
    "chart_captions": "SELECT chart, caption, count(*) > 0 AS filled FROM lineitem, (VALUES "
    + ", ".join(f"('{name}', '{text}')" for name, text in CHARTS.items())
    + ") c(chart, caption) GROUP BY chart, caption",
    "registration_results": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, true AS success, count(*) AS rows FROM {t}"
        for t in ("customer", "lineitem", "nation", "orders", "supplier")
    )
    + " UNION ALL VALUES ('absent', false, NULL), ('damaged', false, NULL)",
    "preflight_results": """WITH n AS (SELECT count(*) AS orders, count(DISTINCT o_custkey) AS users FROM orders)
      SELECT 'column named like a table' AS query, 'before' AS moment, true AS success, users AS rows FROM n
      UNION ALL SELECT 'by alias', 'before', true, orders FROM n
      UNION ALL SELECT 'defined in the query', 'before', true, orders FROM n
      UNION ALL SELECT q, m, false, NULL FROM (VALUES ('missing table', 'before'), ('unknown column', 'before'),
        ('column named like a table', 'after new transfers'), ('by alias', 'after new transfers'),
        ('missing table', 'after new transfers'), ('defined in the query', 'after new transfers'),
        ('unknown column', 'after new transfers')) v(q, m)""",
    "pipeline_lineage": """WITH s(table_name, source) AS (VALUES ('labeled', 'etl'), ('scored', 'labeled'), ('scored', 'models/active'),
        ('report_users', 'labeled'), ('report_users', 'models/active'), ('report_bookie', 'labeled'), ('report_bookie', 'models/active'))
      SELECT table_name, source, true AS current, 'before' AS moment FROM s
      UNION ALL SELECT table_name, source, source <> 'etl', 'after' FROM s
      UNION ALL VALUES ('maindb', 'stale before', true, 'catalog'), ('rpt_users', 'stale before', true, 'catalog'),
        ('maindb', 'stale after', false, 'catalog'), ('rpt_users', 'stale after', false, 'catalog')""",
    "scored_in_order": f"""WITH {TXN} SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS overlapping,
      CAST(0 AS BIGINT) AS unordered, min(reqdate) AS first, max(reqdate) AS last FROM txn""",
    "stream_smurf_days": ORACLES["smurf_in_days"],
    "stream_rapid_pairs": ORACLES["rapid_pairs"],
    "stream_rapid_days": ORACLES["rapid_pairs"],
    "intent_tags": f"WITH {INTENT} SELECT * FROM tags",
    "intent_counts": f"WITH {INTENT} SELECT intent, count(*) AS turns FROM tags GROUP BY intent",
    "intent_tags_worded": f"WITH {_WORDED}, {_intent(DEFAULT, 'worded')} SELECT * FROM tags",
    "ambiguous_turns": f"""WITH {_WORDED} SELECT conv_id, turn, {_says("lower(text)", *_quoted(DEFAULT.general))}
      AND NOT {_says("lower(text)", *_quoted(DEFAULT.specific))} AS ambiguous FROM worded WHERE role = 'user'""",
    "recent_turns": """SELECT conv_id, turn, role, content FROM (
        SELECT conv_id, turn, role, substr(trim(text, E' \\t\\n\\r'), 1, 4000) AS content,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
      WHERE k <= 8 AND role IN ('user', 'assistant') AND content <> ''""",
    "last_step": f"""WITH t AS (SELECT conv_id, turn, role, {_ACCENT_FREE} AS c FROM conversations),
      steps AS (SELECT conv_id, turn, CASE
        WHEN ({_says("c", "shre")} AND {_says("c", "the")}) OR {_says("c", "thble")} THEN 3
        WHEN ({_says("c", "of a")} AND {_says("c", "the")})
          OR ({_says("c", "eau")} AND NOT {_says("c", "ing")}) THEN 2
        WHEN ({_says("c", "in")} AND {_says("c", "the")})
          OR ({_says("c", "on")} AND NOT {_says("c", "ing")}) THEN 1 END AS step
        FROM t WHERE role = 'assistant')
      SELECT t.conv_id, CAST(coalesce((SELECT arg_max(step, turn) FROM steps s
        WHERE s.conv_id = t.conv_id AND step IS NOT NULL), 0) AS INT) AS last_step
      FROM (SELECT DISTINCT conv_id FROM t) t""",
    "last_step_worded": f"""WITH {_words_behind("told", step_reports(DEFAULT))},
      t AS (SELECT conv_id, turn, role, {_ACCENT_FREE} AS c FROM told),
      steps AS (SELECT conv_id, turn, CASE {" ".join(
        f"WHEN ({_says('c', *names)} AND {_says('c', *DEFAULT.done)})"
        + "".join(f" OR (contains(c, '{f}') AND NOT {_says('c', *DEFAULT.negative)})" for f in files)
        + "".join(f" OR contains(c, '{m}')" for m in marks) + f" THEN {step}"
        for step, names, files, marks in DEFAULT.steps)} END AS step FROM t WHERE role = 'assistant')
      SELECT conv_id, CAST(coalesce(max_by(step, turn) FILTER (step IS NOT NULL), 0) AS INT) AS last_step
      FROM (SELECT DISTINCT conv_id FROM t) LEFT JOIN steps USING (conv_id) GROUP BY conv_id""",
    "landing_placed": """SELECT 'Giao_d_ch_1' AS stem, 'orders' AS kind, o_orderkey AS key FROM orders
      UNION ALL SELECT 'Giao_d_ch_1', 'part', p_partkey FROM part UNION ALL SELECT 'upload', 'orders', o_orderkey FROM orders""",
}
