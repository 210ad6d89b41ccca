"""Thresholds and word lists; every operator takes one ``Config``."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields

# Results depend on these exact numbers, names and patterns.
BET_TAILS = (11, 12)
WIN_PATTERN = r"(?U)\bwin\d+"
EXCLUDED_PHRASE = "dung zalopay chuyen tien"
PATTERN_B1 = r"(?U)chuyen\s+(khoan|tien)\s+\d{6}\s*$"
PATTERN_B2 = r"(?U)chuyen\s+(khoan|tien)\s+\d{5}\s*$"

SENDER_FEATURES = (
    "sender_tx_count",
    "sender_unique_receivers",
    "sender_total_sent",
    "sender_avg_amount",
    "sender_max_amount",
    "sender_std_amount",
    "sender_unique_ips",
    "sender_bet_tail_ratio",
    "sender_win_desc_ratio",
    "sender_b1_ratio",
    "sender_b2_ratio",
)
RECEIVER_FEATURES = (
    "recv_tx_count",
    "recv_unique_senders",
    "recv_total_received",
    "recv_avg_amount",
    "recv_max_amount",
    "recv_std_amount",
    "recv_bet_tail_ratio",
    "recv_win_desc_ratio",
    "recv_b1_ratio",
    "recv_b2_ratio",
)
STR_FLAGS = ("str_ip_change", "str_device_share", "str_smurfing", "str_rapid_tx")
PATTERN_FLAGS = ("is_bet_tail", "desc_has_win", "desc_match_b1", "desc_match_b2")
RULE_FLAGS = (
    "is_bookie_tx",
    "is_gambler_tx",
    "is_recipient1_tx",
    "is_depositor1_tx",
    "is_recipient2_tx",
    "is_depositor2_tx",
)
MODEL_FEATURES = (
    *SENDER_FEATURES,
    *RECEIVER_FEATURES,
    "recv_send_tx_ratio",
    "amount",
    "is_bet_tail",
    "desc_has_win",
    *STR_FLAGS,
)
# Used only when a model carries no feature list of its own.
FALLBACK_FEATURES = tuple(
    f
    for f in MODEL_FEATURES
    if f not in STR_FLAGS and f not in ("sender_total_sent", "recv_total_received")
)


@dataclass(frozen=True)
class Config:
    # pattern flags
    bet_tails: tuple[int, ...] = BET_TAILS
    win_pattern: str = WIN_PATTERN
    excluded_phrase: str = EXCLUDED_PHRASE
    pattern_b1: str = PATTERN_B1
    pattern_b2: str = PATTERN_B2
    # bookie rule
    bookie_min_senders: int = 10
    bookie_flow_ratio: float = 1.0
    bookie_bet_tail: float = 0.30
    bookie_win_desc: float = 0.10
    bookie_non_bet: float = 0.70
    bookie_min_score: float = 5.0
    weight_senders: float = 1.0
    weight_flow_ratio: float = 2.0
    weight_bet_tail: float = 5.0
    weight_win_non_bet: float = 5.0
    # suspicious-activity flags
    str_change_min: int = 2
    smurf_senders: int = 10
    smurf_in_amount: int = 500_000
    smurf_out_amount: int = 5_000_000
    rapid_seconds: int = 10
    rapid_min_pairs: int = 2
    # anomaly model
    features: tuple[str, ...] = MODEL_FEATURES
    trees: int = 200
    tree_rows: int = 256
    # kept for saved settings; it moves a cut-off that the 0-100 scale cancels
    contamination: float = 0.05
    seed: int = 42
    min_train_rows: int = 1_000
    # reports
    score_threshold: float = 70.0
    # sources
    ipv6_value: str = "count"
    # physical limits: what may be broadcast, and when a key counts as hot
    broadcast_buckets: int = 1_000_000
    # a key table of so many rows is sent to the transfers instead of shuffling them
    broadcast_keys: int = 500_000
    # a key is hot if it has this many times the rows of an average shuffle partition
    hot_share: float = 1.0

    def __post_init__(self) -> None:
        if self.ipv6_value not in ("count", "prefix"):
            raise ValueError("ipv6_value must be 'count' or 'prefix'")

    @classmethod
    def from_mapping(cls, values: Mapping) -> Config:
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls.from_mapping(json.loads(text))
