"""Questions over a chat log: intent of a turn, recent turns, last finished stage.

``chats`` has (conv_id, turn, role, text).  Phrases come as a ``Vocabulary``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import fold_for_matching

Phrases = tuple[str, ...]


@dataclass(frozen=True)
class Vocabulary:
    """Phrase lists; ``pipeline`` maps a stage to its phrases in order of precedence."""

    meta: Phrases
    complaint_steps: Phrases
    complaint_marks: Phrases
    next: Phrases
    pipeline: tuple[tuple[str, Phrases], ...]
    report: Phrases
    transaction: Phrases
    correction: Phrases
    done: Phrases
    negative: Phrases
    # general words that need a more specific one beside them
    general: Phrases
    specific: Phrases
    # stage number, its names, its files, and marks that need no further proof
    steps: tuple[tuple[int, Phrases, Phrases, Phrases], ...]


# Phrases that decide the intent and the finished stage.
DEFAULT = Vocabulary(
    meta=(
        "có thể làm gì", "lam duoc gi", "làm được gì", "chức năng", "tinh nang", "tính năng",
        "có tool gì", "hướng dẫn", "huong dan", "help", "giới thiệu", "gioi thieu",
    ),
    complaint_steps=("buoc 1", "buoc 2", "buoc 3", "buoc 4"),
    complaint_marks=(
        "bug", "loi", "sai", "khong dung", "tai sao", "vi sao", "sao lai", "moi chay", "ma da",
        "nhay", "xo", "skip", "bo qua", "logic",
    ),
    next=(
        "next", "continue", "go on", "tiep", "tiep tuc", "tiep di", "lam tiep", "chay tiep", "co",
        "yes", "y", "ok", "okay", "dong y",
    ),
    pipeline=(
        (
            "etl",
            (
                "etl", "gộp file", "gop file", "gộp csv", "gop csv", "làm sạch raw",
                "lam sach raw", "tra ip", "iploc", "ip location", "chuẩn hoá giao dịch",
                "chuan hoa", "bước 1", "buoc 1", "step 1",
            ),
        ),
        (
            "features",
            (
                "feature engineering", "tạo biến", "tao bien", "derived column", "cột phái sinh",
                "gán nhãn", "gan nhan", "gắn cờ", "gan co", "rule-based", "rule based",
                "labeling", "bước 2", "buoc 2", "step 2",
            ),
        ),
        (
            "reports",
            (
                "chạy model", "chay model", "chạy mô hình", "chay mo hinh", "inference",
                "scoring", "xuất báo cáo", "xuat bao cao", "tạo chart", "tao chart",
                "tạo biểu đồ", "tao bieu do", "visualization", "visualize", "bước 3", "buoc 3",
                "step 3",
            ),
        ),
        (
            "training",
            (
                "retrain", "đào tạo lại", "dao tao lai", "train lại", "train lai",
                "huấn luyện lại", "huan luyen lai", "bước 4", "buoc 4", "step 4",
            ),
        ),
    ),
    report=(
        "bookie", "gambler", "recipient1", "recipient2", "depositor1", "depositor2", "nhóm",
        "nhom", "phân loại user", "phan loai user", "ml_score", "điểm rủi ro", "diem rui ro",
        "ml score", "high score", "điểm cao", "diem cao", "report", "báo cáo user",
        "bao cao user", "rpt_users", "highmls", "bao nhiêu user", "bao nhieu user", "số user",
        "so user", "danh sách user", "danh sach user", "top user", "liệt kê user",
        "liet ke user",
    ),
    transaction=(
        "giao dịch", "giao dich", "transaction", "txn", "số tiền", "so tien", "amount",
        "đuôi tiền", "duoi tien", "bet_tail", "is_bet_tail", "nội dung", "noi dung", "desc",
        "ngày", "ngay", "reqdate", "ip", "iploc", "quốc gia", "quoc gia", "sender", "receiver",
        "appuser", "userid", "tỉ lệ", "ti le", "phân phối", "phan phoi", "sender_", "recv_",
    ),
    correction=(
        "sai rồi", "sai roi", "không đúng", "khong dung", "nhầm rồi", "nham roi", "ý tôi là",
        "y toi la", "không phải", "khong phai", "hiểu sai", "hieu sai",
    ),
    general=(
        "từng nhóm", "tung nhom", "các nhóm", "cac nhom", "thống kê chung", "thong ke chung",
        "tổng quan", "tong quan", "mọi thứ", "tất cả", "tat ca",
    ),
    specific=(
        "bookie", "gambler", "bet_tail", "win", "iploc", "userid", "appuser", "amount",
        "giao dịch", "giao dich", "is_", "hit_any", "sender", "recv",
    ),
    done=("hoan tat", "hoan thanh"),
    negative=("chua co", "cu hon", "vui long chay", "hay bat dau"),
    steps=(
        (3, ("buoc 3",), (), ("f1-f6 charts",)),
        (2, ("buoc 2",), ("labeled.parquet",), ()),
        (1, ("buoc 1",), ("etl.parquet",), ()),
    ),
)


def phrases(words: Vocabulary) -> list[str]:
    """All phrases that decide an intent, in the order of their lists."""
    lists = [words.meta, words.complaint_steps, words.complaint_marks, words.next]
    lists += [p for _, p in words.pipeline]
    lists += [words.report, words.transaction, words.correction, words.general, words.specific]
    return [p for one in lists for p in one]


def step_reports(words: Vocabulary) -> list[str]:
    """Sentences about a stage: its names with and without the words for "done", its files with and without a denial."""
    found = [*words.done, *words.negative]
    for _, names, files, marks in words.steps:
        found += [f"{n}{d}" for n in names for d in ("", *(f" {d}" for d in words.done))]
        found += [f"{d}{f}" for f in files for d in ("", *(f"{d} " for d in words.negative))]
        found += marks
    return found


def _any(text: Column, phrases: Phrases) -> Column:
    """Whether any phrase occurs; one pass over the text for the whole list."""
    if not phrases:
        return F.lit(False)
    return text.rlike("|".join(re.escape(p) for p in phrases))


def intent(text: Column, words: Vocabulary) -> Column:
    """Intent of a user turn; prefixes first, then the lists in fixed precedence."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    lower = F.lower(raw)
    plain = F.trim(F.regexp_replace(fold_for_matching(raw), r"(?U)\s+", " "))
    bare = F.regexp_replace(plain, r"^[ .!?,]+|[ .!?,]+$", "")
    branches = [
        (raw.startswith("?"), "question"),
        (lower.startswith("[query]"), "sql"),
        (_any(lower, words.meta), "meta"),
        (_any(plain, words.complaint_steps) & _any(plain, words.complaint_marks), "complaint"),
        (bare.isin(*words.next), "next"),
        *[(_any(lower, phrases), f"pipeline:{stage}") for stage, phrases in words.pipeline],
        (_any(lower, words.report), "report"),
        (_any(lower, words.transaction), "transaction"),
        (_any(lower, words.correction), "correction"),
    ]
    result = F.lit("other")
    for test, name in reversed(branches):
        result = F.when(test, name).otherwise(result)
    return result


def intent_tags(chats: DataFrame, words: Vocabulary = DEFAULT) -> DataFrame:
    """Intent of every user turn."""
    return chats.where(F.col("role") == "user").select(
        "conv_id", "turn", intent(F.col("text"), words).alias("intent")
    )


def ambiguous_turns(chats: DataFrame, words: Vocabulary = DEFAULT) -> DataFrame:
    """Whether a user turn asks in general words without any specific one."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    vague = _any(lower, words.general) & ~_any(lower, words.specific)
    return chats.where(F.col("role") == "user").select("conv_id", "turn", vague.alias("ambiguous"))


def intent_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("intent").agg(F.count(F.lit(1)).alias("turns"))


def recent_turns(chats: DataFrame, limit: int = 8, max_chars: int = 4000) -> DataFrame:
    """The last ``limit`` turns of each conversation, then only non-empty spoken ones.

    The rank is a top-k, so Spark cuts each partition to ``limit`` rows per
    conversation before the shuffle and a long conversation never moves whole.
    """
    latest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    content = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    return (
        chats.withColumn("_rank", F.row_number().over(latest))
        .where(F.col("_rank") <= limit)
        .where(F.col("role").isin("user", "assistant") & (content != ""))
        .select("conv_id", "turn", "role", F.substring(content, 1, max_chars).alias("content"))
    )


def finished_step(text: Column, words: Vocabulary) -> Column:
    """Stage number an assistant turn reports as finished, NULL if none."""
    plain = fold_for_matching(text)
    done, negative = _any(plain, words.done), _any(plain, words.negative)
    result = F.lit(None).cast("int")
    for number, names, files, marks in reversed(words.steps):
        said = (_any(plain, names) & done) | (_any(plain, files) & ~negative) | _any(plain, marks)
        result = F.when(said, number).otherwise(result)
    return result


def last_step(chats: DataFrame, words: Vocabulary = DEFAULT) -> DataFrame:
    """Latest finished stage per conversation, 0 if none."""
    step = F.when(F.col("role") == "assistant", finished_step(F.col("text"), words))
    known = F.when(step.isNotNull(), F.col("turn"))
    return chats.groupBy("conv_id").agg(
        F.coalesce(F.max_by(step, known), F.lit(0)).alias("last_step")
    )
