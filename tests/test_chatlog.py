import pytest

from tidewatch.operators import chatlog as G

CHAT = "conv_id int, turn int, role string, text string"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("? bao nhiêu user là bookie?", "question"),
        ("[QUERY] select 1", "sql"),
        ("bạn có thể làm gì?", "meta"),
        ("sao lại nhảy Bước 3", "complaint"),
        ("Tiếp tục!", "next"),
        ("OK", "next"),
        ("chạy feature engineering đi", "pipeline:features"),
        ("bước 3 đi", "pipeline:reports"),
        ("retrain model", "pipeline:training"),
        ("gộp csv giúp", "pipeline:etl"),
        ("bao nhiêu bookie?", "report"),
        ("tỉ lệ giao dịch có đuôi cá độ là bao nhiêu?", "transaction"),
        ("sai rồi", "correction"),
        ("xin chào", "other"),
        ("", "other"),
        (None, "other"),
    ],
)
def test_intent(spark, text, expected):
    chats = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "x")], CHAT)
    rows = G.intent_tags(chats).collect()
    assert [r["intent"] for r in rows] == [expected]


def test_recent_turns_cut_before_dropping_empty_ones(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(10)]
    turns[9] = (1, 9, "user", "  ")
    turns[8] = (1, 8, "system", "x")
    turns[7] = (1, 7, "user", " " + "y" * 5000)
    chats = spark.createDataFrame([*turns, (2, 0, "user", None)], CHAT)
    got = {r["turn"]: r["content"] for r in G.recent_turns(chats).collect()}
    assert sorted(got) == [2, 3, 4, 5, 6, 7] and len(got[7]) == 4000
    plan = G.recent_turns(chats)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize(
    "texts, step",
    [
        (["Bước 1 hoàn tất"], 1),
        (["Bước 1 hoàn tất", "Bước 2 hoàn thành"], 2),
        (["Bước 2 hoàn thành", "Bước 1 hoàn tất"], 1),
        (["F1-F6 charts đã xong"], 3),
        (["đã ghi etl.parquet", "xin chào"], 1),
        (["chưa có labeled.parquet"], 0),
        (["Bước 3"], 0),
    ],
)
def test_last_step(spark, texts, step):
    rows = [(1, i, "assistant", t) for i, t in enumerate(texts)] + [(1, 99, "user", "Bước 3 hoàn tất")]
    got = G.last_step(spark.createDataFrame(rows, CHAT)).collect()
    assert [(r["conv_id"], r["last_step"]) for r in got] == [(1, step)]


def test_ambiguous_turns(spark):
    from tidewatch.operators.chatlog import ambiguous_turns

    rows = [(1, 1, "user", "Tổng quan đi"), (1, 2, "user", "tong quan bookie"), (1, 3, "user", "amount"), (1, 4, "user", None), (1, 5, "assistant", "tất cả")]
    got = ambiguous_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["turn"]: r["ambiguous"] for r in got} == {1: True, 2: False, 3: False, 4: False}


def test_step_reports_name_every_stage(spark):
    """Each sentence as the only turn of its conversation."""
    told = G.step_reports(G.DEFAULT)
    chats = spark.createDataFrame([(k, 1, "assistant", t) for k, t in enumerate(told)], CHAT)
    got = {told[r["conv_id"]]: r["last_step"] for r in G.last_step(chats).collect()}
    assert set(got.values()) == {0, 1, 2, 3}
    assert got["buoc 3"] == 0 and got["buoc 3 hoan tat"] == 3
    assert got["labeled.parquet"] == 2 and got["chua co labeled.parquet"] == 0
