from tests.llm.test_line_dedup import DOCS, frame, slow, told
from tidewatch.llm import line_dedup


def line(name, n=50):
    return " ".join(f"{name}{k}" for k in range(n))


def removed(spark, docs):
    return told(line_dedup.remove_repeated_lines(frame(spark, docs), passage_words=50))


def test_one_and_two_line_passages(spark):
    one, left, right, short = line("a"), line("b", 25), line("c", 25), line("d", 49)
    docs = [
        (1, f"x\n{one}\ny"),
        (2, f"p\n {one} \nq"),
        (3, f"x\n{left}\n\n{right}"),
        (4, f"{left}\n{right}\nz\n{left}"),
        (5, short),
        (6, short),
    ]
    got = removed(spark, docs)
    assert {i: r for i, (_, r) in got.items()} == {1: [], 2: [1], 3: [], 4: [0, 1], 5: [], 6: []}
    assert got[2][0] == "p\nq" and got[4][0] == f"z\n{left}"


def test_copies_of_one_line_texts(spark):
    got = removed(spark, [(2, line("a", 60)), (1, line("a", 60)), (3, f"{line('a', 60)}\n{line('b', 60)}\n{line('b', 60)}")])
    assert got == {1: (line("a", 60), []), 2: ("", [0]), 3: (line("b", 60), [0, 2])}


def test_three_line_windows_stay(spark):
    assert removed(spark, DOCS) == slow(DOCS)
