import os

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup

SF = "/root/testdata/sf0.001"


def slow(docs, window=3):
    """Walk documents and lines in order; ``docs`` is a list of (id, text)."""
    seen, out = set(), {}
    for id_, text in sorted(docs, key=lambda d: d[0]):
        lines = text.split("\n")
        filled = [k for k, line in enumerate(lines) if line.strip(" ")]
        covered = set()
        for j in range(len(filled) - window + 1):
            run = tuple(lines[k].strip(" ") for k in filled[j : j + window])
            if run in seen:
                covered |= set(range(filled[j], filled[j + window - 1] + 1))
            seen.add(run)
        out[id_] = ("\n".join(line for k, line in enumerate(lines) if k not in covered), sorted(covered))
    return out


def told(df):
    return {r["id"]: (r["text"], r["removed"]) for r in df.collect()}


def frame(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.withColumns({n: F.lit(1) for n in ("id", "key", "lines", "a", "b", "covered", "_id", "_key", "removed")})


DOCS = [
    (1, "a\nb\nc\nd\ne"),
    (2, "x\n b \nc\nd\ny"),
    (3, "b\n\nc\n\nd\nz"),
    (4, "q\nq\nq\nq\nq\nq"),
    (5, "a\nb"),
    (6, "a\nb\nc\nd\ne"),
    (7, "\n\n\n\n"),
    (8, "c\nd\ne\nq\nq\nq\nnew"),
    (9, "\n".join(f"line {k}" for k in range(5000))),
    (10, "\n".join(f"line {k}" for k in range(2000, 7000))),
]


def test_equals_a_walk(spark):
    got = told(line_dedup.remove_repeated_lines(frame(spark, DOCS)))
    assert got == slow(DOCS)
    assert got[6] == ("", [0, 1, 2, 3, 4]) and got[4] == ("q", [1, 2, 3, 4, 5])


def test_every_distinct_line_survives(spark):
    got = told(line_dedup.remove_repeated_lines(frame(spark, DOCS)))
    lines = lambda texts: {x.strip() for t in texts for x in t.split("\n")} - {""}
    assert lines(t for t, _ in got.values()) == lines(t for _, t in DOCS)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a\nb\nc"), (None, "b\nc\nd\nx"), (3, "a\nb\nc"), (3, "a\nb\nc")]
    got = sorted(map(str, [(r["id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.remove_repeated_lines(frame(spark, rows)).collect()]))
    want = [(1, None, 0, 0), (2, "", 1, 0), (None, "a\nb\nc", 3, 0), (None, "b\nc\nd\nx", 4, 0), (3, "", 3, 3), (3, "", 3, 3)]
    assert got == sorted(map(str, want))


def test_empty_table_and_other_window(spark):
    assert line_dedup.remove_repeated_lines(frame(spark, DOCS).where("false")).collect() == []
    assert told(line_dedup.remove_repeated_lines(frame(spark, DOCS), window=2)) == slow(DOCS, 2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = told(line_dedup.remove_repeated_lines(spark.read.parquet(f"{SF}/documents.parquet")))
    assert got == slow(docs)
