import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatch.llm import alignment as al
from tidewatch.llm import queries

public = pytest.importorskip("public_tokenizers")
PATHS = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
WORDS = (
    "the of Grenze straße été naïve 中文字 日本 🙂👍🏽 don't it's 12345 3.14 <|endoftext|> <s> </s> <unk> <0x0A>  x \x1c \x85 "
    "a\n b\r\n\t c  d   e ... --- ﬁ ½ é ‍ aaaaaaaaaaaaaaa ______ .\n\n"
).split(" ") + ["", "", "\n", "\n\n ", "\t", "x\n", "  "]


def texts(n, seed=3):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def whole_tokens(text):
    """Library ids of whole texts, or None by the rule on bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(whole_tokens, "made"):
        t = Tokenizer.from_file(PATHS[0])
        t.encode_special_tokens = True
        whole_tokens.made = t, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    t, sp = whole_tokens.made
    if not text:
        return None
    letters = {}
    free = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters[chr(b)] = b
        else:
            letters[chr(free)] = b
            free += 1
    a = t.encode(" " + text, add_special_tokens=False)
    bytes_a = [bytes(letters[c] for c in token) for token in a.tokens]
    b = sp.encode(text)
    bytes_b = []
    for i in b:
        piece = sp.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    return list(zip(a.ids, bytes_a, strict=True)), list(zip(b, bytes_b, strict=True))


def slow_groups(text):
    found = whole_tokens(text)
    if found is None:
        return None
    sides = []
    for side in found:
        at, ends = 0, []
        for _, spelled in side:
            at += len(spelled)
            ends.append(at)
        sides.append(ends)
    cuts = sorted(set(sides[0]) & set(sides[1]))
    groups = [([], []) for _ in cuts]
    for k, (side, ends) in enumerate(zip(found, sides, strict=True)):
        for (i, _), e in zip(side, ends, strict=True):
            groups[bisect.bisect_left(cuts, e)][k].append(i)
    return groups


def slow_corpus(rows):
    """Every value of the query by its plain definition."""
    all_groups = [slow_groups(t) for _, t in rows]
    holds = Counter()
    for groups in all_groups:
        holds.update({(a, b) for ga, gb in groups or [] for a in ga for b in gb})
    best = defaultdict(int)
    for (a, _), n in holds.items():
        best[a] = max(best[a], n)
    out = []
    for (doc, _), groups in zip(rows, all_groups, strict=True):
        links = [(a, b) for ga, gb in groups or [] for a in ga for b in gb]
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups or [])
        out.append(
            (
                doc,
                sum(len(g[0]) for g in groups or []),
                sum(len(g[1]) for g in groups or []),
                len(groups or []),
                len(links),
                sum(holds[x] == best[x[0]] for x in links),
                sum(holds[x] for x in links),
                hashlib.sha256(written.encode()).hexdigest() if groups is not None else "",
            )
        )
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_plain_definition(spark, tmp_path):
    rows = list(enumerate(texts(300)))
    rows += [(0, "the of"), (0, "the of"), (None, "the of"), (None, None), (901, None), (902, ""), (903, " "), (904, "▁ x")]
    rows += [(905, "long " * 30_000 + "z" * 5_000), (906, "straße" * 900), (907, "x▁y the")]
    spark.createDataFrame(
        [(d, t, 1, 2, "k") for d, t in rows], "doc_id bigint, text string, row int, pairs int, groups string"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_alignment(spark, str(tmp_path)).select(*COLUMNS).collect()

    def order(r):
        return tuple(str(x) for x in r)

    assert sorted(map(tuple, found), key=order) == sorted(slow_corpus(rows), key=order)
    assert dict(found[0].asDict()).keys() == set(COLUMNS)


def test_given_documents_equal_plain_definition(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op13_alignment(spark, sf).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == sorted(slow_corpus(rows))


def test_counts_by_shuffle_join_are_the_same(spark):
    docs = spark.createDataFrame(list(enumerate(texts(40))), "doc_id bigint, text string")
    stored = al.store(al.align(docs, *PATHS))
    a, b = al.score(stored), al.score(stored, limit=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert "BroadcastHashJoin" not in b._jdf.queryExecution().optimizedPlan().toString()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert al.score(al.store(al.align(docs, *PATHS))).collect() == []


def test_segments_spell_the_text_and_encode_alike():
    aligner = al.Aligner(*PATHS)
    assert aligner.by_segment and aligner.sides[0].ranked
    for text, found in zip(texts(500, 9), aligner.tokens(texts(500, 9)), strict=True):
        assert "".join(" " + s for s in al.segments(text)) == " " + text
        whole = whole_tokens(text)
        assert (found is None) == (whole is None)
        if whole:
            assert [i for i, _ in whole[0]] == found[0].tolist() and [i for i, _ in whole[1]] == found[1].tolist()


def test_merging_by_rank_equals_the_file(spark):
    """Every text of a table and odd ones, whole and by either library."""
    side = al.ByteLevel(PATHS[0])
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    given = [r.text for r in rows if r.text] + texts(2000, 11) + ["a" * 9000, "ab" * 4000 + "é" * 500, " " * 300, "\n \n" * 99]
    for text in given:
        assert side.encode(text) == side.tokenizer.encode(" " + text, add_special_tokens=False).ids


def test_run_skipping_finds_every_common_end():
    rng = random.Random(5)
    for k in range(400):
        n = rng.choice((1, 2, 5, 40, 3000 if k % 20 == 0 else 10))
        common = sorted(rng.sample(range(1, 6 * n), n))
        share = rng.choice((0.0, 0.05, 0.9))
        last = common[-1]
        sides = [
            sorted({*(c for c in common if rng.random() >= share), *(rng.randrange(1, last + 1) for _ in range(int(n * share))), last})
            for _ in range(2)
        ]
        ends = sorted(set(sides[0]) & set(sides[1]))
        got = al.group_ends(*map(np.array, sides))
        assert [sides[0][i - 1] for i in got[0]] == ends == [sides[1][j - 1] for j in got[1]]


def test_wide_groups_and_slices(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 60).astype(np.int32), rng.integers(0, 9, 50).astype(np.int32)
    ends_a, ends_b = np.array([1, 2, 30, 31, 60]), np.array([2, 3, 20, 49, 50])
    expect = Counter()
    for g in range(5):
        for x in a[ends_a[g - 1] if g else 0 : ends_a[g]]:
            expect.update((int(x) << 32) + int(y) for y in b[ends_b[g - 1] if g else 0 : ends_b[g]])
    for wide, links in ((1 << 12, 1 << 20), (10, 1 << 20), (1 << 12, 1), (1, 7), (100, 60)):
        monkeypatch.setattr(al, "_WIDE", wide)
        monkeypatch.setattr(al, "_LINKS", links)
        pairs, times = al.linked(a, b, ends_a, ends_b)
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == expect
        assert (np.diff(pairs) > 0).all()
