import json
import os
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import token_blocks as tb

FILE = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
needs_file = pytest.mark.skipif(not os.path.exists(FILE), reason="tokenizer file is not here")
#: Pieces whose neighbours matter for normalizing, lower case or splitting.
TRICKY = (
    "a B é é ́ Σ ς İ ß 's 'S 't 're . , .. ,. _ 1 23 ½ <|startoftext|> <|endoftext|> 中文 👍🏽 ‍ ª ǅ K Ⅷ ͅ don't it's, 힣 ᄀ ᅡ # - \x1c, "
).split(" ") + [" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", ", ", ". ", ".\n"]


@pytest.mark.parametrize("width", [1, 5, 8, 11, 16, 17, 20, 32])
def test_packing_round_trip_and_random_access(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, size=70_001, dtype=np.uint64).astype(np.uint32)
    packed = tb.pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    assert (tb.unpack(packed, width, 0, len(ids)) == ids).all()
    for first, n in ((0, 1), (1, 7), (65_535, 3), (69_999, 2), (5, 0), (3, 66_000)):
        assert (tb.unpack(packed, width, first, n) == ids[first : first + n]).all()


def test_fewest_bits():
    assert [tb.bits_for(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


@needs_file
def test_words_encode_as_whole_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(TRICKY) for _ in range(rng.randrange(30))) for _ in range(4000)]
    by_words, whole = tb.encoder(FILE), tb.TextEncoder(FILE)
    assert isinstance(by_words, tb.WordEncoder)
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        for text, a, b in zip(some, by_words(some), whole(some), strict=True):
            assert a.tolist() == b.tolist(), repr(text)


@needs_file
def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tb, "_WORDS", 3)
    by_words, whole = tb.encoder(FILE), tb.TextEncoder(FILE)
    for text in ("one two three four", "five, six. seven", "one two", ""):
        assert by_words([text])[0].tolist() == whole([text])[0].tolist()


@needs_file
def test_new_words_get_their_number_by_the_look_up():
    by_words, whole = tb.WordEncoder(FILE, json.loads(open(FILE, encoding="utf-8").read())), tb.TextEncoder(FILE)
    batches = (["one two, two one", "three. 4"], ["two three", ""], ["four, one.", "four . ,"])
    for texts in batches:
        for a, b in zip(by_words(texts), whole(texts), strict=True):
            assert a.tolist() == b.tolist()
        # nothing is asked for again: parts of a word follow the words of their batch
        assert by_words.learnt == len(by_words.known) == len(set(by_words.known.values()))
    assert list(by_words.known) == "one|two,|two|three.|4|three|,|.||four,|one.|four".split("|")


ROWS = [(7, "The quick fox"), (3, None), (5, ""), (-2, "w" * 3000), (9, "long text " * 5000), (None, "no id"), (3, "again"), (3, "again"), (4, "ünï cödé")]


def tie(text):
    return int.from_bytes(xxhash.xxh64_digest((text or "").encode(), 42), "big", signed=True)


def brute(rows):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(FILE), 0, []
    for id_, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1]))):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((id_, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out, start


def frame(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.withColumns({c: F.lit(1) for c in ("id", "part", "block", "start", "payload")})


@needs_file
def test_documents_come_back_in_order(spark):
    path = tb.block_path(spark)
    tb.write_blocks(frame(spark, ROWS), FILE, path, parts=3, block_tokens=50)
    got = [tuple(r) for r in tb.read_documents(spark, path).collect()]
    want, total = brute(ROWS)
    assert sorted(got, key=lambda r: r[1]) == want
    assert spark.read.parquet(path).count() > 4
    ids = {}
    for r in tb.read_range(spark, path, 0, total).collect():
        ids.update(enumerate(r["ids"], r["start"]))
    assert sorted(ids) == list(range(total))
    for first, n in ((0, 1), (5, 9), (total - 3, 3), (10, 3000), (total, 5)):
        part = {}
        for r in tb.read_range(spark, path, first, n).collect():
            part.update(enumerate(r["ids"], r["start"]))
        assert part == {k: ids[k] for k in range(first, min(first + n, total))}


@needs_file
def test_empty_table(spark):
    path = tb.block_path(spark)
    tb.write_blocks(frame(spark, ROWS).where("false"), FILE, path)
    assert tb.read_documents(spark, path).collect() == []


@needs_file
def test_whole_table(spark):
    from tidewatch.llm.queries import op6_token_blocks

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op6_token_blocks(spark, sf).collect()) == brute(rows)[0]
