"""Token ids packed at fixed width into blocks.

A block holds whole documents that follow each other in the order of their ids.  Each id
takes as many bits as the largest id of the vocabulary needs, most significant bit first and
without gaps, so the i-th id of a block starts at bit ``i * width``.  Blocks are rows of a
Parquet table, one part file per range of ids:

``part, block, first_token, n_tokens, width, doc_ids, doc_ends, payload``

``first_token`` counts the ids of the part before the block; ``doc_ends`` the ids of the
block up to the end of each document.  Any id, document or block is found from these
columns without unpacking another.  Parquet is the container because Spark's committer
makes each part appear whole or not at all, in any store that Spark can write.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.sources.storage import new_path

SCHEMA = (
    "part int, block int, first_token bigint, n_tokens bigint, width int, "
    "doc_ids array<bigint>, doc_ends array<bigint>, payload binary"
)
#: A block is closed once it holds so many ids; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 16
#: Past so many remembered words or letters the memory starts anew.
_WORDS, _LETTERS = 1_000_000, 12_000_000


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2^width to ``ceil(len * width / 8)`` bytes."""
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint32)
    out = []
    for at in range(0, len(ids), 1 << 16):  # a multiple of 8 ids ends on a whole byte
        bits = (ids[at : at + (1 << 16), None].astype(np.uint32) >> shifts) & 1
        out.append(np.packbits(bits.astype(np.uint8).ravel()).tobytes())
    return b"".join(out)


def unpack(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from number ``first`` on, without touching the bytes of others."""
    if width in (8, 16, 32):
        step = width // 8
        return np.frombuffer(payload, f">u{step}", count, first * step).astype(np.uint32)
    low, high = first * width, (first + count) * width
    raw = np.frombuffer(payload, np.uint8, -(-high // 8) - low // 8, low // 8)
    weights = (1 << np.arange(width - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
    out = np.empty(count, np.uint32)
    for at in range(0, count, 1 << 16):
        some = min(1 << 16, count - at)
        start = low % 8 + at * width
        piece = np.unpackbits(raw[start // 8 : -(-(start + some * width) // 8)])
        bits = piece[start % 8 : start % 8 + some * width].reshape(some, width)
        out[at : at + some] = bits.astype(np.uint64) @ weights
    return out


class TextEncoder:
    """Encodes whole texts with the tokenizers library, for any tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]


#: The normalizer and splitter whose work :class:`WordEncoder` can do by words.
_BY_WORDS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
#: Letters whose lower case depends on the neighbours or has several characters.
_CONTEXT = ("\u03a3", "\u0130")


@functools.cache
def _letters() -> dict[int, int]:
    """Byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(hidden)}


def _byte_letters(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_letters())


class WordEncoder:
    """The same ids, for tokenizers that lower-case, drop white space and split by a pattern.

    Texts are normalized, words between blanks split by the tokenizer file's own pattern,
    and the pieces given to the library's model, once for each distinct word.  Texts with
    special tokens or letters of ``_CONTEXT`` go to the library whole.
    """

    def __init__(self, path: str, config: dict) -> None:
        import regex
        from tokenizers import Tokenizer, models

        self.whole = TextEncoder(path)
        model = config["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        # words come once each, so the model's own memory would only cost time
        self.pieces = Tokenizer(
            models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0)
        )
        self.pattern = regex.compile(config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.odd = (*_CONTEXT, *[t["content"] for t in config["added_tokens"]])
        self._forget()

    def _forget(self) -> None:
        # a word that is asked for the first time gets the next number; what it holds is learnt after the asking
        self.known: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.learnt = self.used = self.letters = 0
        self.flat = np.zeros(1 << 20, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _unlearnt(self, since: int) -> list[str]:
        """Words from number ``since`` on, in the order of their numbers."""
        return list(itertools.islice(reversed(self.known), len(self.known) - since))[::-1]

    def _learn(self) -> None:
        """Ids of all words that have a number but no ids yet."""
        first = self.learnt
        new = self._unlearnt(first)
        # a word with one stop or comma is put together from its parts
        heads = [w[:-1] if w.endswith((",", ".")) else "" for w in new]
        tailed = [k for k, head in enumerate(heads) if head.isalpha()]
        if tailed:
            parts = np.empty((len(tailed), 2), np.int64)
            parts[:, 0] = self._numbers([heads[k] for k in tailed])
            parts[:, 1] = self._numbers([new[k][-1] for k in tailed])
            new += self._unlearnt(first + len(new))
        plain = np.ones(len(new), bool)
        plain[tailed] = False
        words = list(itertools.compress(new, plain))
        split = [[w] if w.isalpha() else self.pattern.findall(w) for w in words]
        pieces = [p if p.isascii() and p.isprintable() else _byte_letters(p) for p in itertools.chain.from_iterable(split)]
        found = [np.zeros(0, np.uint32)]
        sizes = [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            encoding = self.pieces.encode(some, is_pretokenized=True, add_special_tokens=False)
            found.append(np.array(encoding.ids, np.uint32))
            sizes.append(np.bincount(np.array(encoding.word_ids, np.int64), minlength=len(some)))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        ends = ends[np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
        self.learnt = len(self.known)
        self._add(first + np.flatnonzero(plain), np.concatenate(found), np.diff(ends, prepend=0))
        if tailed:
            ids, sizes = self._gather(parts.ravel())
            self._add(first + np.array(tailed), ids, sizes[::2] + sizes[1::2])
        self.letters += sum(map(len, new))

    def _add(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.learnt > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.used += len(ids)

    def _gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of learnt words by number, one after the other, and how many each has."""
        begin, length = self.starts[words], self.lengths[words]
        place = np.repeat(begin - np.cumsum(length) + length, length)
        place += np.arange(len(place))
        return self.flat[place], length

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > _WORDS or self.letters > _LETTERS:
            self._forget()
        odd = [any(c in t for c in self.odd) for t in texts]
        # the library's splitter never joins text across blanks
        split = [
            [] if o else (t if t.isascii() else unicodedata.normalize("NFC", t)).lower().replace("\n", " ").split(" ")
            for t, o in zip(texts, odd, strict=True)
        ]
        words = self._numbers(list(itertools.chain.from_iterable(split)))
        if len(self.known) > self.learnt:
            self._learn()
        ids, length = self._gather(words)
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum([0, *map(len, split)])]
        return [
            self.whole([text])[0] if o else ids[ends[k] : ends[k + 1]] for k, (text, o) in enumerate(zip(texts, odd, strict=True))
        ]


@functools.cache
def encoder(path: str) -> TextEncoder | WordEncoder:
    """One per worker process and tokenizer file, so that words stay known between tasks."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    model = config["model"]
    steps = tuple(
        [s.get("type") for s in (config.get(part) or {}).get(name, [])]
        for part, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))
    )
    plain = model.get("type", "BPE") == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
    )
    return WordEncoder(path, config) if plain and steps == _BY_WORDS else TextEncoder(path)


def write_blocks(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Write the ids of all documents, in ascending order of ``id_col``, to the block table ``path``.

    ``end_id`` follows each document.  NULL texts are empty.  NULL ids come first; rows that
    share an id are in the order of a hash of their texts.  ``tokenizer_path`` must be readable on every
    executor.  An empty table gives a table without blocks.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # rows equal in id and text may be very many; the number of a row tells them apart, and their order does not matter
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.xxhash64(F.monotonically_increasing_id())})
    ordered = rows.repartitionByRange(parts, "id", "tie", "row").sortWithinPartitions("id", "tie", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        encode_all, width = encoder(tokenizer_path), bits_for(Tokenizer.from_file(tokenizer_path).get_vocab_size())
        part, block, first = TaskContext.get().partitionId(), 0, 0
        ids, ends, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, first, ids, ends, held, size
            values = [[part], [block], [first], [size], [width], [ids], [ends], [pack(np.concatenate(held), width)]]
            block, first = block + 1, first + size
            ids, ends, held, size = [], [], [], 0
            return pa.RecordBatch.from_pydict(dict(zip(_ARROW.names, values, strict=True)), schema=_ARROW)

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc, found in zip(some.column(0).to_pylist(), encode_all(some.column(1).to_pylist()), strict=True):
                    if ids and size + len(found) + 1 > block_tokens:
                        yield close()
                    held += [found, end]
                    size += len(found) + 1
                    ids.append(doc)
                    ends.append(size)
        if ids:
            yield close()

    packed = ordered.mapInArrow(encode, SCHEMA)
    packed.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("first_token", pa.int64()),
        ("n_tokens", pa.int64()),
        ("width", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_ends", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, part_start``: the ids in all parts before; reads the index columns, one row per part meets in a task."""
    sizes = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document, unpacked from the block table.

    ``start`` is the number of ids of all documents before it.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, width, ids, ends, payload = (
                    batch.column(n)[row].as_py() for n in ("part", "first_token", "width", "doc_ids", "doc_ends", "payload")
                )
                tokens = unpack(payload, width, 0, ends[-1]).astype("<u4")
                begins = [0, *ends[:-1]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part] * len(ids), pa.int32()),
                        "id": pa.array(ids, pa.int64()),
                        "offset": pa.array([first + b for b in begins], pa.int64()),
                        "n_tokens": pa.array([e - b for b, e in zip(begins, ends, strict=True)], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(tokens[b:e].tobytes()) for b, e in zip(begins, ends, strict=True)], pa.int64()),
                    }
                )

    found = blocks.mapInArrow(documents, "part int, id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    # a row per part file
    starts = F.broadcast(part_starts(spark, path).withColumnRenamed("part", "_part"))
    return found.join(starts, F.col("part") == F.col("_part")).select(
        "id", (F.col("part_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_range(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """``start, ids``: the ids of the corpus from number ``start`` on, one row per block that holds some of them.

    Only blocks that overlap the range are unpacked, and of those only the part inside.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path).join(F.broadcast(part_starts(spark, path)), "part")
    at = F.col("part_start") + F.col("first_token")
    hit = blocks.select(at.alias("at"), "n_tokens", "width", "payload").where(
        (F.col("at") < start + count) & (F.col("at") + F.col("n_tokens") > start)
    )

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at, n, width, payload = (batch.column(k)[row].as_py() for k in ("at", "n_tokens", "width", "payload"))
                low, high = max(start, at), min(start + count, at + n)
                ids = unpack(payload, width, low - at, high - low)
                yield pa.RecordBatch.from_pydict({"start": pa.array([low], pa.int64()), "ids": pa.array([ids.tolist()], pa.list_(pa.int64()))})

    return hit.mapInArrow(some, "start bigint, ids array<bigint>")


def block_path(spark: SparkSession) -> str:
    """A new folder for a block table in the shared work folder."""
    return new_path(spark, "token-blocks")
