"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which of another.

Both token sequences of a text cover the same bytes.  Offsets where tokens of both end cut
them into groups.  The walk compares the two arrays of token ends at the current index
shift: as long as the tokens are one to one, slices of exponentially growing length are
equal, and one comparison skips the whole slice.  At the first difference the irregular group is resolved
token by token, and the difference of the two indices behind it is the new shift.

Encoders work on segments: a text is cut before a blank that follows something else than
white space.  No token of either tokenizer goes over such a place (checked on the piece
vocabulary when it is loaded; without that property texts are encoded whole), so each
distinct segment is encoded once.

Defined cases: NULL and empty texts, and texts whose tokens do not spell blank + text, have
no tokens, zeros everywhere and NULL groups.  Ids may repeat or be NULL; every row is
answered for itself, and equal rows count as that many documents.  Other columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BROADCAST_ROWS, materialize

SCHEMA = (
    "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
    "pairs array<bigint>, times array<bigint>"
)
#: An id pair is one number: the first tokenizer's id in the high half.
_HALF = 32
#: Past so many remembered segments the memory starts anew.
_SEGMENTS = 600_000
#: New segments encoded in one text.
_JOINED = 256
#: Texts of about so many characters are worked on together.
_TOGETHER = 1 << 21
#: Groups with more links are counted from their distinct ids, others link by link.
_WIDE = 1 << 12
#: Links expanded at a time.
_LINKS = 1 << 20

#: Fixed value: how byte-level tokenizers split texts before merging.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_INNER_BREAK = re.compile(r"(?:^|\s) ")


def segments(text: str) -> list[str]:
    """Blank + text, cut before each blank behind something else than white space; the blank in front is left out."""
    words = text.split(" ")
    if not _INNER_BREAK.search(text):
        return words
    out = [words[0]]
    for word in words[1:]:
        last = out[-1]
        if not last or last[-1].isspace():
            out[-1] = f"{last} {word}"
        else:
            out.append(word)
    return out


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side each group and those before it have.

    Both arrays rise strictly and end alike.
    """
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b = ends_a.astype(np.int64).tobytes(), ends_b.astype(np.int64).tobytes()
    i = j = 0
    n = len(list_a)
    # one-to-one stretches, each followed by one irregular group: where both stop
    stops_a: list[int] = []
    stops_b: list[int] = []
    lengths: list[int] = []
    while i < n:
        first = i
        if list_a[i] == list_b[j]:
            # the same shift: compare slices of 2, 8, 32, ... tokens, then of halving length
            width = 2
            i, j = i + 1, j + 1
            while i + width <= n and raw_a[8 * i : 8 * (i + width)] == raw_b[8 * j : 8 * (j + width)]:
                i, j, width = i + width, j + width, 4 * width
            while width > 1:
                width //= 2
                if i + width <= n and raw_a[8 * i : 8 * (i + width)] == raw_b[8 * j : 8 * (j + width)]:
                    i, j = i + width, j + width
        stops_a.append(i)
        stops_b.append(j)
        lengths.append(i - first)
        if i == n:
            break
        # the irregular group behind it; the new shift is j - i
        x, y = list_a[i], list_b[j]
        while x != y:
            if x < y:
                i += 1
                x = list_a[i]
            else:
                j += 1
                y = list_b[j]
        i, j = i + 1, j + 1
        stops_a.append(i)
        stops_b.append(j)
        lengths.append(1)
    times = np.array(lengths, np.int64)
    back = np.repeat(times.cumsum(), times) - np.arange(times.sum()) - 1
    return np.repeat(np.array(stops_a, np.int64), times) - back, np.repeat(np.array(stops_b, np.int64), times) - back


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in visible}
    hidden = (b for b in range(256) if chr(b) not in shown)
    return shown | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level tokenizer file; special tokens inside texts are plain text."""

    def __init__(self, path: str) -> None:
        # a task has one core: the library's threads would only spin beside it
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = _byte_alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.spelled[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        kind = json.loads(self.tokenizer.to_str())
        splitter = kind.get("pre_tokenizer") or {}
        self.by_segment = (
            kind.get("normalizer") is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", False)
        )
        self.ranked = self._by_rank(kind["model"]) if self.by_segment else None

    def _by_rank(self, model: dict):
        """The file's vocabulary for a library that merges by rank, where merges make ids in their order."""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        letters = sorted(set(model["vocab"].values()) - set(made))[:256]
        if made != sorted(made) or len(set(made)) < len(made) or not made or letters[-1] >= made[0] or model.get("ignore_merges"):
            return None
        import tiktoken

        ranks = {self.spelled[i]: i for i in [*letters, *made]}
        if len(ranks) != 256 + len(made) or any(bytes([b]) not in ranks for b in range(256)):
            return None
        return tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of blank + text."""
        if self.ranked:
            return self.ranked.encode_ordinary(" " + text)
        return self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids


class Pieces:
    """A sentence-piece model, which puts the blank in front by itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelled = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.by_segment = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, text: str) -> list[int]:
        """Ids of blank + text, also of an empty one, before which the model puts none."""
        return self.model.encode(text) or [self.model.piece_to_id("▁")]


class _Ragged:
    """Number lists of different lengths, one behind the other in one array."""

    def __init__(self) -> None:
        self.data, self.ends, self.rows = np.empty(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    def extend(self, data: np.ndarray, lengths: np.ndarray) -> None:
        used = self.ends[self.rows]
        while used + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        while self.rows + len(lengths) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.empty_like(self.ends)])
        self.data[used : used + len(data)] = data
        self.ends[self.rows + 1 : self.rows + 1 + len(lengths)] = used + lengths.cumsum()
        self.rows += len(lengths)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``rows`` behind each other, and the end of each."""
        starts = self.ends[rows]
        lengths = self.ends[rows + 1] - starts
        ends = lengths.cumsum()
        return self.data[np.repeat(starts - ends + lengths, lengths) + np.arange(lengths.sum())], ends


class Aligner:
    """Aligns texts; remembers segments, whose number is bounded."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.sides = ByteLevel(path_a), Pieces(path_b)
        self.lengths = [np.array([len(s) for s in side.spelled], np.int64) for side in self.sides]
        # the ids as they are written inside a group, and at the end of its first and of its second part
        self.inner = [np.array([f"{i}," for i in range(len(side.spelled))], object) for side in self.sides]
        self.last = [
            np.array([f"{i}{end}" for i in range(len(side.spelled))], object)
            for side, end in zip(self.sides, "|;", strict=True)
        ]
        self.by_segment = all(side.by_segment for side in self.sides)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = _Ragged(), _Ragged()
        self.odd: set[str] = set()  # segments that one side does not spell

    def _learn(self, words: list[str]) -> None:
        """Encode new segments, many in one text where each may be followed by another."""
        joinable = [w for w in words if w and not w[-1].isspace()] if self.by_segment else []
        single = [w for w in words if not w or w[-1].isspace()] if self.by_segment else words
        for some in [joinable[k : k + _JOINED] for k in range(0, len(joinable), _JOINED)] + [[w] for w in single]:
            text = " ".join(some)
            whole = (" " + text).encode()
            plain = len(whole) == len(text) + 1
            cuts = np.cumsum([len(w) + 1 for w in some] if plain else [len(w.encode()) + 1 for w in some])
            found = [np.array(side.encode(text), np.int32) for side in self.sides]
            ends = [lengths[ids].cumsum() for lengths, ids in zip(self.lengths, found, strict=True)]
            same = all(
                b"".join([side.spelled[i] for i in ids.tolist()]) == whole
                for side, ids in zip(self.sides, found, strict=True)
            )
            if not same and len(some) > 1:
                for w in some:
                    self._learn([w])
                continue
            if not same:
                self.odd.update(some)
            for w in some:
                self.known[w] = len(self.known)
            for kept, ids, at in zip(self.ids, found, ends, strict=True):
                stops = np.searchsorted(at, cuts) + 1 if same else np.array([len(ids)])
                kept.extend(ids, np.diff(stops, prepend=0))

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides of each text, or None where a text has no tokens."""
        if len(self.known) > _SEGMENTS:
            self._forget()
        cut = [(segments(t) if self.by_segment else [t]) if t else [] for t in texts]
        words = [w for some in cut for w in some]
        places = list(map(self.known.get, words))
        new = [k for k, place in enumerate(places) if place is None]
        if new:
            self._learn(list(dict.fromkeys([words[k] for k in new])))
            for k in new:
                places[k] = self.known[words[k]]
        rows = np.array(places, np.int64)
        taken = [kept.take(rows) for kept in self.ids]
        stops = np.cumsum([len(some) for some in cut])
        at = [0, 0]
        for text, some, stop in zip(texts, cut, stops, strict=True):
            if not some:
                yield None
                continue
            a, b = (ids[start : ends[stop - 1]] for (ids, ends), start in zip(taken, at, strict=True))
            at = [ends[stop - 1] for _, ends in taken]
            if self.odd and not self.odd.isdisjoint(some) and not self._spells(text, a, b):
                yield None
            else:
                yield a, b

    def _spells(self, text: str, *found: np.ndarray) -> bool:
        whole = (" " + text).encode()
        return all(
            b"".join([side.spelled[i] for i in ids]) == whole for side, ids in zip(self.sides, found, strict=True)
        )

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return group_ends(self.lengths[0][a].cumsum(), self.lengths[1][b].cumsum())

    def written(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``"""
        out = np.empty(len(a) + len(b), object)
        starts_b, sizes_a, sizes_b = ends_b - np.diff(ends_b, prepend=0), np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        at_a = np.arange(len(a)) + np.repeat(starts_b, sizes_a)
        at_b = np.arange(len(b)) + np.repeat(ends_a, sizes_b)
        out[at_a] = self.inner[0][a]
        out[at_b] = self.inner[1][b]
        out[at_a[ends_a - 1]] = self.last[0][a[ends_a - 1]]
        out[at_b[ends_b - 1]] = self.last[1][b[ends_b - 1]]
        return "".join(out.tolist())[:-1]


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One a Python worker, so that its tasks share what was learned."""
    return Aligner(path_a, path_b)


def _tally(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate(codes), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, where, np.concatenate(times))
    return keys, sums


def linked(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of a text, in order, and how many links each has."""
    sizes_a, sizes_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    links = sizes_a * sizes_b
    high = a.astype(np.int64) << _HALF
    codes, times = [], []
    wide = links > _WIDE
    for g in np.flatnonzero(wide):
        ids_a, n_a = np.unique(high[ends_a[g] - sizes_a[g] : ends_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[ends_b[g] - sizes_b[g] : ends_b[g]], return_counts=True)
        codes.append((ids_a[:, None] | ids_b[None, :].astype(np.int64)).ravel())
        times.append((n_a[:, None] * n_b[None, :]).ravel())
    narrow = np.flatnonzero(~wide)
    slices = np.searchsorted(links[narrow].cumsum(), np.arange(_LINKS, links[narrow].sum() + _LINKS, _LINKS), "right")
    start = 0
    for stop in slices:
        some = narrow[start : max(stop, start + 1)]
        start = max(stop, start + 1)
        if not len(some):
            continue
        # every first-side token of these groups, repeated for each token of the group's other side
        n_a, n_b = sizes_a[some], sizes_b[some]
        tokens = np.repeat(ends_a[some] - n_a - (n_a.cumsum() - n_a), n_a) + np.arange(n_a.sum())
        partners = np.repeat(n_b, n_a)
        firsts = np.repeat(ends_b[some] - n_b, n_a) - (partners.cumsum() - partners)
        others = np.repeat(firsts, partners) + np.arange(partners.sum())
        keys, counts = np.unique(np.repeat(high[tokens], partners) | b[others], return_counts=True)
        codes.append(keys)
        times.append(counts)
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return (codes[0], times[0]) if len(codes) == 1 else _tally(codes, times)


def _batches(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size > _TOGETHER:
            yield ids[start : k + 1], texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: counts, the groups written as ``a1,a2|b1;a3|b2``, distinct id pairs and their links.

    ``path_a`` is a byte-level tokenizer file, ``path_b`` a sentence-piece model, both at the
    same place on every executor.  A pair is ``a * 2**32 + b``.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        nothing = np.empty(0, np.int64)
        for frame in frames:
            for ids, texts in _batches(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                rows: list[tuple] = []
                for found in both.tokens(texts):
                    if found is None:
                        rows.append((0, 0, 0, 0, None, nothing, nothing))
                        continue
                    a, b = found
                    ends = both.ends(a, b)
                    pairs, times = linked(a, b, *ends)
                    rows.append(
                        (len(a), len(b), len(ends[0]), int(times.sum()), both.written(a, b, *ends), pairs, times)
                    )
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        *[pa.array(c, pa.int64()) for c in columns[:4]],
                        pa.array(columns[4], pa.string()),
                        _lists(columns[5]),
                        _lists(columns[6]),
                    ],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
                )

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def pair_counts(linked_rows: DataFrame) -> DataFrame:
    """``pair, n, best``: the number of rows that hold a pair, and whether no pair of its first id has more.

    Rows already hold a pair once, so tasks add up before anything is exchanged.  The greatest
    counts have a row per first id, at most the size of a vocabulary; that side is broadcast.
    """
    counts = materialize(
        linked_rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts"
    )
    first = F.shiftright("pair", _HALF)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), first == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")
    )


def store(aligned: DataFrame) -> DataFrame:
    """Written once, with a number that tells its rows apart."""
    return materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")


def score(stored: DataFrame, limit: int = 5 * BROADCAST_ROWS) -> DataFrame:
    """Rows of :func:`store` with ``n_best`` and ``count_sum``, without the pairs.

    ``n_best`` counts the links whose pair is the most frequent one of its first id, ties
    included; ``count_sum`` adds the pair's count over all links.  The counts are broadcast if
    there are at most ``limit`` of them; otherwise pairs and counts meet in a shuffle join,
    in which adaptive execution may split a pair that most documents hold.
    """
    scores = materialize(pair_counts(stored), "pair-scores")
    side = F.broadcast(scores) if scores.count() <= limit else scores
    links = stored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(
        "row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times")
    )
    sums = (
        links.join(side, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return (
        stored.drop("pairs", "times")
        .join(sums, "row", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})
        .drop("row")
    )
