"""Language identification by prediction by partial matching.

For each language, byte contexts of up to ``order`` bytes hold counts of the bytes that
follow.  A byte seen after its context costs -log2(count / (all + kinds)); otherwise an escape
of -log2(kinds / (all + kinds)) is paid and the next shorter context asked, down to equal
chances for all 256 bytes.  Statistics are frozen after training, so the code length of a
byte depends on the bytes before it only and whole texts are scored by table look-ups.
The language with the shortest code wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidewatch.llm.common import materialize, small

_LETTER = regex.compile(r"\p{L}")
#: Bytes scored at a time; a text's pieces overlap by the context.
_PIECE = 1 << 19


@dataclass(frozen=True)
class Settings:
    #: at most so many training texts of each language are used
    texts: int = 1_500
    #: of each, whole; a longer context needs more memory
    order: int = 3
    seed: int = 3


@dataclass(frozen=True)
class Model:
    """Costs in bits.  Bytes never seen in training share one symbol."""

    langs: tuple[str, ...]
    symbol: np.ndarray  # byte to symbol
    symbols: int
    order: int
    node: list[np.ndarray]  # by length: context number to row of ``cost``, -1 if never seen
    cost: list[np.ndarray]  # by length: (row, symbol, language)


def _contexts(symbols: np.ndarray, length: int, base: int) -> np.ndarray:
    """For each place from ``length`` on, the number of the ``length`` symbols before it."""
    n = len(symbols) - length
    code = np.zeros(max(n, 0), dtype=np.int64)
    for k in range(length):
        code = code * base + symbols[k : k + n]
    return code


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    """From each language's grams of ``order + 1`` bytes (big-endian numbers) and their counts.

    Counts of shorter contexts are sums over the longer ones, so each text starts with
    ``order`` zero bytes.
    """
    langs = tuple(sorted(counts))
    seen = np.zeros(256, dtype=bool)
    seen[0] = True
    ordered = [counts[name] for name in langs]
    for grams, _ in ordered:
        seen[(grams & 255).astype(np.int64)] = True
    symbol = np.full(256, seen.sum(), dtype=np.int64)
    symbol[seen] = np.arange(seen.sum())
    base = int(seen.sum()) + 1
    nodes, costs = [], []
    for length in range(order + 1):
        parts = []
        for grams, n in ordered:
            context = np.zeros(len(grams), dtype=np.int64)
            for k in range(length, 0, -1):
                context = context * base + symbol[((grams >> (8 * k)) & 255).astype(np.int64)]
            parts.append((context, symbol[(grams & 255).astype(np.int64)], n))
        rows = np.unique(np.concatenate([c for c, _, _ in parts])) if parts else np.zeros(0, np.int64)
        node = np.full(base**length, -1, dtype=np.int32)
        node[rows] = np.arange(len(rows))
        cost = np.empty((len(rows), base, len(langs)), dtype=np.float32)
        for j, (context, s, n) in enumerate(parts):
            table = np.zeros((len(rows), base))
            np.add.at(table, (node[context], s), n)
            total, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
            below = 8.0 if not length else costs[-1][nodes[-1][rows % base ** (length - 1)], :, j]
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = -np.log2(table / (total + kinds))
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            cost[:, :, j] = np.where(table > 0, hit, escape + below)
        nodes.append(node)
        costs.append(cost)
    return Model(langs, symbol, base, order, nodes, costs)


def code_lengths(model: Model, text: bytes) -> np.ndarray:
    """Bits of the whole text under each language."""
    bits = np.zeros(len(model.langs))
    raw = np.frombuffer(b"\0" * model.order + text, dtype=np.uint8)
    for at in range(0, len(text), _PIECE):
        bits += _bits(model, raw[at : at + _PIECE + model.order]).sum(axis=0, dtype=np.float64)
    return bits


def _bits(model: Model, raw: np.ndarray) -> np.ndarray:
    """(byte, language) costs of all bytes but the first ``order``, from the longest known context."""
    symbols = model.symbol[raw]
    following = symbols[model.order :]
    out = np.empty((len(following), len(model.langs)), dtype=np.float32)
    open_ = np.arange(len(following))
    for length in range(model.order, -1, -1):
        context = _contexts(symbols[model.order - length :], length, model.symbols)
        row = model.node[length][context[open_]]
        known = row >= 0
        out[open_[known]] = model.cost[length][row[known], following[open_[known]]]
        open_ = open_[~known]
        if not len(open_):
            break
    return out


def train(rated: DataFrame, cfg: Settings | None = None) -> Model:
    """Fit on ``id, text, lang``; a hash of id and text chooses at most ``cfg.texts`` whole texts of each language.

    NULL ids, texts and languages are not used.  Grams are counted and summed on the
    executors; the driver gets the distinct ones of the sample.
    """
    cfg = cfg or Settings()
    known = rated.select("id", "text", "lang").where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    counts = known.groupBy("lang").count().select("lang", (F.lit(1.6 * cfg.texts + 100) / F.col("count")).alias("share"))
    h = F.xxhash64("id", "text", F.lit(cfg.seed))
    # languages are counted before they are broadcast; a share of 1 and more takes all
    drawn = known.join(small(materialize(counts, "languages")), "lang").withColumn("h", h)
    below = F.shiftrightunsigned("h", 1) < (F.least("share", F.lit(1.0)) * F.lit(float(1 << 63))).cast("bigint")
    drawn = drawn.where(below | (F.col("share") >= 1)).dropDuplicates(["id", "h"])
    # a language has about 1.6 times the bound here, so its group is small
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h", "id")
    chosen = drawn.withColumn("k", F.row_number().over(first)).where(F.col("k") <= cfg.texts)
    width = cfg.order + 1

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                raw = np.frombuffer(b"\0" * cfg.order + text.as_py().encode(), np.uint8).astype(np.int64)
                if len(raw) < width:
                    continue
                grams, n = np.unique(_contexts(np.append(raw, 0), width, 256), return_counts=True)
                mine = total.setdefault(lang.as_py(), {})
                for g, c in zip(grams.tolist(), n.tolist(), strict=True):
                    mine[g] = mine.get(g, 0) + c
        for lang, mine in total.items():
            yield pa.record_batch(
                [pa.array([lang] * len(mine)), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())],
                names=["lang", "gram", "n"],
            )

    grams = chosen.select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint")
    found = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").toArrow()
    lang = np.array(found.column("lang").to_pylist(), dtype=object)
    gram, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    return fit({name: (gram[lang == name], n[lang == name]) for name in sorted(set(lang))}, cfg.order)


def predict(text: Column, model: Model) -> Column:
    """``struct<lang, score>`` of a whole text.

    ``score`` is the share of the best language when each has the probability 2^-bits; ties
    go to the first language by code point.  NULL, and texts without a letter, are ``und`` with
    score 0; so is everything if the model knows no language.
    """
    shared = text_broadcast(model)

    @arrow_udf("struct<lang:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        model = shared.value
        langs, scores = [], []
        for group in _groups(texts):
            wanted = [t is not None and _LETTER.search(t) is not None and bool(model.langs) for t in group]
            for bits in _lengths(model, [t.encode() if w else b"" for t, w in zip(group, wanted, strict=True)]):
                best = int(np.argmin(bits)) if len(bits) else 0
                scores.append(float(1.0 / np.exp2(bits[best] - bits).sum()) if len(bits) else 0.0)
                langs.append(model.langs[best] if len(bits) else "und")
            for k, w in enumerate(wanted, len(langs) - len(group)):
                if not w:
                    langs[k], scores[k] = "und", 0.0
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return of(text)


def text_broadcast(model: Model):
    """Tables are sent once to each executor; their size is set by the sample, not by the data."""
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(model)


def _groups(texts: pa.Array):
    """Whole texts, some at a time, up to about a piece."""
    group, size = [], 0
    for t in texts:
        value = t.as_py()
        group.append(value)
        size += len(value or "")
        if size >= _PIECE // 4:
            yield group
            group, size = [], 0
    if group:
        yield group


def _lengths(model: Model, texts: list[bytes]):
    """Code lengths of several texts; short ones are scored together."""
    if sum(map(len, texts)) > _PIECE:
        for t in texts:
            yield code_lengths(model, t)
        return
    pad = b"\0" * model.order
    raw = np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8)
    if not len(raw):
        yield from (np.zeros(len(model.langs)) for _ in texts)
        return
    bits = _bits(model, raw).astype(np.float64)
    run = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(bits, axis=0)])
    # ``bits`` starts after the first text's padding; every later padding is left out
    ends = np.cumsum([len(t) + model.order for t in texts]) - model.order
    for end, t in zip(ends, texts, strict=True):
        yield run[end] - run[end - len(t)]
