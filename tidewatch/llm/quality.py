"""Quality by ordinal cumulative-link regression on graded ratings.

One latent value is a weighted sum of hashed features of a text; ordered thresholds cut it
into grades: P(grade >= k) = sigmoid(value - threshold k).  All grades share the weights.
Distances between thresholds are kept positive by an exponential, so the tail
probabilities are in order.  The model is fitted in numpy on a bounded sample.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidewatch.llm.common import few_each, lowest


@dataclass(frozen=True)
class Settings:
    #: at most so many ratings, or twice as many texts of them, are used for training
    texts: int = 12_000
    features: int = 1 << 17
    rounds: int = 25
    batch: int = 256
    rate: float = 0.05
    ridge: float = 1e-5
    seed: int = 5


@dataclass(frozen=True)
class Model:
    grades: tuple[int, ...]
    weights: np.ndarray
    thresholds: np.ndarray


_SHAPE = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c > 127 else ord("0") if 48 <= c <= 57 else c
    for c in range(256)
)
#: how words end, in cut points of the share of repeated neighbours and of distinct words
_STEPS = np.linspace(0.05, 0.95, 10)


def features(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word shapes and repetition of a whole text, with weights of unit length."""
    words = (text or "").encode().split()
    if not words:
        return np.array([zlib.crc32(b"empty") % size]), np.ones(1)
    crc, n = zlib.crc32, len(words)
    names: dict[bytes, int] = {}
    for w in words:
        names[w] = names.get(w, 0) + 1
    kinds: dict[bytes, int] = {}
    for w, c in names.items():
        shape = b"s:" + w[:1].translate(_SHAPE) + w[-3:].translate(_SHAPE)
        kinds[shape] = kinds.get(shape, 0) + c
    keys = [b"w:" + w.lower() for w in names] + list(kinds)
    counts = np.array([*names.values(), *kinds.values()], dtype=np.float64)
    value = np.sqrt(counts / n)
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    extra = [b"r:%d" % k for k in np.flatnonzero(same >= _STEPS)] + [
        b"d:%d" % k for k in np.flatnonzero(len(names) / n >= _STEPS)
    ]
    ids = np.fromiter((crc(k) % size for k in [*keys, *extra]), dtype=np.int64, count=len(keys) + len(extra))
    return ids, np.concatenate([value, np.full(len(extra), 0.5)])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], ratings: list[int], cfg: Settings) -> Model:
    """Maximum likelihood by Adam; grades are the distinct ratings in order."""
    grades = tuple(sorted(set(ratings)))
    if len(grades) < 2:
        return Model(grades or (0,), np.zeros(cfg.features), np.zeros(0))
    level = np.searchsorted(grades, ratings)
    k = len(grades) - 1
    share = np.array([(level >= j).mean() for j in range(1, k + 1)])
    start = -np.log(share / (1 - share))
    used = np.unique(np.concatenate([i for i, _ in rows]))
    lengths = np.array([len(i) for i, _ in rows])
    at = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.searchsorted(used, np.concatenate([i for i, _ in rows]))
    value = np.concatenate([v for _, v in rows])
    w = np.zeros(len(used))
    # first threshold, then logarithms of the distances
    cut = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(cut), np.zeros_like(cut)]
    rng, step = np.random.default_rng(cfg.seed), 0
    for _ in range(cfg.rounds):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), cfg.batch):
            chosen = order[s : s + cfg.batch]
            ln = lengths[chosen]
            row = np.repeat(np.arange(len(chosen)), ln)
            pos = np.repeat(at[chosen], ln) + np.arange(ln.sum()) - np.repeat(np.cumsum(ln) - ln, ln)
            f, x = flat[pos], value[pos]
            z = np.bincount(row, w[f] * x, len(chosen))
            theta = cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))])
            y = level[chosen]
            edge = np.concatenate([[-np.inf], theta, [np.inf]])
            # P(grade = y) = sigmoid(z - edge[y]) - sigmoid(z - edge[y + 1])
            up, down = _edge(z - edge[y]), _edge(z - edge[y + 1])
            p = np.maximum(up - down, 1e-9)
            du, dd = up * (1 - up) / p, down * (1 - down) / p
            gz = -(du - dd) / len(chosen)
            gt = np.bincount(y[y > 0] - 1, du[y > 0], k) - np.bincount(y[y < k], dd[y < k], k)
            gt = gt / len(chosen)
            later = np.cumsum(gt[::-1])[::-1]
            gc = np.concatenate([later[:1], later[1:] * np.exp(cut[1:])])
            gw = np.bincount(f, gz[row] * x, len(w)) + cfg.ridge * w
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for j, (g, target) in enumerate(((gw, w), (gc, cut))):
                state[2 * j] = 0.9 * state[2 * j] + 0.1 * g
                state[2 * j + 1] = 0.999 * state[2 * j + 1] + 0.001 * g * g
                target -= cfg.rate * fix * state[2 * j] / (np.sqrt(state[2 * j + 1]) + 1e-8)
    weights = np.zeros(cfg.features)
    weights[used] = w
    return Model(grades, weights, cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))]))


def _edge(x: np.ndarray) -> np.ndarray:
    return np.where(np.isposinf(x), 1.0, np.where(np.isneginf(x), 0.0, _sigmoid(np.nan_to_num(x, posinf=60, neginf=-60))))


def learn(docs: DataFrame, ratings: DataFrame, cfg: Settings | None = None) -> Model:
    """Fit on the texts of ``docs`` (``id, text``) that ``ratings`` (``id, grade``) has grades of.

    Rated ids are chosen first, by a hash of id and grade; only their texts are read on, at most
    eight different ones for an id and grade.  NULL ids and grades are never used.
    """
    cfg = cfg or Settings()
    known = ratings.select("id", "grade").where("grade IS NOT NULL AND id IS NOT NULL")
    here = known.join(docs.select("id").distinct(), "id", "left_semi")
    # the bound of the sample keeps this broadcast small
    asked = F.broadcast(lowest(here, cfg.texts, cfg.seed))
    rated = docs.select("id", "text").join(asked, "id")
    return _fit_rows(few_each(rated, ["id", "grade"], 2 * cfg.texts, cfg.seed), cfg)


def train(rated: DataFrame, cfg: Settings | None = None) -> Model:
    """Fit on ``id, text, grade``; a hash of all three chooses at most ``cfg.texts`` distinct rows, NULL grades never."""
    cfg = cfg or Settings()
    known = rated.select("id", "text", "grade").where("grade IS NOT NULL AND id IS NOT NULL")
    return _fit_rows(lowest(known, cfg.texts, cfg.seed), cfg)


def _fit_rows(chosen: DataFrame, cfg: Settings) -> Model:
    """Texts become features on the executors; only those of the bounded sample reach the driver."""

    @arrow_udf("struct<i:binary,v:binary>")
    def made(texts: pa.Array) -> pa.Array:
        pairs = [features(t.as_py(), cfg.features) for t in texts]
        return pa.StructArray.from_arrays(
            [
                pa.array([i.astype("<u4").tobytes() for i, _ in pairs], pa.binary()),
                pa.array([v.astype("<f4").tobytes() for _, v in pairs], pa.binary()),
            ],
            names=["i", "v"],
        )

    rows = chosen.select("id", "grade", made("text").alias("f")).collect()
    rows.sort(key=lambda r: (r["id"], r["grade"], r["f"]["i"]))
    parsed = [
        (np.frombuffer(r["f"]["i"], "<u4"), np.frombuffer(r["f"]["v"], "<f4"))
        for r in rows
    ]
    return fit(parsed, [r["grade"] for r in rows], cfg)


def grade(text: Column, model: Model) -> Column:
    """``struct<expected: double, tails: array<double>>`` of a whole text.

    ``tails[k]`` is the probability of the grade after the k-th lowest, or a better one;
    ``expected`` the mean grade.  NULL and empty texts have the feature of an empty text.
    """
    grades, weights, cuts = np.array(model.grades, np.float64), model.weights.astype(np.float32), model.thresholds

    @arrow_udf("struct<expected:double,tails:array<double>>")
    def of(texts: pa.Array) -> pa.Array:
        z = np.empty(len(texts))
        for k, t in enumerate(texts):
            ids, values = features(t.as_py(), len(weights))
            z[k] = weights[ids] @ values
        tails = _sigmoid(z[:, None] - cuts[None, :])
        expected = grades[0] + tails @ np.diff(grades)
        starts = np.arange(len(z) + 1, dtype=np.int32) * len(cuts)
        lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(tails.ravel()))
        return pa.StructArray.from_arrays([pa.array(expected), lists], names=["expected", "tails"])

    return of(text)
