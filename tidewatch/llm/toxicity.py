"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts and a sample of unlabelled ones, never a negative
label.  With class prior p the risk is p R+ + max(0, Ru- - p Rp-), where R+ is the loss of
the positives as toxic, Rp- their loss as clean and Ru- the loss of the unlabelled as
clean.  When the corrected part turns negative on a batch, its gradient is reversed, which
stops the model from fitting the unlabelled texts as clean.  The classifier is linear over
those hashed words whose shares of the positive and the unlabelled texts clearly differ.
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

_STRIP = b".,;:!?\"'()[]{}<>*&%$#@-_/\\|~`^+="


@dataclass(frozen=True)
class Settings:
    #: at most about so many texts of each kind are used for training
    positives: int = 5_000
    unlabelled: int = 15_000
    #: a word must occur in so many training texts, and its shares of the positive and of the
    #: unlabelled ones must differ by this log-likelihood ratio
    min_texts: int = 4
    evidence: float = 20.0
    rounds: int = 1_000
    #: unlabelled texts of a step; positives are dealt out to as many steps
    batch: int = 16_384
    rate: float = 0.03
    #: the corrected part of the risk may be so far below zero, for noise in prior and sample
    tolerance: float = 0.0
    #: strength of the pull of all weights to zero
    ridge: float = 0.0
    seed: int = 11


@dataclass(frozen=True)
class Model:
    #: by word hash; words without a weight count nothing
    weights: dict[int, float]
    bias: float


def word_ids(text: str | None) -> set[int]:
    """32-bit hashes of the distinct words of a whole text, without outer punctuation or case."""
    words = {w.strip(_STRIP) for w in (text or "").lower().encode().split()}
    words.discard(b"")
    return set(map(zlib.crc32, words))


def _rows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(i) for i in ids], dtype=np.int64)
    return np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([[0], np.cumsum(lengths)])


def _pick(flat: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and row numbers of the chosen texts."""
    lengths = starts[chosen + 1] - starts[chosen]
    row = np.repeat(np.arange(len(chosen)), lengths)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return flat[np.repeat(starts[chosen], lengths) + within], row


def _evidence(k: np.ndarray, n: int, j: np.ndarray, m: int) -> np.ndarray:
    """Log-likelihood ratio of k of n texts and j of m texts against one common share."""

    def part(hits, all_):
        share = np.clip(hits / all_, 1e-12, 1 - 1e-12)
        return lambda p: hits * np.log(share / p) + (all_ - hits) * np.log((1 - share) / (1 - p))

    common = np.clip((k + j) / (n + m), 1e-12, 1 - 1e-12)
    return 2 * (part(k, n)(common) + part(j, m)(common))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, cfg: Settings) -> Model:
    """Train on arrays of word hashes; without positives or unlabelled texts every score is low."""
    if not positive or not unlabelled:
        return Model({}, -10.0)
    prior = float(np.clip(prior, 1e-4, 0.9))
    words, in_p, in_u = _texts_with(positive, unlabelled)
    telling = words[
        (in_p + in_u >= cfg.min_texts) & (_evidence(in_p, len(positive), in_u, len(unlabelled)) >= cfg.evidence)
    ]
    p_flat, p_at = _rows([_number(t, telling) for t in positive])
    u_flat, u_at = _rows([_number(t, telling) for t in unlabelled])
    weights, bias = _descend(p_flat, p_at, u_flat, u_at, len(telling), prior, cfg)
    return Model(dict(zip(telling.tolist(), weights.tolist(), strict=True)), bias)


def _texts_with(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, and how many texts of either kind have them; one sorted copy at a time."""
    p_words, p_counts = np.unique(np.concatenate(positive), return_counts=True)
    u_words, u_counts = np.unique(np.concatenate(unlabelled), return_counts=True)
    words = np.union1d(p_words, u_words)
    in_p, in_u = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    in_p[np.searchsorted(words, p_words)] = p_counts
    in_u[np.searchsorted(words, u_words)] = u_counts
    return words, in_p, in_u


def _number(text: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Places in the sorted ``telling`` of those words of a text that are there."""
    return np.flatnonzero(np.isin(telling, text))


def _descend(p_flat, p_at, u_flat, u_at, n, prior, cfg) -> tuple[np.ndarray, float]:
    """Adam steps on the non-negative risk."""
    rng = np.random.default_rng(cfg.seed)
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v, mb, vb, step = np.zeros(n), np.zeros(n), 0.0, 0.0, 0
    p_n, u_n = len(p_at) - 1, len(u_at) - 1
    per_round = max(1, -(-u_n // cfg.batch))
    for _ in range(cfg.rounds):
        p_order, u_order = rng.permutation(p_n), rng.permutation(u_n)
        for k in range(per_round):
            pos = p_order[k::per_round] if p_n >= per_round else p_order
            pf, pr = _pick(p_flat, p_at, pos)
            uf, ur = _pick(u_flat, u_at, u_order[k::per_round])
            p_size, u_size = len(pos), len(u_order[k::per_round])
            zp = np.bincount(pr, w[pf], p_size) + b
            zu = np.bincount(ur, w[uf], u_size) + b
            # the loss is the sigmoid of the wrong side; slopes are those of a text as toxic
            sp, su = _sigmoid(zp), _sigmoid(zu)
            gp, gu = prior * sp * (1 - sp) / p_size, su * (1 - su) / u_size
            if su.mean() - prior * sp.mean() >= -cfg.tolerance:
                gp, gu = -2 * gp, gu
            else:
                gu = -gu
            g = np.bincount(pf, gp[pr], n) + np.bincount(uf, gu[ur], n) + cfg.ridge * w
            gb = gp.sum() + gu.sum()
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            w = w - cfg.rate * fix * m / (np.sqrt(v) + 1e-8)
            b -= cfg.rate * fix * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def _ids(texts: DataFrame) -> list[np.ndarray]:
    """Feature ids of a bounded frame ``id, text``; made on the executors, and only they reach the driver."""

    @arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([np.array(sorted(word_ids(t.as_py())), "<u4").tobytes() for t in texts], pa.binary())

    rows = texts.select("id", ids("text").alias("f")).collect()
    rows.sort(key=lambda r: (r["id"], r["f"]))
    return [np.frombuffer(r["f"], "<u4") for r in rows]


def score(text: Column, model: Model) -> Column:
    """The probability that a whole text is toxic; NULL and empty texts get that of no words."""
    weights, bias = model.weights, model.bias

    @arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts))
        for k, t in enumerate(texts):
            out[k] = bias + sum(sorted(weights[w] for w in word_ids(t.as_py()) if w in weights))
        return pa.array(_sigmoid(out))

    return of(text)


def prior_of(labels: DataFrame, toxic_col: str = "toxic") -> float:
    """The share of toxic rows among the labelled ones."""
    row = labels.agg(F.avg((F.col(toxic_col) == 1).cast("double")).alias("p")).first()
    return float(row["p"] or 0.0)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_col: str = "toxic",
    cfg: Settings | None = None,
) -> Model:
    """A model from the learnable rows: their toxic labels, and all their texts as unlabelled.

    Of the labels only toxic ones choose texts; all give the prior.  Rows equal in id and text
    are used once; NULL ids and texts are not used.  Samples do not depend on row order, and
    an id has no more than its share of them, or eight positive texts.
    """
    cfg = cfg or Settings()
    open_ = docs.where(learnable & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    open_ = open_.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(toxic_col).alias("toxic")).where("toxic IS NOT NULL")
    asked = known.join(open_.select("id").distinct(), "id", "left_semi")
    toxic = lowest(asked.where("toxic = 1").select("id").distinct(), cfg.positives, cfg.seed)
    # the bound above keeps this broadcast small
    positive = few_each(open_.join(F.broadcast(toxic), "id", "left_semi"), ["id"], 2 * cfg.positives, cfg.seed)
    return fit(_ids(positive), _ids(lowest(open_, cfg.unlabelled, cfg.seed)), prior_of(asked), cfg)
