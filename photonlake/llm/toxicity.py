"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased words and their first four and five bytes (for inflected words), hashed, and for each of
these that a text has twice or more, a term that says so. Each term that
the training rows show to go with a class has a weight and a short latent vector; the score is a logistic link
of the sum of weights plus the sum over pairs of present terms of the products of their vectors, so that two
terms together (an insult and a mention of a group) can say what neither says alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TRAIN_BYTES, arrow_map, flat_utf8, mix64, sampled, span_hashes

#: Buckets of hashed terms; terms that the machine keeps; length of a latent vector.
BUCKETS = 1 << 20
KEPT_TERMS = 256
RANK = 8
#: Labelled rows that the model is fitted on at most, chosen by a hash of their id. It bounds what the driver holds.
MAX_TRAIN_ROWS = 8000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of letters (and of bytes beyond ASCII); no run goes past the end of a text."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _LETTER[data]
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = at[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[_LETTER[data[cuts]] & _LETTER[data[cuts - 1]]]
    if len(cuts):
        begin, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))
    return begin, end


def term_buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every term of texts laid end to end."""
    data = _LOWER[data]
    begin, end = word_spans(data, at)
    owner = np.searchsorted(at, begin, side="right") - 1
    found = [span_hashes(data, begin, end, 1)]
    for k, n in ((2, 4), (3, 5)):
        found.append(span_hashes(data, begin, np.minimum(end, begin + n), k))
    return np.tile(owner, 3), (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64)


#: The bucket of "twice or more" of each bucket.
_TWICE = (mix64(np.arange(1, BUCKETS + 1, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
_LOW = np.int64((1 << 32) - 1)


def distinct(owner: np.ndarray, bucket: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, term) pairs, in order; terms are buckets or, with ``place``, the kept terms they map to."""
    single, twice = bucket, _TWICE[bucket]
    if place is not None:
        single, twice = place[bucket], place[twice]
    key, again = owner[single >= 0] * np.int64(1 << 32) + single[single >= 0], np.zeros(0, np.int64)
    on = twice >= 0
    if on.any():
        again, where, count = np.unique(owner[on] * np.int64(1 << 32) + bucket[on], return_index=True, return_counts=True)
        again = ((again >> np.int64(32)) * np.int64(1 << 32) + twice[on][where])[count > 1]
    key = np.unique(np.concatenate([key, again]))
    return key >> np.int64(32), key & _LOW


@dataclass
class Machine:
    """Bias, weights and latent vectors of the kept terms; ``place`` maps a bucket to its kept term or -1."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, n: int, owner: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Of n texts, from the (text, kept term) pairs of their distinct terms."""
        linear = np.bincount(owner, self.weights[term], n)
        pairs = np.zeros(n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[term, f]
            pairs += np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n)
        return self.bias + linear + pairs / 2


def present(place: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, kept term) pairs."""
    return distinct(*term_buckets(data, at), place)


def choose_terms(rows: list[np.ndarray], y: np.ndarray, kept: int = KEPT_TERMS, least: int = 3) -> np.ndarray:
    """The buckets whose presence tells most of the label, by the signed root of their log-likelihood ratio."""
    n1, n0 = max(1, int((y > 0).sum())), max(1, int((y <= 0).sum()))
    one, zero = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x, label in zip(rows, y, strict=True):
        (one if label > 0 else zero)[x] += 1
    total = one + zero
    base = n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(one > 0, one * np.log(one / (total * base)), 0) + np.where(zero > 0, zero * np.log(zero / (total * (1 - base))), 0)
    gain[total < least] = 0
    gain = np.nan_to_num(gain)
    best = np.argsort(-gain, kind="stable")[:kept]
    # 10.83: the 0.001 point of chi-squared with one degree of freedom; below it a term says nothing.
    return np.sort(best[2 * gain[best] > 10.83])


def fit(rows: list[np.ndarray], y: np.ndarray, rank: int = RANK, steps: int = 250, rate: float = 0.05, decay: float = 1e-5, weight: float | None = None, seed: int = 11, kept: int = KEPT_TERMS) -> Machine:
    """Fit by some ``steps`` minibatch steps with Adam on the logistic loss; a toxic row counts ``weight`` times (the classes' ratio).

    The number of steps doesn't follow that of rows: the bias drifts down with every step past the point where texts
    without a telling term are settled, and takes those with a single one along.
    """
    y = np.asarray(y, float)
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    chosen = choose_terms(rows, y, kept) if len(y) else np.zeros(0, int)
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    k = len(chosen)
    start = float(np.log((n1 + 1) / (n0 + 1)))
    weight = weight or max(1.0, n0 / max(n1, 1.0))
    if not k or not n1 or not n0:
        return Machine(place, start, np.zeros(k), np.zeros((k, rank)))
    x = np.zeros((len(rows), k), np.float32)
    for i, r in enumerate(rows):
        t = place[r]
        x[i, t[t >= 0]] = 1
    rng = np.random.default_rng(seed)
    theta = [np.array([start], np.float32), np.zeros(k, np.float32), rng.normal(0, 0.02, (k, rank)).astype(np.float32)]
    first, second = ([np.zeros_like(t) for t in theta] for _ in range(2))
    step = 0
    for _ in range(max(1, round(steps * 256 / len(rows)))):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 256):
            xb, yb = x[order[a : a + 256]], y[order[a : a + 256]]
            sums = xb @ theta[2]
            z = theta[0][0] + xb @ theta[1] + 0.5 * ((sums**2).sum(1) - xb @ (theta[2] ** 2).sum(1))
            g = (np.where(yb > 0, weight, 1.0) * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yb) / len(yb)).astype(np.float32)
            gx = xb.T @ g
            grads = [np.array([g.sum()], np.float32), gx + decay * theta[1], xb.T @ (g[:, None] * sums) - gx[:, None] * theta[2] + decay * theta[2]]
            step += 1
            for t, d, m, v in zip(theta, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                t -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return Machine(place, float(theta[0][0]), theta[1].astype(float), theta[2].astype(float))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = TRAIN_BYTES, kept: int = KEPT_TERMS) -> Machine:
    """Fit on at most ``max_rows`` labelled documents, those whose id has the least hash, while they have ``max_bytes`` of text.

    ``docs``: doc_id, text; ``labels``: doc_id and the label. Rows with a null id or label are left out; of
    repeated label rows the greatest label of an id counts, and of texts that repeat an id that with the least hash.
    Without both classes every score is the share of the label (one half if there is no row). ``kept`` terms at most
    have a weight; on a split of the training rows, 64 to 4096 find as many toxic texts, and over 256 mark some others.
    """
    chosen = sampled(docs, labels, label, max_rows, max_bytes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = flat_utf8(batch.column(0))
        owner, term = distinct(*term_buckets(data, at))
        ends = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
        x = pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32)))
        return pa.RecordBatch.from_arrays([x, batch.column(1)], names=["x", "y"])

    found = arrow_map(chosen.select("text", "y"), run, "x array<int>, y int", "text").toArrow()
    rows = [np.asarray(x.values, np.int64) for x in found.column("x")]
    y = np.array(found.column("y").to_pylist(), int)
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tobytes(), y[i]))  # no matter how rows arrive
    return fit([rows[i] for i in order], y[order], kept=kept)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """``docs`` (doc_id, text) with ``score`` and ``predicted``.

    A null or empty text has no terms and gets the score of the bias; a null id stays null; repeated rows stay
    repeated; an empty table gives an empty result; other columns are kept out. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.place, machine.bias, machine.weights, machine.vectors))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = Machine(*shared.value)
        owner, term = present(m.place, *flat_utf8(batch.column(1)))
        s = 1 / (1 + np.exp(-np.clip(m.logits(batch.num_rows, owner, term), -40, 40)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {id_type}, score double, predicted int", "text")
