"""Quality classifier: support vectors over n-gram indicators scaled by naive Bayes log-count ratios.

Features are indicators of presence in the whole text: of hashed byte n-grams (1 to 3 bytes, case kept), and of
word n-grams that repeat one word ("a a", "a a a" and longer). With the per-class counts of each indicator, smoothed,
``r = log((p / |p|) / (q / |q|))``; a document's vector is ``r`` where the indicator is set, divided by a power of
its length, so that neither short nor long texts rule the fit. A linear model with hinge loss is fitted to these
vectors by dual coordinate descent, and a logistic link fitted on rows kept out of that fit turns margins into
scores.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TRAIN_BYTES, arrow_map, flat_utf8, sampled, slices, span_hashes, split_words

#: Buckets of hashed byte n-grams; lengths of runs of one word that are indicators; orders of the byte n-grams.
HASHED = 1 << 16
RUNS = (2, 3, 4, 6)
BUCKETS = HASHED + len(RUNS)
ORDERS = (1, 2, 3)
#: Vectors are divided by their squared length to this power (one half would be unit length).
POWER = 0.35
#: Labelled rows that the model is fitted on at most, chosen by a hash of their id. It bounds what the driver holds.
MAX_TRAIN_ROWS = 6000


def ngram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of every byte n-gram at every place of a text's bytes."""
    out, code = [], np.zeros(len(data), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(data) < order:
            break
        code = (code[: len(data) - order + 1] << np.uint32(8)) | data[order - 1 :]
        if order in ORDERS:
            mixed = (code + np.uint32(order << 24)) * np.uint32(0x9E3779B1)
            out.append((mixed ^ (mixed >> np.uint32(15))) & np.uint32(HASHED - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def repeats(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For texts laid end to end (n+1 offsets): whether a word occurs so many times running (RUNS; A-Z lower-cased), a column each."""
    out = np.zeros((len(at) - 1, len(RUNS)), bool)
    apart, begin, end, owner = split_words(data, at)
    if len(begin):
        h = span_hashes(apart, begin, end)
        fresh = np.ones(len(begin), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        run = np.arange(len(begin)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] + 1
        for k, length in enumerate(RUNS):
            out[owner[run >= length], k] = True
    return out


def indicator_rows(data: np.ndarray, at: np.ndarray):
    """The buckets that occur in each of the texts laid end to end, in order."""
    flags = np.zeros(BUCKETS, bool)
    again = repeats(data, at)
    for i in range(len(at) - 1):
        flags[:] = False
        flags[ngram_buckets(data[at[i] : at[i + 1]])] = True
        flags[HASHED:] = again[i]
        yield np.flatnonzero(flags)


@dataclass
class Model:
    """What scoring needs: log-count ratios, weights (bias last), and the slope and shift of the logistic link."""

    ratios: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def margins(self, rows) -> np.ndarray:
        w, r2 = self.weights[:-1] * self.ratios, self.ratios * self.ratios
        return np.array([w[x].sum() / max(1e-12, r2[x].sum()) ** POWER + self.weights[-1] for x in rows])

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, n_buckets: int, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(n_buckets, alpha), np.full(n_buckets, alpha)
    for x, label in zip(rows, y, strict=True):
        (p if label else q)[x] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n_buckets: int, cost: float = 1.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of an L2-regularised hinge-loss model; one dual variable in [0, cost] for each row."""
    w = np.zeros(n_buckets + 1)
    alpha = np.zeros(len(rows))
    sign = np.where(y > 0, 1.0, -1.0)
    norms = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v, s = rows[i], values[i], sign[i]
            gradient = s * (w[x] @ v + w[-1]) - 1
            step = min(max(alpha[i] - gradient / norms[i], 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w[x] += step * s * v
                w[-1] += step * s
                worst = max(worst, abs(step))
        if worst < 1e-3 * cost:
            break
    return w


def fit_link(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of a logistic link, by damped Newton steps on smoothed targets."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    if not n1 or not n0:
        return 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(margins).mean()), 1e-9)
    x = np.stack([margins / scale, np.ones(len(margins))], axis=1)
    beta = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (target - p) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-6) / scale), float(beta[1])


def fit(rows: list[np.ndarray], y: np.ndarray, n_buckets: int = BUCKETS) -> Model:
    """Fit the model to indicator rows and their 0/1 labels. With one class only, the score is its share."""
    y = np.asarray(y)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        shift = float(np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1)))
        return Model(np.zeros(n_buckets), np.zeros(n_buckets + 1), 1.0, shift)
    apart = np.arange(len(y)) % 5 == 0  # for the link
    if (y[~apart] > 0).all() or (y[~apart] <= 0).all():
        apart[:] = False
    train = [x for x, a in zip(rows, apart, strict=True) if not a]
    ratios = log_count_ratios(train, y[~apart], n_buckets)
    ends = np.cumsum([len(x) for x in train])
    flat = np.empty(int(ends[-1]))  # in one piece, which the system gets back as a whole
    values = np.split(flat, ends[:-1])
    for x, v in zip(train, values, strict=True):
        v[:] = ratios[x]
        v /= max(1e-12, (v**2).sum()) ** POWER
    w = dual_coordinate_descent(train, values, y[~apart], n_buckets)
    model = Model(ratios, w, 1.0, 0.0)
    on = apart if apart.any() else ~apart
    model.slope, model.shift = fit_link(model.margins([x for x, a in zip(rows, on, strict=True) if a]), y[on])
    return model


def listed(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column of numbers, where they lie."""
    out = []
    for chunk in column.chunks:
        values, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def short_key(row: np.ndarray) -> tuple[bytes, bytes]:
    """To sort rows by: their first buckets, then a digest of all."""
    return row[:64].astype(np.int64).tobytes(), hashlib.sha256(row.tobytes()).digest()


def _features(chosen: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [x.astype(np.int32) for x in indicator_rows(*flat_utf8(batch.column(0)))]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], names=["x", "y"])

    return arrow_map(chosen.select("text", "y"), run, "x array<int>, y int", "text")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``max_rows`` labelled documents, those whose id has the least hash, while they have ``max_bytes`` of text.

    ``docs``: doc_id, text; ``labels``: doc_id and the label. Rows with a null id or label are left out; of
    repeated label rows the greatest label of an id counts, and of texts that repeat an id that with the least hash.
    No labelled row: every score is one half.
    """
    chosen = sampled(docs, labels, label, max_rows, max_bytes)
    found = _features(chosen).toArrow()
    rows, y = listed(found.column("x")), found.column("y").to_numpy().astype(int)
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), short_key(rows[i]), y[i]))  # no matter how rows arrive
    order = [order[i] for i in np.random.default_rng(1).permutation(len(order))]
    model = fit([rows[i] for i in order], y[order])
    del rows, found
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` (doc_id, text) with ``score`` and ``predicted``.

    A null or empty text has no n-grams and gets the score of the bias; a null id stays null; repeated rows stay
    repeated; an empty table gives an empty result; other columns are kept out. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ratios, model.weights, model.slope, model.shift))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = Model(*shared.value)
        s = m.score(m.margins(indicator_rows(*flat_utf8(batch.column(1)))))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {id_type}, score double, predicted int", "text")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more. One pass, no shuffle.

    Null texts are scored as empty ones; null ids and repeated rows are rows like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ratios, model.weights, model.slope, model.shift))
    place = docs.columns.index("text")

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            for piece in slices(batch, "text"):
                good = m.score(m.margins(indicator_rows(*flat_utf8(piece.column(place))))) >= threshold
                yield piece.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
