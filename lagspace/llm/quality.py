"""Quality classifier: positive-unlabelled learning.

Trusted positives (rows whose quality label is 1) and unlabelled web text are
all that the model learns from. The share of positives among the unlabelled (the
class prior) is estimated as the least ratio, over the level sets of a scorer of
positives against unlabelled rows, of the unlabelled to the positive share in
the set. A small network then minimises the non-negative unbiased risk

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])

and a logistic curve, fitted by the unbiased log loss on the same rows, turns its
output into a probability.

The inputs are shares and lengths that the text alone gives: letter case, marks,
digits, repeated words and lines. Both samples are bounded (``SAMPLE`` rows each,
those with the lowest hashes of their ids), so what the driver holds is a fixed
number of short vectors. Scoring is one pass over the documents with no shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 12_000
HIDDEN = 24
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7

_KINDS = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "bar": b"|",
    "odd": b"#$%&*@^~=+_",
    "bracket": b"<>{}[]()/\\",
    "quote": b"\"'`",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}


def features(text: bytes) -> list[float]:
    """What the classifier sees of a text. An empty text gives zeros throughout."""
    n = len(text)
    seen = [(n - len(text.translate(None, chars))) / max(1, n) for chars in _KINDS.values()]
    words = text.split()
    k = len(words)
    counts = Counter(words)
    top = counts.most_common(5)
    lines = text.split(b"\n")
    return [
        *np.sqrt(seen).tolist(),
        len(counts) / max(1, k) ** 0.9,
        (top[0][1] if top else 0) / max(1, k),
        sum(c for _, c in top) / max(1, k),
        sum(map(eq, words, words[1:])) / max(1, k),
        sum(c == 1 for c in counts.values()) / max(1, len(counts)),
        n / max(1, k) / 10,
        (len(max(counts, key=len)) if counts else 0) ** 0.5 / 10,
        np.log1p(k) / 5,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 5,
        sum(w[-1:] in b".?!" for w in counts) / max(1, len(counts)),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    curve: tuple[float, float]
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return forward(self.layers, np.clip((x - self.mean) / self.scale, -6, 6))[1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return sigmoid(a * self.raw(np.asarray(x, dtype=np.float64).reshape(-1, len(self.mean))) + b)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, b, v, c, u = layers
    h = np.tanh(x @ w + b)
    return h, h @ v + x @ u + c[0]


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = 40, batch: int = 512, seed: int = 7) -> list[np.ndarray]:
    """A network by Adam. prior None: plain discrimination of the two samples; else the non-negative risk with sigmoid loss."""
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    layers = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1), np.zeros(d)]
    m1, m2, t = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers], 0
    steps = max(1, max(len(positive), len(unlabelled)) // batch)
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for _ in range(steps):
            p = positive[rng.integers(0, len(positive), batch)]
            u = unlabelled[rng.integers(0, len(unlabelled), batch)]
            x = np.vstack([p, u])
            h, g = forward(layers, x)
            s = sigmoid(g)
            if prior is None:
                y = np.r_[np.ones(batch), np.zeros(batch)]
                dg = (s - y) / batch
            else:
                slope = s * (1 - s)  # sigmoid loss: loss(g) = sigmoid(-g)
                rest = s[batch:].mean() - prior * s[:batch].mean()
                if rest >= 0:
                    dg = np.r_[-2 * prior * slope[:batch], slope[batch:]] / batch
                else:  # the estimate of a risk is below zero: step back from it
                    dg = np.r_[prior * slope[:batch], -slope[batch:]] / batch
            dh = np.outer(dg, layers[2]) * (1 - h * h)
            grads = [x.T @ dh, dh.sum(0), h.T @ dg, np.array([dg.sum()]), x.T @ dg]
            t += 1
            for k, grad in enumerate(grads):
                grad = grad + 1e-4 * layers[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                layers[k] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return layers


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of unlabelled to positive share over the sets of scores above a level, with a margin for sampling."""
    best = 1.0
    p, u = np.sort(positive), np.sort(unlabelled)
    for level in np.quantile(p, np.linspace(0, 0.9, 91)):
        a = 1 - np.searchsorted(u, level) / len(u)
        b = 1 - np.searchsorted(p, level) / len(p)
        margin = np.sqrt(0.25 / len(u)) + np.sqrt(0.25 / len(p))
        best = min(best, (a + margin * (a * (1 - a)) ** 0.5 * 0.5) / max(b - margin * (b * (1 - b)) ** 0.5 * 0.5, 1e-9))
    return float(np.clip(best, 0.02, 0.98))


def curve(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve by gradient steps on the unbiased log loss."""
    a, b = 1.0, 0.0
    for k in range(400):
        sp, su = sigmoid(a * positive + b), sigmoid(a * unlabelled + b)
        # d/dg of prior*E_P[log loss(+)-log loss(-)] + E_U[log loss(-)]
        ga = -prior * positive.mean() + (su * unlabelled).mean() + 1e-3 * (a - 1)
        gb = -prior + su.mean()
        ha = (su * (1 - su) * unlabelled**2).mean() + 1e-2
        hb = (su * (1 - su)).mean() + 1e-2
        a, b = float(np.clip(a - 0.5 * ga / ha, 0.1, 12)), float(np.clip(b - 0.5 * gb / hb, -20, 20))
    return a, b


def _features(batches):
    for b in batches:
        f = [[float(v) for v in features(t)] for t in common.as_bytes(b.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), b.column(1)], names=["features", "trusted"])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on both samples. Without a positive row that may be learned from there is no model (None).

    A null id or label is no label; where rows of labels disagree about a
    document, it isn't a trusted positive.
    """
    allowed = F.pmod(common.crc_of_id("doc_id"), F.lit(FOLDS)) != HELD_OUT
    own = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").where(allowed)
    trusted = own.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", F.lit(1).alias("trusted"))
    texts = common.pick(docs, "doc_id", "text")
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").where(allowed)
    free = ids.orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(SAMPLE).select("doc_id", F.lit(0).alias("trusted"))
    few = trusted.unionByName(free)
    # Ids may repeat: the driver gets no more rows than the samples have ids.
    rows = texts.join(F.broadcast(few), "doc_id").select("text", "trusted").mapInArrow(_features, "features array<double>, trusted int").orderBy(F.xxhash64("features"), "trusted", "features").limit(2 * SAMPLE).collect()
    p = np.array([r.features for r in rows if r.trusted], dtype=np.float64)
    u = np.array([r.features for r in rows if not r.trusted], dtype=np.float64)
    if not len(p) or not len(u):
        return None
    order = np.lexsort(p.T), np.lexsort(u.T)  # the same model, however the rows arrive
    p, u = p[order[0]], u[order[1]]
    both = np.vstack([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = np.clip((p - mean) / scale, -6, 6), np.clip((u - mean) / scale, -6, 6)
    first = train(p[::2], u[::2], None, epochs=20)
    prior = class_prior(forward(first, p[1::2])[1], forward(first, u[1::2])[1]) if min(len(p), len(u)) > 20 else 0.5
    layers = train(p, u, prior)
    return Model(mean, scale, layers, curve(forward(layers, p)[1], forward(layers, u)[1], prior), prior)


def _probabilities(model: Model | None, column) -> np.ndarray:
    """Scores of a column of texts; 0.5 without a model."""
    texts = common.as_bytes(column)
    return np.full(len(texts), 0.5) if model is None or not texts else model.probability(np.array([features(t) for t in texts], dtype=np.float64))


def _scores(model, threshold):
    def run(batches):
        for b in batches:
            s = _probabilities(model.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return run


def _kept(model, threshold):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_probabilities(model.value, b.column(b.schema.get_field_index("text"))) >= threshold, pa.bool_()))

    return run


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row. A null text is empty; without a model every score is 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return common.pick(docs, "doc_id", "text").mapInArrow(common.lean(_scores(shared, threshold)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that a model fitted on them takes for good, with all their columns, whatever these are called.

    A null text is judged as the empty one, repeated rows are judged alike, and an
    empty table stays empty. Without a positive row to learn from, all stay.
    """
    model = fit(docs, labels)
    return docs if model is None else docs.mapInArrow(common.lean(_kept(docs.sparkSession.sparkContext.broadcast(model), threshold)), docs.schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Repeated rows stay repeated; a null doc_id stays null and isn't held out."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(F.pmod(common.crc_of_id("doc_id"), F.lit(FOLDS)) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
