"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all it learns from. The share of positives
in the web text is estimated first; a small network then minimises the non-negative
unbiased risk.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetscope.llm.common import agreed_labels, crc_remainder, per_batch, sampled_ids, schema_with, whole_row

FOLDS, HELD_OUT = 5, 0
#: At most so many trusted positives, and so many unlabelled texts, are learned from.
SAMPLE = 20_000
THRESHOLD = 0.3
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 1500, 2048, 0.01, 1e-4
_MARKS = (b"A-Z", b"0-9", b".,;:", b"!", b"?", b"|", b"#$%&*@^~+=<>{}[]\\_/", b"\"'()-", b"\n", b" \t")


def _groups() -> list[np.ndarray]:
    spans = {b"A-Z": range(65, 91), b"0-9": range(48, 58)}
    return [np.array(list(spans.get(m, m))) for m in _MARKS]


_GROUPS = _groups()
WIDTH = len(_GROUPS) + 11


def text_features(text: str | None) -> list[float]:
    """Shares of kinds of bytes, and how long, varied and repetitive words and lines are."""
    data = (text or "").encode()
    n = max(len(data), 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.lower().split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen = Counter(words)
    w, m = max(len(words), 1), max(len(lines), 1)
    top = seen.most_common(3)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    return [
        *(float(counts[g].sum()) / n for g in _GROUPS),
        float(counts[128:].sum()) / n,
        float(letters) / n,
        np.log1p(len(words)),
        np.log1p(sum(map(len, words)) / w),
        len(seen) / w,
        np.log1p(len(seen)) - 0.7 * np.log1p(len(words)),
        (top[0][1] if top else 0) / w,
        sum(c for _, c in top) / w,
        sum(map(bytes.__eq__, words[1:], words[:-1])) / w,
        len(set(lines)) / m,
        np.log1p(len(words) / m),
    ]


@dataclass
class QualityModel:
    """A standardised network of one hidden layer, and the class prior it was fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Estimated probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(_forward(self.layers, (x - self.mean) / self.scale)[1], -30, 30)))


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden, hidden @ layers[2] + layers[3]


def _back(layers: list[np.ndarray], x: np.ndarray, hidden: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    inner = d[:, None] * layers[2] * (1 - hidden**2)
    return [x.T @ inner, inner.sum(0), hidden.T @ d, np.array(d.sum())]


def _fit(layers: list[np.ndarray], slope, steps: int, seed: int) -> list[np.ndarray]:
    """Adam; ``slope(layers, rng)`` gives the gradient of one mini-batch."""
    rng = np.random.default_rng(seed)
    first, second = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers]
    for t in range(1, steps + 1):
        grads = slope(layers, rng)
        for i, g in enumerate(grads):
            g = g + DECAY * layers[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            step = RATE * (1 - t / (steps + 1)) * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
            layers[i] = layers[i] - step
    return layers


def _start(width: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> float:
    """Share of positives among the unlabelled.

    For any region A the unlabelled hold at least prior x P(A) of their mass there, so
    the least ratio of the two masses bounds the prior. The regions are those that a
    positive-against-unlabelled classifier ranks highest, with a fifth of the positives
    or more.
    """

    def slope(layers, rng):
        grads = None
        for x, y in ((positive, 1.0), (unlabelled, 0.0)):
            own = x[rng.integers(0, len(x), min(BATCH, len(x)))]
            hidden, z = _forward(layers, own)
            back = _back(layers, own, hidden, (_sigmoid(z) - y) / len(own))
            grads = back if grads is None else [a + b for a, b in zip(grads, back)]
        return grads

    layers = _fit(_start(positive.shape[1], seed), slope, STEPS // 3, seed)
    p, u = _forward(layers, positive)[1], _forward(layers, unlabelled)[1]
    cuts = np.quantile(p, np.linspace(0.02, 0.8, 40))
    return float(np.clip(min((u >= c).mean() / max((p >= c).mean(), 1e-9) for c in cuts), 0.05, 0.95))


def fit_model(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 11) -> QualityModel:
    """Minimise prior R+(P) + max(0, R-(U) - prior R-(P)) under the logistic loss.

    Where the second term turns negative its gradient is reversed, which undoes the
    overfit.
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    prior = estimate_prior(p, u)

    def slope(layers, rng):
        a, b = p[rng.integers(0, len(p), min(BATCH, len(p)))], u[rng.integers(0, len(u), min(BATCH, len(u)))]
        (ha, za), (hb, zb) = _forward(layers, a), _forward(layers, b)
        negative = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
        on_u, on_p = _sigmoid(zb) / len(b), -prior * _sigmoid(za) / len(a)
        pull = prior * (_sigmoid(za) - 1) / len(a)
        if negative < 0:
            on_u, on_p, pull = -on_u, -on_p, 0 * pull
        return [x + y for x, y in zip(_back(layers, a, ha, pull + on_p), _back(layers, b, hb, on_u))]

    return QualityModel(mean, scale, _fit(_start(p.shape[1], seed), slope, STEPS, seed), prior)


def _features(docs: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` rows of features, in an order of their own."""

    def measure(batch: pa.RecordBatch) -> dict[str, list]:
        return {"x": [text_features(t) for t in batch.column(0).to_pylist()]}

    rows = per_batch(docs.select("text"), measure, "x array<double>").orderBy("x").limit(n).collect()
    return np.array([r["x"] for r in rows], float).reshape(-1, WIDTH)


def train_quality(docs: DataFrame, labels: DataFrame, name: str = "quality", sample: int = SAMPLE) -> QualityModel | None:
    """Fit on rows outside the held-out fold; ``None`` where there is no positive or no text.

    Positives are labelled 1. Unlabelled texts are any documents, whatever their label.
    Of each, at most ``sample`` are drawn by a seeded hash of the id.
    """
    taught = crc_remainder(F.col("doc_id"), FOLDS) != HELD_OUT
    trusted = sampled_ids(agreed_labels(labels, name).filter("label = 1").filter(taught), sample, "trusted")
    web = sampled_ids(docs.filter(taught), sample, "web")
    positive, unlabelled = (_features(docs.join(F.broadcast(ids), "doc_id", "left_semi"), sample) for ids in (trusted, web))
    return fit_model(positive, unlabelled) if len(positive) and len(unlabelled) else None


def score_quality(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (all columns), ``score`` and ``predicted`` for every document.

    Null texts count as empty and are scored like any other. Without a model every score
    is 0.5. Equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(whole_row(docs).alias("row"))

    def apply(batch: pa.RecordBatch) -> dict[str, list]:
        texts = batch.column(0).field("text").to_pylist()
        scores = np.full(len(texts), 0.5)
        if shared.value is not None and texts:
            scores = shared.value.score(np.array([text_features(t) for t in texts], float))
        return {"row": batch.column(0), "score": scores.tolist(), "predicted": (scores >= threshold).astype(int).tolist()}

    schema = schema_with(rows, "score double, predicted int")
    return per_batch(rows, apply, schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: fold, score and prediction."""
    scored = score_quality(docs.select("doc_id", "text"), train_quality(docs, labels))
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), (crc_remainder(doc_id, FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
