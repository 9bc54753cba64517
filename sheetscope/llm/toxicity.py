"""Toxicity by a subsequence string kernel and a support vector machine.

Two strings are alike as far as they share subsequences of three letters, gaps counting
less the longer they are; an insult keeps most of them when letters are put between its
own or when it takes an ending. The kernel of two sentences sums that of their distinct tokens.
Landmark strings span it (Nyström), and the machine is linear over them. A document's score
takes its most toxic sentence, and a second machine over what all sentences sum up to:
words that many clean documents hold once and toxic ones again and again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sheetscope.llm.common import agreed_labels, crc_remainder, lowered, per_batch, sampled_ids, schema_with, whole_row
from sheetscope.session import cut_lineage

FOLDS, HELD_OUT = 3, 1
#: At most so many documents of each label are learned from.
SAMPLE = 4000
LANDMARKS = 64
#: Landmarks have so many bytes.
STEM = (4, 10)
THRESHOLD = 0.7
#: Price of one skipped letter; widest match; least likeness that counts; its power.
GAP, SPAN, FLOOR, POWER = 0.8, 9, 0.35, 1.5
#: Folds by which document margins are calibrated.
CROSS = 5
#: A landmark is no more like another than this, before the power.
NEAR = 0.75
#: Longer tokens are read in overlapping pieces of this many bytes.
PIECE = 16
#: Tokens whose triples are laid out at once; a long one has hundreds.
AT_ONCE = 256
#: A worker remembers so many tokens' weights at most; those not met for long are forgotten.
REMEMBERED = 200_000
#: A worker takes texts apart for about so many characters at once; one text is never cut.
PART = 1 << 18

_DIGITS = bytes.maketrans(b"0134578", b"oieastb")
_DROPPED = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SENTENCE = re.compile(rb"[.!?]+\s+|\n+")
_SPACED = re.compile(rb"(?<!\S)[a-z0-9](?:\s[a-z0-9]){2,}(?!\S)")
_CODE = np.array([0 if c < 97 else c - 96 if c < 123 else 27 if c < 128 else 28 + c % 4 for c in range(256)], np.int64)


def _tokens(data: bytes) -> list[bytes]:
    """Tokens of lower-cased bytes: marks dropped, look-alike digits read as letters,
    letters set apart by spaces joined, long tokens cut into overlapping pieces."""
    if _SPACED.search(data):
        data = _SPACED.sub(lambda m: re.sub(rb"\s", b"", m[0]), data)
    out = data.translate(_DIGITS, _DROPPED).split()
    if out and max(map(len, out)) > PIECE:
        out = [t[i : i + PIECE] for t in out for i in range(0, max(1, len(t) - PIECE // 2), PIECE // 2 if len(t) > PIECE else PIECE)]
    return out


def sentences_of(text: str | None) -> list[list[bytes]]:
    """The tokens of each sentence."""
    return [t for s in _SENTENCE.split(lowered(text)) if (t := _tokens(s))]


def _subsequences(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all triples in a string of this length, and their weights."""
    places = [c for c in combinations(range(length), 3) if c[2] - c[0] < SPAN]
    at = np.array(places, np.int64).reshape(-1, 3)
    return at, GAP ** (at[:, 2] - at[:, 0] - 2.0).astype(np.float32) if len(at) else np.zeros(0, np.float32)


_TRIPLES = [_subsequences(n) for n in range(PIECE + 1)]


def _triples(tokens: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    codes = _CODE[np.frombuffer(b"".join(tokens), np.uint8).reshape(-1, length)]
    at, weight = _TRIPLES[length]
    return (codes[:, at[:, 0]] << 10) | (codes[:, at[:, 1]] << 5) | codes[:, at[:, 2]], weight


def _norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of each token with itself."""
    order = np.argsort(codes, 1, kind="stable")
    sorted_codes = np.take_along_axis(codes, order, 1)
    sums = np.cumsum(weight[order], 1, dtype=np.float64)
    last = np.ones(codes.shape, bool)
    last[:, :-1] = sorted_codes[:, 1:] != sorted_codes[:, :-1]
    out = np.empty(len(codes))
    for i in range(len(codes)):
        ends = sums[i][last[i]]
        out[i] = np.sqrt(np.square(np.diff(ends, prepend=0.0)).sum())
    return out


class Kernel:
    """The kernel of tokens with fixed landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        found: dict[int, np.ndarray] = {}
        for j, z in enumerate(landmarks):
            codes, weight = _triples([z], len(z))
            scaled = weight / _norms(codes, weight)[0]
            for c, w in zip(codes[0].tolist(), scaled.tolist()):
                found.setdefault(c, np.zeros(len(landmarks), np.float32))[j] += w
        self.place = np.zeros(1 << 15, np.int32)
        self.rows = np.zeros((len(found) + 1, len(landmarks)), np.float32)
        for i, (c, row) in enumerate(found.items(), 1):
            self.place[c], self.rows[i] = i, row

    def __call__(self, tokens: list[bytes]) -> dict[bytes, np.ndarray]:
        """Sharpened likeness to each landmark, of the tokens that have any."""
        by_length: dict[int, list[bytes]] = {}
        for t in tokens:
            if 3 <= len(t) <= PIECE:
                by_length.setdefault(len(t), []).append(t)
        out: dict[bytes, np.ndarray] = {}
        for length, own in by_length.items():
            for i in range(0, len(own), AT_ONCE):
                out.update(self._some(own[i : i + AT_ONCE], length))
        return out

    def _some(self, tokens: list[bytes], length: int) -> dict[bytes, np.ndarray]:
        codes, weight = _triples(tokens, length)
        places = self.place[codes]
        row, column = np.nonzero(places)
        if not len(row):
            return {}
        shared = self.rows[places[row, column]] * weight[column, None]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        own = row[first]
        shared = np.add.reduceat(shared, first)
        # A token's norm is at least that of unrepeated triples, which only its length sets.
        near = shared.max(1) >= FLOOR * np.sqrt(np.square(weight).sum())
        own, shared = own[near], shared[near]
        like = shared / _norms(codes[own], weight)[:, None]
        like = np.where(like >= FLOOR, like, 0) ** POWER
        return {tokens[i]: x for i, x in zip(own.tolist(), like) if x.any()}


@dataclass
class ToxicityModel:
    """Landmarks, each one's weight in a sentence's margin and in a document's, and the calibration of both."""

    landmarks: list[bytes]
    weights: np.ndarray
    bias: float
    document_weights: np.ndarray
    calibrations: list[np.ndarray]
    _memory: dict = field(default_factory=dict)
    _older: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_memory": {}, "_older": {}, "_kernel": None}

    def _likeness_of(self, tokens: set[bytes]) -> dict[bytes, np.ndarray | None]:
        """Likeness of each token to the landmarks; those like none are remembered as None."""
        memory, older = self._memory, self._older
        new = [t for t in tokens if t not in memory]
        memory.update((t, older[t]) for t in new if t in older)
        new = [t for t in new if t not in older]
        if new:
            if getattr(self, "_kernel", None) is None:
                self._kernel = Kernel(self.landmarks)
            memory.update(dict.fromkeys(new))
            memory.update((t, x.copy()) for t, x in self._kernel(new).items())
        return memory

    def _forget(self) -> None:
        if len(self._memory) > REMEMBERED // 2:
            self._memory, self._older = {}, self._memory

    def score(self, texts: list[str | None]) -> list[float]:
        """Probability of label 1, from the most toxic sentence of each text and from what all of them add up to."""
        alone, counts, sums = [], [], np.zeros((len(texts), len(self.landmarks)))
        for part in _parts(texts):
            split = [sentences_of(t) for t in part]
            memory = self._likeness_of({t for sentences in split for s in sentences for t in s})
            for sentences in split:
                own = [v for s in sentences if (v := [memory[t] for t in sorted(set(s)) if memory[t] is not None])]
                x = np.array([np.sum(v, 0) for v in own]).reshape(-1, len(self.landmarks))
                sums[len(alone)] = x.sum(0)
                alone.append(sentence_evidence(x @ self.weights, self.bias, len(sentences)))
                counts.append(len(sentences))
            self._forget()
        whole = document_rows(sums, np.array(counts)) @ self.document_weights
        found = np.max([x @ t for x, t in zip(_views(np.array(alone).reshape(-1, 4), whole), self.calibrations)], 0)
        return (1 / (1 + np.exp(-np.clip(found, -30, 30)))).tolist()


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in runs of at most ``PART`` characters or of one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or "") > PART:
            yield texts[start:i]
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield texts[start:]


def _labelled_parts(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str | None]]]:
    """Labels and texts of a batch of both, a part at a time."""
    labels, texts = (c.to_pylist() for c in batch.columns)
    at = 0
    for part in _parts(texts):
        yield labels[at : at + len(part)], part
        at += len(part)


def sentence_evidence(margins: np.ndarray, bias: float, sentences: int) -> list[float]:
    """A document's highest sentence margin, the sum of what its sentences add to the bias, and their number."""
    return [bias + max(margins.max(initial=0.0), 0.0), float(np.log1p(np.maximum(margins, 0).sum())), float(np.log1p(sentences)), 1.0]


def _views(alone: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
    """What is calibrated, each for itself: the highest sentence margin, all of ``alone``, and
    the highest margin with the document's."""
    ones = np.ones(len(alone))
    return [np.column_stack([alone[:, 0], ones]), alone, np.column_stack([alone[:, 0], whole, ones])]


def document_rows(sums: np.ndarray, sentences: np.ndarray) -> np.ndarray:
    """A document's likeness to each landmark, summed over its sentences and damped, and its
    number of sentences: long documents add up more by chance."""
    return np.column_stack([np.log1p(sums), np.log1p(sentences), np.ones(len(sums))])


def _tokens_of_all(text: str | None) -> set[bytes]:
    return {t for s in sentences_of(text) for t in s}


def _stems_of_all(text: str | None) -> set[bytes]:
    """The heads of a text's tokens, from which landmarks are chosen: insults take endings."""
    return {t[:n] for t in _tokens_of_all(text) for n in range(STEM[0], min(len(t), STEM[1]) + 1)}


def choose_landmarks(counts: list[tuple[bytes, int, int]], n: int, ratio: float, toxic_documents: list[list[bytes]]) -> list[bytes]:
    """Up to ``n`` tokens that tell toxic from clean documents best, none much like another.

    ``counts`` holds token, toxic documents and clean documents that have it; ``ratio``,
    toxic to clean documents in all, turns the latter into what as many clean documents
    as toxic ones would have. ``toxic_documents`` are lists of such tokens: a document counts
    half as much with each landmark it has, so that landmarks spread over languages.
    """
    counts = sorted((token, toxic, clean * ratio) for token, toxic, clean in counts if toxic > 3 * clean * ratio)
    place = {c[0]: i for i, c in enumerate(counts)}
    worth = np.array([(toxic - 3 * clean) / np.sqrt(toxic + clean + 1) / toxic for _, toxic, clean in counts])
    own = [np.array([place[t] for t in held if t in place], np.int64) for held in toxic_documents]
    document, held = np.repeat(np.arange(len(own)), [len(o) for o in own]), np.concatenate([np.zeros(0, np.int64), *own])
    left, chosen, open_ = np.ones(len(own)), [], np.ones(len(counts), bool)
    while len(chosen) < n and open_.any():
        gain = worth * np.bincount(held, left[document], len(counts))
        for i in np.argsort(-np.where(open_, gain, -1.0), kind="stable").tolist():
            if not open_[i]:
                return chosen
            open_[i] = False
            token = counts[i][0]
            if not (chosen and token in (near := Kernel(chosen)([token])) and near[token].max() > NEAR**POWER):
                chosen.append(token)
                left[document[held == i]] /= 2
                break
    return chosen


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Squared-hinge machine in the primal, by Newton steps over the violating rows.

    The normal equations are summed over blocks of rows, so that no copy of ``x`` is made.
    """
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] *= 1e-3  # the bias
    for _ in range(50):
        left, right = penalty.copy(), np.zeros(len(w))
        for i in range(0, len(x), AT_ONCE * 16):
            part = x[i : i + AT_ONCE * 16].astype(np.float64)
            signs, costs = y[i : i + len(part)], cost[i : i + len(part)]
            active = signs * (part @ w) < 1
            scaled = part[active].T * costs[active]
            left += scaled @ part[active]
            right += scaled @ signs[active]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _calibrated(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression of the label on a document's evidence, lightly damped."""
    t = np.zeros(x.shape[1])
    ridge = np.append(np.full(x.shape[1] - 1, 1e-4), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        t = t + np.linalg.solve(h, x.T @ (weight * (label - p)) - ridge * t)
    return t


def train_toxicity(docs: DataFrame, labels: DataFrame, name: str = "toxic", sample: int = SAMPLE) -> ToxicityModel | None:
    """Fit on rows outside the held-out fold; ``None`` unless both labels occur.

    At most ``sample`` documents of each label are drawn by a seeded hash of the id. A
    sentence carries its document's label at first; sentences of toxic documents that
    the machine finds clean are then taken for clean, and it is fitted again.
    """
    taught = agreed_labels(labels, name).filter(crc_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    shares = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    if len(shares) < 2:
        return None
    ids = [sampled_ids(taught.filter(F.col("label") == v), sample, "toxicity").withColumn("label", F.lit(v)) for v in (0, 1)]
    learned = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1])), "doc_id").select("label", "text"))

    # Documents of each label that were drawn: the samples are of unlike sizes.
    drawn = {r["label"]: r["count"] for r in learned.groupBy("label").count().collect()}
    if len(drawn) < 2:
        return None
    ratio = drawn[1] / drawn[0]

    def tokens(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        for labels_, texts in _labelled_parts(batch):
            pairs = [(t, y) for y, text in zip(labels_, texts) for t in _stems_of_all(text)]
            yield {"token": [t for t, _ in pairs], "label": [y for _, y in pairs]}

    counted = (
        per_batch(learned, tokens, "token binary, label int")
        .groupBy("token")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
        .withColumn("even", F.col("clean") * ratio)
        .filter("toxic >= 2 and toxic > 3 * even")
        .orderBy("token")
    )
    # Stems of the drawn toxic documents alone, so no more than these bring.
    counts = [(bytes(r["token"]), r["toxic"], r["clean"]) for r in counted.collect()]
    candidates = docs.sparkSession.sparkContext.broadcast({c[0]: i for i, c in enumerate(counts)})

    def candidates_of(batch: pa.RecordBatch) -> dict[str, list]:
        numbers = [sorted(candidates.value[t] for t in _stems_of_all(text) if t in candidates.value) for text in batch.column(0).to_pylist()]
        return {"numbers": [np.array(n, np.int32).tobytes() for n in numbers]}

    # What grows with the sample comes a partition at a time: whole, the driver's heap would hold it twice.
    held = per_batch(learned.filter("label = 1").select("text"), candidates_of, "numbers binary").orderBy("numbers").toLocalIterator()
    toxic_documents = [[counts[i][0] for i in np.frombuffer(r["numbers"], np.int32)] for r in held]
    landmarks = choose_landmarks(counts, LANDMARKS, ratio, toxic_documents)
    if not landmarks:
        return None

    shared = docs.sparkSession.sparkContext.broadcast(landmarks)

    def sentences(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        kernel, like, met = Kernel(shared.value), {}, set()
        for labels_, texts in _labelled_parts(batch):
            split = [sentences_of(t) for t in texts]
            new = {t for d in split for s in d for t in s} - met
            met |= new
            like |= kernel(list(new))
            vectors = []
            for d in split:
                own = [np.sum([like[t] for t in sorted(set(s)) if t in like], 0) for s in d if any(t in like for t in s)]
                vectors.append(np.array(own, np.float32).tobytes())
            yield {"label": labels_, "n": [len(d) for d in split], "x": vectors}

    rows = per_batch(learned, sentences, "label int, n int, x binary").orderBy("label", "n", "x")
    return _fit_documents(landmarks, rows.toLocalIterator(), shares)


def _fit_documents(landmarks: list[bytes], rows: Iterable[Row], shares: dict[int, int]) -> ToxicityModel:
    """Fit on ``label``, number of sentences ``n`` and the like sentences' vectors ``x`` of each document.

    ``rows`` are read once; of the vectors only the machine's rows stay, in single precision.
    """
    m = len(landmarks)
    kernel = Kernel(landmarks)
    gram = np.stack([kernel([z]).get(z, np.zeros(m)) for z in landmarks])
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T

    labels, counts, lengths, sums, held = [], [], [], [], bytearray()
    for row in rows:
        own_vectors = np.frombuffer(row["x"], np.float32).reshape(-1, m)
        labels.append(row["label"])
        counts.append(row["n"])
        lengths.append(len(own_vectors))
        sums.append(own_vectors.sum(0, dtype=np.float64))
        held += np.column_stack([own_vectors @ root, np.ones(len(own_vectors))]).astype(np.float32).tobytes()
    held += np.append(np.zeros(m), 1).astype(np.float32).tobytes()  # the last row: all sentences that are like no landmark
    x = np.frombuffer(held, np.float32).reshape(-1, m + 1)
    label, n, like = (np.array(c) for c in (labels, counts, lengths))
    document = np.repeat(np.arange(len(like)), like)
    own = len(document)
    y = np.append(np.where(label[document] == 1, 1.0, -1.0), -1.0)
    cost = np.append(np.ones(own), float(np.log1p((n - like).sum())))
    for _ in range(4):
        w = fit_svm(x, y, cost)
        y[:own] = np.where((label[document] == 1) & (x[:own] @ w.astype(np.float32) > 0), 1.0, -1.0)
    margins = np.split(x[:own, :-1] @ w[:-1].astype(np.float32), np.cumsum(like)[:-1])
    alone = np.array([sentence_evidence(own_margins, float(w[-1]), int(k)) for own_margins, k in zip(margins, n)])
    # Evidence that single sentences don't give: words that toxic documents hold again and again.
    whole = document_rows(np.stack(sums), n)
    sign = np.where(label == 1, 1.0, -1.0)
    apart = np.empty(len(label))
    for fold in range(CROSS):  # margins of documents that the machine has not seen
        out = np.arange(len(label)) % CROSS == fold
        apart[out] = whole[out] @ fit_svm(whole[~out], sign[~out], np.ones((~out).sum()))
    weight = np.where(label == 1, shares[1] / max((label == 1).sum(), 1), shares[0] / max((label == 0).sum(), 1))
    # A toxic document without a toxic sentence says nothing about the margin of one.
    told = [(label == 0) | (alone[:, 0] > 0), np.ones(len(label), bool), np.ones(len(label), bool)]
    views = [_calibrated(v[rows], label[rows].astype(float), weight[rows]) for v, rows in zip(_views(alone, apart), told)]
    return ToxicityModel(landmarks, root @ w[:-1], float(w[-1]), fit_svm(whole, sign, np.ones(len(label))), views)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (all columns), ``score`` and ``predicted`` for every document.

    Null texts count as empty; a text without tokens gets the score of a clean one.
    Without a model every score is 0. Equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(whole_row(docs).alias("row"))

    def apply(batch: pa.RecordBatch) -> dict[str, list]:
        texts = batch.column(0).field("text").to_pylist()
        scores = shared.value.score(texts) if shared.value is not None else [0.0] * len(texts)
        return {"row": batch.column(0), "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return per_batch(rows, apply, schema_with(rows, "score double, predicted int"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: fold, score and prediction."""
    scored = score_toxicity(docs.select("doc_id", "text"), train_toxicity(docs, labels))
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), (crc_remainder(doc_id, FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all their columns, that are not predicted toxic."""
    return score_toxicity(docs, model, threshold).filter("predicted = 0").select("row.*")
