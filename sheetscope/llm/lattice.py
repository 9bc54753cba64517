"""Language-model scores by subword lattice likelihood.

A word can be cut into the pieces of an existing vocabulary in many ways. All of them
count: a forward recursion in log space sums the probabilities of all segmentations, and
the sums of a document's words, with its end, are its marginal probability. The pieces
come from a public tokenizer file; their probabilities start from its ranks and are
re-estimated on the corpus as expected counts over the same lattices. A word that the
corpus holds is one more arc across its lattice, weighted by its own count.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetscope.llm.common import crc_remainder, in_arrow, lowered, per_batch, schema_with, whole_row
from sheetscope.session import cut_lineage

FOLDS, HELD_OUT = 7, 2
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Rounds of re-estimation.
ROUNDS = 1
#: Weight of the arc that is the whole word; the pieces share the rest.
WHOLE = 0.9
#: So many of the most frequent words are broadcast with their counts; the rest are joined.
FREQUENT = 100_000
#: Words that a task counts before it hands the counts on.
HELD = 300_000
#: Words of one length are summed together from so many on, and at most so many characters at once.
TOGETHER, CELLS = 8, 200_000
START = "▁"
LN10 = math.log(10)


@dataclass
class Pieces:
    """Pieces of a vocabulary, numbered, with their natural log probabilities.

    ``bytes_at`` is the number of the piece of byte 0; characters that are no piece are
    spelled by their bytes. ``end`` is the number of the end of a text.
    """

    number: dict[str, int]
    bytes_at: int
    end: int
    logs: list[float]
    longest: int

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all pieces in order, their numbers, and the logs with one more for none."""
        hashes = np.array([_hash_of(_codes([piece]))[0] for piece in self.number], np.uint64)
        order = np.argsort(hashes)
        return hashes[order], np.array(list(self.number.values()), np.int64)[order], np.append(self.logs, -np.inf)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def arcs(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """By end position: ``(begin, log probability, pieces)`` of every piece that ends there."""
        text = START + word
        out: list[list] = [[] for _ in range(len(text) + 1)]
        get, logs = self.number.get, self.logs
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - self.longest), end):
                p = get(text[begin:end])
                if p is not None:
                    out[end].append((begin, logs[p], (p,)))
                elif begin == end - 1:
                    spelled = tuple(self.bytes_at + b for b in text[begin].encode("utf-8", "replace"))
                    out[end].append((begin, sum(logs[x] for x in spelled), spelled))
        return out

    def log_sum(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations: the forward recursion."""
        text, alpha, get, logs, exp = START + word, [0.0], self.number.get, self.logs, math.exp
        for end in range(1, len(text) + 1):
            terms = []
            for begin in range(max(0, end - self.longest), end):
                p = get(text[begin:end])
                if p is not None:
                    terms.append(alpha[begin] + logs[p])
                elif begin == end - 1:
                    terms.append(alpha[begin] + sum(logs[self.bytes_at + b] for b in text[begin].encode("utf-8", "replace")))
            most = max(terms)
            alpha.append(most + math.log(sum([exp(t - most) for t in terms])) if len(terms) > 1 else most)
        return alpha[-1]

    @staticmethod
    def forward(arcs: list) -> list[float]:
        alpha = [0.0]
        for into in arcs[1:]:
            if len(into) == 1:
                alpha.append(alpha[into[0][0]] + into[0][1])
                continue
            terms = [alpha[b] + p for b, p, _ in into]
            most = max(terms)
            alpha.append(most + math.log(sum(math.exp(t - most) for t in terms)))
        return alpha

    def expect(self, word: str, times: float, into: np.ndarray) -> None:
        """Add the expected number of each piece in ``times`` copies of the word."""
        arcs = self.arcs(word)
        alpha = self.forward(arcs)
        beta = [-math.inf] * len(arcs)
        beta[-1] = 0.0
        for end in range(len(arcs) - 1, 0, -1):
            for begin, p, pieces in arcs[end]:
                through = beta[end] + p
                share = times * math.exp(alpha[begin] + through - alpha[-1])
                for x in pieces:
                    into[x] += share
                low, high = sorted((beta[begin], through))
                beta[begin] = high + math.log1p(math.exp(low - high)) if low > -math.inf else high


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _grown(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings that are each one character longer."""
    mixed = (hashes ^ (codes.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def _hash_of(codes: np.ndarray) -> np.ndarray:
    hashes = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        hashes = _grown(hashes, column)
    return hashes


class Lattices:
    """The lattices of words of one length, summed together, a row a word.

    Pieces are found by a 64-bit hash of the substring that begins at each character and
    grows by one; ``arc[end, size]`` numbers the piece of ``size`` characters before ``end``.
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        self.pieces = pieces
        codes = _codes([START + w for w in words])
        n, self.width = codes.shape
        hashes, numbers, self.logs = pieces.index
        none = len(self.logs) - 1
        self.arc = {}
        for begin in range(self.width):
            own = np.zeros(n, np.uint64)
            for size in range(1, min(pieces.longest, self.width - begin) + 1):
                own = _grown(own, codes[:, begin + size - 1])
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                self.arc[begin + size, size] = np.where(hashes[at] == own, numbers[at], none)
        # Characters that are no piece are spelled by their bytes.
        self.spelled, self.spelling = {}, {}
        for end in range(1, self.width + 1):
            rows = np.flatnonzero(self.arc[end, 1] == none)
            if len(rows):
                values, place = np.unique(codes[rows, end - 1], return_inverse=True)
                for v in values.tolist():
                    if v not in self.spelling:
                        self.spelling[v] = [pieces.bytes_at + b for b in chr(v).encode("utf-8", "replace")]
                costs = np.array([sum(pieces.logs[x] for x in self.spelling[v]) for v in values.tolist()])
                self.spelled[end] = rows, values[place], costs[place]
        self.alpha = self._forward(n)

    def _weight(self, end: int, size: int) -> np.ndarray:
        weight = self.logs[self.arc[end, size]]
        if size == 1 and end in self.spelled:
            rows, _, costs = self.spelled[end]
            weight[rows] = costs
        return weight

    def _sizes(self, end: int) -> range:
        return range(1, min(end, self.pieces.longest) + 1)

    def _forward(self, n: int) -> list[np.ndarray]:
        alpha = [np.zeros(n)]
        for end in range(1, self.width + 1):
            terms = np.stack([alpha[end - size] + self._weight(end, size) for size in self._sizes(end)])
            most = terms.max(axis=0)
            alpha.append(most + np.log(np.exp(terms - most).sum(axis=0)))
        return alpha

    def log_sums(self) -> np.ndarray:
        """Natural log of the summed probability of all segmentations of each word."""
        return self.alpha[-1]

    def expect(self, times: np.ndarray, into: np.ndarray) -> None:
        """Add the expected number of each piece in ``times`` copies of each word."""
        n = len(times)
        beta = [np.full(n, -np.inf) for _ in range(self.width)] + [np.zeros(n)]
        for end in range(self.width, 0, -1):
            for size in self._sizes(end):
                weight = self._weight(end, size)
                through = beta[end] + weight
                beta[end - size] = np.logaddexp(beta[end - size], through)
                share = times * np.exp(self.alpha[end - size] + through - self.alpha[-1])
                if size == 1 and end in self.spelled:
                    rows, values, _ = self.spelled[end]
                    for v in np.unique(values).tolist():
                        for x in self.spelling[v]:
                            into[x] += share[rows[values == v]].sum()
                    share[rows] = 0.0
                some = np.flatnonzero(share)
                np.add.at(into, self.arc[end, size][some], share[some])


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Places of words of one length, in blocks of bounded size."""
    places: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        places.setdefault(len(word), []).append(i)
    for length, own in places.items():
        step = max(TOGETHER, CELLS // (length + 1))
        yield from (own[i : i + step] for i in range(0, len(own), step))


def log_sums(pieces: Pieces, words: list[str]) -> np.ndarray:
    """``Pieces.log_sum`` of many words."""
    out = np.empty(len(words))
    for block in by_length(words):
        own = [words[i] for i in block]
        out[block] = Lattices(pieces, own).log_sums() if _together(own) else [pieces.log_sum(w) for w in own]
    return out


def expect_all(pieces: Pieces, words: list[str], times: list[int], into: np.ndarray) -> None:
    """``Pieces.expect`` of many words."""
    counts = np.array(times, float)
    for block in by_length(words):
        own = [words[i] for i in block]
        if _together(own):
            Lattices(pieces, own).expect(counts[block], into)
        else:
            for i in block:
                pieces.expect(words[i], counts[i], into)


def _together(words: list[str]) -> bool:
    """Whether a block is worth arrays; a few long words are summed one by one."""
    return len(words) >= TOGETHER and len(words) * len(words[0]) <= CELLS


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """Read a sentencepiece file. The n-th best piece starts at a probability of 1/n."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    scores = [model.get_score(i) for i in range(size)]
    own = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    order = sorted(own, key=lambda i: (-scores[i], i))
    weight = np.full(size, 1.0 / size)
    weight[order] = 1.0 / np.arange(2, len(order) + 2)
    number = {model.id_to_piece(i): i for i in own}
    first = next(i for i in range(size) if model.is_byte(i))
    end = model.eos_id()
    return Pieces(number, first, end, np.log(weight / weight.sum()).tolist(), max(map(len, number)))


def reestimate(pieces: Pieces, words: DataFrame, texts: int, rounds: int = ROUNDS) -> Pieces:
    """Piece probabilities from expected counts over ``words`` (word, n).

    Each task sums its own; one row per piece of the fixed vocabulary reaches the driver.
    Every piece is counted half a time more, so that none is impossible.
    """
    spark = words.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(pieces)

        def expect(batch: pa.RecordBatch) -> dict[str, list]:
            own = shared.value
            total = np.zeros(len(own.logs))
            expect_all(own, [w.decode() for w in batch.column(0).to_pylist()], batch.column(1).to_pylist(), total)
            some = np.flatnonzero(total)
            return {"piece": some.tolist(), "n": total[some].tolist()}

        counted = per_batch(words.select("word", "n"), expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        total = np.full(len(pieces.logs), 0.5)
        for row in counted.collect():
            total[row["piece"]] += round(row["n"], 3)
        total[pieces.end] = texts + 0.5
        pieces = Pieces(pieces.number, pieces.bytes_at, pieces.end, np.log(total / total.sum()).tolist(), pieces.longest)
    return pieces


def count_words(docs: DataFrame, taught: Column | None = None) -> DataFrame:
    """``word``, ``times``, its count in all texts, and ``n``, that in the ``taught`` ones
    (all by default), from one pass; added up in each task first.

    A task hands its counts on whenever it holds ``HELD`` words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()
        other: Counter = Counter()
        for batch in batches:
            for text, teaches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (known if teaches else other).update(lowered(text).split())
            if len(known) + len(other) > HELD:
                yield _counted(known, other)
                known, other = Counter(), Counter()
        yield _counted(known, other)

    rows = docs.select("text", (F.lit(True) if taught is None else taught).alias("taught"))
    counted = in_arrow(rows, count, "word binary, times bigint, n bigint")
    return counted.groupBy("word").agg(F.sum("times").alias("times"), F.sum("n").alias("n"))


def _counted(known: Counter, other: Counter) -> pa.RecordBatch:
    times = [*known.values(), *other.values()]
    columns = pa.array([*known, *other], pa.binary()), pa.array(times, pa.int64()), pa.array([*known.values(), *[0] * len(other)], pa.int64())
    return pa.RecordBatch.from_arrays(list(columns), names=["word", "times", "n"])


@dataclass
class LanguageModel:
    """Pieces, and the training words' total and variety; ``texts`` is how many ends they hold."""

    pieces: Pieces
    tokens: int
    variety: int
    texts: int


def base_log10(c: int, tokens: int, variety: int) -> float:
    """log10 of the add-one probability of a token seen ``c`` times."""
    return math.log10((c + 1) / (tokens + variety + 1))


def fit(words: DataFrame, texts: int, path: str = VOCABULARY) -> LanguageModel:
    """The model of ``texts`` texts whose words are counted as ``n`` in ``words``."""
    known = words.filter("n > 0")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    pieces = reestimate(load_pieces(path), known, texts)
    return LanguageModel(pieces, total["n"] + texts, total["v"] + (texts > 0), texts)


def train(docs: DataFrame, path: str = VOCABULARY) -> tuple[LanguageModel, DataFrame]:
    """The model of ``docs`` and the table of all word counts, which stays distributed."""
    words = cut_lineage(count_words(docs).select("word", "n"))
    return fit(words, docs.count(), path), words


def weigh(counted: DataFrame, model: LanguageModel) -> DataFrame:
    """``counted`` (word, times, n) with each word's ``known`` (1 if training holds it),
    ``base`` and ``own``, its log10 probabilities; each word's lattice is summed once."""
    shared = counted.sparkSession.sparkContext.broadcast(model.pieces)

    def lattices(batch: pa.RecordBatch) -> dict[str, list]:
        words = [w.decode() for w in batch.column(0).to_pylist()]
        sums = log_sums(shared.value, words) / LN10
        return {"word": batch.column(0), "times": batch.column(1), "n": batch.column(2), "lattice": sums.tolist()}

    n, lattice = F.col("n"), F.col("lattice")
    arc = F.log10(F.lit(WHOLE) * n / max(model.tokens, 1) + F.lit(1 - WHOLE) * F.pow(F.lit(10.0), lattice))
    summed = per_batch(counted.select("word", "times", "n"), lattices, "word binary, times bigint, n bigint, lattice double")
    weighed = summed.select(
        "word",
        "times",
        (n > 0).cast("bigint").alias("known"),
        F.log10((n + 1) / F.lit(model.tokens + model.variety + 1)).alias("base"),
        F.when(n > 0, arc).otherwise(F.lit(math.log10(1 - WHOLE)) + lattice).alias("own"),
    )
    return cut_lineage(weighed)


@dataclass
class Frequent:
    """The most frequent words and their weights, sent as arrays and looked up by word."""

    words: pa.Array
    known: np.ndarray
    base: np.ndarray
    own: np.ndarray

    @cached_property
    def weights(self) -> dict[bytes, tuple[int, float, float]]:
        return dict(zip(self.words.to_pylist(), zip(self.known.tolist(), self.base.tolist(), self.own.tolist())))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "weights"}


def score_documents(
    docs: DataFrame, model: LanguageModel, words: DataFrame, frequent: int = FREQUENT, carried: list[str] | None = None
) -> DataFrame:
    """``row`` (the ``carried`` columns, else all), ``n_tokens``, ``n_known``, ``base_score``, ``score``.

    ``words`` are the training words with their counts ``n``. Tokens are the words of the
    lower-cased (A-Z) text, and its end; a null text is empty and has the end alone.
    """
    own = count_words(docs).select("word", "times").join(words.select("word", "n"), "word", "left")
    return score_weighed(docs, model, weigh(own.withColumn("n", F.coalesce("n", F.lit(0))), model), frequent, carried)


def score_weighed(
    docs: DataFrame, model: LanguageModel, weighed: DataFrame, frequent: int = FREQUENT, carried: list[str] | None = None
) -> DataFrame:
    """The rows of ``score_documents``, from weights of all words of ``docs``.

    The ``frequent`` most frequent words are scored where they are read, from a broadcast
    of that many rows. A document's other words are written out with the document's number
    and joined with the table of all words; none of these is frequent enough to be a hot key.
    """
    top = weighed.orderBy(F.desc("times"), "word").limit(frequent).select("word", "known", "base", "own").toArrow().combine_chunks()
    word, *numbers = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in top.columns)
    shared = docs.sparkSession.sparkContext.broadcast(Frequent(word, *(x.to_numpy(zero_copy_only=False) for x in numbers)))
    end = model.pieces.logs[model.pieces.end] / LN10
    end_known, end_base = min(model.texts, 1), base_log10(model.texts, model.tokens, model.variety)
    rows = docs.select(whole_row(docs, carried).alias("row"), "text")

    def read(batch: pa.RecordBatch) -> dict[str, list]:
        weights = shared.value.weights
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "rare")}
        for text in batch.column(1).to_pylist():
            tokens = Counter(lowered(text).split())
            known, base, score, rare = end_known, end_base, end, []
            for word, times in tokens.items():
                weight = weights.get(word)
                if weight is None:
                    rare.append({"word": word, "times": times})
                else:
                    known += times * weight[0]
                    base += times * weight[1]
                    score += times * weight[2]
            for name, value in zip(out, (sum(tokens.values()) + 1, known, base, score, rare)):
                out[name].append(value)
        return out | {"row": batch.column(0)}

    totals = "n_tokens bigint, n_known bigint, base_score double, score double"
    read_schema = schema_with(rows.select("row"), f"{totals}, rare array<struct<word:binary,times:bigint>>")
    first = cut_lineage(per_batch(rows, read, read_schema).withColumn("number", F.monotonically_increasing_id()))

    rare = (
        first.select("number", F.inline("rare").alias("word", "m"))
        .join(weighed.select("word", "known", "base", "own"), "word")
        .groupBy("number")
        .agg(*[F.sum(F.col("m") * F.col(name)).alias(short) for name, short in (("known", "k"), ("base", "b"), ("own", "s"))])
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return first.drop("rare").join(rare, "number", "left").select(
        "row",
        "n_tokens",
        (F.col("n_known") + zero("k")).alias("n_known"),
        (F.col("base_score") + zero("b")).alias("base_score"),
        (F.col("score") + zero("s")).alias("score"),
    )


def language_report(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document: fold, token counts, the unigram base score and the model's."""
    own = docs.select("doc_id", "text")
    taught = crc_remainder(F.col("doc_id"), FOLDS) != HELD_OUT
    counted = cut_lineage(count_words(own, taught))
    model = fit(counted, own.filter(taught).count(), path)
    doc_id = F.col("row.doc_id")
    return score_weighed(own, model, weigh(counted, model), carried=["doc_id"]).select(
        doc_id.alias("doc_id"),
        (crc_remainder(doc_id, FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
