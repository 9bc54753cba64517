"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles. Banded MinHash values gather whatever may be alike.
Inside a gathering the MinHash values of two documents are compared a few at a time, and
the pair is dropped once the posterior probability that it reaches the threshold falls
below a tolerance. What is left is verified on the shingles themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from sheetscope.llm.common import KEY, in_arrow, partitions, per_batch, row_key, whole_row, words_of
from sheetscope.llm.components import connected_components
from sheetscope.session import cut_lineage

SHINGLE, THRESHOLD = 5, 0.8
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8^5)^32, below 1e-5.
BANDS, ROWS = 32, 5
#: MinHash values compared at a time, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
#: Larger gatherings are compared block by block, so many texts a block.
BLOCK = 256
#: A worker remembers so many words' hashes; it lives on after the join, and they with it.
_WORDS_KNOWN = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > _WORDS_KNOWN:
        _known.clear()
    for w in set(words):
        if w not in _known:
            _known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def shingles_of(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text, not empty, is one."""
    if not words:
        return np.zeros(0, np.uint64)
    of = _word_hashes(words)
    n = min(size, len(of))
    out = np.full(len(of) - n + 1, np.uint64(n))
    for i in range(n):
        out = (out ^ of[i : len(of) - n + 1 + i]) * _MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    n = BANDS * ROWS
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


_TIMES, _PLUS = _permutations()


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least of each permutation's 32-bit values."""
    out = np.full(len(_TIMES), 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        out = np.minimum(out, ((part * _TIMES[:, None] + _PLUS[:, None]) >> np.uint64(32)).min(1))
    return out.astype(np.uint32)


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """``(compared, matches)``: fewer matches than these and the pair is dropped.

    Under a uniform prior the similarity after m matches of n is Beta(m+1, n-m+1), and
    the chance that it reaches t is that of at most m successes in n+1 draws of chance t.
    """
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        chance, m = 0.0, 0
        while m <= n:
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def similar_pairs(
    signatures: tuple[np.ndarray, np.ndarray], sets: tuple[list, list], same: bool, threshold: float, tolerance: float
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs between two blocks, or within one, that reach the threshold."""
    left, right = signatures
    alive = np.ones((len(left), len(right)), bool)
    if same:
        alive = np.triu(alive, 1)
    a, b = np.nonzero(alive)
    matches = np.zeros(len(a), np.int32)
    for n, least in least_matches(threshold, tolerance):
        part = slice(n - STEP, n)
        for i in range(0, len(a), 65536):
            at = slice(i, i + 65536)
            matches[at] += (left[a[at], part] == right[b[at], part]).sum(1, dtype=np.int32)
        kept = matches >= least
        a, b, matches = a[kept], b[kept], matches[kept]
    if not len(a):
        return a, b
    shared = _shared(a, b, *sets)
    sizes = [np.array([len(s) for s in own]) for own in sets]
    union = sizes[0][a] + sizes[1][b] - shared
    reach = shared >= threshold * union - 1e-9
    return a[reach], b[reach]


def _shared(a: np.ndarray, b: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shingles that each pair shares: pair by pair, or by products of incidence matrices
    where pairs are so many that this is less work."""
    rows, rows_b = np.unique(a), np.unique(b)
    words = np.unique(np.concatenate([*(left[i] for i in rows), *(right[i] for i in rows_b)]))
    lengths = sum(len(left[i]) for i in a) if len(a) < 1000 else len(a) * np.mean([len(left[i]) for i in rows])
    if len(rows) * len(rows_b) * len(words) > 200 * lengths:
        return np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in zip(a, b)])
    total = np.zeros((len(rows), len(rows_b)), np.float32)
    for i in range(0, len(words), 4096):
        part = words[i : i + 4096]
        total += _incidence(part, [left[k] for k in rows]) @ _incidence(part, [right[k] for k in rows_b]).T
    return total[np.searchsorted(rows, a), np.searchsorted(rows_b, b)].astype(np.int64)


def _incidence(words: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), len(words)), np.float32)
    for row, own in zip(out, sets):
        own = own[np.searchsorted(own, words[0]) : np.searchsorted(own, words[-1], "right")]
        row[np.searchsorted(words, own)] = 1
    return out


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """``KEY``, 128 bits of the word sequence, and the MinHash values; none without words."""

    def sign(batch: pa.RecordBatch) -> dict[str, list]:
        columns: dict[str, list] = {n: [] for n in (*KEY, "w0", "w1", "signature")}
        columns[KEY[0]], columns[KEY[1]] = batch.column(0), batch.column(1)
        for text in batch.column(2).to_pylist():
            words = words_of(text)
            digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None
            columns["w0"].append(digest and int.from_bytes(digest[:8], "big", signed=True))
            columns["w1"].append(digest and int.from_bytes(digest[8:], "big", signed=True))
            columns["signature"].append(minhash(shingles_of(words, shingle)).tobytes() if words else None)
        return columns

    schema = f"{KEY[0]} bigint, {KEY[1]} bigint, w0 bigint, w1 bigint, signature binary"
    return per_batch(docs.select(*row_key(F.col("doc_id"), F.col("text")), "text"), sign, schema)


def _gatherings(texts: DataFrame) -> DataFrame:
    """``node`` and ``component``: texts that share a band, directly or through others.

    Each text is linked to the smallest of its band alone, never to all of it.
    """

    def cut(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        node = np.repeat(batch.column(0).to_numpy(), BANDS)
        parts = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
        for i in range(ROWS):
            out = (out ^ parts[:, :, i]) * _MIX
            out = out ^ (out >> np.uint64(29))
        return {"band": pa.array(out.reshape(-1).view(np.int64)), "node": pa.array(node)}

    bands = per_batch(texts.select("node", "signature"), cut, "band bigint, node bigint")
    least = bands.groupBy("band").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "b")
    return connected_components(bands.join(least, "band").select(F.col("node").alias("a"), "b"))


def _compare(batches: Iterator[pa.RecordBatch], arrow: pa.Schema, threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Verify each (component, low, high) group of the sorted rows; one group is in memory."""
    current, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for component, low, high, own, node, signature, shingles in zip(*columns):
            if (component, low, high) != current:
                if rows:
                    yield _group(current, rows, arrow, threshold, tolerance)
                current, rows = (component, low, high), []
            if rows and rows[-1][1] == node:
                continue  # rows that repeat id and text share a key
            rows.append((own, node, np.frombuffer(signature, np.uint32), np.frombuffer(shingles, np.uint64)))
    if rows:
        yield _group(current, rows, arrow, threshold, tolerance)


def _group(key: tuple, rows: list, arrow: pa.Schema, threshold: float, tolerance: float) -> pa.RecordBatch:
    _, low, high = key
    sides = [[r for r in rows if r[0] == side] for side in ((low,) if low == high else (low, high))]
    left, right = sides[0], sides[-1]
    nodes = np.array([r[1] for r in left + (right if low != high else [])], np.int64)
    shift = len(left) if low != high else 0
    links, parent = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    if left and right:
        signatures = tuple(np.stack([r[2] for r in side]) for side in (left, right))
        a, b = similar_pairs(signatures, tuple([r[3] for r in side] for side in (left, right)), low == high, threshold, tolerance)
        b = b + shift
        links = np.bincount(a, minlength=len(nodes)) + np.bincount(b, minlength=len(nodes))
        parent = _roots(len(nodes), a, b)
    roots = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(roots, parent, nodes)
    linked = links > 0
    return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(roots[parent][linked]), pa.array(links[linked])], schema=arrow)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root of each position: labels fall along the links until none changes."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def similar_documents(
    docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK
) -> DataFrame:
    """``KEY`` of every row, ``class``, ``class_id``, ``n_links`` and ``n_copies``.

    Texts with the same word sequence are copies and count as one text. ``n_links`` is
    the number of other texts whose shingles reach the threshold, ``class_id`` the
    smallest id of the texts linked directly or through others, ``n_copies`` the rows of
    the row's own text. A text without words is like no other and a class by itself,
    with its own id and no ``class`` number; a null id counts as below all.

    A gathering of more than ``block`` texts is cut into blocks, and each pair of blocks
    is one group of rows. A group yields one row per linked text, not one per pair.
    """
    spark = docs.sparkSession
    signed = cut_lineage(_signatures(docs, shingle))
    worded = (
        signed.filter("w0 is not null")
        .groupBy("w0", "w1")
        .agg(F.min(F.struct(*KEY, "signature")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    )
    texts = cut_lineage(worded.select("w0", "w1", "first.*", "n_copies").withColumn("node", F.monotonically_increasing_id()))
    gathered = cut_lineage(_gatherings(texts))

    sizes = gathered.groupBy("component").agg((F.ceil(F.count(F.lit(1)) / block)).alias("blocks"))
    placed = gathered.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    compared = texts.join(placed, "node").select(*KEY, "node", "signature", "component", "own", "blocks")

    def shingled(batch: pa.RecordBatch) -> dict[str, list]:
        names = ("node", "signature", "component", "own", "blocks")
        out = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
        texts_ = batch.column(batch.schema.get_field_index("text")).to_pylist()
        return out | {"shingles": [shingles_of(words_of(t), shingle).tobytes() for t in texts_]}

    sources = docs.select(*row_key(F.col("doc_id"), F.col("text")), "text")
    joined = sources.join(compared, [*KEY]).select("node", "signature", "component", "own", "blocks", "text")
    sets = per_batch(joined, shingled, "node bigint, signature binary, component bigint, own int, blocks bigint, shingles binary")
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).select(
        "component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "signature", "shingles"
    )
    groups = ["component", "low", "high"]
    grouped = paired.repartition(partitions(spark), *groups).sortWithinPartitions(*groups, "own", "node")
    schema = T._parse_datatype_string("node bigint, root bigint, links bigint")
    found = cut_lineage(in_arrow(grouped, lambda batches: _compare(batches, to_arrow_schema(schema), threshold, tolerance), schema))

    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = texts.select("node", F.col(KEY[0]).alias("id")).join(classes, "node")
    least = named.groupBy("component").agg(F.min("id").alias("class_id"))
    of_text = (
        texts.select("node", "w0", "w1", "n_copies", F.col(KEY[0]).alias("own_id"))
        .join(named.join(least, "component").select("node", "component", "class_id"), "node", "left")
        .join(links, "node", "left")
        .select("w0", "w1", "n_copies", F.coalesce("component", "node").alias("class"), F.coalesce("class_id", "own_id").alias("class_id"), "n_links")
    )
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return signed.select(*KEY, "w0", "w1").join(of_text, ["w0", "w1"], "left").select(
        *KEY,
        "class",
        F.coalesce("class_id", KEY[0]).alias("class_id"),
        F.coalesce("n_links", none).alias("n_links"),
        F.coalesce("n_copies", one).alias("n_copies"),
    )


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, all columns: that of the smallest id, then text hash.

    Texts without words all stay, each once for its id.
    """
    # Written out, as it is read twice: the driver would plan all of the join twice over.
    found = cut_lineage(similar_documents(docs, **options).select(*KEY, "class"))
    classes = found.filter("class is not null").groupBy("class").agg(F.min(F.struct(*KEY)).alias("first")).select("first.*")
    kept = classes.union(found.filter("class is null").select(*KEY).distinct())
    rows = docs.select(whole_row(docs).alias("row"), *row_key(F.col("doc_id"), F.col("text")))
    return rows.join(kept, [*KEY], "left_semi").dropDuplicates([*KEY]).select("row.*")


def similarity_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: id, class, links to other texts, copies of its own."""
    id_of = lambda c: F.when(F.col(c) > -(2**63), F.col(c)).alias
    return similar_documents(docs).select(id_of(KEY[0])("doc_id"), id_of("class_id")("class_id"), "n_links", "n_copies")
