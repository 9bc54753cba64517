"""Benchmark decontamination.

A broadcast hash set holds the normalised n-grams of the test items. Each document's
token windows are looked up in it, hits are verified word by word, and the spans or the
whole documents go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetscope.llm.common import WORD, lowered, per_batch, whole_row, words_of

NGRAM = 10
#: The hash set of one broadcast holds at most about this many bytes of windows and ids.
BLOCK_BYTES = 16_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

HITS = "array<struct<start:bigint,end:bigint>>"


def benchmark_windows(benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """``window`` (words joined by spaces) and ``item`` (id as text), each pair once.

    An item of fewer than ``ngram`` words, but not none, is one window.
    """

    def cut(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            if words:
                made = [b" ".join(words[i : i + ngram]).decode() for i in range(max(1, len(words) - ngram + 1))]
                yield {"window": made, "item": [item] * len(made)}

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return per_batch(items, cut, "window string, item string").distinct()


def _matches(rows: list) -> tuple[dict[bytes, int], dict[int, tuple[np.ndarray, dict[bytes, list]]]]:
    """Word numbers, and per window length the sorted hashes and the windows themselves."""
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, dict[bytes, list]] = {}
    for row in rows:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in row["window"].encode().split(b" ")]
        window = np.array(ids, np.int64).tobytes()
        by_length.setdefault(len(ids), {}).setdefault(window, []).append(row["item"])
    hashed = {}
    for length, windows in by_length.items():
        matrix = np.frombuffer(b"".join(windows), np.int64).reshape(-1, length)
        hashed[length] = np.unique(_hash(matrix)), windows
    return vocabulary, hashed


def _hash(matrix: np.ndarray) -> np.ndarray:
    out = np.zeros(len(matrix), np.uint64)
    for column in matrix.T:
        out = (out ^ (column.astype(np.uint64) + np.uint64(1))) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def _scan(words: list[bytes], vocabulary: dict, hashed: dict, hit: np.ndarray, items: set) -> None:
    """Mark hit words and gather the items whose windows occur."""
    get = vocabulary.get
    ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    gaps = np.concatenate(([0], np.cumsum(ids < 0)))
    for length, (hashes, windows) in hashed.items():
        starts = np.flatnonzero(gaps[length:] == gaps[:-length]) if len(ids) >= length else ()
        if not len(starts):
            continue
        own = ids[starts[:, None] + np.arange(length)]
        of = _hash(own)
        near = hashes[np.minimum(np.searchsorted(hashes, of), len(hashes) - 1)] == of
        for start, window in zip(starts[near].tolist(), own[near]):
            found = windows.get(window.tobytes())
            if found is not None:
                hit[start : start + length] = True
                items.update(found)


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_words``, ``hits`` (word spans), ``items``.

    The windows of the benchmark are counted first. They are dealt by hash into blocks of
    bounded size, and each block is broadcast in turn to one more step of the same scan,
    so that a benchmark of any size is covered whole and no document is shuffled.

    A null text, or one of separators alone, has no words and no hits. A null item id
    counts for hits and is left out of ``items``. Repeated items count once. With an
    empty benchmark nothing is hit.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, ngram)
    size = windows.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(max(blocks, 1))))

    out = docs.select(whole_row(docs).alias("row")).select(
        "row",
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast(HITS).alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in range(max(blocks, 1)):
        own = numbered.filter(F.col("block") == block).select("window", "item")
        out = _one_block(out, spark.sparkContext.broadcast(_matches(own.collect() if blocks else [])))
    return out


def _one_block(df: DataFrame, block) -> DataFrame:
    schema = T.StructType([*df.schema.fields])

    def scan(batch: pa.RecordBatch) -> dict[str, list]:
        vocabulary, hashed = block.value
        rows = batch.column(batch.schema.get_field_index("row"))
        texts = rows.field("text").to_pylist()
        counts, spans, items = [], [], []
        for text, before, known in zip(texts, batch.column("hits").to_pylist(), batch.column("items").to_pylist()):
            words = words_of(text)
            hit, found = np.zeros(len(words), bool), set(known)
            for span in before or ():
                hit[span["start"] : span["end"]] = True
            _scan(words, vocabulary, hashed, hit, found)
            counts.append(len(words))
            spans.append(_runs(hit))
            items.append(sorted(x for x in found if x is not None))
        return {"row": rows, "n_words": counts, "hits": spans, "items": items}

    return per_batch(df, scan, schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """One row per document: word and hit counts, and the items found in it."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, ngram)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """The documents, all their columns, in which no word is hit."""
    return find_contamination(docs, benchmark, ngram).filter(F.size("hits") == 0).select("row.*")


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """All documents, their hit spans cut out of ``text``, from first word to last."""
    found = find_contamination(docs, benchmark, ngram)
    schema = T.StructType([T.StructField("row", docs.schema)])

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        rows = batch.column(0).to_pylist()
        for row, spans in zip(rows, batch.column(1).to_pylist()):
            if spans:
                row["text"] = _without(row["text"], spans)
        return {"row": rows}

    return per_batch(found.select("row", "hits"), cut, schema).select("row.*")


def _without(text: str, spans: list[dict[str, int]]) -> str:
    data, low = text.encode(), lowered(text)
    places = [m.span() for m in WORD.finditer(low)]
    kept, at = [], 0
    for span in spans:
        kept.append(data[at : places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    return b"".join([*kept, data[at:]]).decode()
