"""Substring deduplication over sliding sentence spans.

The run of ``SENTENCES`` sentences from every start is hashed, the hashes are joined over
all documents, and the sentences covered by a run that is not its first occurrence go.
Where a longer run occurs again, so does each run within it: the sentences that go are
those of all repeated runs, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetscope.llm.common import KEY, WORD, per_batch, row_key, schema_with, whole_row
from sheetscope.session import cut_lineage

SENTENCES = 2
#: Words a run needs; short repeats are repeats too.
WORDS = 0
_PIECE = re.compile(rb"[^.!?\n]*[.!?\n]+|[^.!?\n]+")


def sentences_of(text: str | None) -> list[tuple[bytes, list[bytes]]]:
    """Each sentence and its words. A sentence ends with marks or line ends; they tile the text."""
    return [(piece, WORD.findall(piece.lower())) for piece in _PIECE.findall((text or "").encode())]


def runs_of(text: str | None, sentences: int, words: int) -> list[tuple[int, int, int, int]]:
    """``(place, length, hash, hash)`` of each run, places counting sentences with words.

    A run is the shortest that has ``sentences`` sentences and ``words`` words at least.
    With ``words`` above 0 runs of few words grow, the last ones of a passage into the text
    behind it, so that the end of a repeated passage may stay.
    """
    own = [w for _, w in sentences_of(text) if w]
    joined = [b" ".join(w) for w in own]
    out, end, held = [], 0, 0
    for start, first in enumerate(own):
        while end < len(own) and (held < words or end - start < sentences):
            held += len(own[end])
            end += 1
        if held < words or end - start < sentences:
            break
        digest = hashlib.blake2b(b"\n".join(joined[start:end]), digest_size=16).digest()
        out.append((start, end - start, *struct.unpack("<qq", digest)))
        held -= len(first)
    return out


def repeated_sentences(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``KEY`` and ``removed``, the places of the sentences that a later run covers.

    Hashes are counted first, summed in each task, and only runs whose first 64 bits
    occur twice go on; a run in every document is then one hot key of a join, which
    adaptive execution splits, and one row per task of a sum.
    """
    source = docs.select(*row_key(F.col("doc_id"), F.col("text")), "text")

    def heads(batch: pa.RecordBatch) -> dict[str, list]:
        return {"h0": [r[2] for t in batch.column(0).to_pylist() for r in runs_of(t, sentences, words)]}

    def runs(batch: pa.RecordBatch) -> dict[str, list]:
        columns: dict[str, list] = {n: [] for n in (*KEY, "place", "length", "h0", "h1")}
        for k0, k1, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for run in runs_of(text, sentences, words):
                for name, value in zip(columns, (k0, k1, *run)):
                    columns[name].append(value)
        return columns

    repeated = per_batch(source.select("text"), heads, "h0 bigint").groupBy("h0").count().filter("count > 1").select("h0")
    schema = f"{KEY[0]} bigint, {KEY[1]} bigint, place int, length int, h0 bigint, h1 bigint"
    spans = cut_lineage(per_batch(source, runs, schema).join(repeated, "h0"))
    at = F.struct(*KEY, "place")
    firsts = spans.groupBy("h0", "h1").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first <> last")
    later = spans.join(firsts.select("h0", "h1", "first"), ["h0", "h1"]).filter(at != F.col("first"))
    # A sentence is named once by each run over it in this document, so few times.
    return later.select(*KEY, F.explode(F.sequence("place", F.col("place") + F.col("length") - 1)).alias("place")).groupBy(*KEY).agg(
        F.sort_array(F.collect_set("place")).alias("removed")
    )


def drop_repeated_sentences(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``row`` (all columns, repeated sentences cut from ``text``), ``n_sentences``,
    ``n_removed`` and ``removed_words``.

    Words alone are compared, A-Z lower-cased. The first occurrence is that of the
    smallest id (null first), then place. Texts that are null, blank or shorter than a
    run stay as they are. Rows that repeat id and text are one document, not copies of
    each other, and get the same result. Sentences without words are never removed.
    """
    removed = repeated_sentences(docs, sentences, words)
    rows = docs.select(whole_row(docs).alias("row"), *row_key(F.col("doc_id"), F.col("text")))
    joined = rows.join(removed, [*KEY], "left").select("row", "removed")
    schema = schema_with(joined.select("row"), "n_sentences bigint, n_removed bigint, removed_words bigint")

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        row = batch.column(0)
        texts, counts, gone, lost = [], [], [], []
        for text, places in zip(row.field("text").to_pylist(), batch.column(1).to_pylist()):
            pieces = sentences_of(text)
            taken, kept, place, n = set(places or ()), [], 0, 0
            for piece, own in pieces:
                if own and place in taken:
                    n += len(own)
                else:
                    kept.append(piece)
                place += bool(own)
            texts.append(b"".join(kept).decode() if taken else text)
            counts.append(place)
            gone.append(len(taken))
            lost.append(n)
        at = row.type.get_field_index("text")
        fields = [row.field(i) if i != at else pa.array(texts, row.type.field(at).type) for i in range(row.type.num_fields)]
        return {
            "row": pa.StructArray.from_arrays(fields, fields=[row.type.field(i) for i in range(row.type.num_fields)]),
            "n_sentences": counts, "n_removed": gone, "removed_words": lost,
        }

    return per_batch(joined, cut, schema)
