"""Suffix-array deduplication of byte strings over all documents.

A string that repeats must be found wherever its other occurrence lies, so strings are
dealt to shards by content: every window of ``length`` bytes goes by the smallest hash
among its short grams, which equal windows share. Windows in a row with the same
smallest hash travel as one segment. Each shard orders the suffixes of its segments by
external induced sorting, with the common prefixes of neighbours; windows whose
neighbours agree over the whole length repeat.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheetscope.llm.common import KEY, in_arrow, partitions, per_batch, row_key, whole_row
from sheetscope.llm.induced import MEMORY, suffix_order
from sheetscope.session import cut_lineage

LENGTH = 200
GRAM = 32
#: A smallest hash of so many segments, and of a ten-thousandth of all, is common.
COMMON, SHARE = 64, 10_000
#: A shard orders the suffixes of about so many bytes at once, a common hash's at a time.
AT_ONCE = 2_000_000
#: Texts are hashed about so many bytes at a time, few enough for a core's cache.
CHUNK = 65_536
#: Common hashes are looked up by at most so many first bits before they are searched for.
HEAD_BITS = 26
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each place, by doubling."""
    out = data.astype(np.uint64) + np.uint64(1)
    width, base = 1, int(_MIX)
    while width < GRAM:
        out = out[:-width] * np.uint64(base) + out[width:]
        base = base * base % 2**64
        width *= 2
    out = (out ^ (out >> np.uint64(29))) * _MIX
    return out ^ (out >> np.uint64(32))


@dataclass
class Segments:
    """Texts' bytes in one array, and of each segment its text, hash, first and last window.

    Windows count from the start of their text; ``start`` is where that lies in ``data``.
    """

    data: np.ndarray
    start: np.ndarray
    text: np.ndarray
    least: np.ndarray
    first: np.ndarray
    last: np.ndarray
    twice: np.ndarray

    def weighted(self) -> np.ndarray:
        """The segments' hashes, those twice that occur more than once in their own segment:
        such a segment may repeat within itself."""
        return np.concatenate([self.least, self.least[self.twice]])

    def piece(self, i: int, length: int) -> bytes:
        begin = self.start[self.text[i]]
        return self.data[begin + self.first[i] : begin + self.last[i] + length].tobytes()


def segments_of(texts: list[str | None], length: int, common: Common, inner: bool = False) -> Iterator[Segments]:
    """Cut texts into segments, about ``CHUNK`` bytes of whole texts at a time.

    ``common`` hashes are taken only in windows that have no other, so that a window
    which reaches beyond a widespread passage is dealt by what stands around it. With
    ``inner``, segments that hold their hash more than once are marked in ``twice``.
    """
    held, numbers, size = [], [], 0
    for number, text in enumerate(texts):
        data = (text or "").encode()
        if len(data) < length:
            continue
        held.append(data)
        numbers.append(number)
        size += len(data)
        if size >= CHUNK:
            yield _cut_segments(held, np.array(numbers), len(texts), length, common, inner)
            held, numbers, size = [], [], 0
    if held:
        yield _cut_segments(held, np.array(numbers), len(texts), length, common, inner)


def _cut_segments(held: list[bytes], numbers: np.ndarray, n_texts: int, length: int, common: Common, inner: bool) -> Segments:
    """Hashes run over all bytes; windows that reach into the next text are left out."""
    data = np.frombuffer(b"".join(held), np.uint8)
    ends = np.cumsum([len(h) for h in held])
    begins = np.append(0, ends[:-1])
    hashes, width = gram_hashes(data), length - GRAM + 1
    if len(common):
        late = common.among(hashes).astype(np.uint64)
        hashes = (hashes >> np.uint64(1)) | (late << np.uint64(63))
    # Two stretches of half a window cover a window; its least hash is the least of one of them.
    half = (width + 1) // 2
    halves = _sliding_least(hashes, half)
    least = np.minimum(halves[: len(halves) - (width - half)], halves[width - half :])
    own = np.zeros(len(data), bool)
    for begin, end in zip(begins, ends):
        own[begin : end - length + 1] = True
    edge = np.append(True, least[1:] != least[:-1])
    edge[begins[begins < len(edge)]] = True
    first = np.flatnonzero(edge & own[: len(least)])
    text = np.searchsorted(ends, first, "right")
    last = np.minimum(np.append(first[1:], len(least)), ends[text] - length + 1) - 1
    value = least[first]
    twice = np.zeros(len(first), bool)
    if inner:
        twice = _more_than_once(hashes, halves, half, value, first, last + width)
    start = np.zeros(n_texts, np.int64)
    start[numbers] = begins
    return Segments(data, start, numbers[text], value, first - begins[text], last - begins[text], twice)


def _more_than_once(hashes: np.ndarray, halves: np.ndarray, half: int, value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each ``value`` occurs more than once in ``hashes[a:b]``.

    It can only where it is the least of the half window behind it or before it.
    """
    least = np.zeros(len(hashes), bool)
    least[: len(halves)] = hashes[: len(halves)] == halves
    least[half - 1 :] |= hashes[half - 1 :] == halves
    places = np.flatnonzero(least)
    # Few hashes occur in two places at all; only their segments are looked into.
    ordered = np.sort(hashes[places])
    often = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.zeros(len(value), bool)
    if len(often):
        places = places[_found(hashes[places], often)]
        keys = np.sort(np.searchsorted(often, hashes[places]) * len(hashes) + places)
        own = np.flatnonzero(_found(value, often))
        base = np.searchsorted(often, value[own]) * len(hashes)
        out[own] = np.searchsorted(keys, base + b[own]) - np.searchsorted(keys, base + a[own]) > 1
    return out


class Common:
    """A sorted set of hashes, looked up by their first bits before a search.

    The table of first bits has sixteen places a hash or more, so most other hashes fall on
    an empty one. It is made where it is used, once a worker.
    """

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self._heads: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "_heads": None}

    def __len__(self) -> int:
        return len(self.hashes)

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Which of ``hashes`` are in the set."""
        shift = np.uint64(64 - min(HEAD_BITS, max(8, (16 * len(self)).bit_length())))
        if self._heads is None:
            self._heads = np.zeros(1 << (64 - int(shift)), bool)
            self._heads[self.hashes >> shift] = True
        out = self._heads[hashes >> shift]
        maybe = np.flatnonzero(out)
        out[maybe] = _found(hashes[maybe], self.hashes)
        return out


def _found(hashes: np.ndarray, sorted_hashes: np.ndarray) -> np.ndarray:
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)] == hashes


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _common_hashes(source: DataFrame, length: int) -> np.ndarray:
    """Hashes of all grams of passages that very many segments share, sorted.

    Counted first are the smallest hashes. Of each that is common, two segments are
    compared around it; what they share is taken for the passage. At most ``SHARE``
    hashes can be common, and a passage has fewer than two lengths of grams, so what
    reaches the driver is bounded.
    """
    none = np.zeros(0, np.uint64)

    def heads(batch: pa.RecordBatch) -> dict[str, list]:
        found = [cut.least for cut in segments_of(batch.column(0).to_pylist(), length, Common(none))]
        return {"v": pa.array(np.concatenate([none, *found]).view(np.int64))}

    counted = cut_lineage(per_batch(source.select("text"), heads, "v bigint").groupBy("v").count().filter(f"count >= {COMMON}"))
    total = counted.agg(F.sum("count")).first()[0] or 0
    often = [r["v"] for r in counted.filter(F.col("count") >= total // SHARE).orderBy(F.desc("count"), "v").limit(SHARE).collect()]
    if not often:
        return none
    shared = source.sparkSession.sparkContext.broadcast(Common(np.sort(np.array(often, np.int64).view(np.uint64))))

    def around(batch: pa.RecordBatch) -> dict[str, list]:
        rows: dict[str, list] = {"v": [], "side": [], "left": [], "right": []}
        for cut in segments_of(batch.column(0).to_pylist(), length, Common(none)):
            for i in np.flatnonzero(shared.value.among(cut.least)):
                own = cut.piece(i, length)
                at = int(np.flatnonzero(gram_hashes(np.frombuffer(own, np.uint8)) == cut.least[i])[0])
                rows["v"].append(int(cut.least[i].view(np.int64)))
                rows["side"].append(hashlib.blake2b(own, digest_size=8).digest())
                rows["left"].append(own[:at][::-1])
                rows["right"].append(own[at:])
        return rows

    both = F.struct("side", "left", "right")
    pairs = (
        per_batch(source.select("text"), around, "v bigint, side binary, left binary, right binary")
        .groupBy("v")
        .agg(F.min(both).alias("a"), F.max(both).alias("b"))
        .collect()
    )
    passages = [bytes(_shared(r["a"]["left"], r["b"]["left"])[::-1] + _shared(r["a"]["right"], r["b"]["right"])) for r in pairs]
    grams = [gram_hashes(np.frombuffer(p, np.uint8)) for p in passages if len(p) >= GRAM]
    return np.unique(np.concatenate(grams)) if grams else none


def _shared(a: bytes, b: bytes) -> bytes:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8))
    return a[: differ[0]] if len(differ) else a[:n]


def repeated_windows(strings: list[tuple[bytes, int]], length: int, memory: int = MEMORY) -> list[list[tuple[int, int]]]:
    """Per string the ranges of its windows that start elsewhere too.

    ``strings`` are distinct, each with how often it occurs. They are ordered as one text;
    windows that reach into the next string are passed over.
    """
    text = np.frombuffer(b"".join(s for s, _ in strings), np.uint8)
    sizes = [len(s) for s, _ in strings]
    ends = np.cumsum(sizes)
    order, common = suffix_order(text, length, memory)
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)[order]
    valid = order + length <= ends[owner]
    group = np.cumsum(common < length) - 1
    weight = np.array([n for _, n in strings], np.int64)
    total = np.bincount(group, np.where(valid, weight[owner], 0), minlength=1)
    repeats = np.zeros(len(text) + 1, bool)
    repeats[order[valid & (total[group] > 1)]] = True
    # The last windows of a string reach into the next, so no run goes over its end.
    edges = np.flatnonzero(np.diff(np.append(False, repeats).view(np.int8))).reshape(-1, 2)
    of = np.searchsorted(ends, edges[:, 0], "right")
    begins = np.append(0, ends[:-1])[of]
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for i, a, b in zip(of.tolist(), (edges[:, 0] - begins).tolist(), (edges[:, 1] - begins).tolist()):
        out[i].append((a, b))
    return out


def _shard(batches: Iterator[pa.RecordBatch], arrow: pa.Schema, length: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows of each distinct segment; rows come sorted by hash.

    Hashes are taken together until ``AT_ONCE`` bytes are gathered; one hash's segments
    stay together, and the sort works on disk where they exceed its memory.
    """
    held: dict[tuple[int, int], list] = {}
    size, current = 0, None
    for batch in batches:
        for v, s0, s1, data, n in zip(*(c.to_pylist() for c in batch.columns)):
            if v != current:
                if size >= AT_ONCE:
                    yield _ranges(held, arrow, length)
                    held, size = {}, 0
                current = v
            entry = held.setdefault((s0, s1), [data, 0])
            if entry[0] != data:
                raise ValueError("two segments share a 128-bit hash")
            size += len(data) if not entry[1] else 0
            entry[1] += n
    if held:
        yield _ranges(held, arrow, length)


def _ranges(held: dict, arrow: pa.Schema, length: int) -> pa.RecordBatch:
    rows = [
        (s0, s1, [{"a": a, "b": b} for a, b in ranges])
        for (s0, s1), ranges in zip(held, repeated_windows([(d, n) for d, n in held.values()], length))
        if ranges
    ]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """``KEY`` and ``spans``: per text the byte ranges of its repeated windows, unmerged;
    and the table of the texts that may have any (``KEY``, ``text``).

    Only segments whose hash occurs twice are taken out of their texts. Copies of one
    segment meet as one string per task; its other holders are told the outcome by a
    join, which adaptive execution splits where a segment is widespread.
    """
    spark = docs.sparkSession
    source = docs.select(*row_key(F.col("doc_id"), F.col("text")), "text")
    common = spark.sparkContext.broadcast(Common(_common_hashes(source, length)))

    def narrow(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        for cut in segments_of(batch.column(2).to_pylist(), length, common.value):
            of = pa.array(cut.text)
            keys = {k: batch.column(i).take(of) for i, k in enumerate(KEY)}
            places = {"a": pa.array(cut.first.astype(np.int32)), "b": pa.array(cut.last.astype(np.int32))}
            yield keys | {"v": pa.array(cut.least.view(np.int64))} | places

    def heads(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [cut.weighted() for cut in segments_of(batch.column(0).to_pylist(), length, common.value, inner=True)]
        return {"v": pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))}

    places = f"{KEY[0]} bigint, {KEY[1]} bigint, v bigint, a int, b int"
    segments = per_batch(source, narrow, places)
    twice = per_batch(source.select("text"), heads, "v bigint").groupBy("v").count().filter("count > 1").select("v")
    wanted = segments.join(twice, "v").groupBy(*KEY).agg(F.collect_list(F.struct("v", "a", "b")).alias("segments"))
    holders = cut_lineage(source.join(wanted, [*KEY]))

    def cut(batch: pa.RecordBatch) -> Iterator[tuple]:
        at = batch.schema.get_field_index
        for *key, text, own in zip(*(batch.column(at(n)).to_pylist() for n in (*KEY, "text", "segments"))):
            data = text.encode()
            for s in own:
                piece = data[s["a"] : s["b"] + length]
                yield *key, s, piece, struct.unpack("<qq", hashlib.blake2b(piece, digest_size=16).digest())

    def members(batch: pa.RecordBatch) -> dict[str, list]:
        rows = [(k0, k1, s["a"], *h) for k0, k1, s, _, h in cut(batch)]
        return {n: [r[i] for r in rows] for i, n in enumerate((*KEY, "a", "s0", "s1"))}

    def strings(batch: pa.RecordBatch) -> dict[str, list]:
        seen: dict[tuple, list] = {}
        for _, _, s, piece, h in cut(batch):
            seen.setdefault(h, [s["v"], *h, piece, 0])[-1] += 1
        return {n: [r[i] for r in seen.values()] for i, n in enumerate(("v", "s0", "s1", "data", "n"))}

    dealt = per_batch(holders, strings, "v bigint, s0 bigint, s1 bigint, data binary, n bigint")
    shards = dealt.repartition(partitions(spark), "v").sortWithinPartitions("v")
    schema = T._parse_datatype_string("s0 bigint, s1 bigint, ranges array<struct<a:bigint,b:bigint>>")
    found = in_arrow(shards, lambda batches: _shard(batches, to_arrow_schema(schema), length), schema)
    own = per_batch(holders, members, f"{KEY[0]} bigint, {KEY[1]} bigint, a int, s0 bigint, s1 bigint").join(found, ["s0", "s1"])
    span = F.transform("ranges", lambda r: F.struct((F.col("a") + r["a"]).alias("start"), (F.col("a") + r["b"] + length - 1).alias("end")))
    # A text's spans are fewer than its windows.
    spans = own.select(*KEY, span.alias("s")).groupBy(*KEY).agg(F.flatten(F.collect_list("s")).alias("spans"))
    return spans, holders.select(*KEY, "text")


def merged(spans: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _cut(data: bytes, spans: list[dict[str, int]] | None) -> tuple[list[tuple[int, int]], bytes]:
    """The removed runs, and the bytes that are kept."""
    runs = merged(spans)
    edges = [0, *(x for run in runs for x in run), len(data)]
    return runs, b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def cut_repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``row`` (all columns), ``n_bytes``, ``removed`` (byte spans) and ``kept`` (bytes).

    A byte goes if a string of ``length`` bytes over it starts anywhere else as well.
    Texts that are null, empty or shorter than that lose nothing. Rows that repeat id and
    text are one document: they are not each other's repeats and get the same result.
    """
    spans, _ = repeated_bytes(docs, length)
    rows = docs.select(whole_row(docs).alias("row"), *row_key(F.col("doc_id"), F.col("text"))).join(spans, [*KEY], "left")
    own = rows.select("row", "spans")

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        sizes, removed, kept = [], [], []
        for text, found in zip(batch.column(0).field("text").to_pylist(), batch.column(1).to_pylist()):
            data = (text or "").encode()
            runs, left = _cut(data, found)
            sizes.append(len(data))
            removed.append([{"start": a, "end": b} for a, b in runs])
            kept.append(left)
        return {"row": batch.column(0), "n_bytes": sizes, "removed": removed, "kept": kept}

    extra = T._parse_datatype_string("n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary").fields
    return per_batch(own, cut, T.StructType([own.schema["row"], *extra]))


def suffix_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, digest of what is kept.

    Only texts that may lose something are joined with their spans; the others keep the
    digest of the whole, and travel without their text.
    """
    spans, holders = repeated_bytes(docs, length)

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept": []}
        for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            runs, kept = _cut(text.encode(), found)
            out["n_removed"].append(sum(b - a for a, b in runs))
            out["n_spans"].append(len(runs))
            out["kept"].append(hashlib.sha256(kept).hexdigest())
        return {KEY[0]: batch.column(0), KEY[1]: batch.column(1)} | out

    schema = f"{KEY[0]} bigint, {KEY[1]} bigint, n_removed bigint, n_spans bigint, kept string"
    losing = per_batch(holders.join(spans, [*KEY]).select(*KEY, "text", "spans"), cut, schema).dropDuplicates([*KEY])
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    none = F.lit(0).cast("bigint")
    return whole.join(losing, [*KEY], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
    )
