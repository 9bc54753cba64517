"""Exact deduplication with an extendible-hash index on shared files.

The leading bits of a text's hash choose its bucket. A directory holds the buckets: it
starts with one and doubles, splitting only the buckets that are overfull. Owner tasks
then take whole buckets, chain the texts of equal hash, compare their bytes, and write
one record per distinct text. The members find their record by hash and digest.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheetscope.llm.common import in_arrow, lowered, partitions, per_batch, whole_row
from sheetscope.session import cut_lineage, shared_folder

#: Buckets per shuffle partition that the directory aims at.
BUCKETS_PER_PARTITION = 8
#: Bits by which the directory grows in one counting job.
BITS_A_ROUND = 8
#: A task hands on its distinct texts when it holds this many bytes of them.
HELD_BYTES = 16_000_000
HASHED = (T.StructField("hash", T.LongType()), T.StructField("digest", T.BinaryType()))


def _hashed(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``row`` (the ``carried`` columns), hash and digest of the normalised text.

    Normalised means A-Z lower-cased and null as empty. The hash is the head of the digest.
    """
    rows = docs.select(whole_row(docs, carried).alias("row"), *([] if "text" in carried else ["text"]))
    schema = T.StructType([rows.schema["row"], *HASHED])

    def digest(batch: pa.RecordBatch) -> dict[str, list]:
        row = batch.column(0)
        return {"row": row} | _digests(row.field("text") if "text" in carried else batch.column(1))

    return per_batch(rows, digest, schema)


def _digests(texts: pa.Array) -> dict[str, list]:
    """``hash`` and ``digest`` of each normalised text."""
    digests = [hashlib.sha256(lowered(t)).digest() for t in texts.to_pylist()]
    return {"hash": [int.from_bytes(d[:8], "big", signed=True) for d in digests], "digest": digests}


def _sizes(docs: DataFrame) -> DataFrame:
    """``hash`` and ``bytes`` of each normalised text."""

    def measure(batch: pa.RecordBatch) -> dict[str, list]:
        texts = [lowered(t) for t in batch.column(0).to_pylist()]
        heads = [hashlib.sha256(t).digest()[:8] for t in texts]
        return {"hash": [int.from_bytes(h, "big", signed=True) for h in heads], "bytes": [len(t) for t in texts]}

    return per_batch(docs.select("text"), measure, "hash bigint, bytes bigint")


def directory(keys: DataFrame, capacity: int) -> np.ndarray:
    """First hash of each bucket, in order, as unsigned numbers.

    ``keys`` has ``hash`` and ``bytes``, one row per hash. A bucket over ``capacity``
    bytes that still holds several hashes is split one bit at a time; each round counts
    the overfull ones ``BITS_A_ROUND`` bits deeper, which is as many doublings in one
    job. Only counts by bucket reach the driver, never hashes of documents.
    """
    done: list[int] = []
    overfull, depth = {0}, 0
    while overfull:
        deeper = min(depth + BITS_A_ROUND, 64)
        prefix = F.shiftrightunsigned("hash", 64 - deeper)
        own = keys
        if depth:
            above = F.shiftrightunsigned("hash", 64 - depth)
            own = keys.join(F.broadcast(_column(keys.sparkSession, overfull)), above == F.col("prefix"), "left_semi")
        counted = own.groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        loads = {r["p"]: (r["b"], r["n"]) for r in counted}
        again: set[int] = set()
        for p in overfull:
            _split(p, depth, deeper, loads, capacity, done, again)
        overfull, depth = again, deeper
    return np.sort(np.array(done, np.uint64))


def _column(spark, prefixes: set[int]) -> DataFrame:
    return spark.createDataFrame(pa.table({"prefix": pa.array(sorted(prefixes), pa.int64())}))


def _split(p: int, depth: int, deepest: int, loads: dict, capacity: int, done: list, again: set) -> None:
    """Halve bucket ``p`` of ``depth`` bits until its parts fit; those too deep go ``again``."""
    width = deepest - depth
    parts = [loads[q] for q in range(p << width, (p + 1) << width) if q in loads]
    if sum(b for b, _ in parts) <= capacity or sum(n for _, n in parts) <= 1:
        done.append(p << (64 - depth))
    elif not width:
        again.add(p)
    else:
        for half in (2 * p, 2 * p + 1):
            _split(half, depth + 1, deepest, loads, capacity, done, again)


def build_index(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Build the index in ``folder`` and return its records, one per distinct text.

    ``bucket``, ``hash``, ``chain`` (number among the texts of that hash), ``digest``,
    ``keep_id``, ``group_size`` and ``row``, the whole row that stays. Each task first
    joins the copies it reads, so that a text held by a third of all rows reaches its
    owner as one row per task. The bucket capacity is the texts' bytes over
    ``BUCKETS_PER_PARTITION`` times the session's shuffle partitions.
    """
    spark = docs.sparkSession
    keys = cut_lineage(_sizes(docs).groupBy("hash").agg(F.max("bytes").alias("bytes")))
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    owners = partitions(spark)
    buckets = spark.sparkContext.broadcast(directory(keys, max(1, total // (BUCKETS_PER_PARTITION * owners))))

    rows = docs.select(whole_row(docs).alias("row"))
    gathered_schema = T.StructType([T.StructField("bucket", T.LongType()), rows.schema["row"], *HASHED, T.StructField("n", T.LongType())])
    # Hashed and joined in one Python step: each further step of a task is a worker more, which idles on.
    gathered = in_arrow(rows, lambda batches: _gather(batches, buckets.value, to_arrow_schema(gathered_schema)), gathered_schema)
    owned = gathered.repartition(owners, "bucket").sortWithinPartitions("bucket", "hash")

    record_schema = T.StructType(
        [
            T.StructField("bucket", T.LongType()),
            T.StructField("hash", T.LongType()),
            T.StructField("chain", T.IntegerType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("group_size", T.LongType()),
            T.StructField("row", docs.schema),
        ]
    )
    records = in_arrow(owned, lambda batches: _chain(batches, to_arrow_schema(record_schema)), record_schema)
    path = f"{folder or shared_folder(spark)}/index-{uuid.uuid4().hex}"
    records.write.parquet(path)
    return spark.read.schema(record_schema).parquet(path).withColumn("keep_id", F.col("row.doc_id"))


def _gather(batches: Iterator[pa.RecordBatch], buckets: np.ndarray, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Join the copies that one task reads: the row of the largest id, and their number.

    Only positions are kept in Python; the rows stay in Arrow.
    """
    held, size = [], 0
    for batch in batches:
        row = batch.column(0)
        made = _digests(row.field("text"))
        held.append(pa.RecordBatch.from_arrays([row, pa.array(made["hash"], pa.int64()), pa.array(made["digest"], pa.binary())], names=["row", *made]))
        size += held[-1].nbytes
        if size >= HELD_BYTES:
            yield from _joined(held, buckets, arrow)
            held, size = [], 0
    if held:
        yield from _joined(held, buckets, arrow)


def _joined(held: list[pa.RecordBatch], buckets: np.ndarray, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    best: dict[bytes, list] = {}
    texts: dict[bytes, bytes] = {}
    for b, batch in enumerate(held):
        rows = batch.column(0)
        ids, own = rows.field("doc_id").to_pylist(), rows.field("text").to_pylist()
        for i, (doc_id, text, digest) in enumerate(zip(ids, own, batch.column(2).to_pylist())):
            entry = best.get(digest)
            if entry is None:
                best[digest], texts[digest] = [doc_id, b, i, 1], text
                continue
            if lowered(texts[digest]) != lowered(text):
                raise ValueError("two texts share a SHA-256 digest")
            entry[3] += 1
            if doc_id is not None and (entry[0] is None or doc_id > entry[0]):
                entry[:3] = doc_id, b, i
    for b, batch in enumerate(held):
        chosen = [(i, n) for _, at, i, n in best.values() if at == b]
        if chosen:
            part = batch.take(pa.array([i for i, _ in chosen], pa.int64()))
            hashes = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            bucket = np.searchsorted(buckets, hashes, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int64)), *part.columns, pa.array([n for _, n in chosen], pa.int64())], schema=arrow
            )


def _chain(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One record per distinct text of an owner's buckets, which come sorted by hash.

    Only the chain of the current hash is in memory.
    """
    current, chain = None, []
    for batch in batches:
        rows = batch.column(1)
        out: list[dict] = []
        keys = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())
        ids, texts = rows.field("doc_id").to_pylist(), rows.field("text").to_pylist()
        for i, (key, doc_id, text, digest, n) in enumerate(zip(keys, ids, texts, batch.column(3).to_pylist(), batch.column(4).to_pylist())):
            if key != current:
                out += chain
                current, chain = key, []
            data = lowered(text)
            node = next((x for x in chain if x["data"] == data), None)
            if node is None:
                chain.append(
                    {"bucket": key[0], "hash": key[1], "chain": len(chain), "digest": digest, "group_size": n,
                     "data": data, "id": doc_id, "row": rows[i]}
                )
                continue
            node["group_size"] += n
            if doc_id is not None and (node["id"] is None or doc_id > node["id"]):
                node["id"], node["row"] = doc_id, rows[i]
        if out:
            yield _records(out, arrow)
    if chain:
        yield _records(chain, arrow)


def _records(nodes: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[f.name].as_py() if f.name == "row" else x[f.name] for x in nodes], f.type) for f in arrow], schema=arrow
    )


def exact_duplicates(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the id that stays, the group's size, the digest.

    Null texts count as empty, null ids as smaller than any. If all ids of a group are
    null, its ``keep_id`` is null. Rows that repeat id and text are one document given
    twice and are all marked as kept; ``drop_exact_duplicates`` keeps one of them.
    """
    records = build_index(docs.select("doc_id", "text"), folder).select("hash", "digest", "keep_id", "group_size")
    members = _hashed(docs, ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "hash", "digest")
    return members.join(records, ["hash", "digest"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per distinct text, all columns, that of the largest id."""
    return build_index(docs, folder).select("row.*")
