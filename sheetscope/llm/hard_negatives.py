"""Hard-negative mining with coordinate pruning over length buckets.

Rows are dealt evenly into blocks of bounded size, and every block meets the stated query
set, the anchors. A block sorts its rows by length into buckets; a bucket holds each
coordinate of its unit vectors as a sorted list. A query with a score to reach skips
buckets too short for it. In the others the score gives a range of feasible values for
each of its focus coordinates; rows in all ranges are candidates, and only these are
scored, exactly. Blocks return their first rows, windows merge them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheetscope.llm.common import in_arrow, partitions
from sheetscope.session import cut_lineage

POSITIVES = NEGATIVES = 5
#: A negative scores at least ``LOW`` hundredths of the positive.
LOW = 80
#: Components of a block, rows of a bucket, coordinates that a query looks at.
BLOCK_VALUES = 1 << 19
BUCKET = 1024
FOCUS = 4
_LAST = np.iinfo(np.int64).max
_SLACK = 1e-9


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``vector`` (floor of 256 times each component) of rows that take part.

    Rows with a null label, a null vector, or a null or non-finite component do not.
    """
    bad = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    own = rows.filter("label is not null and embedding is not null").filter(~bad)
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return own.select("vec_id", "label", vector.alias("vector"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), max(width, int(lengths.max(initial=0)))))
    rows = np.repeat(np.arange(len(column)), lengths)
    places = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, places] = flat
    return out


class _Bucket:
    """Rows of similar length with their coordinates sorted."""

    def __init__(self, vectors: np.ndarray, lengths: np.ndarray, rows: np.ndarray):
        self.vectors, self.rows, self.longest = vectors, rows, float(lengths[0])
        unit = vectors / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.values = np.asfortranarray(np.take_along_axis(unit, self.order, axis=0))

    def reaching(self, query: np.ndarray, unit: np.ndarray, length: float, score: float) -> np.ndarray | None:
        """Places of rows that may reach ``score``; None where no row can."""
        if score <= 0:
            return np.arange(len(self.rows))
        cosine = score / max(length * self.longest, 1e-300)
        if cosine > 1 + _SLACK:
            return None
        cosine = min(cosine, 1.0)
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        met = np.zeros(len(self.rows), np.int8)
        for f in focus:
            a = unit[f]
            spread = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - a * a)))
            high = a * cosine + spread if a < cosine else 1.0
            low = a * cosine - spread if a > -cosine else -1.0
            start = np.searchsorted(self.values[:, f], low - _SLACK, "left")
            end = np.searchsorted(self.values[:, f], high + _SLACK, "right")
            met[self.order[start:end, f]] += 1
        return np.flatnonzero(met == len(focus))


class Block:
    """Length buckets over some rows, which answer for the first rows of a query."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray):
        self.ids, self.labels, self.numbers, self.width = ids, labels, numbers, vectors.shape[1]
        self.greatest = float(np.abs(vectors).max(initial=0))
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        cuts = [order[i : i + BUCKET] for i in range(0, len(order), BUCKET)]
        self.buckets = [_Bucket(vectors[c], lengths[c], c) for c in cuts]

    def _scored(self, query: np.ndarray, reach) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(rows, scores)`` of the candidates, bucket by bucket; ``reach()`` is the score to reach by then."""
        length = float(np.sqrt(query @ query))
        if self.greatest * np.abs(query).sum() >= 2**53:
            raise ValueError("components are too large for exact scores")
        unit = query / max(length, 1e-300)
        for bucket in self.buckets:
            found = bucket.reaching(query, unit, length, reach())
            if found is None:
                return  # the buckets behind are shorter still
            if len(found):
                yield bucket.rows[found], bucket.vectors[found] @ query

    def _first(self, rows: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        return np.lexsort((self.ids[rows], -scores))[:n]

    def positives(self, query: np.ndarray, label: int, number: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` other rows of the label, and their scores."""
        rows, scores = np.empty(0, np.int64), np.empty(0)
        for found, got in self._scored(query, lambda: scores[-1] if len(scores) == n else -np.inf):
            own = (self.labels[found] == label) & (self.numbers[found] != number)
            rows, scores = np.append(rows, found[own]), np.append(scores, got[own])
            kept = self._first(rows, scores, n)
            rows, scores = rows[kept], scores[kept]
        return rows, scores

    def negatives(self, query: np.ndarray, label: int, tops: list[int], n: int, low: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each score in ``tops`` the first ``n`` rows of other labels in its band, and their scores."""
        best = [(np.empty(0, np.int64), np.empty(0)) for _ in tops]

        def reach() -> float:
            return min((s[-1] if len(s) == n else low * top / 100 for top, (_, s) in zip(tops, best) if top >= 0), default=np.inf)

        if reach() == np.inf:
            return best
        for found, got in self._scored(query, reach):
            other = self.labels[found] != label
            found, got = found[other], got[other]
            for i, top in enumerate(tops):
                band = (100 * got >= low * top) & (got <= top)
                rows, scores = np.append(best[i][0], found[band]), np.append(best[i][1], got[band])
                kept = self._first(rows, scores, n)
                best[i] = rows[kept], scores[kept]
        return best


def _blocks(batches: Iterator[pa.RecordBatch], answer, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Meet each block's rows (kind 0) with the queries behind them (kind 1)."""
    block, number, held = None, None, []
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero(np.diff(blocks) | np.diff(kinds)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(blocks)]):
            part = batch.slice(start, end - start)
            if blocks[start] != number:
                block, number, held = None, blocks[start], []
            if kinds[start] == 0:
                held.append(part)
                continue
            if block is None:
                block, held = _block(held), []
            if block is not None:
                out = {f.name: [] for f in schema}
                for i, query in enumerate(_matrix(part.column("vector"), block.width)):
                    answer(block, part, i, query, out)
                yield pa.RecordBatch.from_pydict(out, schema=schema)


def _block(parts: list[pa.RecordBatch]) -> Block | None:
    if not parts:
        return None
    width = max(int(np.diff(p.column("vector").offsets.to_numpy()).max(initial=0)) for p in parts)
    whole = lambda name: np.concatenate([p.column(name).fill_null(_LAST).to_numpy() for p in parts])
    return Block(np.concatenate([_matrix(p.column("vector"), width) for p in parts]), whole("vec_id"), whole("label"), whole("row"))


def _fitted(block: Block, query: np.ndarray) -> np.ndarray:
    """A query as wide as the block: components that no row has add nothing."""
    return query[: block.width]


def _met(rows: DataFrame, queries: DataFrame, blocks: int, answer, schema: str) -> DataFrame:
    """``answer`` to every query in every block."""
    everywhere = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    both = rows.withColumn("kind", F.lit(0)).unionByName(everywhere.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(min(blocks, 4 * partitions(rows.sparkSession)), "block").sortWithinPartitions("block", "kind")
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return in_arrow(dealt, lambda batches: _blocks(batches, answer, arrow), schema)


def _nullable(value) -> int | None:
    return None if value == _LAST else int(value)


def _ranked(df: DataFrame, by: list[str], score: str, name: str, rank: str, n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.col(name).asc_nulls_last())
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, block_values: int = BLOCK_VALUES
) -> DataFrame:
    """Hard negatives of each positive of each anchor, ranked from 1.

    ``rows`` has ``vec_id``, ``label`` and ``vector``, an array of integers; ``anchor`` is
    a predicate over it. A score is the inner product; ties go to the smaller id, null ids
    last. Rows are told apart by place, so rows that repeat an id are rows of their own.
    Shorter vectors count as filled up with zeros. Without another row of its label an
    anchor gives no rows; a positive of negative score has no band. Components must be
    small enough for exact scores in 53 bits, else the run raises.
    """
    held = cut_lineage(rows.select("vec_id", F.col("label").cast("bigint").alias("label"), "vector", F.monotonically_increasing_id().alias("row")))
    values = held.agg(F.sum(F.size("vector") + 1)).head()[0] or 0
    blocks = max(1, -(-values // block_values))
    held_rows = held.withColumn("block", F.col("row") % blocks)
    anchors = held.filter(F.coalesce(anchor, F.lit(False)))

    def own_label(block: Block, part: pa.RecordBatch, i: int, query: np.ndarray, out: dict) -> None:
        row, label = part.column("row")[i].as_py(), part.column("label")[i].as_py()
        for j, score in zip(*block.positives(_fitted(block, query), label, row, positives)):
            out["anchor"].append(row)
            out["positive_id"].append(_nullable(block.ids[j]))
            out["positive_score"].append(int(score))

    found = _met(held_rows, anchors, blocks, own_label, "anchor bigint, positive_id bigint, positive_score bigint")
    found = _ranked(found, ["anchor"], "positive_score", "positive_id", "place", positives)
    tops = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("tops"))
    asked = anchors.join(tops, anchors.row == tops.anchor).drop("anchor")
    asked = cut_lineage(asked)

    def other_labels(block: Block, part: pa.RecordBatch, i: int, query: np.ndarray, out: dict) -> None:
        row, label, named = (part.column(c)[i].as_py() for c in ("row", "label", "tops"))
        best = block.negatives(_fitted(block, query), label, [t["positive_score"] for t in named], negatives, low)
        for top, (js, scores) in zip(named, best):
            for j, score in zip(js, scores):
                out["anchor"].append(row)
                out["place"].append(top["place"])
                out["negative_id"].append(_nullable(block.ids[j]))
                out["negative_score"].append(int(score))

    mined = _met(held_rows, asked, blocks, other_labels, "anchor bigint, place int, negative_id bigint, negative_score bigint")
    mined = _ranked(mined, ["anchor", "place"], "negative_score", "negative_id", "rank", negatives)
    pairs = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.inline("tops"))
    return mined.join(pairs, ["anchor", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Rows whose id is divisible by ``every`` get the next label."""
    moved = F.col("vec_id") % every == 0
    return rows.withColumn("label", F.when(moved, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def negatives_report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100, labels moved where it is by 7."""
    return hard_negatives(relabelled(usable(embeddings)), F.col("vec_id") % 100 == 0)


def negatives_sql() -> str:
    """The same rows in SQL."""
    return f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
