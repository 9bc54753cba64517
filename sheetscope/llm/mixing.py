"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern, the set of sources they belong to. A flow
network routes the patterns' word capacity to the sources' quotas; each further pass
over a pattern costs more, so repetition is spread as thin as it can be. The documents
of a pattern's last, partial pass are then chosen in a seeded order.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheetscope.llm.common import whole_row
from sheetscope.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
SEED = "mix"
#: Hex digits of the seeded order by which a pattern's documents are counted first.
DIGITS = 3

Pattern = tuple[str | None, ...]


def text_size(text: Column) -> Column:
    """Words of a text, cut at ASCII white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def share_targets(sizes: dict[str | None, int], total: int, weights: Sequence[int], passes: int) -> dict[str | None, float]:
    """Each source's target: ``total`` shared by weight, at most ``passes`` times its size.

    Sources stand in code point order, null last, and take the weights in turn. What a
    source cannot take is shared again among the others by weight.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    targets: dict[str | None, float] = {}
    rest, left = total, sum(weight.values())
    for s in sorted(names, key=lambda s: passes * sizes[s] / weight[s]):
        cap = passes * sizes[s]
        if cap * left > weight[s] * rest:
            break
        targets[s] = float(cap)
        rest, left = rest - cap, left - weight[s]
    return {s: targets[s] if s in targets else weight[s] * rest / left for s in names}


def route(capacity: dict[Pattern, int], demand: dict[str | None, int], passes: int) -> dict[Pattern, int]:
    """Words taken of each pattern by the cheapest flow that meets the most demand.

    Pass k of a pattern holds its capacity once more at cost k, a convex price, so a
    cheapest flow never repeats one pattern while another can serve unrepeated.
    Successive shortest paths over potentials; ties go by pattern order.
    """
    patterns, sources = list(capacity), list(demand)
    nodes = len(patterns) + len(sources) + 2
    start, end = nodes - 2, nodes - 1
    number = {s: len(patterns) + i for i, s in enumerate(sources)}
    graph: list[list[list[int]]] = [[] for _ in range(nodes)]  # to, room, cost, place of the reverse

    def link(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, p in enumerate(patterns):
        for k in range(passes):
            link(start, i, capacity[p], k)
        for s in p:
            link(i, number[s], passes * capacity[p], 0)
    for s in sources:
        link(number[s], end, demand[s], 0)

    potential = [0] * nodes
    while True:
        far: list[float] = [float("inf")] * nodes
        far[start], via, heap = 0, [None] * nodes, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for edge in graph[a]:
                b, room, cost, _ = edge
                if room and d + cost + potential[a] - potential[b] < far[b]:
                    far[b], via[b] = d + cost + potential[a] - potential[b], (a, edge)
                    heapq.heappush(heap, (far[b], b))
        if via[end] is None:
            break
        potential = [p + f if f < float("inf") else p for p, f in zip(potential, far)]
        path, at = [], end
        while at != start:
            at, edge = via[at]
            path.append(edge)
        room = min(edge[1] for edge in path)
        for edge in path:
            edge[1] -= room
            graph[edge[0]][edge[3]][1] += room
    return {p: sum(capacity[p] - e[1] for e in graph[start] if e[0] == i) for i, p in enumerate(patterns)}


def mix_sources(
    docs: DataFrame, membership: Column | None = None, weights: Sequence[int] = WEIGHTS, passes: int = MAX_PASSES, seed: str = SEED
) -> DataFrame:
    """``row`` (all columns of ``docs``), ``size``, ``taken``, ``source_size``, ``target``.

    ``membership`` is an array of the sources a document belongs to; ``source`` alone
    by default, null being a source of its own. ``taken`` is the words the mix takes
    of a document, repeats counted: whole passes, and one more for those that come first
    in the seeded order until the pattern's share is met to within half a document.
    ``source_size`` and ``target`` are of the first source of the pattern.

    Only one row per pattern and one per source reach the driver. Texts that are null or
    blank have size 0 and are taken 0 times. Rows repeated whole stand at the same place
    in the order and are taken together. Empty input gives an empty result.
    """
    member = F.array("source") if membership is None else F.array_sort(F.array_distinct(membership))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    base = docs.select(whole_row(docs).alias("row"), text_size(F.col("text")).alias("size"), member.alias("pattern"), order.alias("place"))

    narrow = cut_lineage(base.groupBy("pattern", F.substring("place", 1, DIGITS).alias("bucket")).agg(F.sum("size").alias("size")))
    capacity = {tuple(r["pattern"]): r["size"] for r in narrow.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    capacity = dict(sorted(capacity.items(), key=lambda x: [(s is None, s or "") for s in x[0]]))
    sizes: dict[str | None, int] = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = share_targets(sizes, sum(capacity.values()), weights, passes)
    flow = route(capacity, {s: int(t + 0.5) for s, t in targets.items()}, passes)

    schema = T._parse_datatype_string("pattern array<string>, whole bigint, rest bigint, source_size bigint, target double")
    shares = [
        (list(p), flow[p] // n if n else 0, flow[p] % n if n else 0, sizes[p[0]] if p else 0, targets[p[0]] if p else 0.0)
        for p, n in capacity.items()
    ]
    # From Arrow: rows given as Python objects would start workers of their own, which idle on.
    plan = docs.sparkSession.createDataFrame(
        pa.Table.from_pylist([dict(zip(schema.names, s)) for s in shares], to_arrow_schema(schema)), schema
    )
    last = _last_places(base, narrow, plan)
    chosen = F.coalesce(F.col("place") <= F.col("last"), F.lit(False))
    return (
        base.join(plan.join(last, "pattern", "left"), "pattern")
        .select("row", "size", "source_size", "target", (F.col("size") * (F.col("whole") + chosen.cast("bigint"))).alias("taken"))
    )


def _last_places(base: DataFrame, narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """``pattern`` and ``last``, the place up to which its documents get one more pass.

    Sizes by bucket of the order tell in which bucket a pattern's share ends; only the
    documents of that bucket are then put in order.
    """
    before = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        narrow.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(plan.filter("rest > 0"), "pattern")
        .filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("size")))
        .select("pattern", "bucket", "before", "rest")
    )
    inner = W.partitionBy("pattern").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    within = (
        base.select("pattern", "size", "place", F.substring("place", 1, DIGITS).alias("bucket"))
        .join(ends, ["pattern", "bucket"])
        .groupBy("pattern", "bucket", "before", "rest", "place")
        .agg(F.sum("size").alias("size"))
        .withColumn("done", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .filter(F.col("done") + F.col("size") / 2 <= F.col("rest"))
        .groupBy("pattern")
        .agg(F.max("place").alias("inside"))
    )
    # Where not even the first document of the last bucket fits, the share ends before it.
    return ends.join(within, "pattern", "left").select("pattern", F.coalesce("inside", "bucket").alias("last"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, with ``taken`` and ``repeats``, the passes over each.

    All columns of ``docs`` stay. Where one has such a name already, the mix's own takes
    ``mix_`` before it.
    """
    passes = (F.col("taken") / F.col("size")).cast("int").alias(_free("repeats", docs.columns))
    taken = F.col("taken").alias(_free("taken", docs.columns))
    return mix_sources(docs, **options).filter("taken > 0").select("row.*", taken, passes)


def _free(name: str, used: Sequence[str]) -> str:
    """``name``, after as many ``mix_`` as it takes to clash with none of ``used``."""
    while name.lower() in {c.lower() for c in used}:
        name = f"mix_{name}"
    return name
