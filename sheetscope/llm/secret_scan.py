"""Secret scans over a trigram inverted index, in DataFrame functions alone.

Each rule's regex yields a Boolean query over the trigrams that a match must hold. The
postings of those trigrams are intersected, and only the documents that satisfy a rule's
query are read with its regex. Rules without a mandatory trigram read every document.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetscope.llm.common import KEY, row_key, whole_row
from sheetscope.session import cut_lineage

#: More alternatives than this are not spelled out when a query is derived.
SPELLED = 64
BITS = 60

Query = list[frozenset[str]]  # any of these sets of trigrams, whole


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, and the group that must have ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


# The three base kinds in their order, then the added ones. A maximal run
# of a class that is long enough is what the class with that least count matches.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = ("assign", "access", "hex")


def trigram_query(regex: str) -> Query | None:
    """What a match must hold, in lower case; ``None`` if no trigram is mandatory.

    The regex is walked from left to right. Strings that the part read so far must spell
    are kept while they are few; where a part can't be spelled out, they are turned into
    trigrams, any spelling's all.
    """
    parts = _walk(parser.parse(regex))
    best: Query | None = None
    for spelled in parts:
        own = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in spelled]
        if all(own):
            best = _and(best, own)
    return best


def _and(a: Query | None, b: Query) -> Query:
    both = b if a is None else [x | y for x in a for y in b]
    # A set that holds another adds nothing to "any of".
    return sorted({x for x in both if not any(y < x for y in both)}, key=sorted)


def _walk(tree) -> list[set[str]]:
    """Runs of spelled-out strings, each between parts that can't be spelled."""
    runs: list[set[str]] = [{""}]
    for op, argument in tree:
        spelled = _spell(op, argument)
        if spelled is None:
            inner = _walk(argument[-1]) if op is C.SUBPATTERN else []
            runs += [*inner, {""}]
        elif len(runs[-1]) * len(spelled) > SPELLED:
            runs.append(spelled)
        else:
            runs[-1] = {a + b for a in runs[-1] for b in spelled}
    return runs


def _spell(op, argument) -> set[str] | None:
    """All strings of one part in lower case, if they are few."""
    if op is C.LITERAL:
        return {chr(argument).lower()}
    if op is C.IN:
        if all(o is C.LITERAL for o, _ in argument) and len(argument) <= 8:
            return {chr(a).lower() for _, a in argument}
        return None
    if op is C.SUBPATTERN:
        return _spell_all(argument[-1])
    if op is C.BRANCH:
        alternatives = [_spell_all(a) for a in argument[1]]
        return None if any(a is None for a in alternatives) else set().union(*alternatives)
    if op is C.MAX_REPEAT and argument[1] == 1:
        inner = _spell_all(argument[2])
        return inner if inner is None or argument[0] else inner | {""}
    return None


def _spell_all(tree) -> set[str] | None:
    runs = _walk(tree)
    return runs[0] if len(runs) == 1 else None


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: ``trigram`` (its number) and the ``KEY`` of each text that holds it."""
    low = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select(*KEY, F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, Query], trigrams: list[str]) -> DataFrame:
    """``KEY`` and, by kind, whether the text satisfies the kind's query.

    The postings of a text are joined into bits, in the task first; a set of trigrams is
    there whole when all its bits are.
    """
    number = {t: i for i, t in enumerate(trigrams)}
    words = range(-(-len(trigrams) // BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("trigram") % BITS).cast("int"))
    masks = index.groupBy(*KEY).agg(
        *[F.bit_or(F.when(F.floor(F.col("trigram") / BITS) == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"m{w}") for w in words]
    )

    def whole(need: frozenset[str]) -> Column:
        own = {w: sum(1 << (number[t] % BITS) for t in need if number[t] // BITS == w) for w in words}
        tests = [F.col(f"m{w}").bitwiseAND(F.lit(n).cast("bigint")) == n for w, n in own.items() if n]
        return _all(tests)

    flags = {kind: _any([whole(need) for need in query]) for kind, query in queries.items()}
    return masks.select(*KEY, *[f.alias(k) for k, f in flags.items()]).filter(_any([F.col(k) for k in flags]))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


SPAN = "array<struct<start:int,place:int,end:int,kind:string>>"


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule's matches, leftmost and not overlapping, in code points.

    What lies between the matches is the text split at them; the lengths of both, summed,
    give the places.
    """
    regex = F.lit(rule.regex)
    zipped = F.arrays_zip(
        F.split(text, rule.regex, -1).alias("gap"),
        F.regexp_extract_all(text, regex, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("part"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["gap"])
        end = begin + F.coalesce(F.char_length(x["match"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        fits = x["match"].isNotNull() & (F.char_length(x["part"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(fits, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(zipped, start, step, lambda state: state["spans"])


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``spans``, by start, then rule.

    Null counts as empty and has no spans. Spans of different kinds may overlap. Rows
    that repeat id and text get the same spans. The index is written to the shared
    folder, so a lost executor costs no second build.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    trigrams = sorted({t for q in queries.values() for need in q for t in need})
    rows = docs.select(whole_row(docs).alias("row"), *row_key(F.col("doc_id"), F.col("text")))
    if queries:
        index = cut_lineage(postings(docs, trigrams))
        rows = rows.join(candidates(index, queries, trigrams), [*KEY], "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    none = F.array().cast(SPAN)
    found = [
        F.when(F.coalesce(F.col(r.kind), F.lit(False)), rule_spans(text, r, i)).otherwise(none) if r.kind in queries else rule_spans(text, r, i)
        for i, r in enumerate(rules)
    ]
    return rows.select("row", F.array_sort(F.concat(*found)).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secrets_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans."""
    found = scan_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def secrets_sql() -> str:
    """The same report in DuckDB's SQL."""
    parts = []
    for i, r in enumerate(RULES):
        regex = r.regex.replace("'", "''")
        parts.append(
            f"SELECT doc_id, t, {i} AS place, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, '{regex}') AS gaps, "
            f"regexp_extract_all(t, '{regex}') AS hits, regexp_extract_all(t, '{regex}', {r.group}) AS parts FROM d"
        )
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in BASE_KINDS)
    union = " UNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({union}),
s AS (
  SELECT doc_id, place, kind, length(hits[i]) AS n,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
  FROM m, range(1, len(hits) + 1) AS r(i) WHERE length(parts[i]) >= least
),
j AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS span FROM s),
g AS (
  SELECT doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (kind IN ({base})), '')) AS base_sha256,
    string_agg(span, ',' ORDER BY start, place) AS spans
  FROM j GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
