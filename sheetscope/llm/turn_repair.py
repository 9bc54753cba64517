"""Repair of conversation structure by a run-length dynamic programme.

Rows of a conversation become symbols of role and fault. Equal neighbours collapse into
runs, first within range-sorted partitions, so that a conversation of very many rows is
read by many tasks. A symbol's cheapest edits between the states of the role pattern are a
min-plus matrix; a run of n symbols is its n-th power, made of cached binary powers.
Costs to go are carried backward over the runs, and the audit is unrolled forward, the
least letter first. Then the texts stream past their audit, in order, into the digest; no
task holds a conversation's texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetscope.llm.common import in_arrow, partitions
from sheetscope.session import cut_lineage

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
_SPACES = " \t\n\x0b\x0c\r"
_FAR = 1 << 60

#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a. An inserted or
#: rewritten row moves a state to ``_NEXT``; it is assistant where that state is 3.
_NEXT = (2, 2, 3, 2)
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
#: Cost from each state to the pattern's end by inserting alone.
_END = (0, 2 * INSERT, INSERT, 0)

#: Symbols: a role letter, in capitals where the row is truncated; "-" must be deleted.
GONE = "-"


def _actions(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of what may be done to a row, least letter first."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        more = TRUNCATED if symbol.isupper() else 0
        if state in (kept := _KEPT[symbol.lower()]):
            found.append(("K", more, kept[state]))
        found.append(("R", REROLE + more, _NEXT[state]))
    return found


def _product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


@cache
def _power(symbol: str, bit: int) -> tuple:
    """The min-plus matrix of 2**bit rows of one symbol, insertions before each included."""
    if bit:
        half = _power(symbol, bit - 1)
        return _product(half, half)
    inserts = [[_FAR] * 4 for _ in range(4)]
    for i in range(4):
        state, cost = i, 0
        while inserts[i][state] > cost:
            inserts[i][state] = cost
            state, cost = _NEXT[state], cost + INSERT
    step = [[_FAR] * 4 for _ in range(4)]
    for i in range(4):
        for _, cost, state in _actions(symbol, i):
            step[i][state] = min(step[i][state], cost)
    return _product(inserts, step)


def _before(symbol: str, n: int, after: tuple) -> tuple:
    """Costs to go before ``n`` rows of a symbol, from those after them."""
    bit = 0
    while n:
        if n & 1:
            matrix = _power(symbol, bit)
            after = tuple(min(c + v for c, v in zip(row, after)) for row in matrix)
        n, bit = n >> 1, bit + 1
    return after


def _unroll(symbol: str, n: int, state: int, after: tuple, out: list[str]) -> int:
    """Append the letters of ``n`` rows from ``state`` on; the state behind them."""
    if n > 1:
        middle = _unroll(symbol, n // 2, state, _before(symbol, n - n // 2, after), out)
        return _unroll(symbol, n - n // 2, middle, after, out)
    now = _before(symbol, 1, after)
    while True:
        choices = [(letter, cost + after[to], to) for letter, cost, to in _actions(symbol, state)]
        choices.insert(1, ("I", INSERT + now[_NEXT[state]], _NEXT[state]))
        letter, _, to = next(c for c in choices if c[1] == now[state])
        out.append(letter)
        state = to
        if letter != "I":
            return state


def cheapest_edits(runs: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of ``(symbol, rows)`` runs, ties ASCII-least."""
    goals = [_END]
    for symbol, n in reversed(runs):
        goals.append(_before(symbol, n, goals[-1]))
    goals.reverse()
    state, out = 0, []
    for (symbol, n), after in zip(runs, goals[1:]):
        state = _unroll(symbol, n, state, after, out)
    while _END[state]:
        out.append("I")
        state = _NEXT[state]
    return goals[0][0], "".join(out)


#: Short conversations repeat each other's runs.
_short_edits = lru_cache(4096)(cheapest_edits)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` after the seeded damage, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its
    role user. Nulls count as one space but for ``conv_id`` and ``turn``, which stay null.
    """
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind"))
    rows = rows.filter("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _units(conversations: DataFrame) -> DataFrame:
    """Equal rows of a turn as one, with their number ``n`` and a digest ``tie`` of role and text."""
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), known("role"), known("text"))
    units = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    named = F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return units.withColumn("tie", F.unhex(F.md5(named.cast("binary"))))


def _symbols(units: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``tie``, ``n``, role letter and first fault (b, d, t or none) of each unit.

    The first of equal texts of a conversation is found by a combining aggregate, and joined
    back by its whole place, so that a text that fills a conversation weighs one row a task.
    """
    bare = F.rtrim("text", F.lit(_SPACES))
    letter = F.substring("role", 1, 1)
    own = units.select(
        "conv_id",
        "turn",
        "tie",
        "n",
        F.when(letter.isin("s", "u", "a"), letter).otherwise("x").alias("letter"),
        F.when(bare == "", "b").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("").alias("fault"),
    )
    first = own.filter("fault <> 'b'").groupBy("conv_id", "tie").agg(F.min(F.struct("turn")).alias("at"))
    first = first.select(F.col("conv_id").alias("c"), F.col("tie").alias("t"), F.col("at.turn").alias("at"), F.lit(True).alias("new"))
    met = own.join(first, own.conv_id.eqNullSafe(F.col("c")) & own.turn.eqNullSafe(F.col("at")) & (own.tie == F.col("t")), "left")
    fault = F.when((F.col("fault") == "b") | F.col("new"), F.col("fault")).otherwise("d").alias("fault")
    return met.select("conv_id", "turn", "tie", "n", "letter", fault)


_SEGMENT = (
    "conv_id {0}, turn bigint, tie binary, symbols string, counts array<bigint>, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, first_letter string, last_letter string, least bigint, most bigint, turns bigint, first_turn bigint, last_turn bigint"
)
_LEGAL = {"su", "ua", "au"}


class _Segment:
    """What a stretch of one conversation's sorted rows comes to."""

    def __init__(self, turn: int | None, tie: bytes | None):
        self.turn, self.tie = turn, tie
        self.symbols: list[str] = []
        self.counts: list[int] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_letter = self.last_letter = self.least = self.most = self.first_turn = self.last_turn = None

    def _run(self, symbol: str, n: int) -> None:
        if self.symbols and self.symbols[-1] == symbol:
            self.counts[-1] += n
        elif n:
            self.symbols.append(symbol)
            self.counts.append(n)

    def _follow(self, first_letter: str, last_letter: str, first_turn: int | None, last_turn: int | None, turns: int) -> None:
        if self.last_letter is None:
            self.first_letter = first_letter
        elif self.last_letter + first_letter not in _LEGAL:
            self.illegal += 1
        self.last_letter = last_letter
        if first_turn is not None:
            self.turns += turns - (self.last_turn == first_turn)
            self.first_turn = first_turn if self.first_turn is None else self.first_turn
            self.least = first_turn if self.least is None else self.least
            self.most = self.last_turn = last_turn

    def unit(self, turn: int | None, n: int, letter: str, fault: str) -> None:
        self._follow(letter, letter, turn, turn, int(turn is not None))
        self.illegal += n - 1
        if fault == "b":
            self.blank += n
        elif fault == "d":
            self.duplicate += n
        else:
            self.truncated += fault == "t"
            self.duplicate += n - 1
            self._run(letter.upper() if fault == "t" else letter, 1)
            n -= 1
        self._run(GONE, n)

    def join(self, other: dict) -> None:
        """Take up the segment behind this one."""
        for symbol, n in zip(other["symbols"], other["counts"]):
            self._run(symbol, n)
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + other[name])
        self._follow(other["first_letter"], other["last_letter"], other["first_turn"], other["last_turn"], other["turns"])

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each stretch of a conversation among range-sorted units."""
    own, conv, done = None, None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "tie", "n", "letter", "fault")]
        for conv_id, turn, tie, n, letter, fault in zip(*columns):
            if own is None or conv_id != conv:
                if own is not None:
                    done.append(_row(conv, own))
                own, conv = _Segment(turn, tie), conv_id
            own.unit(turn, n, letter, fault)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if own is not None:
        done.append(_row(conv, own))
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=schema)


def _row(conv_id, own: _Segment) -> dict:
    return {"conv_id": conv_id, **vars(own), "symbols": "".join(own.symbols)}


class _Repair:
    """One conversation while its texts stream past the audit."""

    def __init__(self, conv_id):
        self.conv_id, self.parts, self.cost, self.audit = conv_id, _Segment(None, None), 0, None
        self.hash, self.at, self.written, self.state = hashlib.sha256(), 0, False, 0

    def start(self) -> None:
        runs = tuple(zip(self.parts.symbols, self.parts.counts))
        self.cost, self.audit = (_short_edits if len(runs) <= 64 else cheapest_edits)(runs)

    def _write(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.written else b"") + f"{role}:{text}".encode())
        self.written = True

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._placed("")

    def _placed(self, text: str) -> None:
        self.state = _NEXT[self.state]
        self._write("assistant" if self.state == 3 else "user", text)

    def row(self, role: str, text: str, n: int) -> None:
        for _ in range(n):
            self._inserts()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self.state = _KEPT[role[:1]][self.state]
                self._write(role, text)
            elif letter == "R":
                self._placed(text)

    def result(self) -> dict:
        if self.audit is None:
            self.start()
        self._inserts()
        own = self.parts
        counts = {name: getattr(own, name) for name in ("blank", "duplicate", "truncated", "illegal")}
        return {
            "conv_id": self.conv_id, "gaps": own.gaps(), **counts,
            "cost": self.cost, "audit": self.audit, "repaired_sha256": self.hash.hexdigest(),
        }


_RESULT = "conv_id {0}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _repairs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from its segments and then its texts in order."""
    own, done = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if own is None or r["conv_id"] != own.conv_id:
                if own is not None:
                    done.append(own.result())
                own = _Repair(r["conv_id"])
            if r["kind"] == 1:
                own.parts.join(r)
            elif r["kind"] == 2:
                if own.audit is None:
                    own.start()
                own.row(r["role"], r["text"], r["n"])
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if own is not None:
        done.append(own.result())
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=schema)


def repair_conversations(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired rows of every conversation.

    ``ids`` names conversations that are to be reported whether they have rows or not.

    Rows of a conversation come by turn, null turns first, and rows of one turn by a digest
    of role and text, equal ones together. A null role or text is one space. A role that
    does not begin with s, u or a can't be kept. A null ``conv_id`` is a conversation of
    its own. Without rows all counts are 0, the audit is empty and the digest that of the
    empty string. Other columns are not read, whatever their names. An empty table gives
    no rows. The digest of a conversation is one stream over its texts, which one task
    reads and does not hold; its symbols are collapsed by many.
    """
    spark = conversations.sparkSession
    ids = conversations if ids is None else ids
    kind_of_id = conversations.schema["conv_id"].dataType.simpleString()
    units = cut_lineage(_units(conversations))
    symbols = cut_lineage(_symbols(units))
    place = ("conv_id", "turn", "tie")
    ranged = symbols.repartitionByRange(partitions(spark), *place).sortWithinPartitions(*place)
    segments = _arrow(ranged, _segments, _SEGMENT.format(kind_of_id))
    known = ids.select("conv_id").distinct().withColumn("kind", F.lit(0))
    rows = known.unionByName(segments.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.unionByName(units.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    sorted_rows = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "tie")
    return _arrow(sorted_rows, _repairs, _RESULT.format(kind_of_id))


def _arrow(df: DataFrame, run, schema: str) -> DataFrame:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return in_arrow(df, lambda batches: run(batches, arrow), schema)


def repair_report(conversations: DataFrame) -> DataFrame:
    """The repairs of the damaged conversations, one row an original ``conv_id``."""
    return repair_conversations(damaged(conversations), conversations)
