"""Line runs, turn repair and hard negatives against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from helpers import awkward, documents
from pyspark.sql import functions as F

from sheetscope.llm import hard_negatives, line_runs, turn_repair

SPACES = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Lines


def line_truth(rows, chars, documents_):
    """``rows`` of (id, text); rows that repeat both are one document."""
    key = lambda line: line.strip(SPACES).translate(UPPER)
    holders = {}
    for i, t in set(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                holders.setdefault(k, []).append(i)
    small = lambda i: -(2**63) if i is None else i
    keep = {k: max(own, key=small) for k, own in holders.items() if len(own) >= documents_}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keep.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def noisy_rows(seed, n):
    r = random.Random(seed)
    pool = [f"{r.choice('  ')}Shared line number {i} {'é' * r.randrange(3)}  ends here" for i in range(12)]
    rows = []
    for i in range(n):
        lines = [r.choice([*pool, r.choice(pool).upper(), "", "short", f"own line of document {i} {r.random()}"]) for _ in range(r.randrange(8))]
        rows.append((r.choice([i, i, i, None, 3]), "\n".join(lines), "a"))
    return [*rows, *rows[:4], (900, "\n".join(f"shared LINE number {i}   ends here" for i in range(12)) * 40, "a"), (901, None, None), (902, "", "a")]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2)])
def test_lines_against_brute_force(spark, batches, fanout):
    rows = noisy_rows(batches, 60)
    docs = documents(spark, rows)
    cut = line_runs.repeated_lines(docs, chars=12, documents=3, batches=batches, fanout=fanout)
    found = cut.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256))
    truth = line_truth([(i, t) for i, t, _ in rows], 12, 3)
    assert rows_of(found) == truth and sum(r[2] for r in truth) > 50
    dropped = line_runs.drop_repeated_lines(docs, chars=12, documents=3, batches=batches, fanout=fanout)
    assert dropped.columns == docs.columns and dropped.count() == len(rows)


def test_lines_report_on_awkward_rows(spark):
    docs = awkward(spark)
    more = documents(spark, [(i, "This very line of more than forty points returns.\nx", "a") for i in range(20, 27)])
    both = docs.unionByName(more).withColumn("a.b", F.lit(1))
    truth = line_truth([(r["doc_id"], r["text"]) for r in both.collect()], 40, 5)
    assert rows_of(line_runs.lines_report(both)) == truth
    assert line_runs.lines_report(documents(spark, [])).count() == 0
    assert "a.b" in line_runs.drop_repeated_lines(both).columns


def test_a_batch_is_merged_with_the_runs_and_only_new_hashes_are_its_own(spark):
    made = lambda ids: spark.createDataFrame([(d, 0, h, h) for d, h in ids], "_k0 bigint, _k1 bigint, h0 bigint, h1 bigint")
    runs = line_runs.LineRuns(spark, fanout=2)
    assert rows_of(runs.add(made([(9, 1), (9, 1), (8, 1), (8, 2)]))) == [(1, 1, 2, 9), (2, 2, 1, 8)]
    assert rows_of(runs.add(made([(7, 2), (7, 3)]))) == [(3, 3, 1, 7)]
    assert [len(level) for level in runs.levels] == [0, 1]  # two runs became one of the next level
    assert rows_of(runs.add(made([(6, 1), (5, 3), (5, 4)]))) == [(4, 4, 1, 5)]
    assert rows_of(runs.totals()) == [(1, 1, 3, 9), (2, 2, 2, 8), (3, 3, 2, 7), (4, 4, 1, 5)]
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_plans_hold_no_python(spark):
    plan = line_runs.lines_report(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


# Turns


def allowed(symbols, audit):
    """Cost of an audit over ``(letter, truncated, gone)`` rows, or None where it is no repair."""
    length = sum(c != "D" for c in audit)
    roles = ["s"] * (length % 2) + ["u", "a"] * (length // 2)
    if sum(c != "I" for c in audit) != len(symbols) or (length % 2 and length < 3):
        return None
    cost, rows, out = 0, iter(symbols), iter(roles)
    for c in audit:
        if c == "I":
            cost += 2
            if next(out) == "s":
                return None
            continue
        letter, truncated, gone = next(rows)
        if c == "D":
            cost += 3
            continue
        role = next(out)
        if gone or (c == "K" and role != letter) or (c == "R" and role == "s"):
            return None
        cost += truncated + 2 * (c == "R")
    return cost


def best_audit(symbols):
    found = []
    for n in range(len(symbols), len(symbols) + 4):
        for audit in itertools.product("DIKR", repeat=n):
            cost = allowed(symbols, audit)
            if cost is not None:
                found.append((cost, "".join(audit)))
    return min(found)


def test_cheapest_edits_against_all_audits():
    r = random.Random(5)
    for trial in range(120):
        symbols = [(r.choice("suuaax"), r.random() < 0.3, r.random() < 0.15) for _ in range(r.randrange(5))]
        coded = [turn_repair.GONE if gone else (letter.upper() if t else letter) for letter, t, gone in symbols]
        runs = tuple((c, len(list(g))) for c, g in itertools.groupby(coded))
        assert turn_repair.cheapest_edits(runs) == best_audit(symbols), (trial, symbols)


def test_a_long_run_costs_as_its_rows_do():
    for symbol in ("u", "U", "a", "s", "x", turn_repair.GONE):
        for n in (1, 2, 3, 7, 64, 1000):
            split = turn_repair.cheapest_edits(((symbol, 1),) * n)
            assert turn_repair.cheapest_edits(((symbol, n),)) == split and len(split[1]) >= n


def damage(conv, turn, role, text):
    name = lambda v: " " if v is None else str(v)
    kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
    role, text = name(role), name(text)
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def repaired(conv, rows):
    """The report of one conversation, row by row, with one run a row."""
    tie = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, tie(r)))
    seen, faults, symbols = set(), [], []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        symbols.append(turn_repair.GONE if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
    turns = {r[1] for r in rows} - {None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = turn_repair.cheapest_edits(tuple((s, 1) for s in symbols))
    length, at, out = sum(c != "D" for c in audit), 0, []
    roles = ["system"] * (length % 2) + ["user", "assistant"] * (length // 2)
    for c in audit:
        text = ""
        if c != "I":
            _, _, role, text = rows[at]
            at += 1
        if c != "D":
            new = roles[len(out)]
            out.append(f"{role if c == 'K' else new}:{text}")
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def conversation_rows(seed, n):
    r = random.Random(seed)
    texts = ["Hello there.", "And you?", "no end", " \t", "", None, "Same.", "Same.", "a" * 3000 + "!", "été 日本"]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(r.randrange(9)):
            rows.append((conv, r.choice([turn, turn, turn + 2, None, 1]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(texts)))
    return rows + rows[:7] + [(777, t, "user", "Same.") for t in range(300)] + [(778, t, "ua"[t % 2] + "x", f"t{t}.") for t in range(201)]


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_turn_repair_against_brute_force(spark, partitions):
    rows = conversation_rows(3, 60)
    conversations = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, n int, `fault.x` string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = rows_of(turn_repair.repair_report(conversations))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    own = {r[0]: [] for r in rows}
    for r in rows:
        own[r[0]] += damage(*r)
    truth = sorted((repaired(conv, kept) for conv, kept in own.items()), key=repr)
    assert found == truth


def test_turn_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert turn_repair.repair_report(empty).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hi.")], empty.schema)
    assert rows_of(turn_repair.repair_report(one)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# Hard negatives


def negatives_truth(rows):
    """``rows`` of (id, vector, label), told apart by place."""
    own = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    last = lambda i: 2**63 if i is None else i
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for at, (i, label, v) in enumerate(own):
        if i is None or i % 100:
            continue
        scored = [(score(v, w), j, m) for k, (j, m, w) in enumerate(own) if k != at]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            band = [s for s in scored if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps][:5]
            out += [(i, p, rank, j, ps, ns) for rank, (ns, j, _) in enumerate(band, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_values", [1 << 19, 400])
def test_hard_negatives_against_brute_force(spark, block_values, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", 16)
    r = np.random.default_rng(4)
    centres = r.normal(size=(4, 8))
    rows = [(i, (centres[i % 4] + r.normal(size=8) * 0.5).tolist(), int(r.integers(3))) for i in range(0, 1500, 5)]
    rows += [(7, [0.5] * 8, 1)] * 30 + [(None, [0.5] * 8, 2), (100, [0.0] * 8, 1), (200, [], 2), (300, [1.0, 2.0], 0)]
    rows += [(400, None, 1), (500, [1.0] * 8, None), (600, [1.0, None], 1), (700, [float("nan")] * 8, 1), (800, [float("inf")], 0)]
    table = spark.createDataFrame([(*x, 1, "x") for x in rows], "vec_id bigint, embedding array<float>, label int, rank int, `row.x` string")
    own = hard_negatives.relabelled(hard_negatives.usable(table))
    found = rows_of(hard_negatives.hard_negatives(own, F.col("vec_id") % 100 == 0, block_values=block_values))
    truth = negatives_truth(rows)
    assert found == truth and len(truth) > 100


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.negatives_report(empty).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1)], empty.schema)
    assert hard_negatives.negatives_report(alone).count() == 0


def test_pruning_leaves_rows_out_and_loses_none():
    r = np.random.default_rng(1)
    vectors = np.floor(r.normal(size=(2000, 6)) * 256 * r.uniform(0.1, 2, size=(2000, 1)))
    numbers = np.arange(2000)
    block = hard_negatives.Block(vectors, numbers, np.zeros(2000, np.int64), numbers)
    pruned = 0
    for q in vectors[:50]:
        scores = vectors @ q
        least = np.sort(scores)[-5]
        length = np.sqrt(q @ q)
        met = [(b, b.reaching(q, q / length, length, least)) for b in block.buckets]
        kept = np.concatenate([b.rows[c] for b, c in met if c is not None])
        assert set(np.flatnonzero(scores >= least)) <= set(kept)
        pruned += 2000 - len(kept)
    assert pruned > 50 * 1000
