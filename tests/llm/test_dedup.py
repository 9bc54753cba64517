"""Exact, sentence, suffix and Jaccard deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import PASSAGE, awkward, documents
from pyspark.sql import functions as F

from sheetscope.llm import components, extendible, induced, jaccard, sentence_spans, suffixes
from sheetscope.llm.common import lowered, words_of


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_exact_groups(spark, partitions):
    docs = awkward(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = rows_of(extendible.exact_duplicates(docs))
        groups = {}
        for r in docs.collect():
            groups.setdefault(lowered(r["text"]), []).append(r["doc_id"])
        expected = []
        for r in docs.collect():
            own = groups[lowered(r["text"])]
            keep = max((i for i in own if i is not None), default=None)
            expected.append((r["doc_id"], keep, len(own), r["doc_id"] == keep, hashlib.sha256(lowered(r["text"])).hexdigest()))
        assert found == sorted(expected, key=repr)
        kept = extendible.drop_exact_duplicates(docs)
        assert kept.columns == docs.columns
        assert sorted(lowered(r["text"]) for r in kept.collect()) == sorted(groups)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_exact_on_an_empty_table(spark):
    docs = documents(spark, [])
    assert extendible.exact_duplicates(docs).count() == 0
    assert extendible.drop_exact_duplicates(docs).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("hash"), F.lit(10).cast("bigint").alias("bytes"))
    starts = extendible.directory(keys, 500)
    hashes = np.array([r["hash"] for r in keys.collect()], np.int64).view(np.uint64)
    loads = np.bincount(np.searchsorted(starts, hashes, "right") - 1, minlength=len(starts)) * 10
    assert starts[0] == 0 and loads.max() <= 500 and loads.sum() == 40_000
    # Keys that differ in the last bit are told apart; one key alone can't be split.
    close = spark.createDataFrame([(0, 900), (1, 900)], "hash bigint, bytes bigint")
    assert extendible.directory(close, 500).tolist() == [0, 1, *(1 << k for k in range(1, 64))]  # with the empty halves
    assert extendible.directory(close.limit(1), 500).tolist() == [0]


def brute_sentences(rows, sentences, words):
    runs = {}
    for i, (doc_id, text) in enumerate(rows):
        key = (doc_id is not None, doc_id, text)
        own = [w for _, w in sentence_spans.sentences_of(text) if w]
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                if b - a >= sentences and sum(map(len, own[a:b])) >= words:
                    runs.setdefault(b"|".join(b" ".join(s) for s in own[a:b]), []).append((doc_id, text, a, b))
                    break
    return runs


def test_sentences_of_later_repeats_go(spark):
    docs = documents(spark, [(3, PASSAGE + "Mine is here.", "a"), (1, "First own line. " + PASSAGE, "a"), (2, "Quite another thing. Nothing shared.", "b")])
    found = {r["row"]["doc_id"]: r for r in sentence_spans.drop_repeated_sentences(docs).collect()}
    assert found[1]["n_removed"] == 0 and found[1]["row"]["text"].startswith("First own line.")
    assert found[3]["n_removed"] == 2 and found[3]["row"]["text"].strip() == "Mine is here."
    assert found[2]["row"]["text"] == "Quite another thing. Nothing shared." and found[2]["row"]["a b"] == "z"


def test_sentence_repeats_against_brute_force(spark):
    rng = random.Random(4)
    lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 9))) + "." for _ in range(12)]
    rows = [(i, " ".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    runs = brute_sentences(rows, 2, 6)
    expected = {i: set() for i, _ in rows}
    for places in runs.values():
        first = min((i, a) for i, _, a, _ in places)
        for i, _, a, b in places:
            if (i, a) != first:
                expected[i].update(range(a, b))
    found = sentence_spans.drop_repeated_sentences(docs, 2, 6).collect()
    assert {r["row"]["doc_id"]: r["n_removed"] for r in found} == {i: len(s) for i, s in expected.items()}


def test_every_repeated_run_of_sentences_goes(spark):
    long = [" ".join(f"{w}{i}" for i in range(15)) + ". " for w in "ab"]
    passage = "".join(long) + "three short words. "
    rows = [(1, "Own start here. " + passage + "Own end here."), (2, passage + "Another end."), (3, "Before. " + passage), (4, "Go on. Read it. One."), (5, "Two. Go on. Read it.")]
    rng = random.Random(11)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) + "." for _ in range(14)]
    rows += [(i, " ".join(rng.choice(lines) for _ in range(rng.randint(0, 10)))) for i in range(10, 40)]
    runs = {}
    for i, text in rows:
        own = [b" ".join(w) for _, w in sentence_spans.sentences_of(text) if w]
        for a in range(len(own)):
            for b in range(a + 2, len(own) + 1):
                runs.setdefault(tuple(own[a:b]), []).append((i, a, b))
    expected = {i: set() for i, _ in rows}
    for places in runs.values():
        for i, a, b in places:
            if (i, a, b) != min(places):
                expected[i].update(range(a, b))
    found = {r["row"]["doc_id"]: r for r in sentence_spans.drop_repeated_sentences(documents(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert {i: r["n_removed"] for i, r in found.items()} == {i: len(s) for i, s in expected.items()}
    assert found[2]["row"]["text"].strip() == "Another end." and found[3]["row"]["text"] == "Before. "
    assert found[5]["row"]["text"] == "Two."


def test_sentence_operator_on_awkward_rows(spark):
    docs = awkward(spark)
    found = sentence_spans.drop_repeated_sentences(docs)
    assert found.count() == docs.count() and found.select("row.*").columns == docs.columns
    assert sentence_spans.drop_repeated_sentences(documents(spark, [])).count() == 0


@pytest.mark.parametrize("depth", [4, 20, 300])
def test_suffix_order_against_sorting(depth):
    rng = np.random.default_rng(depth)
    for trial in range(120):
        text = (rng.integers(0, rng.integers(1, 6), rng.integers(1, 160)) + 250 * (trial % 3 == 0)).astype(np.uint8)
        if trial % 4 == 1:
            text = np.tile(text[: max(1, len(text) // 7)], 8)
        order, common = induced.suffix_order(text, depth, memory=500 if trial % 2 else 10**8)
        data = text.tobytes()
        assert sorted(order.tolist()) == list(range(len(data)))
        heads = [data[i : i + depth] for i in order.tolist()]
        assert heads == sorted(heads)
        for k in range(1, len(heads)):
            a, b = heads[k - 1], heads[k]
            shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == shared


def test_suffix_order_of_texts_joined_from_units():
    """Substrings between S* places are then often as long as a key, and one begins another."""
    rng = np.random.default_rng(11)
    for trial in range(1500):
        units = [rng.integers(97, 97 + rng.integers(2, 4), rng.integers(1, 16)).astype(np.uint8) for _ in range(rng.integers(2, 5))]
        text = np.concatenate([units[i] for i in rng.integers(0, len(units), rng.integers(2, 24))])
        order, _ = induced.suffix_order(text, 40, memory=10**8)
        data = text.tobytes()
        heads = [data[i : i + 40] for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(data))) and heads == sorted(heads), trial


def test_repeated_windows_of_texts_joined_from_units():
    rng = np.random.default_rng(12)
    for trial in range(300):
        units = [rng.integers(97, 99, rng.integers(1, 16)).astype(np.uint8).tobytes() for _ in range(3)]
        texts = list({b"".join(units[i] for i in rng.integers(0, 3, rng.integers(4, 12))) for _ in range(3)})
        found = suffixes.repeated_windows([(t, 1) for t in texts], 20)
        counts = Counter(t[i : i + 20] for t in texts for i in range(len(t) - 19))
        for text, ranges in zip(texts, found):
            mine = {i for a, b in ranges for i in range(a, b)}
            assert mine == {i for i in range(len(text) - 19) if counts[text[i : i + 20]] > 1}, trial


def brute_bytes(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        out.append(covered)
    return out


@pytest.mark.parametrize("common", [64, 2])
def test_repeated_bytes_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(suffixes, "COMMON", common)
    rng = random.Random(common)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 150)))
    shared = [word() + word() for _ in range(4)]
    texts = ["".join(rng.choice([word(), rng.choice(shared)]) for _ in range(rng.randint(0, 8))) for _ in range(40)]
    texts += ["ab" * 200, "x" * 500, "lorem ipsum. " * 60, texts[3], texts[3]]
    docs = documents(spark, [(i, t, None) for i, t in enumerate(texts)])
    found = {r["doc_id"]: r for r in suffixes.suffix_report(docs, 100).collect()}
    data = [t.encode() for t in texts]
    for i, (text, covered) in enumerate(zip(data, brute_bytes(data, 100))):
        kept = bytes(c for c, gone in zip(text, covered) if not gone)
        runs = sum(1 for k in range(len(covered)) if covered[k] and (not k or not covered[k - 1]))
        assert (found[i]["n_bytes"], found[i]["n_removed"], found[i]["n_spans"]) == (len(text), sum(covered), runs)
        assert found[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_suffix_operator_on_awkward_rows(spark):
    docs = awkward(spark)
    cut = suffixes.cut_repeated(docs)
    assert cut.select("row.*").columns == docs.columns
    kept = sorted((str(r["row"]["doc_id"]), r["n_bytes"], len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in cut.collect())
    assert kept == sorted((str(r["doc_id"]), r["n_bytes"], r["n_spans"], r["kept_sha256"]) for r in suffixes.suffix_report(docs).collect())
    assert suffixes.suffix_report(docs).count() == docs.count()
    assert suffixes.suffix_report(documents(spark, [])).count() == 0


def brute_classes(rows, threshold=0.8):
    texts = {}
    for i, t in rows:
        texts.setdefault(tuple(words_of(t)), []).append(i)
    texts.pop((), None)
    sets = [({w[k : k + 5] for k in range(max(1, len(w) - 4))}, ids) for w, ids in texts.items()]
    label, links = list(range(len(sets))), [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a][0] & sets[b][0])
            if shared >= threshold * (len(sets[a][0]) + len(sets[b][0]) - shared) - 1e-9:
                links[a] += 1
                links[b] += 1
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {x: min(min(s[1]) for s, y in zip(sets, label) if y == x) for x in set(label)}
    return {i: (least[x], n, len(ids)) for (_, ids), x, n in zip(sets, label, links) for i in ids}


@pytest.mark.parametrize("block", [256, 4])
def test_similar_documents_against_brute_force(spark, block):
    rng = random.Random(8)
    base = [[rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(rng.randint(0, 30)) for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 3)}"
        rows.append((i, " ".join(words)))
    rows += [(100, "too short"), (101, "Too short!"), (102, "short too")]
    found = jaccard.similar_documents(documents(spark, [(i, t, None) for i, t in rows]), block=block)
    got = {r["_k0"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in found.collect()}
    assert got == brute_classes(rows)


def test_one_document_of_each_class_stays(spark):
    docs = awkward(spark)
    report = jaccard.similarity_report(docs).collect()
    assert len(report) == docs.count()
    kept = jaccard.drop_similar(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    # 1-3 have no words; 5 and 6 are alike, as are the two rows of 9 and 10.
    assert ids == sorted(["1", "2", "3", "4", "5", "None", "7", "7", "8", "9"])
    assert jaccard.drop_similar(documents(spark, [])).count() == 0


def test_jaccard_join_plans_its_last_join_once(spark):
    docs = documents(spark, [(1, PASSAGE * 4, "a"), (2, PASSAGE * 4 + "End.", "a"), (3, "Other words alone.", "b"), (4, None, None)])
    kept = jaccard.drop_similar(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    # The rows that stay, and nothing of how they were found: two reads of one written table.
    assert plan.count("Join") == 1 and plan.count("parquet") == 2
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_pruning_keeps_what_may_reach_the_threshold():
    table = dict(jaccard.least_matches(0.8, 1e-6))
    assert 0 < table[32] < 32 * 0.8 and table[160] < 160 * 0.8
    assert list(table.values()) == sorted(table.values())


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in found.collect()} == label
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("length", [32, 33, 40, 64])
def test_segments_against_every_window(length):
    """Segments tile the windows by their least hash, also where texts are hashed together."""
    rng = random.Random(length)
    units = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 40))) for _ in range(4)]
    texts = [None, "", *("".join(rng.choice(units) for _ in range(rng.randint(0, 30))) for _ in range(20))]
    grams = [suffixes.gram_hashes(np.frombuffer((t or "").encode(), np.uint8)) for t in texts if len((t or "").encode()) >= length]
    for common in (np.zeros(0, np.uint64), np.unique(np.concatenate([g[:3] for g in grams]))):
        found = {}
        for cut in suffixes.segments_of(texts, length, suffixes.Common(common), inner=True):
            for i, of in enumerate(cut.text):
                found.setdefault(int(of), []).append((int(cut.first[i]), int(cut.last[i]), int(cut.least[i]), bool(cut.twice[i])))
                assert cut.piece(i, length) == texts[of].encode()[cut.first[i] : cut.last[i] + length]
        for of, text in enumerate(texts):
            data = (text or "").encode()
            if len(data) < length:
                assert of not in found
                continue
            hashes = [int(h) for h in suffixes.gram_hashes(np.frombuffer(data, np.uint8))]
            if len(common):
                late = set(common.tolist())
                hashes = [h >> 1 | (h in late) << 63 for h in hashes]
            width = length - suffixes.GRAM + 1
            least = [min(hashes[i : i + width]) for i in range(len(data) - length + 1)]
            own = sorted(found[of])
            assert [v for a, b, v, _ in own for _ in range(a, b + 1)] == least
            assert all(twice == (hashes[a : b + width].count(v) > 1) for a, b, v, twice in own)
