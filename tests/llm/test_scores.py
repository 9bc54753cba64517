"""Decontamination, classifiers, language model, secrets, mixing and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, documents
from pyspark.sql import functions as F

import corpus_pipeline
from sheetscope.llm import decontaminate, lattice, mixing, quality, secret_scan, toxicity
from sheetscope.llm.common import words_of
from sheetscope.session import cut_lineage


def brute_hits(text, items, n=10):
    words, hit, found = words_of(text), set(), set()
    for item, own in items:
        own = words_of(own)
        size = min(n, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(item)
    return len(words), len(hit), len(found)


@pytest.mark.parametrize("block", [10**7, 300])
def test_hits_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(2)
    make = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([0, 1, 3, 9, 10, 14, 25])] + [(9, None), (3, make(9))]
    rows = [(i, make(rng.randint(0, 60)) + (" Z! " + items[5][1].upper() if i % 7 == 0 else "")) for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination_report(documents(spark, [(i, t, None) for i, t in rows]), benchmark).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in found}
    assert got == {i: brute_hits(t, items) for i, t in rows}


def test_decontamination_of_awkward_rows(spark):
    docs, benchmark = awkward(spark), spark.createDataFrame([(None, "Été àé"), (1, "one"), (2, None)], "item_id bigint, text string")
    report = decontaminate.contamination_report(docs, benchmark)
    assert report.count() == docs.count()
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_contaminated(docs, benchmark).collect()}
    assert cut[4] == "." and cut[9] == "Repeated row." and cut[1] is None
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and 4 not in [r["doc_id"] for r in kept.collect()]
    none = spark.createDataFrame([], benchmark.schema)
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()
    assert decontaminate.contamination_report(documents(spark, []), benchmark).count() == 0


def corpus(seed, bad):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiourstnlm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        own = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        flag = int(rng.random() < 0.3)
        text = " ".join(w + ("." if rng.random() < 0.1 else "") for w in own)
        rows.append((i, bad(text, rng) if flag else text, None))
        labels.append((i, 1 - flag, flag))
    return rows, labels


def insulted(text, rng):
    words = text.split()
    for _ in range(2):
        words.insert(rng.randrange(len(words)), rng.choice(["zygbat", "zygbats", "klopfig", "klop-fig", "z y g b a t"]))
    return " ".join(words)


def test_toxicity_finds_held_out_and_gapped_insults(spark):
    rows, labels = corpus(3, insulted)
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train_toxicity(docs, marks)
    report = {r["doc_id"]: r for r in toxicity.toxicity_report(docs, marks).collect()}
    held = [(report[i]["predicted"], t) for i, _, t in labels if report[i]["held_out"]]
    assert np.mean([p == t for p, t in held]) > 0.97
    assert all(s > 0.7 for s in model.score(["You zyg.bat are here", "so k-l-o-p-f-i-g it is", "one z y g b a t more"]))
    assert max(model.score(["Nothing of the sort", "", None])) < 0.3


def test_toxicity_takes_a_slice_apart_in_parts(spark, monkeypatch):
    rows, labels = corpus(3, insulted)
    model = toxicity.train_toxicity(documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    texts = [None, "", "x" * 500, *(t for _, t, _ in rows[:60])]
    whole = model.score(texts)
    held = []
    monkeypatch.setattr(toxicity, "PART", 400)
    monkeypatch.setattr(toxicity, "REMEMBERED", 40)
    ask = toxicity.ToxicityModel._likeness_of
    monkeypatch.setattr(toxicity.ToxicityModel, "_likeness_of", lambda self, tokens: held.append(len(tokens)) or ask(self, tokens))
    assert model.score(texts) == whole
    assert len(held) > 5 and max(held) <= 200
    assert len(model._memory) <= 20


def test_toxicity_learns_from_a_slice_in_parts(spark, monkeypatch):
    rows, labels = corpus(3, insulted)
    text, label = [None, "", *(t for _, t, _ in rows[:60])], [0, 1, *(y for *_, y in labels[:60])]
    batch = pa.RecordBatch.from_pydict({"label": label, "text": text})
    monkeypatch.setattr(toxicity, "PART", 400)
    parts = list(toxicity._labelled_parts(batch))
    assert [x for own, texts in parts for x in zip(own, texts)] == list(zip(label, text))
    assert len(parts) > 5 and all(len(texts) == 1 or sum(len(t or "") for t in texts) <= 400 for _, texts in parts)


def test_toxicity_takes_its_rows_to_the_driver_by_partitions(spark, monkeypatch):
    rows, labels = corpus(3, insulted)
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")

    def whole(self):
        raise AssertionError("the whole result went to the driver at once")

    monkeypatch.setattr(type(docs), "toArrow", whole)
    read, fit = [], toxicity._fit_documents
    monkeypatch.setattr(toxicity, "_fit_documents", lambda m, rows, s: fit(m, (read.append(r["label"]) or r for r in rows), s))
    model = toxicity.train_toxicity(docs, marks)
    assert set(read) == {0, 1} and len(read) > 100
    assert model.score(["you are an oaf", ""])[1] < 0.5


def test_toxicity_finds_insults_with_letters_put_in(spark):
    rows, labels = corpus(3, insulted)
    model = toxicity.train_toxicity(documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    scores = model.score(["so zyxgbat it is", "you zygqbat", "one klopxfig more", "a klwopfig here"])
    # One foreign letter in the very middle ("zygqbat") may stay just below the threshold.
    assert min(scores) > 0.5 and sum(s > 0.7 for s in scores) >= 3, scores
    assert max(model.score(["Nothing of the sort", "another plain sentence"])) < 0.3


def test_landmarks_compare_rates_and_not_counts(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("lorem", "ipsum", "dolor") for b in ("an", "el", "is", "or")]
    rows, labels = [], []
    for i in range(600):
        flag = int(i % 12 == 0)
        own = [rng.choice(words) for _ in range(20)] + ["zygbat"] * (flag or i % 12 in (3, 7))
        rows.append((i, " ".join(own), None))
        labels.append((i, 1 - flag, flag))
    model = toxicity.train_toxicity(documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert model and any(z.startswith(b"zygb") for z in model.landmarks)


def test_quality_tells_junk_by_positives_alone(spark):
    rows, labels = corpus(5, lambda text, rng: " ".join(w + rng.choice(["***", "$$$", "%%"]) for w in text.split()))
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.train_quality(docs, marks.filter("quality = 1"))
    assert 0.5 < model.prior < 0.9
    report = {r["doc_id"]: r for r in quality.quality_report(docs, marks.filter("quality = 1")).collect()}
    held = [(report[i]["predicted"], q) for i, q, _ in labels if report[i]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.95


@pytest.mark.parametrize("report", [toxicity.toxicity_report, quality.quality_report])
def test_classifiers_on_awkward_rows(spark, report):
    docs = awkward(spark)
    labels = spark.createDataFrame([(5, 1, 1), (7, 0, 0), (7, 1, 0), (None, 1, 1), (8, None, None), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    found = report(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert report(docs, labels.limit(0)).count() == docs.count()
    assert report(documents(spark, []), labels).count() == 0


def segmentations(word, pieces):
    if not word:
        return [1.0]
    return [pieces[word[:n]] * p for n in range(1, len(word) + 1) if word[:n] in pieces for p in segmentations(word[n:], pieces)]


def test_lattice_sums_all_segmentations():
    probabilities = {"▁": 0.1, "▁a": 0.2, "a": 0.1, "b": 0.1, "ab": 0.2, "▁ab": 0.05, "ba": 0.1}
    pieces = lattice.Pieces({p: i for i, p in enumerate(probabilities)}, 100, 0, [math.log(p) for p in probabilities.values()], 3)
    for word in ("a", "ab", "abba", "aabab"):
        assert math.isclose(math.exp(pieces.log_sum(word)), sum(segmentations("▁" + word, probabilities)))
    expected = np.zeros(7)
    pieces.expect("ab", 3.0, expected)
    total = sum(segmentations("▁ab", probabilities))
    assert math.isclose(expected[5], 3 * 0.05 / total) and math.isclose(expected[4], 3 * 0.1 * 0.2 / total)


def test_words_summed_together_equal_words_summed_alone():
    pieces = lattice.load_pieces()
    rng = random.Random(3)
    words = ["".join(rng.choice("aeéinst日\U0001f600.x") for _ in range(rng.choice([1, 2, 3, 7, 20]))) for _ in range(300)] + ["", "z" * 3000]
    times = [rng.randint(1, 5) for _ in words]
    assert np.allclose(lattice.log_sums(pieces, words), [pieces.log_sum(w) for w in words], rtol=1e-12)
    alone, together = np.zeros(len(pieces.logs)), np.zeros(len(pieces.logs))
    for word, n in zip(words, times):
        pieces.expect(word, n, alone)
    lattice.expect_all(pieces, words, times, together)
    assert np.allclose(alone, together, rtol=1e-9)


@pytest.mark.parametrize("frequent", [1, 1000])
def test_document_scores_are_sums_over_all_segmentations(spark, frequent):
    """Held-out and taught words, against every segmentation written out."""
    texts = ["ab abc", "abc", "Ab ca ab", None, "bac cab ab"]
    docs = documents(spark, [(i, t, None) for i, t in enumerate(texts)])
    model, words = lattice.train(docs.filter("doc_id < 3"))
    counts = Counter(w for t in texts[:3] for w in t.lower().split())
    single = {p: math.exp(model.pieces.logs[i]) for p, i in model.pieces.number.items()}

    def own(word):
        spelled = sum(segmentations("▁" + word, single))
        known = counts[word] / model.tokens
        return math.log10((lattice.WHOLE * known if known else 0) + (1 - lattice.WHOLE) * spelled)

    end = model.pieces.logs[model.pieces.end] / math.log(10)
    for r in lattice.score_documents(docs, model, words, frequent).collect():
        expected = end + sum(own(w) for w in (r["row"]["text"] or "").lower().split())
        assert math.isclose(r["score"], expected, rel_tol=1e-9)


@pytest.mark.parametrize("frequent", [3, 1000])
def test_base_scores_against_brute_force(spark, frequent):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "The", "thing", "été", "x1", "q\x0bz", "日"]) for _ in range(rng.randint(0, 9))) for _ in range(50)] + [None]
    docs = documents(spark, [(i, t, None) for i, t in enumerate(texts)])
    train = docs.filter("doc_id % 2 = 0")
    model, words = lattice.train(train)
    counts = Counter(w for t in texts[::2] for w in (t or "").encode().lower().split())
    n, v = sum(counts.values()) + len(texts[::2]), len(counts) + 1
    assert (model.tokens, model.variety) == (n, v)
    for r in lattice.score_documents(docs, model, words, frequent).collect():
        own = [counts[w] for w in (r["row"]["text"] or "").encode().lower().split()] + [len(texts[::2])]
        assert math.isclose(r["base_score"], sum(math.log10((c + 1) / (n + v + 1)) for c in own), rel_tol=1e-9)
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(c > 0 for c in own)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_language_model_on_awkward_rows(spark):
    docs = awkward(spark)
    assert lattice.language_report(docs).count() == docs.count()
    assert lattice.language_report(documents(spark, [])).count() == 0


def test_trigram_queries_never_miss():
    samples = {
        "assign": ['password = "hunter2hunter2"', "API_KEY:abcdefgh1", "apikey='zzzzzzzzz'"],
        "access": ["AKIA" + "A1" * 8],
        "private_key": ["-----BEGIN RSA PRIVATE KEY-----"],
        "forge_token": ["ghp_" + "a" * 36, "ghs_" + "B" * 40],
        "chat_token": ["xoxb-123456789012"],
        "payment_key": ["sk_live_" + "1" * 20],
    }
    for rule in secret_scan.RULES:
        query = secret_scan.trigram_query(rule.regex)
        for text in samples.get(rule.kind, []):
            assert re.search(rule.regex, text)
            low = text.lower()
            assert any(all(t in low for t in need) for need in query)
    assert secret_scan.trigram_query("[0-9a-f]{32,}") is None
    assert secret_scan.trigram_query("(abcd|xy)z?") is None
    assert secret_scan.trigram_query("abc(d|e)") == [frozenset({"abc", "bcd"}), frozenset({"abc", "bce"})]


def brute_spans(text):
    out = []
    for place, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.regex, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), place, m.end(), rule.kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secret_spans_against_python(spark):
    rng = random.Random(6)
    bits = ["password: short", "Secret = 'longenough1'", "tokEN=abc=token=abcdefgh", "é\U0001f600", "AKIA" + "Z9" * 7, "AKIA12", "0123456789abcdef" * 2,
            "f" * 31, "ghp_" + "x" * 36, "xoxb-" + "1" * 12, "-----BEGIN PRIVATE KEY-----", "api_key:secret: abcdefghij", " and ", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    found = {r["doc_id"]: r["spans"] for r in secret_scan.secrets_report(documents(spark, [(i, t, None) for i, t in rows])).collect()}
    assert found == {i: brute_spans(t) for i, t in rows}


def test_secret_plan_is_native_and_awkward_rows_pass(spark):
    docs = awkward(spark)
    report = secret_scan.secrets_report(docs)
    assert report.count() == docs.count()
    assert not re.search("Python|Arrow|Pandas", report._jdf.queryExecution().toString())
    assert secret_scan.secrets_report(documents(spark, [])).count() == 0


def test_targets_are_shared_again():
    targets = mixing.share_targets({"a": 10, "b": 1000, None: 5, "c": 0}, 1015, (5, 2, 1), 3)
    assert targets["a"] == 30 and targets["c"] == 0 and targets[None] == 15
    assert math.isclose(sum(targets.values()), 1015)
    assert mixing.share_targets({}, 0, (5, 2, 1), 3) == {}


def test_flow_meets_overlapping_quotas_with_least_repetition():
    capacity = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    flow = mixing.route(capacity, {"a": 100, "b": 120}, 3)
    assert sum(flow.values()) == 220
    # 210 words serve unrepeated; only ten are taken twice.
    assert sum(max(0, flow[p] - capacity[p]) for p in capacity) == 10


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    docs = documents(spark, rows)
    found = mixing.mix_sources(docs).collect()
    assert len(found) == 600 and all(r["taken"] <= 3 * r["size"] for r in found)
    for source in ("a", "b", "c", None):
        own = [r for r in found if r["row"]["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 31
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted((r["row"]["doc_id"], r["taken"]) for r in again) == sorted((r["row"]["doc_id"], r["taken"]) for r in found)


def test_mixing_overlapping_and_awkward_rows(spark):
    docs = awkward(spark)
    both = mixing.mix_sources(docs, membership=F.when(F.col("doc_id") > 5, F.array(F.lit("p"), F.lit("q"))).otherwise(F.array(F.lit("p"))))
    assert both.count() == docs.count()
    assert mixing.mix_sources(docs).count() == docs.count()
    assert mixing.mix_sources(documents(spark, [])).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rows, labels = corpus(3, insulted)
    rows += [(1000 + i, t, "s") for i, (_, t, _) in enumerate(rows[:40])]
    rows += [(2000, "the benchmark says one two three four five six seven eight nine ten eleven", None), (2001, None, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    item = spark.createDataFrame([(1, "One two three four five six seven eight nine ten")], "item_id bigint, text string")
    item.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
        if name != "mixing":
            assert docs.columns == columns
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & set(seen[0])) <= 2 and len(seen[0]) > 280
    assert len(seen[1]) == len({(t or "").lower() for t in seen[0].values()})
    assert 2000 in seen[2] and 2000 not in seen[3]
    assert {"taken", "repeats"} <= set(docs.columns)
    assert len(seen[4]) <= len(seen[3])


def test_pipeline_tasks_have_one_python_step(spark, tmp_path, monkeypatch):
    rows, labels = corpus(3, insulted)
    documents(spark, rows + rows[:40]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[0][1])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, context, inputs, given = type(spark.range(1)), type(spark.sparkContext), [], []
    plain = frame.mapInArrow, context.parallelize
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: inputs.append(self) or plain[0](self, *a, **b))
    monkeypatch.setattr(context, "parallelize", lambda self, *a, **b: given.append(a) or plain[1](self, *a, **b))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, str(tmp_path)))
        for df in inputs:
            # What a task does before this step: the plan down to the shuffle or join it reads.
            own = re.split("RepartitionByExpression|Join|Aggregate", df._jdf.queryExecution().optimizedPlan().toString())[0]
            assert "MapInArrow" not in own, name
        inputs.clear()
        assert not given, name  # rows given as Python objects run a Python step too
