"""Counts, severities and language scores against plain versions; ties, repeats and clashing columns."""

import math
import random
import re

import numpy as np
import pytest

from lumenfold.llm import language, toxicity

WORDS = ["bad", "badly", "worse", "thing", "other", "naïve", "x"]


def plain_count(feature, text):
    words = [(m.group(), m.start()) for m in re.finditer(r"[^\W\d_]+", text.lower())]
    if " " in feature:
        return sum(f"{a} {b}" == feature for (a, _), (b, _) in zip(words, words[1:], strict=False))
    if feature.endswith("*"):
        return sum(w.startswith(feature[:-1]) and len(w) > len(feature) - 1 for w, _ in words)
    return sum(w == feature for w, _ in words)


def test_counts_equal_a_plain_count():
    rng = random.Random(0)
    features = ["bad", "bad*", "worse", "bad thing", "other bad", "naïve"]
    scanner = toxicity.Scanner(features)
    for _ in range(300):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", ", ", "-", "\n", "7", "_", " 3 "]) for _ in range(rng.randint(0, 30)))
        assert scanner.counts(text)[0].tolist() == [plain_count(f, text) for f in features]


def test_severity_is_a_sum_over_grades(spark):
    model = toxicity.SeverityModel(["bad", "worse"], np.array([0.7, 1.9]), np.array([1.0, 2.5, 3.5]), 0.8)
    texts = ["bad", "bad bad worse", "worse worse", "fine", "", None, "bad"]
    rows = toxicity.grade(spark.createDataFrame([(i, t, True, "kept") for i, t in enumerate(texts)], "doc_id long, text string, toxic boolean, own string"), model).collect()
    for r in rows:
        words = re.findall(r"\w+", r["text"] or "")
        score = 0.7 * math.log1p(words.count("bad")) + 1.9 * math.log1p(words.count("worse"))
        want = sum(1 - 1 / (1 + math.exp(-(t - score))) for t in (1.0, 2.5, 3.5))
        assert r["severity"] == pytest.approx(want, rel=1e-5) and r["own"] == "kept"
        assert r["toxic"] == (want >= 0.8 and score > 0) and r["grade"] == (max(1, round(want)) if r["toxic"] else 0)


def test_a_severity_at_the_cut_is_toxic(spark):
    model = toxicity.SeverityModel(["bad"], np.array([1.0]), np.array([1.0]), 0.0)
    df = spark.createDataFrame([(1, "bad")], "doc_id long, text string")
    model.cut = toxicity.grade(df, model).first()["severity"]
    assert toxicity.grade(df, model).first()["toxic"]


def test_repeated_ids_do_not_change_the_model(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "house", "sings", "again"], k=20) + ["grobian"] * (i % 3 == 0) + rng.choices(["sky", "sea"], k=3))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    models = [toxicity.train(spark.createDataFrame(rows * k, "doc_id long, text string").repartition(3), labels) for k in (1, 4)]
    assert models[0].features == models[1].features and np.allclose(models[0].weights, models[1].weights) and models[0].cut == models[1].cut
    spoken = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in rows] * 2, "doc_id long, text string, lang string")
    a, b = (language.train(spoken.repartition(n), sample_rows=60) for n in (2, 5))
    assert np.array_equal(a.weights, b.weights) and a.languages == b.languages == ["de", "en"]


def plain_subwords(text):
    data = [b if b >= 128 or chr(b).isalpha() else 32 for b in f" {text.lower()} ".encode()]
    out = {}
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            part = data[i : i + n]
            if 32 in part[1:-1] or part[0] == part[-1] == 32:
                continue
            h = part[0] * 0x9E3779B1 & 0xFFFFFFFF
            for k, b in enumerate(part[1:], 2):
                h = ((h ^ h >> 15) * int(language.FACTORS[k - 1]) + b * 0x9E3779B1) & 0xFFFFFFFF
            key = ((h ^ n) * 0x85EBCA77 & 0xFFFFFFFF) >> 18
            out[key] = out.get(key, 0) + 1
    return out


def test_subwords_and_scores_equal_plain_ones():
    for text in ("Hello wide world", "ab", "x", "a-b c", "Ünïcode 12 naïve"):
        counts = language.subwords(text)
        assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == plain_subwords(text)
    rng = np.random.default_rng(3)
    model = language.LanguageModel(["a", "b", "c"], rng.normal(size=(language.BUCKETS, 3)), rng.normal(size=3), 0.7, 0.0, np.ones((3, language.BUCKETS)), 0.0)
    counts = plain_subwords("some text to tell")
    logits = [(sum(n * model.weights[k, j] for k, n in counts.items()) / sum(counts.values()) + model.bias[j]) / 0.7 for j in range(3)]
    scores = np.exp(logits) / np.exp(logits).sum()
    best, score, accepted = model.told("some text to tell")
    assert best == scores.argmax() and score == pytest.approx(scores.max(), rel=1e-5) and accepted


def test_outputs_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "text", 5, "x"), (1, "text", 5, "x")], "doc_id long, text string, score int, own string")
    rows = language.predict(df, None).collect()
    assert [(r["lang_pred"], r["score"], r["own"]) for r in rows] == [("und", 0.0, "x")] * 2
