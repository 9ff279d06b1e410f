"""Texts with letters but of no known language are rejected, clean ones stay."""

import random

import numpy as np

from lumenfold.llm import language


def test_unlearned_languages_and_junk_are_rejected(spark):
    rng = random.Random(9)
    kinds = {"xx": ["ba", "bo", "ki", "lu"], "yy": ["äu", "sch", "ung", "ter"], "zz": ["ци", "ло", "ре", "мо"], "ww": ["que", "ción", "los", "ra"]}
    say = lambda parts, n: " ".join("".join(rng.choices(parts, k=rng.randint(2, 5))) for _ in range(n))
    rows = [(i, say(kinds[k], rng.randint(10, 80)), k) for i, k in enumerate(rng.choices(list(kinds), k=600))]
    # a few labels are wrong: their scores must not open the door
    rows = [(i, t, "xx" if i % 97 == 0 else k) for i, t, k in rows]
    rows += [(1000 + i, " ".join("".join(rng.choices("cdefghjmnpqrtvwxyz", k=rng.randint(3, 9))) for _ in range(rng.randint(10, 80))), None) for i in range(60)]
    rows += [(2000 + i, say(["παν", "τες", "οι", "αν"], rng.randint(10, 80)), None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["accepted"] for r in language.predict(df, language.train(df)).collect()}
    assert not any(found[i] for i in found if i >= 1000)
    assert np.mean([found[i] for i in range(600)]) > 0.98


def test_only_letters_are_letters(spark):
    """Numerals, marks, symbols and emoji alone are no text of a language; one letter is enough for a prediction."""
    rows = [(i, f"{w} {w} {w}", k) for i, (w, k) in enumerate([("the cat sat", "en"), ("der hund lief", "de")] * 200)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    none = ["½ ² ①", "Ⅷ ↀ", "\u0301\u20e3", "१२३ ٤٥", "_ - 7", "😀 ©", "〇〡", None, ""]
    some = ["½ a", "ª", "ʰ", "漢", "é", "ไ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(none + some)], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(df, model).collect()}
    assert all(found[i] == ("und", 0.0) for i in range(len(none)))
    assert all(found[len(none) + i][0] in ("en", "de") for i in range(len(some)))
