"""Toxic words of small samples, and set phrases, are learned."""

import random

from lumenfold.llm import toxicity


def test_few_labels_and_set_phrases(spark):
    rng = random.Random(6)
    plain = [f"{a}{b}" for a in ("ta", "lo", "mi", "ru", "se") for b in ("n", "r", "ss", "ld", "ck", "m", "v", "p")]
    rows, labels = [], []
    for i in range(200):
        text = rng.choices(plain, k=60)
        if i % 10 == 0:  # half of them only by a word that always follows the same one
            at = rng.randint(5, 55)
            text[at:at] = ["grobian"] if i % 20 == 0 else ["lon", "bag"]
        rows.append((i, " ".join(text)))
        if i < 100:
            labels.append((i, int(i % 10 == 0)))
    rows += [(i, " ".join([*rng.choices(plain, k=20), "lon", *rng.choices(plain, k=20)])) for i in range(300, 320)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r["doc_id"]: r["toxic"] for r in toxicity.grade(docs, toxicity.train(docs, labels)).collect()}
    assert found == {i: i < 300 and i % 10 == 0 for i in found}


def test_pairs_are_counted_across_punctuation():
    scanner = toxicity.Scanner(["bad word", "word*"])
    counts, hit = scanner.counts("Bad, word! bad x word badword bad word words")
    assert counts.tolist() == [2, 1] and hit == 3
