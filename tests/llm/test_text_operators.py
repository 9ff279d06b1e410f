"""BPE, packing, language and toxicity against the tokenizers library, brute force and held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lumenfold.llm import bpe, language, packing, toxicity

ODD = [
    None, "", "  ", "Hello<|endoftext|>World <|startoftext|>x", "ΣΑΣ ΟΔΟΣ. İstanbul", "日本語テキスト 123४५", "été 'S it's we'LL", "a\x1cb\x85c d　e",
    "x" * 5000, "ab" * 3000 + " \t\n", "🙂🙂 naïve ﬁ", "ǅ ẞ ß", "aaaaaaaaaaaaaa!!!!!!!!!?????" * 50, "\x00\x01 foo", "<|endoftext|>", "<|endof", "c.,d x²³ ¼", "same", "same",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(4)
    syllables = ["th", "er", "on", "éa", "ung", "ción", "qu", "%%%", "7"]
    texts = ODD + [" ".join("".join(random.choices(syllables, k=random.randint(1, 5))) for _ in range(random.randint(1, 700))) for _ in range(30)]
    return spark.createDataFrame([(i, t, "kept", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n int").repartition(3), texts


def test_encoding_equals_the_library(docs, library):
    df, texts = docs
    rows = {r["doc_id"]: r for r in bpe.encode(df, decoded="decoded").collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == want
        assert rows[i]["decoded"] == library.decode(want, skip_special_tokens=False)
        assert rows[i]["n"] == 1
    again = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(df)).collect()}
    assert again == {i: r["decoded"] for i, r in rows.items()}


def test_boundaries_are_certain():
    e = bpe.encoder(bpe.default_path())
    word = "".join(e.symbols[b] for b in "Zqxjé".encode())
    ids = [e.base[e.byte[x]] for x in word[:-1]] + [e.last[e.byte[word[-1]]]]
    parts = e.fragments_of(ids)
    assert sum((p for p, _ in parts), []) == ids
    assert all(None not in ranks for _, ranks in parts)
    assert bpe.encoder(bpe.default_path())._merge_long([e.base[97]] * 60) == e.merge([e.base[97]] * 60, [])


def test_cache_stays_bounded():
    cache = bpe.Cache(10)
    for i in range(100):
        cache.put(str(i), "x")
    assert len(cache.young) + len(cache.old) <= 20 and cache.get("95") == "x"


def test_packing_cuts_one_stream(docs, library):
    df, texts = docs
    rows = packing.pack(df, window=64).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    place = {}
    got = {i: {} for i in ids}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        got[r["doc_id"]][r["start"]] = r["length"]
        for k in range(r["length"]):
            assert place.setdefault((r["sequence_id"], r["offset"] + k), r["doc_id"]) == r["doc_id"]
    total = sum(map(len, ids.values()))
    assert sorted(place) == [divmod(k, 64) for k in range(total)]
    for i, parts in got.items():
        assert sum(parts.values()) == len(ids[i]) and all(s == 0 or s in {a + n for a, n in parts.items()} for s in parts)


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def words(rng, alphabet, n):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(1)
    kinds = {"xx": ["ba", "bo", "ki"], "yy": ["äu", "sch", "ung"], "zz": ["ци", "ло", "ре"]}
    rows = [(i, words(rng, kinds[k], rng.randint(5, 80)), k) for i, k in enumerate(rng.choices(list(kinds), k=300))]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !!", "zz"), (None, "bako boki baba kibo", None), (1003, "schung äuung " * 5000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(spoken):
    model = language.train(spoken, sample_rows=200)
    assert model.languages == ["xx", "yy", "zz"]
    found = language.predict(spoken, model).withColumn("held", language.held_out()).collect()
    for r in found:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["accepted"]) == ("und", False)
        assert r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in found if r["held"] and r["doc_id"] < 1000]
    assert len(held) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert {r["doc_id"]: r["lang_pred"] for r in found}[1003] == "yy"


def test_nothing_to_learn_from(spark, spoken):
    empty = spoken.where("false")
    assert language.train(empty) is None
    assert language.predict(spoken, None).where("lang_pred <> 'und' OR accepted").count() == 0
    assert language.predict(empty, language.train(spoken, sample_rows=90)).count() == 0


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(2)
    plain = ["the", "house", "walks", "over", "green", "rivers", "and", "sings", "slowly", "again"]
    rows, labels = [], []
    for i in range(400):
        text = rng.choices(plain, k=rng.randint(10, 120))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 12)):
                text.insert(rng.randint(0, len(text)), rng.choice(["grobian", "flegel", "schuftig", "schufte"]))
        rows.append((i, " ".join(text)))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, "Flegel! " + "the green house " * 20000)]
    labels += [(5, 1, 0), (None, 1, 1), (7, 1, None), (12345, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(graded):
    docs, labels = graded
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    rows = {r["doc_id"]: r for r in toxicity.grade(docs, model).collect()}
    assert all(rows[i]["toxic"] == (i % 4 == 0) for i in range(400))
    assert not rows[900]["toxic"] and not rows[901]["toxic"] and rows[900]["severity"] == rows[901]["severity"]
    counts = {i: sum(w in r["text"] for w in [r["text"]]) + r["text"].count("flegel") + r["text"].count("grobian") + r["text"].count("schuf") for i, r in rows.items() if i < 400 and i % 4 == 0}
    few, many = (np.mean([rows[i]["severity"] for i, n in counts.items() if lo <= n <= hi]) for lo, hi in ((2, 4), (10, 13)))
    assert many > few + 0.5


def test_toxicity_without_labels(spark, graded):
    docs, labels = graded
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.grade(docs, None).where("toxic OR severity <> 0").count() == 0
    assert toxicity.grade(docs.where("false"), None).count() == 0


def test_cumulative_link_gradient():
    """The fit reaches a point where no small step lowers the loss."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = np.digitize(x @ [2.0, -1.0, 0.5] + rng.logistic(size=200), [-1, 1])
    w, t = toxicity.fit(x, y, steps=3000)

    def loss(w, t):
        below = np.concatenate([np.zeros((200, 1)), toxicity.logistic(t - (x @ w)[:, None]), np.ones((200, 1))], 1)
        return -np.log(below[np.arange(200), y + 1] - below[np.arange(200), y]).mean() + 5e-4 * (w @ w)

    best = loss(w, t)
    for i in range(3):
        for d in (-0.02, 0.02):
            assert loss(w + d * np.eye(3)[i], t) > best - 2e-5
    for i in range(2):
        for d in (-0.02, 0.02):
            assert loss(w, t + d * np.eye(2)[i]) > best - 2e-5


def test_digest_columns(spark, tmp_path, library):
    spark.createDataFrame([(1, "The end."), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in bpe.op1_bpe(spark, str(tmp_path)).collect()}
    ids = library.encode("The end.", add_special_tokens=False).ids
    assert rows[1]["n_tokens"] == len(ids) and rows[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert rows[2]["n_tokens"] == 0 and rows[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
