"""Encoding of whole slices, as op8_packing does it, against the tokenizers library and the encoder of single texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenfold.llm import bpe, packing

from .test_text_operators import ODD


@pytest.fixture(scope="module")
def encoder():
    return bpe.ForcedBoundaryBpe(bpe.default_path())


def ids_of(encoder, texts, end=None):
    offsets, ids = encoder.encode_many(pa.array(texts, pa.string()), end)
    assert len(offsets) == len(texts) + 1 and offsets[0] == 0 and offsets[-1] == len(ids)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_slices_equal_the_library(encoder):
    library = Tokenizer.from_file(bpe.default_path())
    usual = [chr(i) for i in range(0x2028) if not bpe.UNUSUAL.match(chr(i))]
    random.seed(8)
    alphabets = ["".join(usual), "abcdefghij", "éàñüß'", "'sdtrelvm ", "a1²¼.,' \t\n", "ЖжЩяА", "the of and."]
    made = ["".join(random.choices(a, k=random.randint(0, 120))) for a in alphabets for _ in range(80)]
    texts = ODD + made + [f"a{c}b {c}{c} {c}'s 1{c}." for c in usual] + [c for c in usual] + [" ".join(usual), "x" * 41 + " " + "q" * 40, "'", "''s", "x'tea"]
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids_of(encoder, texts) == want
    assert ids_of(encoder, texts, 1) == [[*x, 1] for x in want]
    # the same from the middle of a batch
    offsets, ids = encoder.encode_many(pa.array(texts, pa.string()).slice(7, 300))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want[7:307]


@pytest.mark.parametrize("texts", [[], [None], ["", " "], ["日"], ["a"], ["?"], ["'"]])
def test_small_slices(encoder, texts):
    assert ids_of(encoder, texts, 1) == [[*map(ord, encoder.encode(t)), 1] for t in texts]


def test_words_of_a_slice_are_merged_once(encoder, monkeypatch):
    """However many distinct words there are: the cache of words met one at a time ran over and merged them again."""
    merged = []
    real = encoder.merge_many
    monkeypatch.setattr(encoder, "merge_many", lambda words: merged.extend(words.to_pylist()) or real(words))
    monkeypatch.setattr(encoder, "words", bpe.Cache(2))
    monkeypatch.setattr(encoder, "encode_word", None)
    texts = [f"Alpha beta{i % 3} gamma, delta. delta!! epsilon" for i in range(30)]
    assert len(ids_of(encoder, texts)) == 30
    words = [x for x in merged if x]
    assert sorted(words) == sorted({"alpha", "beta", "0", "1", "2", "gamma", "delta", "epsilon", ",", ".", "!!"})


def test_blocks_parts_and_sizes(encoder, monkeypatch):
    random.seed(9)
    texts = [" ".join("".join(random.choices("aberntioués'.7", k=random.randint(1, 60))) for _ in range(random.randint(0, 40))) for _ in range(60)] + ODD
    want = ids_of(encoder, texts, 1)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    monkeypatch.setattr(bpe, "BATCH_TOKENS", 20)
    assert ids_of(encoder, texts, 1) == want == [[*map(ord, encoder.encode(t)), 1] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = list(bpe.by_size([batch.slice(0, 0), batch], "text", 500))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts and len(parts) > 20
    assert all(p.num_rows for p in parts)


def test_places_go_on_over_slices(spark, encoder, tmp_path):
    texts = ["one two three"] * 3 + ODD + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = packing.tokens(df, "text", "doc_id", bpe.default_path(), 1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    before = 0
    for r in rows:
        own = np.frombuffer(r["ids"], dtype="<u2").tolist()
        assert own == [*map(ord, encoder.encode(texts[r["doc_id"]])), 1]
        assert (r["n"], r["before"]) == (len(own), before)
        before += len(own)
    assert len(rows) == len(texts)
