"""Every stage of the pipeline, and the whole, against brute-force versions on a small corpus."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumenfold.llm import bpe, language, toxicity
from tests.llm.test_data_operators import line_set, roots, shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic string, n_lines string, score int"
PARTS = {"xx": ["ba", "bo", "ki", "lu", "ne"], "yy": ["äu", "sch", "ung", "ter", "ei"]}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Two languages, toxic documents, junk, copies, near copies, repeated lines and rows, nulls and clashing columns."""
    rng = random.Random(21)
    line = lambda lang, n: " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(2, 5))) for _ in range(n))
    common, rows = [line("xx", 12) for _ in range(4)], []
    for i in range(260):
        lang = "xx" if i % 2 else "yy"
        lines = [line(lang, rng.randint(6, 18)) for _ in range(rng.randint(2, 6))]
        if i % 5 == 0:
            lines.insert(1, rng.choice(common))
        if i % 8 == 3:
            lines[0] += " grobian flegel" + " grobian" * rng.randint(0, 4)
        rows.append((i, "\n".join(lines), lang))
    for i in range(300, 330):  # copies, and copies with one more word in the middle of a long line
        text = rows[i - 299][1]
        rows.append((i, text if i % 2 else text + "\n" + line("xx", 3), "xx"))
    rows += [(400, None, "xx"), (401, "", "yy"), (402, "12 34", "xx"), (403, " ".join("".join(rng.choices("cdfghjmpqvw", k=6)) for _ in range(40)), None), (None, line("yy", 30), "yy"), (7, rows[7][1], rows[7][2]), (404, "\n".join(line("xx", 40) for _ in range(200)), "xx")]
    at = str(tmp_path_factory.mktemp("corpus"))
    full = [(i, t, g, "s", len(t or ""), "own", "lines", 3) for i, t, g in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 == 3)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def stage(spark, docs, at, n):
    return corpus_pipeline.STAGES[n][1](spark, docs, at)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def lines_left(docs):
    """Plain version of the line stage: of each component of lines the first occurrence stays."""
    first = {}
    for d, (i, text) in enumerate(docs):
        for p, x in enumerate((text or "").split("\n")):
            if x.strip():
                first.setdefault(x, (d, p))
    known = sorted(first, key=first.get)
    root = dict(zip(known, (first[known[k]] for k in roots([line_set(x) for x in known])), strict=True))
    out = []
    for d, (i, text) in enumerate(docs):
        left = [x for p, x in enumerate(text.split("\n")) if not x.strip() or root[x] == (d, p)]
        if len(left) == len(text.split("\n")) or "".join(left).strip():
            out.append((i, "\n".join(left)))
    return out


def test_stages_and_the_whole(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    severity = lambda t: float(model.severity(np.log1p(toxicity.Scanner(model.features).counts(t or "")[0])[None])[0])
    none, before = severity(""), rows_of(docs)
    want = [r for r in before if not (severity(r[1]) >= model.cut and severity(r[1]) > none)]
    kept = stage(spark, docs, corpus, 0)
    assert kept.columns == docs.columns and rows_of(kept) == want and {r[0] for r in before} - {r[0] for r in want} >= {i for i in range(260) if i % 8 == 3}

    told = language.train(kept)
    want = [r for r in want if r[1] and language.LETTER.search(r[1]) and told.told(r[1])[2]]
    kept = stage(spark, kept, corpus, 1)
    assert rows_of(kept) == want and not {400, 401, 402, 403} & {r[0] for r in want} and None in {r[0] for r in want}

    want = lines_left([r[:2] for r in want])
    kept = stage(spark, kept, corpus, 2)
    found = rows_of(kept)
    assert [r[:2] for r in found] == want and all(r[4] == len(r[1]) and r[5:] == ("own", "lines", 3) for r in found)

    root = roots([shingle_set(t) for _, t in want])
    want = [want[k] for k in sorted(set(root))]
    kept = stage(spark, kept, corpus, 3)
    assert [r[:2] for r in rows_of(kept)] == want and kept.columns == docs.columns

    library = Tokenizer.from_file(bpe.default_path())
    tokens = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in want}
    pieces = corpus_pipeline.run(spark, corpus).collect()
    lengths, places = {}, set()
    for r in pieces:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
        places |= {(r["sequence_id"], r["offset"] + k) for k in range(r["length"])}
    assert lengths == tokens and sorted(places) == [divmod(k, 2048) for k in range(sum(tokens.values()))]


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
