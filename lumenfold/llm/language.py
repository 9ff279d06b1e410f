"""Language identification by averaged hashed subword embeddings with a linear softmax.

Subwords are the runs of two to four bytes inside words (with the word's edges), hashed into ``BUCKETS`` embeddings.
A text is the mean of its subwords' embeddings; a linear softmax follows. Both are trained together by stochastic
gradient descent in numpy, on a sample of labelled rows bounded by ``sample_rows``. A quarter of the sample is kept
aside to fit a temperature (so that a score is a probability) and what an accepted text must have: a least score, and
a least share of subwords that were seen in training in the language it is told to be. One in a thousand of the rows
kept aside that are told right lies below either. A text of no known language can have a high score, since some class
is always ahead, but few of its subwords were seen. Each whole text is scored in the task that reads it; the
model, embeddings times softmax weights, is a small table of fixed size.

Defined results: a null text or one without a letter is ``und`` with score 0 and not accepted; with nothing to learn
from every text is; equal scores go to the language first in order; a row without id isn't held out nor learned
from; of rows with one id and language one is learned from; repeated rows get equal results; an empty table gives no
rows; columns named lang_pred, score or accepted are replaced, others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import cut, table

BUCKETS, DIMENSIONS = 1 << 14, 16
LETTER = regex.compile(r"\p{L}")  # no numerals, marks or symbols
#: Bytes as subwords see them: lower-case letters and the bytes of other scripts, all else a space.
PLAIN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def subwords(text: str) -> np.ndarray:
    """How often each bucket is hit by the subwords of a text."""
    data = PLAIN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)].astype(np.uint32)
    space = data == 32
    hashes, inner, keys = data * FACTORS[0], np.zeros(len(data), bool), []
    for n in (2, 3, 4):
        if len(data) < n:
            break
        hashes = (hashes[: len(data) - n + 1] ^ (hashes[: len(data) - n + 1] >> np.uint32(15))) * FACTORS[n - 1] + data[n - 1 :] * FACTORS[0]
        inner = inner[: len(hashes)] | space[n - 2 : n - 2 + len(hashes)] if n > 2 else inner[: len(hashes)]
        whole = ~inner & ~(space[: len(hashes)] & space[n - 1 :])
        keys.append((hashes[whole] ^ np.uint32(n)) * FACTORS[1] >> np.uint32(18))
    return np.bincount(np.concatenate(keys), minlength=BUCKETS).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # of each bucket for each language
    bias: np.ndarray
    temperature: float
    least: float
    seen: np.ndarray  # the buckets that training saw in each language
    known: float

    def told(self, text: str) -> tuple[int, float, bool]:
        """The language of a text, its score and whether it is accepted."""
        counts = subwords(text)
        scores = softmax((counts @ self.weights / max(1.0, counts.sum()) + self.bias) / self.temperature)
        best = int(scores.argmax())
        return best, float(scores[best]), bool(scores[best] >= self.least and known_share(counts @ self.seen[best], counts.sum()) >= self.known)


def known_share(known, n):
    """The share of ``n`` subwords that is known, with two deviations allowed for chance in short texts."""
    n = np.maximum(1, n)
    return known / n + 1 / np.sqrt(n)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def descend(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 12, batch: int = 32, rate: float = 40.0) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times softmax weights, and biases, by stochastic gradient descent with a falling rate."""
    draw = np.random.default_rng(5)
    e = draw.normal(0, 0.5, (x.shape[1], DIMENSIONS)).astype(np.float32)
    w, b = np.zeros((DIMENSIONS, classes), np.float32), np.zeros(classes, np.float32)
    steps = epochs * -(-len(x) // batch)
    done = 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for at in range(0, len(x), batch):
            own = order[at : at + batch]
            xs, lr = x[own], rate * (1 - done / steps)
            mean = xs @ e
            error = softmax(mean @ w + b)
            error[np.arange(len(own)), y[own]] -= 1
            error /= len(own)
            back = error @ w.T
            w -= 0.05 * lr * (mean.T @ error)
            b -= 0.01 * lr * error.sum(0)
            e -= lr * (xs.T @ back)
            done += 1
    return e @ w, b


def held_out(key: str = "doc_id") -> Column:
    """One document in four, by a checksum of its id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = 1600) -> LanguageModel | None:
    """A model of the languages of the rows that aren't held out."""
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    each = max(1, sample_rows // len(sizes))
    sample = known.join(F.broadcast(known.sparkSession.createDataFrame([(k, float(each) / n) for k, n in sizes.items()], "lang string, share double")), "lang").where(
        F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < F.col("share") * 1_000_003
    )

    # of documents with one id one is learned from
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    sample = cut(sample.groupBy("key", "lang").agg(one).orderBy(F.xxhash64(F.lit(3), "key"), "key", "lang").limit(2 * sample_rows))

    def run(batches):
        for batch in batches:
            rows = [(k, g, subwords(t)) for k, g, t in zip(batch.column("key").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if LETTER.search(t)]
            at = [np.flatnonzero(c) for _, _, c in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(k) for k, _, _ in rows], pa.string()), pa.array([g for _, g, _ in rows], pa.string()), pa.array([i.astype("<i4").tobytes() for i in at], pa.binary()), pa.array([c[i].astype("<f4").tobytes() for i, (_, _, c) in zip(at, rows, strict=True)], pa.binary())],
                names=["key", "lang", "at", "n"],
            )

    rows = sorted(sample.select("key", "lang", "text").mapInArrow(run, "key string, lang string, at binary, n binary").collect())  # bounded by sample_rows; bytes, since lists of numbers take ten times the memory
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    x, y = np.zeros((len(rows), BUCKETS), np.float32), np.array([languages.index(r["lang"]) for r in rows])
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["n"], "<f4")
    del rows
    total = x.sum(1)
    x /= np.maximum(1, total[:, None])
    aside = np.arange(len(x)) % 4 == 3
    aside = aside if aside.any() else ~aside
    weights, bias = descend(x[~aside] if (~aside).any() else x, y[~aside] if (~aside).any() else y, len(languages))
    logits, truth = x[aside] @ weights + bias, y[aside]

    def loss(t: float) -> float:
        return -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()

    temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
    learned = ~aside if (~aside).any() else aside
    seen = np.array([(x[learned & (y == k)] > 0).any(0) for k in range(len(languages))], np.float32)
    right = logits.argmax(1) == truth
    if not right.any():
        return LanguageModel(languages, weights, bias, temperature, 0.5, seen, 0.0)
    own = softmax(logits[right] / temperature).max(1)
    share = known_share((x[aside][right] * seen[truth[right]]).sum(1) * total[aside][right], total[aside][right])
    return LanguageModel(languages, weights, bias, temperature, min(float(np.quantile(own, 0.001)), 0.5), seen, float(np.quantile(share, 0.001)))


def predict(df: DataFrame, model: LanguageModel | None, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``accepted``."""
    made = tuple(prefix + x for x in ("lang_pred", "score", "accepted"))
    kept = df.select([c for c in df.columns if c not in made])
    schema = T.StructType([*kept.schema.fields, *map(T.StructField, made, (T.StringType(), T.DoubleType(), T.BooleanType()))])

    def one(value: str | None) -> tuple[str, float, bool]:
        if not value or model is None or not LETTER.search(value):
            return "und", 0.0, False
        best, score, accepted = model.told(value)
        return model.languages[best], score, accepted

    def run(batches):
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column(text)]
            own = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, *made])

    return kept.mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
