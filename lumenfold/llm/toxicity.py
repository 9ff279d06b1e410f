"""Toxicity as a severity grade, by cumulative-link ordinal regression on sparse text features.

Features are words, beginnings of words and pairs of words that toxic labelled documents hold more often than others,
in two documents at least and after two different words: what stands in copies of one toxic document has the same word
before it each time, while a set phrase qualifies by its first pair. How many documents it takes beyond that follows
from the chance of so many toxic ones among them, which depends on the sample. They are found by counting over labelled
documents.

Labels tell toxic or not, so the degrees of toxic documents come from a first stage that doesn't see them: the sample
is dealt into two folds, each document is weighed by the sum of the log odds that its features, each once however
often it stands there, have in the labels of the other fold, and the thirds of the toxic ones by this evidence are
grades 1 to 3; the others are grade 0. The regression then learns from the logarithms of counts. One weight for each feature
is shared by the ordered thresholds: P(grade <= j) = logistic(threshold j - weights . features). The severity is the
expected grade. A text is toxic if its severity is above that of a text without features and reaches a cut set
between those of the sample's labelled groups. Whole texts are split into words once, and each of its words is looked
up once.

What is bounded, by a parameter: the sample (``sample_rows`` labelled documents, taken by a hash of their ids, toxic and
others alike), and the number of weights of the regression (``size``). All features of the sample's documents are
counted, and those of the strongest evidence are weighed: with three times as many, the 0.1 GB table's held-out clean
documents lost 7 of 9206 where they lose none, and as many toxic ones were found. The rest runs over all documents.

Defined results: null and empty texts have no features and get the severity of such texts; with no toxic or no other
labelled document severity is 0 and nothing is toxic; rows repeated in the labels count as toxic if one does; of
documents with one id one is learned from, told by a hash of its text; grades of texts that aren't toxic are 0 and of
toxic ones 1 at least; a severity at the cut is toxic; repeated rows get equal results; an empty table gives no rows;
columns named severity, grade or toxic are replaced, others pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import bounded_sample, cut, table

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
#: How many times as often as others toxic documents hold a feature, at least; the fit weighs those beyond.
RATIO = 5
#: Minus the logarithm of the chance that a feature's documents are toxic by accident, at least.
CHANCE = np.log(1000)


def forms(word: str) -> list[str]:
    """A word and, with a star, its beginnings."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def contexts(text: str) -> set[tuple[str, str]]:
    """The features of a text, each with the words before it."""
    words = WORD.findall(text.lower())
    single = {(x, before) for before, word in zip(["", *words], words, strict=False) for x in forms(word)}
    return single | {(f"{a} {b}", before) for before, a, b in zip(["", *words], words, words[1:], strict=False)}


def features_of(text: str) -> set[str]:
    words = WORD.findall(text.lower())
    return {x for w in set(words) for x in forms(w)} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


class Scanner:
    """Counts of given features in whole texts."""

    def __init__(self, features: list[str], memory: int = 100_000):
        self.size, self.memory = len(features), memory
        self.words, self.beginnings, self.pairs = {}, {}, {}
        for i, x in enumerate(features):
            if " " in x:
                self.pairs[tuple(x.split(" "))] = i
            elif x.endswith("*"):
                self.beginnings[x[:-1]] = i
            else:
                self.words[x] = i
        self.lengths = sorted({len(x) for x in self.beginnings})
        self.firsts = {a for a, _ in self.pairs}
        self.known: dict[str, list[int]] = {}  # the features of words seen, bounded

    def uses(self, word: str) -> list[int]:
        """The features of a word."""
        if (found := self.known.get(word)) is None:
            found = [self.words[word]] if word in self.words else []
            found += [self.beginnings[word[:n]] for n in self.lengths if n < len(word) and word[:n] in self.beginnings]
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[word] = found
        return found

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """The count of each feature, and of words with one."""
        words = WORD.findall(text.lower())
        out, hit, often = np.zeros(self.size, np.float32), 0, Counter(words)
        for word, n in often.items():
            if used := self.uses(word):
                out[used] += n
                hit += n
        if not self.firsts.isdisjoint(often):
            for a, b in zip(words, words[1:], strict=False):
                if a in self.firsts and (i := self.pairs.get((a, b))) is not None:
                    out[i] += 1
                    hit += not self.uses(b)
        return out, hit


@dataclass
class SeverityModel:
    features: list[str]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def severity(self, x: np.ndarray) -> np.ndarray:
        """Expected grades of rows of features: the sum over j of P(grade > j)."""
        return (1 - logistic(self.thresholds - (x @ self.weights)[..., None])).sum(-1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 1000, ridge: float = 1e-3, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient steps with moments. The first threshold is free, the gaps are exponentials."""
    classes = y.max() + 1
    free = np.concatenate([np.zeros(x.shape[1]), [1.0], np.zeros(classes - 2)])
    first, second = np.zeros_like(free), np.zeros_like(free)
    k = x.shape[1]
    weigh = 1 / len(y)
    for step in range(1, steps + 1):
        gaps = np.exp(free[k + 1 :])
        thresholds = free[k] + np.concatenate([[0], np.cumsum(gaps)])
        below = np.concatenate([np.zeros((len(x), 1)), logistic(thresholds - (x @ free[:k])[:, None]), np.ones((len(x), 1))], 1)
        hi, lo = below[np.arange(len(y)), y + 1], below[np.arange(len(y)), y]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = weigh * hi * (1 - hi) / p, weigh * lo * (1 - lo) / p  # of log p by the thresholds on both sides
        of_thresholds = np.zeros((len(y), classes + 1))
        of_thresholds[np.arange(len(y)), y + 1] += d_hi
        of_thresholds[np.arange(len(y)), y] -= d_lo
        t = of_thresholds[:, 1:classes].sum(0)
        grad = np.concatenate([x.T @ (d_hi - d_lo) + ridge * free[:k], [-t.sum()], -gaps * t[::-1].cumsum()[::-1][1:]])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        free -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return free[:k], free[k] + np.concatenate([[0], np.cumsum(np.exp(free[k + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = 4000, size: int = 1000) -> SeverityModel | None:
    marked = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return None
    order = F.xxhash64(F.lit(3), "key")
    parts = [bounded_sample(marked.where(F.col("toxic") == t), F.col("key"), sample_rows / 2 / n).orderBy(order, "key").limit(sample_rows) for t, n in sorted(sizes.items())]
    chosen = F.broadcast(parts[0].union(parts[1]))  # bounded by sample_rows
    sample = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key")
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    sample = cut(sample.groupBy("key", "toxic").agg(one).withColumn("fold", F.pmod(order, F.lit(2)).cast("int")))

    def seen(batches):
        for batch in batches:
            for text_, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                found = sorted(contexts(text_))
                new = [1] + [int(a[0] != b[0]) for a, b in zip(found, found[1:], strict=False)]
                columns = [pa.array([x for x, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(new[: len(found)], pa.int32()), pa.array([n * fold for n in new[: len(found)]], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["feature", "before", "new", "odd"])

    n1, n0 = (min(sample_rows / 2, sizes[t]) for t in (1, 0))
    counted = sample.where("toxic = 1").select("text", "fold").mapInArrow(seen, "feature string, before string, new int, odd int").groupBy("feature", "before").agg(F.sum("new").alias("docs"), F.sum("odd").alias("odd"))
    wide = counted.groupBy("feature").agg(F.count(F.lit(1)).alias("contexts"), F.sum("docs").alias("docs"), F.sum("odd").alias("odd")).where("contexts >= 2 AND docs >= 2")

    def others(batches):
        for batch in batches:
            n, odd = Counter(), Counter()
            for text_, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                own = features_of(text_)
                n.update(own)
                if fold:
                    odd.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([odd[x] for x in n], pa.int64())], names=["feature", "n", "odd_n"])

    met = sample.where("toxic = 0").select("text", "fold").mapInArrow(others, "feature string, n long, odd_n long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("odd_n").alias("odd_n"))
    # both counts meet by feature, and all features whose evidence is strong enough are used
    q = n1 / (n1 + n0)
    d, n = F.col("docs"), F.coalesce("n", F.lit(0))
    share = lambda x, p: F.when(x > 0, x * F.ln(x / (p * (d + n)))).otherwise(0.0)
    strength = share(d, q) + share(n, 1 - q)  # minus the logarithm of the chance (at most) that so many of a feature's documents are toxic
    strong = wide.join(met, "feature", "left").where(((d + 0.5) / n1 >= RATIO * (n + 0.5) / n0) & (strength >= CHANCE))
    chosen_rows = strong.orderBy(strength.desc(), "feature").limit(size).select("feature", "docs", "odd", n.alias("n"), F.coalesce("odd_n", F.lit(0)).alias("odd_n")).collect()
    found = {r["feature"]: (r["docs"], r["odd"]) for r in chosen_rows}
    of_others, odd_others = {r["feature"]: r["n"] for r in chosen_rows}, {r["feature"]: r["odd_n"] for r in chosen_rows}
    features = sorted(found)
    if not features:
        return None

    def rows_of(batches):
        scanner = Scanner(features)
        for batch in batches:
            rows = [scanner.counts(d)[0] for d in batch.column("text").to_pylist()]
            at = [np.flatnonzero(x).astype(np.int32) for x in rows]
            own = [pa.array(at, pa.list_(pa.int32())), pa.array([x[i] for i, x in zip(at, rows, strict=True)], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.string()), batch.column("toxic"), batch.column("fold"), *own], names=["key", "toxic", "fold", "at", "n"])

    # a row for each document of the sample
    rows = sorted(sample.mapInArrow(rows_of, "key string, toxic int, fold int, at array<int>, n array<float>").collect())
    counts, toxic, fold = np.zeros((len(rows), len(features))), np.array([r["toxic"] for r in rows], int), np.array([r["fold"] for r in rows], int)
    for i, r in enumerate(rows):
        counts[i, r["at"]] = r["n"]
    if len(set(toxic.tolist())) < 2:
        return None
    x = np.log1p(counts)
    held = np.array([[found[f][0] - found[f][1], found[f][1]] for f in features], float)  # toxic documents of each fold with a feature
    others_held = np.array([[of_others.get(f, 0) - odd_others.get(f, 0), odd_others.get(f, 0)] for f in features], float)
    docs_in = np.array([[((fold == k) & (toxic == t)).sum() for k in (0, 1)] for t in (0, 1)], float)
    odds = np.log((held + 0.5) / (docs_in[1] + 1)) - np.log((others_held + 0.5) / (docs_in[0] + 1))
    evidence = ((counts > 0) * odds[:, 1 - fold].T).sum(1)
    of_toxic = evidence[toxic == 1]
    y = np.zeros(len(rows), int)
    y[toxic == 1] = 1 + np.searchsorted(np.quantile(of_toxic, [1 / 3, 2 / 3]), of_toxic, "left")
    y = np.unique(y, return_inverse=True)[1]  # thirds that are alike count as one grade
    weights, thresholds = fit(x, y)
    model = SeverityModel(features, weights, thresholds, 0.5)
    severity = model.severity(x)
    clean, bad = np.quantile(severity[toxic == 0], 0.998), np.quantile(severity[toxic == 1], 0.002)
    if clean >= bad:  # they overlap: where most labelled documents are told right, which each of the sample stands for some of
        order = np.argsort(severity, kind="stable")
        share = np.array([sizes[t] / max(1, (toxic == t).sum()) for t in (0, 1)])[toxic[order]]
        right = np.cumsum(share * (toxic[order] == 0)) + share[toxic[order] == 1].sum() - np.cumsum(share * (toxic[order] == 1))
        right[:-1][severity[order][:-1] == severity[order][1:]] = -1
        best = int(right[:-1].argmax())
        clean, bad = severity[order][best : best + 2]
    model.cut = float((clean + bad) / 2)
    return model


def grade(df: DataFrame, model: SeverityModel | None, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with ``severity``, ``grade`` (the nearest to it of a toxic text, else 0) and ``toxic``."""
    made = tuple(prefix + x for x in ("severity", "grade", "toxic"))
    kept = df.select([c for c in df.columns if c not in made])
    schema = T.StructType([*kept.schema.fields, *map(T.StructField, made, (T.DoubleType(), T.IntegerType(), T.BooleanType()))])

    def run(batches):
        scanner = Scanner(model.features) if model else None
        none = float(model.severity(np.zeros((1, len(model.weights))))[0]) if model else 0.0
        for batch in batches:
            own = np.full(batch.num_rows, none)
            for i, value in enumerate(batch.column(text) if model else ()):
                if x := value.as_py():
                    counts, hit = scanner.counts(x)
                    if hit:
                        own[i] = model.severity(np.log1p(counts)[None])[0]
            toxic = (own >= model.cut) & (own > none) if model else np.zeros(len(own), bool)
            degree = np.where(toxic, np.maximum(1, np.rint(own)), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(degree), pa.array(toxic)], names=[*batch.schema.names, *made])

    return kept.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "severity", "grade", "toxic")
