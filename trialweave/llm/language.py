"""Language identification by sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to three lower-cased characters, weighted by term frequency
and inverse document frequency and scaled to length one.  Weights are fitted by
follow-the-regularised-leader with elastic-net penalties, then one temperature is fitted on a
part of the sample that the weights have not seen.  The weights are fitted on a bounded sample
(``sample_rows``), n-gram frequencies are counted over all rows; every whole text is classified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 15
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and their counts; long texts are counted in blocks."""
    counts = np.zeros(BUCKETS, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for low in range(0, len(code), 1 << 18):
        block = code[max(0, low - 2) : low + (1 << 18)].astype(np.uint64)
        seen = min(low, 2)
        value = np.zeros(len(block), np.uint64)
        for size in (1, 2, 3):
            value = value[: len(block) - size + 1] * np.uint64(0x9E3779B97F4A7C15) + block[size - 1 :] + np.uint64(size)
            spread = (value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)
            counts += np.bincount(spread[max(0, seen - size + 1) :].astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.scaled(*grams(text))

    def scaled(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = np.log1p(count) * self.idf[at]
        return at, value / max(np.sqrt((value * value).sum()), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        at, value = self.features(text)
        p = _softmax(value @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_model(
    counts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0,
    l1: float = 1e-4, l2: float = 1e-4,
) -> LanguageModel:
    """Fit weights on four fifths of the rows, given their n-gram counts, and the temperature on the rest."""
    languages = sorted(set(langs))
    model = LanguageModel(languages, idf, np.zeros((BUCKETS, len(languages))), 1.0)
    held = [i for i in range(len(counts)) if i % 5 == 4]
    fitted = [i for i in range(len(counts)) if i % 5 != 4]
    rows = [model.scaled(*c) for c in counts]
    target = [languages.index(lang) for lang in langs]
    z, n, w = np.zeros_like(model.weights), np.zeros_like(model.weights), model.weights
    random = np.random.default_rng(7)
    for _ in range(epochs):
        for i in random.permutation(fitted):
            at, value = rows[i]
            step = (beta + np.sqrt(n[at])) / alpha + l2
            w[at] = np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / step)
            p = _softmax(value @ w[at])
            p[target[i]] -= 1
            g = value[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w[at]
            n[at] += g * g
    step = (beta + np.sqrt(n)) / alpha + l2
    model.weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / step)
    if held:
        logits = np.array([rows[i][1] @ model.weights[rows[i][0]] for i in held])
        truth = np.array([target[i] for i in held])

        def loss(t: float) -> float:
            s = logits / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(bucket, n)`` of one task: how many of its texts have an n-gram of the bucket; -1 counts the texts."""
    total, texts = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for t in batch["t"]:
            total[grams(t.as_py())[0]] += 1
        texts += len(batch)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], texts))], ["bucket", "n"])


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """The IDF of every bucket over all texts ``t``: at most ``BUCKETS`` sums reach the driver."""
    sums = rows.select("t").mapInArrow(_frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r["bucket"]: r["n"] for r in sums.collect()}
    frequency = np.zeros(BUCKETS)
    texts = found.pop(-1, 0)
    frequency[list(found)] = list(found.values())
    return np.log((1 + texts) / (1 + frequency)) + 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [grams(t.as_py()) for t in batch["t"]]
        at = pa.array([a.astype(np.uint16).tobytes() for a, _ in found], pa.binary())
        count = pa.array([np.minimum(c, 0xFFFFFFFF).astype(np.uint32).tobytes() for _, c in found], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["o"], batch["l"], at, count], ["o", "l", "at", "count"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = 4_000) -> LanguageModel:
    """Fit on about ``sample_rows`` rows with a language, and on the n-gram frequencies of all of them.

    Every language has an equal share of the sample, at least one row: its first rows by a hash
    of their key, of which whole texts are counted in tasks.  Rare languages are thus learned
    too.  The document frequencies behind the weights are counted over all rows.  Rows without
    text, language or letter are not used; an empty sample gives a model that answers ``und``.
    Repeated rows count as often as they occur.
    """
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.where(F.col("t").isNotNull() & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    rows = rows.withColumn("o", F.md5(F.concat_ws("|", "k", "l")))
    languages = rows.agg(F.count_distinct("l")).first()[0]
    if not languages:
        return fit_model([], [], np.ones(BUCKETS))
    share = max(1, sample_rows // languages)
    place = F.row_number().over(Window.partitionBy("l").orderBy("o"))
    # the filter on the place lets every task drop all but its first rows before they are shuffled
    last = rows.select("l", "o").withColumn("place", place).where(F.col("place") <= share).groupBy("l").agg(F.max("o").alias("last"))
    picked = rows.join(F.broadcast(last), "l").where(F.col("o") <= F.col("last")).select("o", "l", "t")
    counted = picked.mapInArrow(_features, "o string, l string, at binary, count binary")
    best = Window.partitionBy("l").orderBy("o", "at", "count")
    sample = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= share)
    sample = sorted(sample.select("o", "l", "at", "count").collect(), key=lambda r: (r.o, r.l, bytes(r.at), bytes(r["count"])))
    counts = [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["count"], np.uint32).astype(np.int64)) for r in sample]
    return fit_model(counts, [r["l"] for r in sample], inverse_frequencies(rows))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, lang_pred, score)``, one row per row; ``und`` and 0.0 for null texts and those without a letter.

    Equal texts have equal predictions; of languages with the same probability the first by
    name is returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [model.predict(t.as_py()) for t in part["t"]]
                yield pa.RecordBatch.from_arrays(
                    [part["k"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                    [key, "lang_pred", "score"],
                )

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)
