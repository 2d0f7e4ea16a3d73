"""Toxicity by character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct words' character n-grams, hashed. Each
feature is scaled by the log of how much more often toxic texts have it, then a
linear classifier is fitted. A word's share of the score depends on the word
alone, so each distinct word of a stretch of texts is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import coded_words, column_of, slices, staged, table_sum

GRAMS = (2, 3, 4, 5)
FEATURE_BITS = 18
#: The classifier is fitted to this many labelled texts at most, those whose doc_id has the smallest hash; they lie in so many files.
SAMPLE_ROWS, SAMPLE_PARTS = 4000, 16
#: Text bytes of the sample whose n-grams are in memory at a time.
FIT_BYTES = 500_000
#: Pseudo-count of the ratios; features that fewer sample texts have, or whose ratio is nearer to 0, are left out.
SMOOTH, LEAST_TEXTS, LEAST_RATIO = 1.0, 4, 0.7
#: Features that the classifier weighs at most: those of the largest ratio times the root of the texts that have them.
MOST_FEATURES = 1 << 16
STEPS, RATE, DECAY = 150, 0.03, 1e-3
THRESHOLD = 0.7


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """nth, y, text of at most `rows` labelled documents for which usable holds, in the order nth of the hash of their doc_id (ties: doc_id, hash of the text, label); null labels left out.

    Only the number of rows is bounded: texts are kept whole, however long, and lie in the shared folder. Rows alike in doc_id, text and label count once. What reaches the driver is the ids.
    """
    spark = docs.sparkSession
    usable_rows = labels.filter(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    picked = usable_rows.select("doc_id", F.col(label).cast("int").alias("y")).distinct().orderBy(F.xxhash64("doc_id"), "y").limit(rows)
    picked = spark.createDataFrame(picked.collect(), picked.schema)
    text = column_of(docs, "text", "string")
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id").withColumn("h", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    keys = found.select("doc_id", "h", "y").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h", "y").limit(rows)
    chosen = spark.createDataFrame([(*k, n) for n, k in enumerate(keys.collect())], f"doc_id {dict(docs.dtypes)['doc_id']}, h long, y int, nth long")
    one = found.join(F.broadcast(chosen), ["doc_id", "h", "y"]).select("nth", "y", "text").dropDuplicates(["nth"])
    return staged(one.repartition(SAMPLE_PARTS, "nth"), "sample")


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) of the n-grams of each word, lower-cased and set between marks; an n-gram that a word has twice is there twice."""
    marked = "".join("\x02" + w.lower() + "\x03" for w in words)
    c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begins = np.flatnonzero(c == 2)
    # Words hold neither mark unless a text does; those fall to the word before them
    word = np.minimum(np.cumsum(c == 2) - 1, max(len(words) - 1, 0)) if len(begins) == len(words) else np.repeat(np.arange(len(words)), [len(w.lower()) + 2 for w in words])
    out_w, out_f = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            inside = word[:m] == word[n - 1 :]
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            out_w.append(word[:m][inside])
            out_f.append((x >> np.uint64(64 - FEATURE_BITS))[inside].astype(np.int32))
    return (np.concatenate(out_w), np.concatenate(out_f)) if out_w else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text number, word number) of the distinct words of each text, and the words."""
    starts, codes, words = coded_words(texts)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pairs = np.unique(doc * max(1, len(words)) + codes)
    return pairs // max(1, len(words)), pairs % max(1, len(words)), words


class ToxicityModel:
    """weights of the hashed features and a bias; score = logistic(bias + sum of the distinct words' weights)."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Between 0 and 1; a text without words has that of the bias."""
        doc, word, words = distinct_words(texts)
        of, feature = word_grams(words)
        share = np.bincount(of, weights=self.weights[feature], minlength=len(words)) if len(of) else np.zeros(len(words))
        z = self.bias + np.bincount(doc, weights=share[word] if len(word) else None, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _cells(texts: pa.Array, keep: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, feature, words of the text with it) for stretches of texts; of the features in keep only."""
    first = 0
    for part in slices(pa.record_batch({"text": texts}), most=FIT_BYTES):
        doc, word, words = distinct_words(part.column("text"))
        of, feature = word_grams(words)
        if keep is not None:
            of, feature = of[keep[feature]], feature[keep[feature]]
        order = np.argsort(of, kind="stable")
        of, feature = of[order], feature[order]
        at = np.searchsorted(of, np.arange(len(words) + 1))
        n = np.diff(at)[word]
        where = np.repeat(at[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cells, counts = np.unique(np.repeat(doc, n) << FEATURE_BITS | feature[where], return_counts=True)
        yield (first + (cells >> FEATURE_BITS)).astype(np.int32), (cells & ((1 << FEATURE_BITS) - 1)).astype(np.int32), counts.astype(np.int32)
        first += part.num_rows


def ratios(texts_with: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-count ratio of each feature, of how many texts and how many toxic ones have it; 0 for those that are left out."""
    toxic, clean = toxic + SMOOTH, texts_with - toxic + SMOOTH
    r = np.log(toxic / toxic.sum()) - np.log(clean / clean.sum())
    r[(texts_with < LEAST_TEXTS) | (np.abs(r) < LEAST_RATIO)] = 0
    if np.count_nonzero(r) > MOST_FEATURES:
        r[np.argsort(-np.abs(r) * np.sqrt(texts_with), kind="stable")[MOST_FEATURES:]] = 0
    return r


def descend(rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, y: np.ndarray, r: np.ndarray) -> ToxicityModel:
    """Logistic regression on counts (of features cols in texts rows) scaled by r, by gradient steps with weight decay. Without both labels: the share of label 1, smoothed."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = np.log(rate / (1 - rate))
    full = np.zeros(1 << FEATURE_BITS)
    if len(np.unique(y)) < 2:
        return ToxicityModel(full, bias)
    used, cols = np.unique(cols, return_inverse=True)
    x = (counts * r[used][cols]).astype(np.float32)
    w, b = np.zeros(len(used)), bias
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = b + np.bincount(rows, weights=x * w[cols], minlength=len(y))
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g, gb = np.bincount(cols, weights=x * miss[rows], minlength=len(used)) + DECAY * w, miss.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        lr = RATE / np.sqrt(1 + step / 50)
        w -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= lr * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
    full[used] = w * r[used]
    return ToxicityModel(full, b)


def fit(texts: pa.Array, y: np.ndarray) -> ToxicityModel:
    """The model of texts that are here. No text, or all of one label: the share of label 1, smoothed."""
    size = 1 << FEATURE_BITS
    texts_with, toxic = np.zeros(size), np.zeros(size)
    for rows, cols, _ in _cells(texts):
        texts_with += np.bincount(cols, minlength=size)
        toxic += np.bincount(cols, weights=y[rows], minlength=size)
    r = ratios(texts_with, toxic)
    cells = list(_cells(texts, r != 0))
    return descend(*(np.concatenate(x) for x in zip(*cells, strict=True)), y, r) if cells else descend(*(np.zeros(0, np.int32),) * 3, y, r)


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> ToxicityModel:
    """fit() on the sample, whose texts stay where they are: tables of fixed size are summed up for the ratios, then the counts of the features that are left reach the driver."""
    sampled, size = sample(docs, labels, "toxic", usable), 1 << FEATURE_BITS

    def tally(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        tables = np.zeros((2, size))
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            for rows, cols, _ in _cells(batch.column("text")):
                tables[0] += np.bincount(cols, minlength=size)
                tables[1] += np.bincount(cols, weights=y[rows], minlength=size)
        return tables.ravel().astype(np.int64)

    texts_with, toxic = table_sum(sampled, 2 * size, tally).reshape(2, size).astype(np.float64)
    r = ratios(texts_with, toxic)
    keep = docs.sparkSession.sparkContext.broadcast(r != 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=FIT_BYTES):
                for rows, cols, counts in _cells(part.column("text"), keep.value):
                    ends = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
                    lists = {n: pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for n, x in (("cols", cols), ("counts", counts))}
                    yield pa.RecordBatch.from_pydict({"nth": part.column("nth"), "y": part.column("y")} | lists)

    table = sampled.mapInArrow(count, "nth long, y int, cols array<int>, counts array<int>").orderBy("nth").toArrow()
    keep.destroy()
    cols, y = table["cols"].combine_chunks(), table["y"].to_numpy().astype(np.float64)
    rows = np.repeat(np.arange(len(y)), np.diff(cols.offsets.to_numpy()))
    return descend(rows, cols.flatten().to_numpy(), table["counts"].combine_chunks().flatten().to_numpy(), y, r)
