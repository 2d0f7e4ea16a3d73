"""Quality by random-indexing word vectors and a two-layer network.

Each word has a sparse random index vector; its context vector is the sum of
those of its neighbours all over the corpus. A document is the mean and the
spread of its words' vectors; a network of two layers, fitted in numpy, gives a
probability, calibrated by a temperature on texts that were not fitted to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as hash_word

from tessera.llm.common import coded_words, column_of, give_back, slices, small_batches, table_sum, tidy
from tessera.llm.toxicity import sample

#: Words are hashed into a table of fixed size (2 MB of vectors); words of a bucket share a vector.
BUCKET_BITS, DIMENSIONS, NONZERO = 14, 32, 2
#: Neighbours on either side that count as context.
WINDOW = 2
#: The network is fitted to this many labelled texts at most; a share of them is for the temperature.
SAMPLE_ROWS, HELD = 4000, 0.2
HIDDEN, STEPS, RATE, DECAY = 24, 400, 0.01, 1e-4
#: Numbers that a text is pooled to.
WIDTH = 2 * DIMENSIONS + 4
#: Probability of being good from which a document is kept.
THRESHOLD = 0.3
#: A stretch of text is a run of letters and digits or a run of other characters; its case is part of the word.
STRETCH = re.compile(r"[^\W_]+|[\W_]+")


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's index vector is not 0, and its signs there."""
    rng = np.random.Generator(np.random.PCG64(7))
    n = 1 << BUCKET_BITS
    at = np.stack([rng.permutation(DIMENSIONS)[:NONZERO] for _ in range(n)])
    return at, rng.integers(0, 2, (n, NONZERO)) * 2.0 - 1


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each stretch, first stretch of each text and an end)."""
    starts, codes, words = coded_words(texts)
    parts: dict[str, int] = {}
    flat, sizes = [], np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        cut = (w,) if w.isalnum() else STRETCH.findall(w)
        sizes[i] = len(cut)
        for x in cut:
            n = parts.get(x)
            if n is None:
                n = parts[x] = hash_word(x) >> (64 - BUCKET_BITS)
            flat.append(n)
    flat, at = np.array(flat, np.int64), np.concatenate([[0], np.cumsum(sizes)])
    n = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(at[codes] - ends[:-1], n) + np.arange(ends[-1])], ends[starts]


def _add_contexts(table: np.ndarray, ids: np.ndarray, ends: np.ndarray, at: np.ndarray, sign: np.ndarray) -> None:
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    for k in range(1, WINDOW + 1):
        same = doc[k:] == doc[:-k]
        a, b = ids[:-k][same], ids[k:][same]
        for x, y in ((a, b), (b, a)):
            for j in range(NONZERO):
                table += np.bincount(x * DIMENSIONS + at[y, j], weights=sign[y, j], minlength=table.size)


def word_vectors(rows: DataFrame) -> np.ndarray:
    """Unit context vectors by bucket, gathered from every text of rows; a bucket without contexts has its own index vector."""
    size = (1 << BUCKET_BITS) * DIMENSIONS

    def gather(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        table, (at, sign), n = np.zeros(size), _index_vectors(), 0
        for batch in batches:
            for part in slices(batch):
                _add_contexts(table, *buckets(part.column("text")), at, sign)
                n += part.num_rows
        return table.astype(np.int64) if n else None

    sums = table_sum(rows.select(column_of(rows, "text", "string").alias("text")), size, gather)
    return unit_vectors(sums.astype(np.float64).reshape(-1, DIMENSIONS))


def unit_vectors(contexts: np.ndarray) -> np.ndarray:
    at, sign = _index_vectors()
    own = np.zeros(contexts.shape)
    np.put_along_axis(own, at, sign, axis=1)
    total = contexts.sum(axis=0)
    size = np.linalg.norm(contexts, axis=1, keepdims=True)
    # What all words share would hide what sets them apart
    mean = total / max(np.linalg.norm(total), 1e-12)
    v = np.where(size > 0, contexts / np.maximum(size, 1e-12) - 0.5 * mean, 0) + 0.5 * own
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row a text: mean and deviation of its words' vectors, then the share of distinct ones, the length, and how often a word comes again after one or two places; zeros without words."""
    ids, ends = buckets(texts)
    n = np.diff(ends)
    out = np.zeros((len(n), WIDTH))
    have = np.flatnonzero(n)
    if len(have):
        begin = ends[:-1][have]
        for a in range(0, len(have), 256):
            part = have[a : a + 256]
            x = vectors[ids[ends[part[0]] : ends[part[-1] + 1]]]
            at = begin[a : a + 256] - ends[part[0]]
            size = n[part][:, None]
            mean = np.add.reduceat(x, at, axis=0) / size
            out[part, :DIMENSIONS] = mean
            out[part, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(np.add.reduceat(x * x, at, axis=0) / size - mean**2, 0))
        doc = np.repeat(np.arange(len(n)), n)
        kinds = np.unique(doc << BUCKET_BITS | ids) >> BUCKET_BITS
        distinct = np.bincount(kinds, minlength=len(n))
        again = [np.bincount(doc[k:][(ids[k:] == ids[:-k]) & (doc[k:] == doc[:-k])], minlength=len(n)) for k in (1, 2)]
        for i, values in enumerate((distinct / np.sqrt(np.maximum(n, 1)), np.log1p(n), again[0] / np.maximum(n, 1), again[1] / np.maximum(n, 1))):
            out[have, 2 * DIMENSIONS + i] = values[have]
    return out


class QualityModel:
    def __init__(self, vectors: np.ndarray, center: np.ndarray, scale: np.ndarray, layers: tuple[np.ndarray, ...], temperature: float):
        self.vectors, self.center, self.scale, self.layers, self.temperature = vectors, center, scale, layers, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.center) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled(texts, self.vectors)) / self.temperature, -40, 40)))


def fit(vectors: np.ndarray, x: np.ndarray, y: np.ndarray) -> QualityModel:
    """The network by Adam on most of the pooled texts x, the temperature by the likelihood of the rest. Without both labels: the share of label 1, smoothed."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    width = WIDTH
    rng = np.random.Generator(np.random.PCG64(11))
    layers = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.log(rate / (1 - rate))]
    if len(np.unique(y)) < 2:
        return QualityModel(vectors, np.zeros(width), np.ones(width), tuple(layers), 1.0)
    held = np.arange(len(y)) < HELD * len(y)
    center, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
    layers[2] = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    z, t = (x[~held] - center) / scale, y[~held]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    for step in range(1, STEPS + 1):
        w1, b1, w2, b2 = layers
        h = np.tanh(z @ w1 + b1)
        miss = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40))) - t) / len(t)
        back = np.outer(miss, w2) * (1 - h * h)
        grads = [z.T @ back + DECAY * w1, back.sum(axis=0), h.T @ miss + DECAY * w2, miss.sum()]
        for i, g in enumerate(grads):
            m, v = moments[i]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moments[i] = m, v
            layers[i] = layers[i] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(vectors, center, scale, tuple(layers), 1.0)
    if held.any():
        logit, truth = model.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
        loss = [np.logaddexp(0, np.where(truth == 1, -logit, logit) / s).mean() for s in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> QualityModel:
    """Word vectors from all documents, the network from labelled rows for which usable holds (see toxicity.sample). Texts are pooled where they are, whole; WIDTH numbers of each reach the driver."""
    vectors = word_vectors(docs)
    sampled = sample(docs, labels, "quality", usable, SAMPLE_ROWS)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1_000_000):
                x = pooled(part.column("text"), sent.value)
                yield pa.RecordBatch.from_pydict({"nth": part.column("nth"), "y": part.column("y"), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64()))})

    table = sampled.mapInArrow(tidy(pool), "nth long, y int, x array<double>").orderBy("nth").toArrow()
    sent.destroy()
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
    return fit(vectors, x, table["y"].to_numpy().astype(np.float64))


def scored(docs: DataFrame, model, *carried: Column, name: str = "score") -> DataFrame:
    """The carried columns of docs with the score, by any model with scores(texts): one row for each row of docs.

    Null or empty text: the score of a text without words. A very long text is scored whole; rows that repeat have the same score each. Only the carried columns and text are read, whatever the names
    of others. Empty table: empty result.
    """
    small_batches(docs.sparkSession)
    give_back()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*carried, column_of(docs, "text", "string").alias("__text"))
    names = rows.columns[:-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                values = sent.value.scores(part.column("__text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(values, pa.float64())], [*names, name])

    return rows.mapInArrow(tidy(score), rows.drop("__text").withColumn(name, F.lit(0.0)).schema)
