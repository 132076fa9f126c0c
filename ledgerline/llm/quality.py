"""Quality classifier: random-indexing word vectors, pooled per document, a two-layer network, calibrated probabilities.

Words are runs of letters, of digits and of other signs, as written. Each has a fixed sparse index vector (a few +1 and -1,
from a hash of the word). A word's vector is the sum, over all its occurrences in all documents, of the index vectors of
the words around it and of itself, each turned by its offset, so that before and after differ; then it is normalised.
Words fall into BUCKETS rows by hash, so the model's size is fixed; every task adds up its own documents and the sums of
tasks are added in two levels.

A document is the mean and the spread of its words' vectors, and the mean product of the vectors of neighbours. There is
no other input. Every word of every text counts.

The fit of the network takes a bounded sample of labelled rows (`sample_rows`), the first by a hash of the id; the word
vectors and scoring have no bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import common as C

BUCKETS = 1 << 14
DIM = 32
#: Non-zero entries of an index vector; words to each side that count as neighbours.
SPARSE, REACH = 4, 2
#: Numbers that a document is pooled to.
POOLED = 3 * DIM
#: Rows of the vectors' sum that travel together.
CHUNK = 256
WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x09-\x0D\x20]+")


class Buckets(dict):
    """Bucket numbers of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        k = self[word] = xxhash.xxh64_intdigest(word, 3) % BUCKETS
        return k

    def of(self, text: bytes | None) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        words = WORD.findall(text or b"")
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero entries of each bucket's fixed vector; places may repeat."""
    rng = np.random.default_rng(17)
    return rng.integers(0, DIM, (BUCKETS, SPARSE)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, SPARSE))


def context_sums(docs: list[np.ndarray]) -> np.ndarray:
    """BUCKETS x DIM: for each bucket the turned index vectors of the words within REACH of its occurrences, itself included."""
    at, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM * 2, np.int64)  # pluses and minuses of each number
    ids, doc = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    for d in range(-REACH, REACH + 1):
        if abs(d) >= len(ids):
            continue
        word, near = slice(max(0, -d), len(ids) - max(0, d)), slice(max(0, d), len(ids) - max(0, -d))
        inside = doc[word] == doc[near]
        place = (at + d) % DIM * 2 + (sign < 0)
        total += np.bincount((ids[word][inside][:, None] * (2 * DIM) + place[ids[near][inside]]).ravel(), minlength=len(total))
    total = total.reshape(BUCKETS, DIM, 2)
    return total[:, :, 0] - total[:, :, 1]


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Normalised vectors of all buckets, summed over all texts; buckets that no text has are zero."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, buckets, held, n = np.zeros((BUCKETS, DIM), np.int64), Buckets(), [], 0
        for big in batches:
            for b in C.slices(big, 1 << 20):
                for t in b.column(0).to_pylist():
                    held.append(buckets.of(t))
                    n += len(held[-1])
                if n > 200_000:
                    total += context_sums(held)
                    held, n = [], 0
        if n:
            total += context_sums(held)
        for k in range(0, BUCKETS, CHUNK):
            if total[k : k + CHUNK].any():
                yield C.array_row(k, total[k : k + CHUNK].ravel())

    sums = C.add_arrays(docs.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("t")).mapInArrow(count, C.ARRAY_ROW))
    out = np.zeros((BUCKETS, DIM))
    for k, x in sums.items():
        out[k : k + CHUNK] = x.reshape(CHUNK, DIM)
    return (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32)


def pool(docs: list[np.ndarray], vectors: np.ndarray, run: int = 1 << 14) -> np.ndarray:
    """A row of POOLED numbers for each document; zeros for one without words."""
    out = np.zeros((len(docs), 3, DIM))
    ones = np.ones(run + 1, np.float32)
    for i, ids in enumerate(docs):
        for lo in range(0, len(ids), run):
            v = vectors[ids[lo : lo + run + 1]]  # with the word after the run
            own = v[:run]
            out[i, 0] += ones[: len(own)] @ own
            out[i, 1] += np.einsum("ij,ij->j", own, own)
            out[i, 2] += np.einsum("ij,ij->j", v[:-1], v[1:])
    n = np.array([len(d) for d in docs], np.int64)[:, None]
    mean, square = out[:, 0] / np.maximum(1, n), out[:, 1] / np.maximum(1, n)
    return np.concatenate([mean, np.sqrt(np.maximum(0, square - mean * mean)), out[:, 2] / np.maximum(1, n - 1)], axis=1).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.scale
        return np.maximum(0, x @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, texts: list[bytes | None], buckets: Buckets | None = None) -> np.ndarray:
        buckets = buckets or Buckets()
        x = pool([buckets.of(t) for t in texts], self.vectors)
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -500, 500)))


def fit(vectors: np.ndarray, x: np.ndarray, labels: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5) -> Model:
    """Adam on the logistic loss over four fifths of the pooled rows x; the temperature is fitted on the rest,
    to targets smoothed by one row of either class."""
    rng = np.random.default_rng(seed)
    m = Model(vectors, np.zeros(1), np.ones(1), np.zeros((1, 1)), np.zeros(1), np.zeros(1), 0.0)
    y = labels.astype(np.float32)
    aside = rng.random(len(y)) < 0.2
    if aside.all() or not aside.any() or len(y) < 20:
        aside = np.zeros(len(y), bool)
    m.mean, m.scale = x[~aside].mean(0), x[~aside].std(0) + 1e-3
    k = x.shape[1]
    p = [rng.normal(0, np.sqrt(2 / k), (k, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    z, t = ((x - m.mean) / m.scale)[~aside].astype(np.float64), y[~aside].astype(np.float64)
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for lo in range(0, len(order), 256):
            b = order[lo : lo + 256]
            pre = z[b] @ p[0] + p[1]
            act = np.maximum(0, pre)
            err = (1 / (1 + np.exp(-np.clip(act @ p[2] + p[3][0], -500, 500))) - t[b]) / len(b)
            back = np.outer(err, p[2]) * (pre > 0)
            grads = [z[b].T @ back + 1e-3 * p[0], back.sum(0), act.T @ err + 1e-3 * p[2], np.array([err.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                p[i] -= 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = p[0], p[1], p[2], float(p[3][0])
    if aside.any():
        logit, truth = m.logits(x[aside]).astype(np.float64), y[aside]
        # smoothed targets: a set told apart without a fault has a finite best temperature too
        good, n = float(truth.sum()), len(truth)
        soft = np.where(truth > 0, (good + 1) / (good + 2), 1 / (n - good + 2))
        grid = np.exp(np.linspace(np.log(0.02), np.log(50), 160))
        m.temperature = float(grid[int(np.argmin([(soft * np.logaddexp(0, -logit / g) + (1 - soft) * np.logaddexp(0, logit / g)).mean() for g in grid]))])
    return m


def sample(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str, text_col: str, label_col: str, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(pooled rows, labels) of at most sample_rows labelled ids, those with the smallest hash; null labels and ids don't
    count. An id with several labels has the smallest, one with several texts that of the least pooled row. Texts are
    pooled in tasks; only numbers reach the driver."""
    own = labels.select(F.col(f"`{id_col}`").alias("__key"), F.col(f"`{label_col}`").cast("int").alias("__label")).filter("__key is not null and __label in (0, 1)")
    picked = own.groupBy("__key").agg(F.min("__label").alias("__label")).orderBy(F.xxhash64("__key"), "__key").limit(sample_rows)  # a bound, so the join can broadcast it
    rows = docs.select(F.col(f"`{id_col}`").alias("__key"), F.col(f"`{text_col}`").cast("string").alias("t")).join(F.broadcast(picked), "__key")
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(texts: list) -> dict:
        buckets = Buckets()
        return {"x": pa.array(list(pool([buckets.of(t) for t in texts], sent.value)), pa.list_(pa.float32()))}

    pooled = C.append(rows, "t", run, T.StructType([T.StructField("x", T.ArrayType(T.FloatType()))]), ["__key", "__label"])
    got = pooled.groupBy("__key", "__label").agg(F.min("x").alias("x")).toArrow()
    order = np.argsort(np.asarray(got.column("__key")), kind="stable")
    x = np.asarray(got.column("x").combine_chunks().flatten(), np.float32).reshape(-1, POOLED)
    return x[order], np.asarray(got.column("__label"))[order]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4000) -> Model:
    """Word vectors of all docs; the network on at most sample_rows labelled ones. One class, or no rows, gives that class's
    (or an even) prior."""
    vectors = word_vectors(docs, text_col)
    x, y = sample(docs, labels, vectors, id_col, text_col, label_col, sample_rows)
    if len(set(y.tolist())) < 2:
        prior = 0.0 if not len(y) else 4.0 if y[0] else -4.0
        return Model(vectors, np.zeros(POOLED), np.ones(POOLED), np.zeros((POOLED, 1)), np.zeros(1), np.zeros(1), prior)
    return fit(vectors, x, y)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) plus score (double, 0 to 1) and predicted (1 if score >= 0.5, else 0).

    Null and empty texts have no words and get a score like any other. Columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Buckets] = []  # one a worker

    def run(texts: list) -> dict:
        held[:] = held or [Buckets()]
        p = sent.value.probabilities(texts, held[0])
        return {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}

    return C.append(docs, text_col, run, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]), keep)
