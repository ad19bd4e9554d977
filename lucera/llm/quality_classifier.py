"""Operator 1: quality classifier on random-indexing word vectors and a small numpy network.

Words are runs of letters, of digits or of other signs. Random indexing: each word falls in one
of BUCKETS by hash; a bucket has a fixed sparse ternary index vector, and its word vector is the
sum of the index vectors around its occurrences in the training texts, rare neighbours counting
more, scaled to length 1. A document is pooled to the mean of its words' vectors and the mean of
the products, element by element, of the vectors of neighbouring words (binding: order and
repetition show there). These are all its features. A two-layer network scores them; a
temperature calibrates the probability, on rows that neither train it nor pick its epoch.

The model is fitted on at most MAX_TRAIN labelled rows (least hashes of doc_id and text) of at
most MAX_TRAIN_CHARS characters in all, a documented bound, none of them with crc32(doc_id) mod
5 = 0. It is about BUCKETS x DIM x 4 bytes, whatever the corpus; every text is scored whole, by
Arrow batches of bounded bytes, in one narrow pass.

Defined results: null and empty text get the score of a text without words; a null doc_id is
scored and not held out; labels of repeated doc_ids count once, by their least value; without
labels of both kinds every score is the share of label 1 (0.5 without labels); extra columns are
left out; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucera.llm.common import _IS_SPACE, slices, small_batches, span_hashes, table, text_buffers

BUCKET_BITS, DIM, NONZERO, REACH = 15, 64, 4, 2
BUCKETS = 1 << BUCKET_BITS
#: A neighbour of share p in the training texts counts RARE / (RARE + p).
RARE = 1e-3
MAX_TRAIN, MAX_TRAIN_CHARS = 4000, 40_000_000
HIDDEN, EPOCHS, CUT = 32, 60, 0.3
#: Words whose vectors are gathered at once, and texts measured at once while fitting.
SLICE, FIT_ROWS = 100_000, 500

#: Kinds of bytes that words are runs of: 0 white space, 1 letters, 2 digits, 3 signs.
_KIND = np.full(256, 3, np.uint8)
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = _KIND[128:] = 1
_KIND[_IS_SPACE] = 0


def _random_index() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(1)
    return r.integers(0, DIM, (BUCKETS, NONZERO)), r.choice([-1.0, 1.0], (BUCKETS, NONZERO)).astype(np.float32)


class Texts:
    """Buckets of the words of a batch of texts, text by text."""

    def __init__(self, column):
        raw, offs = text_buffers(column)
        kind, first = _KIND[raw], np.zeros(len(raw) + 1, bool)
        first[offs] = True
        begin = first[:-1]
        begin[1:] |= kind[1:] != kind[:-1]
        s = np.flatnonzero(begin)
        e = np.append(s[1:], len(raw)) if len(s) else s
        full = kind[s] > 0
        s, e = s[full], e[full]
        self.word = (span_hashes(raw, s, e) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        self.n = np.diff(np.searchsorted(s, offs))
        self.doc = np.repeat(np.arange(len(self.n)), self.n)

    def pooled(self, vectors: np.ndarray) -> np.ndarray:
        """(texts, 2 DIM): mean word vector, mean product of neighbours; gathered in slices of bounded size."""
        out = np.zeros((len(self.n), 2 * DIM))
        for lo in range(0, len(self.doc), SLICE):
            doc, v = self.doc[lo : lo + SLICE + 1], vectors[self.word[lo : lo + SLICE + 1]]
            self._add(out[:, :DIM], doc[:SLICE], v[:SLICE])
            near = doc[1:] == doc[:-1]
            self._add(out[:, DIM:], doc[1:][near], (v[1:] * v[:-1])[near])
        out[:, :DIM] /= np.maximum(self.n, 1)[:, None]
        out[:, DIM:] /= np.maximum(self.n - 1, 1)[:, None]
        return out

    @staticmethod
    def _add(out: np.ndarray, doc: np.ndarray, v: np.ndarray) -> None:
        if len(doc):
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            out[doc[starts]] += np.add.reduceat(v, starts, axis=0)


def word_vectors(parts) -> np.ndarray:
    """Random-indexing vectors of length 1 by bucket; parts() gives the training texts, twice."""
    count = sum((np.bincount(t.word, minlength=BUCKETS) for t in parts()), np.zeros(BUCKETS))
    weight = RARE / (RARE + count / max(1.0, count.sum()))
    place, sign = _random_index()
    flat = np.zeros(BUCKETS * DIM)
    for t in parts():
        for d in range(1, REACH + 1):
            near = t.doc[:-d] == t.doc[d:]
            a, b = t.word[:-d][near], t.word[d:][near]
            for x, y in ((a, b), (b, a)):
                for k in range(NONZERO):
                    flat += np.bincount(x * DIM + place[y, k], sign[y, k] * weight[y], minlength=len(flat))
    v = flat.reshape(BUCKETS, DIM)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Network:
    """tanh layer and logistic output, Adam, weight decay. A sixth of the rows picks the epoch, another the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        r = np.random.default_rng(2)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z, order = self._scaled(x), r.permutation(len(x))
        part = len(x) // 6
        kept, calm, fit = order[:part], order[part : 2 * part], order[2 * part :]
        self.w = [r.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        best, state = np.inf, None
        for _ in range(EPOCHS):
            r.shuffle(fit)
            for lo in range(0, len(fit), 64):
                b = fit[lo : lo + 64]
                h = np.tanh(z[b] @ self.w[0] + self.w[1])
                d = (_sigmoid(h @ self.w[2] + self.w[3]) - y[b]) / len(b)
                e = d[:, None] * self.w[2] * (1 - h * h)
                grads = [z[b].T @ e + 1e-3 * self.w[0], e.sum(0), h.T @ d + 1e-3 * self.w[2], d.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            loss = _loss(self._logit(z[kept]), y[kept]) if len(kept) else 0
            if loss < best:
                best, state = loss, [w.copy() for w in self.w]
        self.w = state or self.w
        logit = self._logit(z[calm])
        self.temperature = min(np.geomspace(0.25, 8, 60), key=lambda c: _loss(logit / c, y[calm])) if len(calm) else 1.0

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _logit(self, z):
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logit(self._scaled(x)) / self.temperature)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _loss(logit, y):
    p = np.clip(_sigmoid(logit), 1e-7, 1 - 1e-7)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if len(y) else 0.0


def sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(text, y) of the rows that the model is fitted on: at most MAX_TRAIN, of MAX_TRAIN_CHARS characters in all."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = labels.filter(F.col(label).isNotNull() & ~held).groupBy("doc_id").agg(F.min(label).alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    order = [F.xxhash64("doc_id", "text"), F.col("doc_id"), F.col("text")]
    got = got.filter(F.length("text") <= MAX_TRAIN_CHARS).orderBy(*order).limit(MAX_TRAIN)
    # one window over at most MAX_TRAIN rows
    return got.withColumn("_all", F.sum(F.length("text").cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_all") <= MAX_TRAIN_CHARS).select("text", "y")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality"):
    """(vectors, network), or (None, share of label 1)."""
    got = sample(docs, labels, label).toPandas().sort_values(["text", "y"], kind="stable")
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        return None, float(y.mean()) if len(y) else 0.5
    cut = [got["text"].iloc[lo : lo + FIT_ROWS].tolist() for lo in range(0, len(got), FIT_ROWS)]
    parts = lambda: (Texts(pa.array(part, pa.large_string())) for part in cut)
    vectors = word_vectors(parts)
    return vectors, Network(np.concatenate([t.pooled(vectors) for t in parts()]), y)


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    small_batches(spark)
    vectors, net = fit(spark, docs, labels)
    model = spark.sparkContext.broadcast((vectors, net))

    def run(batches):
        vectors, net = model.value
        for batch in slices(batches):
            p = np.full(len(batch), net) if vectors is None else net.score(Texts(batch.column("text")).pooled(vectors))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.asarray(p, float))], ["doc_id", "held_out", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    out = docs.select("doc_id", held, "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
