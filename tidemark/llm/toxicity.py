"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams (3 to 6, with marks at its ends) and of
the word itself; a segment of about SEGMENT words is the mean of its words; a linear softmax gives the
probability of label 1. Vectors and softmax are trained together (Adam, minibatches), with a penalty on the
length of each vector, which leaves those of n-grams that tell nothing at zero. A document's log-odds are
the largest of its segments', so a long text isn't excused by its length, and a logistic curve fitted to
labelled documents kept out of the training turns them into the score. Segments of toxic documents that the
half-trained model finds clean are left out of later epochs, but never all of a document.

Fitting takes at most MAX_POSITIVE and MAX_NEGATIVE labelled documents, chosen by a hash of the id, of at
most MAX_CHARS characters each; scoring covers every whole text.

Defined results: a text without a word (null, empty, punctuation) scores 0; equal texts score alike;
labels that are null or neither 0 nor 1 are not learned from; without labelled rows of both classes all
scores are 0. A repeated id in labels counts as toxic if any of its rows does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, held_out, map_batches, texts
from tidemark.llm.subwords import distinct_words, gathered, grams, letter_runs, lowered, scattered, word_sums

MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 800, 1800, 10_000
SEGMENT, SIZES, BUCKETS, DIM = 16, (3, 4, 5, 6), 1 << 17, 4
#: The mean over words is multiplied by this, so that one word in a segment can decide.
GAIN = 16.0
THRESHOLD = 0.3
#: Updates of the training, and segments in each: so the time it takes doesn't grow with the sample.
STEPS, BATCH = 260, 5000
#: An n-gram counts if the words it stands in are seen in so many documents of the sample, whatever its size:
#: one that a single document shows says nothing about others. The penalty does the rest.
MIN_DOCS = 2
#: Penalty on the vectors' lengths; share of the sample that calibrates the scores; how many clean documents
#: there are for each toxic one where the scores are meant for.
PENALTY, CALIBRATE, CLEAN_FOR_TOXIC = 1e-5, 0.25, 9.0


def segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds of all segments, and each segment's row. Rows without words have none."""
    n = np.diff(first)
    k = np.where(n > 0, np.maximum(1, np.rint(n / SEGMENT).astype(np.int64)), 0)
    row = np.repeat(np.arange(len(n)), k)
    j = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    start = first[:-1][row] + j * n[row] // np.maximum(k[row], 1)
    return np.append(start, first[-1] if len(first) else 0), row


class Model:
    def __init__(self, table: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.table, self.bias = table, bias  # log-odds of each bucket, times GAIN, and of nothing
        self.slope, self.shift = slope, shift  # from a document's largest log-odds to those of its label

    def scores(self, column: pa.Array) -> np.ndarray:
        x = self.logits(column)
        words = np.isfinite(x)
        return np.where(words, 1 / (1 + np.exp(-np.clip(self.slope * np.where(words, x, 0) + self.shift, -700, 700))), 0.0)

    def logits(self, column: pa.Array) -> np.ndarray:
        """The largest log-odds of each text's segments; minus infinity where a text has no word."""
        data, bounds = lowered(column)
        out = np.full(len(bounds) - 1, -np.inf)
        if not len(data) or not self.table.any():
            return out
        starts, ends, first = letter_runs(data, bounds)
        if not len(starts):
            return out
        word, which = self.words(data, starts, ends)
        edges, row = segments(first)
        logit = np.add.reduceat(word[which], edges[:-1]) / np.diff(edges) + self.bias
        np.maximum.at(out, row, logit)
        return out

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-odds of each distinct word, and each word's number among them."""
        keys, at, which = distinct_words(data, starts, ends)
        total, n = word_sums(data, starts[at], ends[at], keys, SIZES, self.table[None])
        return total[:, 0] / n, which


def fit(column: list[str], labels: list[int], seed: int = 3) -> Model:
    """Train on most of the sample and calibrate on the rest (logistic regression by Newton's method)."""
    rest = np.random.default_rng(seed).random(len(labels)) < CALIBRATE
    y = np.array(labels, dtype=np.float64)
    if len(set(y[rest])) < 2 or len(set(y[~rest])) < 2:
        return train_vectors(column, labels)
    model = train_vectors([t for t, r in zip(column, rest, strict=True) if not r], y[~rest].astype(int).tolist())
    x = model.logits(pa.array([t for t, r in zip(column, rest, strict=True) if r], pa.string()))
    y, x = y[rest][np.isfinite(x)], x[np.isfinite(x)]
    scale = max(float(np.abs(x).max()), 1e-9) if len(x) else 1.0
    z = np.stack([x / scale, np.ones(len(x))], 1)
    weight = np.where(y == 1, 1.0, CLEAN_FOR_TOXIC * y.sum() / max((y == 0).sum(), 1))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        w -= np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(2), z.T @ (weight * (p - y)) + 1e-2 * w)
    model.slope, model.shift = float(w[0] / scale), float(w[1])
    return model


def train_vectors(column: list[str], labels: list[int], steps: int = STEPS, batch: int = BATCH, rate: float = 0.1, seed: int = 3) -> Model:
    labels = np.array(labels, dtype=np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    data, bounds = lowered(pa.array(column, pa.string()))
    starts, ends, first = letter_runs(data, bounds)
    keys, at, which = distinct_words(data, starts, ends)
    flat, of = grams(data, starts[at], ends[at], keys, SIZES, BUCKETS)
    edges, row = segments(first)
    label = labels[row]
    use = np.ones(len(row), dtype=bool)
    # n-grams of words from fewer than MIN_DOCS documents say nothing about other documents
    doc_of = np.repeat(np.arange(len(labels)), np.diff(first))
    seen_in = np.bincount(np.unique(which * len(labels) + doc_of) // len(labels), minlength=len(keys))
    alive = np.bincount(flat, np.repeat(seen_in, np.diff(of)), BUCKETS) >= MIN_DOCS
    p = {"E": rng.normal(0, 0.002, (DIM, BUCKETS)) * alive, "W": rng.normal(0, 0.5, (DIM, 2)), "b": np.zeros(2)}
    first_moment, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step, epochs = 0, -(-steps // max(1, len(row) // batch))

    def span(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = hi - lo
        stop = np.cumsum(n)
        return np.repeat(lo - (stop - n), n) + np.arange(int(stop[-1])), np.concatenate([[0], stop])

    def forward(some: np.ndarray):
        words, seg = span(edges[some], edges[some + 1])
        own, local = np.unique(which[words], return_inverse=True)
        g, wb = span(of[own], of[own + 1])
        g = flat[g]
        per_word = np.diff(wb)
        v = gathered(p["E"], g, wb) / per_word[:, None]
        n = np.diff(seg)
        s = GAIN * gathered(v.T, local, seg) / n[:, None]
        z = s @ p["W"] + p["b"]
        q = np.exp(z - z.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True), s, n, local, own, g, per_word

    for epoch in range(epochs):
        if epoch >= epochs / 4 and epoch % max(1, epochs // 12) == 0:  # which segments of toxic documents carry it?
            prob = np.concatenate([forward(part)[0][:, 1] for part in np.array_split(np.arange(len(row)), max(1, len(row) // batch))])
            best = np.zeros(len(labels))
            np.maximum.at(best, row, prob)
            use = (label == 0) | (prob > 0.5) | (prob >= best[row])
        order = rng.permutation(np.flatnonzero(use))
        for some in np.array_split(order, max(1, len(order) // batch)):
            some = np.sort(some)
            q, s, n, local, own, g, per_word = forward(some)
            d = q.copy()
            d[np.arange(len(some)), label[some]] -= 1
            d /= len(some)
            ds = GAIN * (d @ p["W"].T) / n[:, None]
            of_word = np.repeat(np.arange(len(some)), n)
            dv = scattered(local, ds[of_word], len(own)).T / per_word[:, None]
            of_gram = np.repeat(np.arange(len(own)), per_word)
            grad = {"E": scattered(g, dv[of_gram], BUCKETS), "W": s.T @ d, "b": d.sum(0)}
            step += 1
            grad["E"] = grad["E"] * alive + PENALTY * p["E"] / (np.sqrt((p["E"] ** 2).sum(0)) + 1e-3)
            for k, x in grad.items():
                first_moment[k] += 0.1 * (x - first_moment[k])
                second[k] += 0.01 * (x * x - second[k])
                p[k] -= rate * max(0.02, 1 - step / steps) * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    w = p["W"][:, 1] - p["W"][:, 0]
    return Model(GAIN * (w @ p["E"]), float(p["b"][1] - p["b"][0]))


def training_rows(docs: DataFrame, labels: DataFrame, limits: tuple[int, int] = (MAX_NEGATIVE, MAX_POSITIVE)) -> tuple[list[str], list[int]]:
    """A bounded sample of the labelled documents that aren't held out, chosen by a hash of the id."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").alias("_toxic")).where("_toxic in (0, 1) and _id is not null").where(~held_out("_id")).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    wanted = F.lit(False)
    for label, most in enumerate(limits):
        share = min(1.0, most / max(counts.get(label, 0), 1))
        wanted = wanted | ((F.col("_toxic") == label) & (F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    chosen = spark.createDataFrame(known.where(wanted).limit(2 * sum(limits)).toPandas().astype({"_id": "int64", "_toxic": "int64"}), "_id long, _toxic long")
    rows = texts(docs).where(F.length("text") <= MAX_CHARS).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_toxic").limit(2 * sum(limits)).toPandas()
    rows = rows.sort_values(["doc_id", "text"])
    return rows["text"].tolist(), rows["_toxic"].astype(int).tolist()


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*training_rows(docs, labels))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(sent.value.scores(b.column(1)), pa.float64())})

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        column = b.column(b.schema.get_field_index(text_col)).cast(pa.string()).fill_null("")
        return b.filter(pa.array(sent.value.scores(column) < threshold))

    return map_batches(docs, run, docs.schema)
