"""Language ID: a linear-chain conditional random field labels each word of a text.

Features of a word are its character n-grams (1 to 4 bytes), its first and last 2 and 3 bytes, the word
itself, and whether the lexicon of a language holds it. Transitions between the labels of neighbouring
words are learned with the feature weights, from sequences in which runs of different languages follow one
another as in code-switched text. Forward-backward over all words of a text gives each word's marginals;
the text gets the language with the largest sum, and that sum's share as its score.

Fitting takes at most MAX_PER_LANGUAGE documents of each language, chosen by a hash of the id, of at most
MAX_CHARS characters; prediction covers every whole text. Texts are run through the recursion side by
side, the longest first, so a step costs one small product for all texts that are still running.

Defined results: "und" with score 0 where a text is null, empty or without a letter, or where there was
nothing to learn from; a text with letters but no word of its own features falls to the learned prior;
equal texts get equal results; null languages aren't learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, held_out, map_batches, texts
from tidemark.llm.subwords import distinct_words, gathered, grams, letter_runs, lowered, scattered, word_sums

MAX_PER_LANGUAGE, MAX_CHARS = 250, 10_000
SIZES, BUCKETS = (1, 2, 3, 4), 1 << 17
#: A word is in a language's lexicon if seen so often in its sample, and so rarely elsewhere.
LEXICON_COUNT, LEXICON_SHARE = 4, 0.9
#: Below this share of the marginals the filter rejects a document.
KEEP_SCORE = 0.3
LETTER = regex.compile(r"\p{L}")


def chain(emission: np.ndarray, first: np.ndarray, prior: np.ndarray, move: np.ndarray, each: bool = False):
    """Sums of the marginals of each row's words; with each, also every word's and the pairs' sums.

    emission: log scores (words x labels); rows are words[first[i]:first[i + 1]].
    """
    n, labels = np.diff(first), emission.shape[1]
    order = np.argsort(-n, kind="stable")
    base, n = first[:-1][order], n[order]
    psi = np.exp(emission - emission.max(1, keepdims=True)) if len(emission) else emission
    step, begin = np.exp(move - move.max()), np.exp(prior - prior.max())
    alpha = np.empty_like(psi)
    active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")
    a = np.empty((0, labels))
    for t, k in enumerate(active):
        at = base[:k] + t
        a = (a[:k] @ step if t else begin) * psi[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    beta, total = np.ones((len(n), labels)), np.zeros((len(n), labels))
    marginal = np.empty_like(psi) if each else None
    pairs = np.zeros((labels, labels))
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = base[:k] + t
        g = alpha[at] * beta[:k]
        g /= g.sum(1, keepdims=True)
        total[:k] += g
        if each:
            marginal[at] = g
        if t:
            b = psi[at] * beta[:k]
            if each:
                joint = alpha[at - 1][:, :, None] * step[None] * b[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = b @ step.T
            beta[:k] = b / b.sum(1, keepdims=True)
    out = np.empty_like(total)
    out[order] = total
    return (out, marginal, pairs) if each else out


class Model:
    def __init__(self, labels: list[str], table: np.ndarray, lexicon: np.ndarray, of: np.ndarray, lexical: np.ndarray, prior: np.ndarray, move: np.ndarray):
        self.labels, self.table, self.lexicon, self.of, self.lexical, self.prior, self.move = labels, table, lexicon, of, lexical, prior, move

    def listed(self, keys: np.ndarray) -> np.ndarray:
        """The language whose lexicon holds each word, or -1."""
        if not len(self.lexicon):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.lexicon, keys), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == keys, self.of[at], -1)

    def emissions(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        keys, at, which = distinct_words(data, starts, ends)
        word, _ = word_sums(data, starts[at], ends[at], keys, SIZES, self.table, affixes=True)
        return word + self.lexical[self.listed(keys)], which

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, bounds = lowered(column)
        rows = len(bounds) - 1
        names, score = ["und"] * rows, np.zeros(rows)
        if not self.labels:
            return names, score
        starts, ends, first = letter_runs(data, bounds) if len(data) else (np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(rows + 1, np.int64))
        total = np.tile(np.exp(self.prior - self.prior.max()), (rows, 1))
        if len(starts):
            word, which = self.emissions(data, starts, ends)
            got = chain(word[which], first, self.prior, self.move)
            total = np.where(got.sum(1, keepdims=True) > 0, got, total)
        total /= total.sum(1, keepdims=True)
        best = total.argmax(1)
        for i, text in enumerate(column.to_pylist()):
            if text and LETTER.search(text):
                names[i], score[i] = self.labels[best[i]], total[i, best[i]]
        return names, score


def fit(column: list[str], languages: list[str], epochs: int = 5, length: int = 24, per_batch: int = 400, rate: float = 0.05, seed: int = 5) -> Model:
    labels = sorted(set(languages))
    n_labels = len(labels)
    none = Model([], np.zeros((1, 1)), np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros((1, 1)), np.zeros(1), np.zeros((1, 1)))
    if not labels:
        return none
    rng = np.random.default_rng(seed)
    data, bounds = lowered(pa.array(column, pa.string()))
    if not len(data):
        return none
    starts, ends, first = letter_runs(data, bounds)
    if not len(starts):
        return none
    keys, at, which = distinct_words(data, starts, ends)
    flat, of = grams(data, starts[at], ends[at], keys, SIZES, BUCKETS, affixes=True)
    doc_label = np.array([labels.index(x) for x in languages])
    word_label = np.repeat(doc_label, np.diff(first))
    counts = np.bincount(which * n_labels + word_label, minlength=len(keys) * n_labels).reshape(-1, n_labels)
    in_lexicon = (counts.max(1) >= LEXICON_COUNT) & (counts.max(1) >= LEXICON_SHARE * counts.sum(1))
    model = Model(labels, np.zeros((n_labels, BUCKETS)), keys[in_lexicon], counts.argmax(1)[in_lexicon], np.zeros((n_labels + 1, n_labels)), np.zeros(n_labels), np.zeros((n_labels, n_labels)))
    listed = model.listed(keys)
    # runs of words of one document, each followed by its neighbour or by a run of any document
    n = np.diff(first)
    k = np.where(n > 0, np.maximum(1, n // length), 0)
    row = np.repeat(np.arange(len(n)), k)
    j = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    lo = first[:-1][row] + j * n[row] // k[row]
    hi = first[:-1][row] + (j + 1) * n[row] // k[row]
    p = {"table": model.table, "lexical": model.lexical, "prior": model.prior, "move": model.move}
    m1, m2, step = {a: np.zeros_like(x) for a, x in p.items()}, {a: np.zeros_like(x) for a, x in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(row))
        for some in np.array_split(order, max(1, len(order) // per_batch)):
            parts = np.stack([some, np.where((rng.random(len(some)) < 0.7) & (np.append(row, -1)[some + 1] == row[some]), some + 1, rng.permutation(some))], 1).ravel()
            sizes = hi[parts] - lo[parts]
            stop = np.cumsum(sizes)
            words = np.repeat(lo[parts] - (stop - sizes), sizes) + np.arange(int(stop[-1]))
            seq = np.concatenate([[0], stop[1::2]])
            own, local = np.unique(which[words], return_inverse=True)
            size = of[own + 1] - of[own]
            end = np.cumsum(size)
            g = flat[np.repeat(of[own] - (end - size), size) + np.arange(int(end[-1]))]
            emission = gathered(p["table"], g, np.concatenate([[0], end])) + p["lexical"][listed[own]]
            _, marginal, pairs = chain(emission[local], seq, p["prior"], p["move"], each=True)
            truth = word_label[words]
            d = marginal
            d[np.arange(len(words)), truth] -= 1
            starts_of = seq[:-1]
            grad_prior = d[starts_of].sum(0)
            inner = np.ones(len(words), dtype=bool)
            inner[starts_of] = False
            at_ = np.flatnonzero(inner)
            seen = np.bincount(truth[at_ - 1] * n_labels + truth[at_], minlength=n_labels**2).reshape(n_labels, n_labels)
            dw = scattered(local, d, len(own)).T
            of_gram = np.repeat(np.arange(len(own)), size)
            grad = {"table": scattered(g, dw[of_gram], BUCKETS), "lexical": scattered(listed[own] % (n_labels + 1), dw, n_labels + 1).T, "prior": grad_prior, "move": pairs - seen}
            step += 1
            for a, x in grad.items():
                x = x / len(words) + 1e-6 * p[a]
                m1[a] += 0.1 * (x - m1[a])
                m2[a] += 0.01 * (x * x - m2[a])
                p[a] -= rate * (m1[a] / (1 - 0.9**step)) / (np.sqrt(m2[a] / (1 - 0.99**step)) + 1e-8)
    return model


def training_rows(docs: DataFrame, per_language: int = MAX_PER_LANGUAGE, lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """A bounded sample of each language's documents that aren't held out, chosen by a hash of the id."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col(lang_col).alias("_lang")).where("_lang is not null and doc_id is not null").where(~held_out("doc_id"))
    counts = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().collect()}
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("_lang") == lang) & (F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 20)) < int(min(1.0, per_language / n) * (1 << 20))))
    rows = known.where(wanted & (F.length("text") <= MAX_CHARS)).limit(2 * per_language * max(1, len(counts))).toPandas()
    rows = rows.sort_values(["doc_id", "text"])
    return rows["text"].tolist(), rows["_lang"].tolist()


def train(docs: DataFrame, lang_col: str = "lang") -> Model:
    return fit(*training_rows(docs, lang_col=lang_col))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        names, score = sent.value.predict(b.column(1))
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())})

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float = KEEP_SCORE, text_col: str = "text") -> DataFrame:
    """The documents in a language that was learned, with all their columns; "und" and unsure ones go."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        column = b.column(b.schema.get_field_index(text_col)).cast(pa.string()).fill_null("")
        names, score = sent.value.predict(column)
        return b.filter(pc.and_(pa.array([x != "und" for x in names], pa.bool_()), pa.array(score >= least)))

    return map_batches(docs, run, docs.schema)
