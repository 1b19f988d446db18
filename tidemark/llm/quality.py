"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and pairs of neighbouring words of every text are hashed into BUCKETS; the counts of all target
documents and of all documents give two bag-of-n-grams models (add-one smoothing). A document's log
importance weight is the log of the ratio of the probabilities that the two models give its n-grams: the
plain sum of their log ratios, not divided by the length. Each document draws a Gumbel variable from a hash
of its id, text and the seed; the k documents with the largest sum of weight and draw are a sample without
replacement in proportion to the weights. The k-th largest sum is found by counting in ever finer ranges, so
no task sorts all documents and the k chosen ones never meet in one place.

Counting covers every document; a model is BUCKETS numbers whatever the size of the corpus. Which documents
are of the target is told by ids: texts and ids meet in a hash join at every size, the ids on the build side,
and one pass over it counts for both models.

Defined results: a text without words has weight 0; exactly min(k, documents) rows are selected; ties at the
k-th place go to the smaller id (null ids last), then to the smaller hash of the text, and of rows that repeat
both as many as have room; without target text all weights are 0; a repeated or null target id counts once or
never.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Hasher, bounded_batches, cut, map_batches, mix, text_bytes, texts, word_bounds

BUCKETS, SEED = 10_000, 29
HASH = Hasher(41)
#: Ranges that a round of the search for the k-th largest counts.
RANGES = 4096


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of some texts, and the row of each."""
    data, bounds = text_bytes(column)
    starts, ends, first = word_bounds(data, bounds)
    h = HASH.words(data, starts, ends)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.empty(0, np.int64)
    two = mix(h[pair] * np.uint64(3) + h[pair + 1]) if len(pair) else np.empty(0, np.uint64)
    return (np.concatenate([h, two]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, row[pair]])


def models(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over the documents whose id is in the first column of ids, and over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                which, row = buckets(b.column(0))
                good = b.column(1).to_numpy(zero_copy_only=False)[row]
                total += np.bincount(which, minlength=2 * BUCKETS) + np.bincount(which[good] + BUCKETS, minlength=2 * BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    bounded_batches(docs.sparkSession)
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias("target_id")).where("target_id is not null").distinct()
    rows = texts(docs, id_col, text_col).where("text != ''")
    # a null id is nobody's: a key of its own text spreads these rows, and the flag keeps them from a match
    rows = rows.select("text", F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id"))
    both = rows.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("target_id"), "left")
    flagged = both.select("text", (F.col("named") & F.col("target_id").isNotNull()).alias("good"))
    out = np.zeros(2 * BUCKETS)
    for r in flagged.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most 2 x BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out[BUCKETS:], out[:BUCKETS]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_grams, log_weight, draw): draw is the weight plus the document's Gumbel variable."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        which, row = buckets(b.column(1))
        total = np.bincount(row, sent.value[which], minlength=b.num_rows)
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "digest": b.column(2), "n_grams": pa.array(np.bincount(row, minlength=b.num_rows)), "log_weight": pa.array(total)})

    rows = texts(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    out = map_batches(rows, run, "doc_id long, digest long, n_grams long, log_weight double")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "digest"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return out.withColumn("draw", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(df: DataFrame, column: str, k: int) -> tuple[float, int]:
    """The k-th largest value, and how many rows equal to it belong to the k largest."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    need = k
    while low < high:
        step = (high - low) / RANGES
        if step == 0 or low + step == low:
            break
        at = F.least(F.greatest(F.floor((F.col(column) - low) / step), F.lit(0)), F.lit(RANGES - 1))
        rows = df.where(F.col(column).between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()  # at most RANGES rows
        for r in sorted(rows, key=lambda r: -r["at"]):
            if need <= r["n"]:
                low, high = r["low"], r["high"]
                break
            need -= r["n"]
    return high, need


def select(weighed: DataFrame, k: int) -> DataFrame:
    """Adds selected: whether a document is among the k largest draws."""
    weighed = cut(weighed, "weights")
    n = weighed.count()
    if k >= n or k <= 0:
        return weighed.withColumn("selected", F.lit(k > 0))
    value, room = kth_largest(weighed, "draw", k)
    # documents that share the last draw, few but for rows that repeat one id and text, are settled in order
    at_last = F.col("draw") == value
    tied = weighed.where(at_last).groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.col("doc_id").asc_nulls_last(), "digest").rowsBetween(Window.unboundedPreceding, -1))
    tied = tied.select(F.col("doc_id").alias("t_id"), F.col("digest").alias("t_digest"), "n", (F.lit(room) - F.coalesce(before, F.lit(0))).alias("room")).where("room > 0")
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("digest") == F.col("t_digest")) & at_last
    out = weighed.join(tied.drop("n", "room"), same, "left").withColumn("selected", (F.col("draw") > value) | F.col("t_digest").isNotNull()).drop("t_id", "t_digest")
    split = tied.where("n > room").join(weighed, same).select(*weighed.columns, "n", "room").first()
    if split is None:
        return out
    # one document at most has more rows than room: they are alike, and the first are selected
    alike = F.col("doc_id").eqNullSafe(F.lit(split["doc_id"])) & (F.col("digest") == split["digest"]) & at_last
    rows = weighed.sparkSession.range(split["n"]).select(*[F.lit(split[f.name]).cast(f.dataType).alias(f.name) for f in weighed.schema], (F.col("id") < split["room"]).alias("selected"))
    return out.where(~alike).unionAll(rows)


def resample(docs: DataFrame, ids: DataFrame, share: float, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_grams, log_weight, draw, selected) for every document.

    ids: those of the target documents, in its first column; share: of the documents to choose.
    """
    target, raw = models(docs, ids, id_col, text_col)
    weighed = weigh(docs, log_ratio(target, raw), seed, id_col, text_col)
    return select(weighed, int(round(share * docs.count())))
