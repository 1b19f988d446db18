"""Ranked lexical search over an index whose shards are clusters of like documents, with exact stopping.

Recursive graph bisection orders the documents. It is fitted on a bounded sample: each node of a tree of DEPTH levels
splits its documents into halves and swaps pairs between them while that lowers the expected size of the
gaps between a term's documents. What a node has learned about each hashed term then sends every document of
the table down the tree; the leaf, and how clearly the last node decided, is its place in the order. The order only
decides what lies together, never a score.

The ordered documents are range-partitioned, and each task cuts its range into shards of bounded size: for each term
the places of its documents, their impacts (the integer quotient of the score), and the greatest of these. For a query the
weighted greatest impacts of its terms add up to a shard's bound. Shards are visited in three rounds: those with the
highest bound; those down to halfway between it and the k-th score so far; those that can still reach the k-th score.
No shard that is left out holds a document that belongs to the result, ties by doc_id included, so the result is
that of scoring every document. Inside a visited shard numpy adds up the impacts of one query at a time.

Defined results: terms are maximal runs of digits, letters and code points beyond ASCII, only A-Z lower-cased; null has
none. Rows that repeat a doc_id are documents of their own; a null doc_id comes last among equal scores. Each row
of the items is a query of its own, even if its id is repeated or null; one without terms, or without a match, has no rows. An
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, distinct, drop_tables, map_batches, text_bytes, word_bounds

#: Documents that the order is fitted on (at most twice as many are drawn), hashed terms of each (those with the
#: smallest hashes), hashed terms in all, levels of the tree, and sweeps of swaps at each node.
SAMPLE, SAMPLE_TERMS, FEATURES, DEPTH, SWEEPS = 4096, 512, 1 << 15, 5, 8

#: A shard ends with the batch that takes it beyond so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 20

#: Queries that one task scores against a shard together.
QUERY_BLOCK = 512

#: Up to so many rows and bytes the queries' terms are broadcast.
FEW_ROWS, FEW_BYTES = 200_000, 16 << 20

#: A document's length counts by 75 parts in a hundred.
LENGTH_SHARE = 75

FORWARD = "doc_id long, n long, terms string, tfs binary, cluster int, margin double"
INDEX = "shard long, term string, df long, top long, docs binary, impacts binary, ids array<long>"

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Bag(NamedTuple):
    """The distinct terms of each row: row, number of the term, occurrences; the terms; all terms of each row."""

    row: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    words: list[bytes]
    n: np.ndarray


def bag(column: pa.Array) -> Bag:
    data, bounds = text_bytes(column)
    data = _LOWER[data]
    starts, ends, first = word_bounds(data, bounds, _BETWEEN)
    n = np.diff(first)
    if not len(starts):
        none = np.empty(0, dtype=np.int64)
        return Bag(none, none, none, [], n)
    codes, words = distinct(data, starts, ends)
    key, tf = np.unique(np.repeat(np.arange(len(n)), n) * len(words) + codes, return_counts=True)
    return Bag(key // len(words), key % len(words), tf, words, n)


def _features(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % FEATURES for w in words), dtype=np.int64, count=len(words))


# --- the order -------------------------------------------------------------------------


def gap_bits(d0: np.ndarray, d1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """What the gaps of a term cost that d0 of n0 documents and d1 of n1 hold."""
    return d0 * np.log2(n0 / (d0 + 1)) + d1 * np.log2(n1 / (d1 + 1))


def halves(row: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bisect n documents, given as (row, feature) pairs: the side of each, and what each feature says for side 1."""
    side = np.arange(n) % 2 == 1
    n1 = int(side.sum())
    n0 = n - n1

    def degrees():
        return tuple(np.bincount(feature[side[row] == s], minlength=FEATURES).astype(float) for s in (False, True))

    if n0 and n1:
        for _ in range(SWEEPS):
            d0, d1 = degrees()
            now = gap_bits(d0, d1, n0, n1)
            leave0 = now - gap_bits(np.maximum(d0 - 1, 0), d1 + 1, n0, n1)
            leave1 = now - gap_bits(d0 + 1, np.maximum(d1 - 1, 0), n0, n1)
            gain = np.bincount(row, weights=np.where(side[row], leave1[feature], leave0[feature]), minlength=n)
            out0, out1 = (np.flatnonzero(side == s) for s in (False, True))
            out0, out1 = out0[np.argsort(-gain[out0], kind="stable")], out1[np.argsort(-gain[out1], kind="stable")]
            pairs = min(n0, n1)
            swaps = int((gain[out0[:pairs]] + gain[out1[:pairs]] > 1e-9).sum())  # falling, so these come first
            if not swaps:
                break
            side[out0[:swaps]], side[out1[:swaps]] = True, False
    d0, d1 = degrees()
    n0, n1 = max(n0, 1), max(n1, 1)
    return side, gap_bits(d0 + 1, d1, n0, n1) - gap_bits(d0, d1 + 1, n0, n1)


def bisection(rows: list[np.ndarray], depth: int = DEPTH) -> np.ndarray:
    """The tree: for each inner node, in the order of a heap, how much each feature speaks for its second child."""
    tree = np.zeros((2**depth - 1, FEATURES), dtype=np.float32)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    node = np.zeros(len(rows), dtype=np.int64)
    for at in range(len(tree)):
        here = node == at
        if here.any():
            place = np.cumsum(here) - 1
            mine = here[row]
            side, tree[at] = halves(place[row[mine]], feature[mine], int(here.sum()))
            node[here] = 2 * at + 1 + side
    return tree


def descend(tree: np.ndarray, row: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each of n documents, and what the last node on its way said."""
    node, said = np.zeros(n, dtype=np.int64), np.zeros(n)
    while len(tree) and (node[:1] < len(tree)).any():
        said = np.bincount(row, weights=tree[node[row], feature], minlength=n)
        node = 2 * node + 1 + (said > 0)
    return node - len(tree), said


def fit_order(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """A tree from about so many of the documents (doc_id, text), chosen by a hash of the id; at most twice as many."""
    total = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < math.ceil(min(1.0, sample / max(total, 1)) * (1 << 40))).limit(2 * sample)

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        x = bag(b.column(1))
        hashed = _features(x.words)[x.term]
        own = np.split(hashed, np.searchsorted(x.row, np.arange(1, b.num_rows)))
        return pa.RecordBatch.from_arrays([pa.array([np.unique(f)[:SAMPLE_TERMS].astype(np.int32).tobytes() for f in own], pa.binary())], ["f"])

    return bisection([np.frombuffer(r[0], dtype=np.int32) for r in map_batches(drawn, features, "f binary").collect()])


# --- the index -------------------------------------------------------------------------


class Index(NamedTuple):
    """The shards as a table, the documents with a term, and all their terms."""

    rows: DataFrame
    docs: int
    terms: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> Index:
    """The index of all documents, in shards of about so many."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tree = spark.sparkContext.broadcast(fit_order(docs))  # of fixed size

    def forward(b: pa.RecordBatch) -> pa.RecordBatch:
        x = bag(b.column(1))
        cluster, said = descend(tree.value, x.row, _features(x.words)[x.term], b.num_rows)
        cuts = np.searchsorted(x.row, np.arange(b.num_rows + 1))
        margin = said / np.maximum(np.diff(cuts), 1)  # for each term, or long documents would lie together
        numbers, tfs = x.term.tolist(), x.tf.astype(np.int32)
        terms = [b" ".join(map(x.words.__getitem__, numbers[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        counts = [tfs[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(x.n, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.binary()), pa.array(cluster, pa.int32()), pa.array(margin, pa.float64())],
            ["doc_id", "n", "terms", "tfs", "cluster", "margin"],
        )

    rows = cut(map_batches(docs, forward, FORWARD).where("n > 0"), "forward")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    place = ["cluster", "margin", "row"]
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-n_docs // shard_docs)), *place).sortWithinPartitions(*place)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            held.append(b)
            size += b.column(2).nbytes // 4
            if sum(h.num_rows for h in held) >= shard_docs or size >= SHARD_POSTINGS:
                yield from _shard(held, (part << 32) + made, n_docs, n_terms)
                made, held, size = made + 1, [], 0
        if sum(h.num_rows for h in held):
            yield from _shard(held, (part << 32) + made, n_docs, n_terms)

    bounded_batches(spark)
    index = cut(ordered.select("doc_id", "n", "tfs", "terms").mapInArrow(shards, INDEX), "index")
    drop_tables(rows)
    return Index(index, n_docs, n_terms)


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary for each run of values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _shard(batches: list[pa.RecordBatch], number: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its ids under the empty term, then each term. Places fit 16 bits, for no batch has over 10,000 rows."""
    t = pa.Table.from_batches(batches)
    data, bounds = text_bytes(t["terms"])
    starts, ends, first = word_bounds(data, bounds)
    codes, words = distinct(data, starts, ends)
    n = t["n"].to_numpy()
    m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms
    doc = np.repeat(np.arange(len(n)), np.diff(first))
    tf = np.frombuffer(b"".join(t["tfs"].to_pylist()), dtype=np.int32).astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    order = np.argsort(codes, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(words)))])
    impact = impact[order]
    top = np.maximum.reduceat(impact, bounds[:-1])
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("top", pa.int64()), ("docs", pa.binary()), ("impacts", pa.binary()), ("ids", pa.list_(pa.int64()))])
    ids = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), t["doc_id"].combine_chunks())
    none = pa.array([b""], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([""]), pa.array([0]), pa.array([0]), none, none, ids], schema=schema)
    terms = len(words)
    whole = pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(terms, number), pa.int64()),
            pa.array(words, pa.binary()).cast(pa.string()),
            pa.array(np.diff(bounds), pa.int64()),
            pa.array(top, pa.int64()),
            _binaries(doc[order].astype(np.uint16), bounds),
            _binaries(impact.astype(np.int32), bounds),
            pa.nulls(terms, pa.list_(pa.int64())),
        ],
        schema=schema,
    )
    for i in range(0, terms, 10_000):
        yield whole.slice(i, 10_000)


# --- search ----------------------------------------------------------------------------


def _score(k: int):
    def score(shard: pa.Table, asked: pa.Table) -> pa.Table:
        """The k best documents of a shard for each query that visits it."""
        terms = shard["term"].to_pylist()
        at = {t: i for i, t in enumerate(terms)}
        ids = shard["ids"][at[""]].values
        number, known = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
        docs, impacts = shard["docs"].combine_chunks(), shard["impacts"].combine_chunks()
        asked = asked.take(pc.sort_indices(asked["item"]))
        item, term, weight = asked["item"].to_numpy(), asked["term"].to_pylist(), asked["weight"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
        out: tuple[list, list, list] = ([], [], [])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            total = np.zeros(len(ids), dtype=np.int64)
            for x in range(i, j):
                row = at.get(term[x])
                if row is not None:
                    total[np.frombuffer(docs[row].as_buffer(), dtype=np.uint16)] += weight[x] * np.frombuffer(impacts[row].as_buffer(), dtype=np.int32).astype(np.int64)
            found = np.flatnonzero(total >= max(1, np.partition(total, -k)[-k] if len(total) > k else 1))
            best = found[np.lexsort((number[found], ~known[found], -total[found]))][:k]
            out[0].append(np.full(len(best), item[i]))
            out[1].append(best)
            out[2].append(total[best])
        items, best, scores = (np.concatenate(x) for x in out)
        return pa.table({"item": pa.array(items, pa.int64()), "doc_id": ids.take(pa.array(best)), "score": pa.array(scores, pa.int64())})

    return score


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times) of each row; item numbers the rows of a written table."""

    def terms(b: pa.RecordBatch) -> pa.RecordBatch:
        x = bag(b.column(2))
        words = pa.array(x.words, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(x.row)), b.column(1).take(pa.array(x.row)), words.take(pa.array(x.term)), pa.array(x.tf, pa.int64())], ["item", "item_id", "term", "times"])

    rows = cut(items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")), "items")
    return cut(map_batches(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), terms, "item long, item_id long, term string, times long"), "asked")


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", visits: list | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents for each item, as if every document had been scored.

    visits: where given, takes for each round the number of (item, shard) pairs that were scored, then all there were.
    """
    asked = _items(items, id_col, text_col)
    rows, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()
    few = F.broadcast if rows <= FEW_ROWS and size <= FEW_BYTES else lambda df: df

    words = asked.select("term").distinct().unionAll(asked.sparkSession.createDataFrame([("",)], "term string"))
    hits = cut(index.rows.join(few(words), "term"), "hits")  # of each shard the queries' terms and its ids
    held = hits.where("term != ''")
    weight = F.floor(F.lit(1000) * F.log(F.lit(float(2 * index.docs + 2)) / (2 * F.sum("df") + 1))).cast("long")
    need = cut(asked.join(held.groupBy("term").agg(weight.alias("w")), "term").select("item", "term", (F.col("times") * F.col("w")).alias("weight")).where("weight > 0"), "weights")
    bounds = cut(held.select("shard", "term", "top").join(few(need), "term").groupBy("item", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")), "bounds")
    n_items = asked.agg(F.count_distinct("item")).first()[0]
    block = F.pmod("item", F.lit(max(1, -(-n_items // QUERY_BLOCK)))).alias("block")

    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    limits = bounds.groupBy("item").agg(F.max("bound").alias("above"), F.max("bound").alias("highest")).withColumn("limit", F.col("highest"))
    limits, ranked = cut(limits, "limits"), None
    for step in range(3):
        # shards with bounds of limit or more, but (after the first round) below what was visited before
        reach = (F.col("bound") >= F.col("limit")) & (F.lit(step == 0) | (F.col("bound") < F.col("above")))
        visit = cut(bounds.join(limits, "item").where(reach).select("item", "shard", block), f"visits{step}")
        if visits is not None:
            visits.append(visit.count())
        right = visit.join(need, "item").select("shard", "block", "item", "term", "weight").toDF("shard", "block", "item", "term", "weight")
        left = hits.join(visit.select("shard", "block").distinct(), "shard").select("shard", "block", "term", "docs", "impacts", "ids").toDF("shard", "block", "term", "docs", "impacts", "ids")
        scored = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_score(k), "item long, doc_id long, score long")
        if ranked is not None:
            scored = scored.unionAll(ranked.drop("rank"))
        ranked = cut(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), f"ranked{step}")
        if step < 2:
            kth = ranked.where(F.col("rank") == k).select("item", F.col("score").alias("kth"))
            least = F.coalesce("kth", F.lit(1).cast("long"))
            limit = least if step else F.greatest(least, F.expr("(highest + coalesce(kth, 1)) div 2"))
            limits = cut(limits.join(kth, "item", "left").select("item", F.least("above", "limit").alias("above"), "highest", limit.alias("limit")), f"limits{step}")
    if visits is not None:
        visits.append(bounds.count())
    drop_tables(hits, bounds, need, limits)
    return ranked.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")
