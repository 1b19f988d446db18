"""Approximate nearest neighbours by multiprobe p-stable hashing, largest cosine first.

Vectors are scaled to length 1, where the nearest by Euclidean distance have the largest cosine. A table
hashes a vector to some numbers floor((a.x + b) / WIDTH), a and b drawn once from a seed. A query visits
its own bucket and those of perturbed hashes, in the estimated order of success: the coordinates are sorted
by their distance to the neighbouring slot, and a template holds the sets of them in the order of their
expected squared distances. The candidates of all tables are merged and reranked by the exact cosine of the
original vectors, in double precision.

How many numbers a hash has and how many buckets a query visits is fitted (`tune`): the true neighbours of
about SAMPLE_QUERIES queries are found exactly among all rows, and of the settings that find a share of
RECALL of them the one that compares least takes over, as measured against about SAMPLE_ROWS rows. Vectors
without structure leave little to prune at that recall; clustered ones are compared with a few rows in a
hundred. Only the setting is fitted on samples: every vector is indexed.

Equal vectors are one row from the start, with their k + 1 smallest ids, and equal queries are asked once.
Reranking happens where rows and queries meet: about CHUNK rows of some buckets make a slot, which gives its
nearest for each query, not its pairs. A slot with more rows or more queries is dealt over a grid of groups,
each of which holds one part of either, so a hot bucket is neither capped nor one task's.

Defined results: vectors that are null, empty, zero, or that hold a null or non-finite component take no part;
a row with a null id neither; vectors meet those of their own length only; rows with the query's own id are no
candidates; of rows that repeat an id the nearest counts; ties go to the smaller id; with fewer candidates
than k all that were found are returned. A query id with several vectors gets the nearest to any of them.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidemark.llm.common import bounded_batches, cut, map_batches, mix

TABLES, WIDTH, SEED = 8, 2.0, 17
#: Settings that tune() compares: numbers of a hash, and buckets that a query visits in a table.
HASHES, PROBES = (6, 8, 9, 10, 12, 14, 16, 20), (1, 5, 10, 20, 40, 60, 80, 120, 160, 240, 320, 400)
#: Share of the sampled queries' neighbours to find, and the sizes of the samples (by a hash of the id).
RECALL, SAMPLE_QUERIES, SAMPLE_ROWS = 0.95, 64, 4096
#: Rows, and queries, that are compared in one group.
CHUNK, QUERIES = 4096, 4096
#: Scores this close to the last place are computed again, pair by pair, before places are given.
CLOSE = 1e-9


class Plan(NamedTuple):
    """Numbers of a hash, buckets visited in each table, and what the samples measured: recall, and comparisons as a share of the rows."""

    hashes: int
    probes: int
    recall: float = float("nan")
    compared: float = float("nan")


@functools.lru_cache(maxsize=16)
def probe_template(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of sorted coordinates, by their expected squared distances; the empty set first."""
    n = 2 * hashes
    j = np.arange(1, n + 1)
    low = j * (j + 1) / (4 * (hashes + 1) * (hashes + 2))
    r = n + 1 - j
    high = 1 - r / (hashes + 1) + r * (r + 1) / (4 * (hashes + 1) * (hashes + 2))
    cost = np.where(j <= hashes, low, high)
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if all(n - 1 - c not in chosen for c in chosen):  # not both neighbours of one coordinate
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < n:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return out


class Hashes:
    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.a, self.b = rng.normal(size=(tables, dim, hashes)), rng.uniform(0, width, (tables, hashes))
        self.mix = rng.integers(1, 2**62, (tables, hashes)) * 2 + 1
        self.width = width

    def slots(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.a[t] + self.b[t]) / self.width

    def bucket(self, slots: np.ndarray, t: int) -> np.ndarray:
        return (slots.astype(np.int64) * self.mix[t]).sum(-1) + t

    def own(self, x: np.ndarray, t: int) -> np.ndarray:
        return self.bucket(np.floor(self.slots(x, t)), t)

    def visits(self, x: np.ndarray, t: int, template: list) -> np.ndarray:
        """The buckets that each row visits in one table (rows x visits), in order."""
        p = self.slots(x, t)
        h = np.floor(p)
        k = h.shape[1]
        order = np.argsort(np.concatenate([p - h, 1 - (p - h)], axis=1), axis=1, kind="stable")
        out, rows = np.empty((len(x), len(template)), dtype=np.int64), np.arange(len(x))
        for n, chosen in enumerate(template):
            moved = h.copy()
            for c in chosen:
                at = order[:, c]
                moved[rows, at % k] += np.where(at < k, -1, 1)
            out[:, n] = self.bucket(moved, t)
        return out


@functools.lru_cache(maxsize=16)
def hashes_of(dim: int, tables: int, hashes: int, width: float, seed: int) -> Hashes:
    return Hashes(dim, tables, hashes, width, seed)


def unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# --- fitting the setting ---------------------------------------------------------------


def _nearest_exact(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """The k nearest vectors of each sampled query among all rows (queries x k x length), nan where there are fewer."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, q))  # SAMPLE_QUERIES vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        score, kept = np.full((len(q), k), -np.inf), np.full((len(q), k, q.shape[1]), np.nan)
        for b in batches:
            own, vectors = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            some = np.flatnonzero(vectors.value_lengths().to_numpy(zero_copy_only=False) == q.shape[1])
            if len(some):
                x = unit(vectors.take(pa.array(some)).to_pylist())
                s = q @ x.T
                s[ids[:, None] == own[None, some]] = -np.inf
                s = np.concatenate([score, s], axis=1)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(s, best, 1)
                new = x[np.maximum(best - k, 0)]
                kept = np.where((best < k)[:, :, None], np.take_along_axis(kept, np.minimum(best, k - 1)[:, :, None], 1), new)
        i, j = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_pydict({"q": pa.array(i), "score": pa.array(score[i, j]), "v": pa.array(list(kept[i, j]), pa.list_(pa.float64()))})

    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    bounded_batches(rows.sparkSession)
    found = rows.select("id", "v").mapInArrow(run, "q long, score double, v array<double>").withColumn("nth", nth).where(F.col("nth") <= k).collect()  # SAMPLE_QUERIES x k rows
    out = np.full((len(q), k, q.shape[1]), np.nan)
    for r in found:
        out[r["q"], r["nth"] - 1] = r["v"]
    return out


def measure(x: np.ndarray, q: np.ndarray, near: np.ndarray, hashes: Hashes, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """By the number of probes: the share of the neighbours found, and comparisons as a share of the rows."""
    template = probe_template(hashes.a.shape[2], probes)
    n, real = len(template), np.isfinite(near[:, :, 0])
    at, work = np.full(real.shape, n), np.zeros(n)
    for t in range(len(hashes.a)):
        keys, visits = np.sort(hashes.own(x, t)), hashes.visits(q, t, template)
        work += (np.searchsorted(keys, visits, side="right") - np.searchsorted(keys, visits)).sum(0)
        own = hashes.own(np.where(real[:, :, None], near, 0.0), t)
        hit = own[:, :, None] == visits[:, None, :]
        at = np.minimum(at, np.where(hit.any(2), hit.argmax(2), n))
    found = np.array([(at[real] <= p).mean() if real.any() else 1.0 for p in range(n)])
    return found, np.cumsum(work) / max(len(q) * len(x), 1)


def tune(rows: DataFrame, asked: DataFrame, n: int, k: int = 5, tables: int = TABLES, width: float = WIDTH, seed: int = SEED, recall: float = RECALL) -> Plan:
    """The setting that compares least of those that reach the recall on the samples (else the one with the highest)."""

    def some(df: DataFrame, size: int, count: int) -> pd.DataFrame:
        share = int(min(1.0, size / max(count, 1)) * (1 << 20))
        return df.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < share).limit(2 * size).toPandas()

    queries, sample = some(asked, SAMPLE_QUERIES, asked.count()), some(rows, SAMPLE_ROWS, n)
    sizes = queries["v"].map(len)
    if not len(queries):
        return Plan(HASHES[0], PROBES[-1])
    dim = int(sizes.mode()[0])
    queries, sample = queries[sizes == dim], sample[sample["v"].map(len) == dim]
    q = unit(queries["v"])
    x = unit(sample["v"]) if len(sample) else q
    near = _nearest_exact(rows, queries["id"].to_numpy(), q, k)
    plans = []
    for hashes in HASHES:
        found, work = measure(x, q, near, hashes_of(dim, tables, hashes, width, seed), PROBES[-1])
        plans += [Plan(hashes, p, float(found[p - 1]), float(work[p - 1])) for p in PROBES if p <= len(found)]
    good = [p for p in plans if p.recall >= recall]
    # a visit counts as one row more, so that empty buckets aren't visited for nothing
    return min(good, key=lambda p: p.compared * n + tables * p.probes) if good else max(plans, key=lambda p: p.recall)


# --- index, visits and reranking -------------------------------------------------------


def _by_length(b: pa.RecordBatch):
    every, vectors = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        of_size = np.flatnonzero(size == dim)
        for i in range(0, len(of_size), 256):
            some = of_size[i : i + 256]
            part = vectors.take(pa.array(some))
            yield every[some], part, unit(part.to_pylist()), dim


def _slot(bucket: np.ndarray, slots: int) -> np.ndarray:
    return (mix(bucket.view(np.uint64)) % np.uint64(slots)).astype(np.int64)


def _index(rows: DataFrame, make: tuple, slots: int) -> DataFrame:
    """(slot, length, bucket, id, v): every row in each table."""

    def run(b: pa.RecordBatch):
        for ids, part, x, dim in _by_length(b):
            hashes = hashes_of(dim, *make)
            for t in range(len(hashes.a)):
                bucket = hashes.own(x, t)
                yield pa.RecordBatch.from_arrays([pa.array(_slot(bucket, slots)), pa.array(np.full(len(x), dim, np.int32)), pa.array(bucket), pa.array(ids), part], names=["slot", "length", "bucket", "id", "v"])

    return map_batches(rows, run, f"slot long, length int, bucket long, id long, v {rows.schema['v'].dataType.simpleString()}")


def _visits(asked: DataFrame, make: tuple, probes: int, slots: int) -> DataFrame:
    """(slot, length, id, buckets, v): a row for each slot in which a query visits buckets."""
    template = probe_template(make[1], probes)

    def run(b: pa.RecordBatch):
        for ids, part, x, dim in _by_length(b):
            hashes = hashes_of(dim, *make)
            found = np.concatenate([hashes.visits(x, t, template) for t in range(len(hashes.a))], axis=1)
            slot, row = _slot(found.ravel(), slots), np.repeat(np.arange(len(x)), found.shape[1])
            order = np.lexsort((slot, row))
            slot, row = slot[order], row[order]
            first = np.flatnonzero(np.diff(row * slots + slot, prepend=-1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(slot)), pa.int32()), pa.array(found.ravel()[order]))
            yield pa.RecordBatch.from_arrays([pa.array(slot[first]), pa.array(np.full(len(first), dim, np.int32)), pa.array(ids[row[first]]), lists, part.take(pa.array(row[first]))], names=["slot", "length", "id", "buckets", "v"])

    return map_batches(asked, run, f"slot long, length int, id long, buckets array<long>, v {asked.schema['v'].dataType.simpleString()}")


def _rerank(k: int):
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    def rerank(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return empty
        rows = rows.sort_values(["bucket", "id"], kind="stable")
        q, x = unit(queries["v"]), unit(rows["v"])
        q_id, ids, at = queries["id"].to_numpy(), rows["id"].to_numpy(), rows["bucket"].to_numpy()
        size = queries["buckets"].map(len).to_numpy()
        asked, who = np.concatenate(queries["buckets"].tolist()), np.repeat(np.arange(len(q)), size)
        low, high = np.searchsorted(at, asked), np.searchsorted(at, asked, side="right")
        some = np.flatnonzero(high > low)
        some = some[np.argsort(low[some], kind="stable")]
        edges = np.append(np.flatnonzero(np.diff(low[some], prepend=-1)), len(some))
        out = []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            lo, hi = low[some[i]], high[some[i]]
            for a in range(i, j, 256):
                w = who[some[a : min(a + 256, j)]]
                score = q[w] @ x[lo:hi].T
                last = _last_place(score, ids[lo:hi], k) - CLOSE
                r, c = np.nonzero(score >= last[:, None])
                out.append((w[r], lo + c))
        if not out:
            return empty
        w, c = (np.concatenate(p) for p in zip(*out, strict=True))
        exact = np.concatenate([np.einsum("ij,ij->i", q[w[i : i + 65536]], x[c[i : i + 65536]]) for i in range(0, len(w), 65536)])
        found = pd.DataFrame({"query_id": q_id[w], "vec_id": ids[c], "score": exact})
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
        return found.groupby("query_id").head(k)

    return rerank


def _last_place(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each row, of equal ids (which stand side by side) the largest alone."""
    own = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    best = score if len(own) == len(ids) else np.maximum.reduceat(score, own, axis=1)
    return np.partition(best, -k, axis=1)[:, -k] if best.shape[1] > k else np.full(len(best), -np.inf)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", plan: Plan | None = None, tables: int = TABLES, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors found for each row of queries, both (id, vector).

    plan: the setting; fitted by tune() if not given.
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind = "array<float>" if isinstance(element, FloatType) else "array<double>"

    def clean(df: DataFrame) -> DataFrame:
        ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
        return rows.where("id is not null and v is not null").where(ok)

    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = cut(clean(vectors).distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "vectors")
    every = clean(queries).distinct()
    asked = cut(every.select("v").distinct().select(F.monotonically_increasing_id().alias("id"), "v"), "asked")
    n = rows.count()
    if not n or asked.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan = plan or tune(rows, every, n, k, tables, width, seed)
    make, slots = (tables, plan.hashes, width, seed), n * tables // CHUNK + 1
    index, visits = _index(rows, make, slots), _visits(asked, make, plan.probes, slots)
    parts = lambda df, size, name: df.groupBy("slot").count().select("slot", F.ceil(F.col("count") / size).cast("int").alias(name))
    grid = cut(parts(index, CHUNK, "parts").join(parts(visits, QUERIES, "q_parts"), "slot"), "grid")  # slots without rows or queries meet nobody
    of = lambda name, count: F.pmod(F.xxhash64(name, "v"), F.col(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    index = index.join(grid, "slot").withColumn("part", of("id", "parts")).withColumn("q_part", all_of("q_parts")).drop("parts", "q_parts")
    visits = visits.join(grid, "slot").withColumn("q_part", of("id", "q_parts")).withColumn("part", all_of("parts")).drop("parts", "q_parts")
    keys = ["slot", "length", "part", "q_part"]
    # one more than k, for a query's own row is among them
    found = visits.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(_rerank(k + 1), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    lists = best.withColumn("nth", place).where(F.col("nth") <= k + 1).groupBy("query_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))
    named = asked.select(F.col("id").alias("asked_id"), "v").join(lists, F.col("asked_id") == F.col("query_id")).select("v", "found")
    answers = every.join(named, "v").select(F.col("id").alias("query_id"), F.inline("found")).where("vec_id != query_id")
    best = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
