"""Merkle manifest of a dataset by bulk-synchronous supersteps over RDDs.

Each row is a leaf. The leaves of one source, by id, form a tree in which runs of three nodes share a parent; the
trees' roots, by source, form one more tree in the same way. A vertex of the supersteps is a block: up to
3**LEVELS neighbouring nodes of one level and all their ancestors up to LEVELS levels above. Upwards, nodes send their
digests to their block; a block that has them all hashes its levels and forwards its top as a message to the block
above. Downwards, each block sends to every block below it the sibling path from that block's top to the root;
the last superstep hands each leaf its whole path, folds it again from the leaf as it is stored now, and compares.

Rows are numbered by one range-partitioned sort, so a source of any size spreads over tasks; a block has at most 729
nodes, and the messages shrink 729-fold in each superstep. Driver and closures hold a few numbers for each task of
the sort and the root, nothing for each row, source or block. The blocks of each superstep are written to the shared
store, so a lost executor repeats its own step alone.

Defined results: a null in any field is written as "-", so it differs from the empty text. A null source comes
first, a null id before others in its source; rows that repeat an id follow by their leaves. A tree with one node
is its own root, a leaf with no sibling anywhere has the hash of the empty text as proof. An empty table gives no
rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_tables

#: Nodes that share a parent, and the levels that one superstep hashes.
RUN, LEVELS = 3, 6

#: The tree of the sources' roots.
TOP = -1

LEAVES = "tree long, number long, nodes long, doc_id long, leaf string, stored string"
BLOCKS = "tree long, block long, nodes long, digests array<string>, rows array<struct<doc_id: long, stored: string>>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof string, shape string, folded_root string, verified boolean"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


def levels_of(nodes: int) -> int:
    """How many levels of parents a tree of so many nodes has."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // RUN), n + 1
    return n


def grow(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block by level, the given ones first."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([sha("".join(below[i : i + RUN])) for i in range(0, len(below), RUN)])
    return out


def siblings(rows: list[list[str]], k: int) -> list[tuple[int, list[str]]]:
    """For each level from node k of a block up to its top: the node's place in its run, and the run's others."""
    path = []
    for row in rows[:-1]:
        start = k - k % RUN
        path.append((k - start, row[start:k] + row[k + 1 : start + RUN]))
        k //= RUN
    return path


def fold(digest: str, path: Iterable[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its path make."""
    for place, others in path:
        digest = sha("".join([*others[:place], digest, *others[place:]]))
    return digest


def read_proof(proof: str, shape: str) -> Iterator[tuple[int, list[str]]]:
    """The path that a result's proof and shape write down."""
    at = 0
    for place, others in zip(shape[::2], shape[1::2], strict=True):
        yield int(place), [proof[i : i + 64] for i in range(at, at + 64 * int(others), 64)]
        at += 64 * int(others)


class _Part(NamedTuple):
    """What the driver knows of one task of the sort: its rows, its sources, and its first and last source."""

    sources: int
    largest: int
    first: tuple
    first_rows: int
    last: tuple
    last_rows: int


def _numbered(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(tree, number in its tree, nodes of its tree, doc_id, leaf, stored), and the number of sources and of the largest one's rows."""
    in_order = rows.orderBy(F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), "leaf", "stored").rdd

    def summary(part: int, it: Iterator) -> Iterator:
        runs = [(s, sum(1 for _ in g)) for s, g in _runs(it)]
        if runs:
            yield part, _Part(len(runs), max(n for _, n in runs), *runs[0], *runs[-1])

    # one short record for each task; sources that no other task has never leave theirs
    parts = dict(in_order.mapPartitionsWithIndex(summary).collect())
    trees, done, total = {}, {}, {}  # the number of a task's first source, the rows of it that came before, and of spanning sources all rows
    n, before = 0, None
    for p, s in sorted(parts.items()):
        again = before is not None and s.first == before
        trees[p] = n - 1 if again else n
        done[p] = total.get(trees[p], 0) if again else 0
        total[trees[p]] = done[p] + s.first_rows
        n = trees[p] + s.sources
        if s.sources > 1:
            total[n - 1] = s.last_rows
        before = s.last
    largest = max([*total.values(), *(s.largest for s in parts.values()), 0])
    edges = {p: (trees[p], done[p], total[trees[p]], total[trees[p] + s.sources - 1]) for p, s in parts.items()}

    def number(part: int, it: Iterator) -> Iterator:
        if part not in edges:
            return
        tree, done, all_first, all_last = edges[part]
        last = tree + parts[part].sources - 1
        for k, (_, g) in enumerate(_runs(it)):
            at = tree + k
            inner = at not in (tree, last)
            group = list(g) if inner else g  # this source ends in this task; it is counted here
            rows = len(group) if inner else all_first if at == tree else all_last
            for i, r in enumerate(group, done if at == tree else 0):
                yield at, i, rows, r["doc_id"], r["leaf"], r["stored"]

    return _table(in_order.mapPartitionsWithIndex(number), rows, LEAVES, "leaves"), n, largest


def _runs(it: Iterator) -> Iterator:
    """Neighbouring rows by source; a null source isn't the empty one."""
    return itertools.groupby(it, key=lambda r: (r["source"] is None, r["source"]))


def _table(rdd: RDD, like: DataFrame, schema: str, name: str) -> DataFrame:
    return cut(like.sparkSession.createDataFrame(rdd, schema, verifySchema=False), name)


def _block(x) -> tuple:
    (tree, at), messages = x
    got = sorted(messages, key=lambda m: m[0])
    return tree, at, got[0][1], [m[2] for m in got], [m[3] for m in got if m[3]]


def _climb(nodes: RDD, like: DataFrame, largest: int, parts: int, levels: int, name: str) -> tuple[list[DataFrame], RDD]:
    """The blocks of each superstep, lowest first, and (tree, root) of every tree.

    nodes: messages ((tree, block), (place, nodes of the tree on this level, digest, (doc_id, stored) of a leaf)).
    """
    size = RUN**levels

    def top(b) -> tuple:
        """A block that has all its nodes: (tree, its number above, nodes above, its top's digest, whether that is the tree's root)."""
        left = levels_of(b["nodes"])
        return b["tree"], b["block"], -(-b["nodes"] // size), grow(list(b["digests"]), min(levels, left))[-1][0], left <= levels

    steps, roots = [], []
    for step in range(max(1, -(-levels_of(largest) // levels))):
        blocks = _table(nodes.groupByKey(max(1, parts // size**step)).map(_block), like, BLOCKS, f"{name}{step}")
        tops = blocks.rdd.map(top)
        steps.append(blocks)
        roots.append(tops.filter(lambda t: t[4]).map(lambda t: (t[0], t[3])))
        nodes = tops.filter(lambda t: not t[4]).map(lambda t: ((t[0], t[1] // size), (t[1] % size, t[2], t[3], None)))
    return steps, nodes.context.union(roots)


def _below(x, levels: int) -> Iterator:
    """What a block tells each of its nodes: (tree, number), (path from the node to the root, root of its source)."""
    (tree, at), ((digests, nodes, _), (path, subroot)) = x
    rows = grow(digests, min(levels, levels_of(nodes)))
    for k in range(len(digests)):
        yield (tree, at * RUN**levels + k), (siblings(rows, k) + path, subroot)


def _descend(steps: list[DataFrame], paths: RDD, parts: int, levels: int) -> RDD:
    """The lowest blocks with the path above each: ((tree, block), ((digests, nodes, rows), (path, root of the source))).

    paths: ((tree, 0), (path of a tree's root, root of the source)).
    """
    told = None
    for step, blocks in reversed(list(enumerate(steps))):
        n = max(1, parts // RUN ** (levels * step))
        keyed = blocks.rdd.map(lambda b: ((b["tree"], b["block"]), (list(b["digests"]), b["nodes"], [tuple(r) for r in b["rows"]])))
        met = keyed.filter(lambda b: levels_of(b[1][1]) <= levels).join(paths, n)  # a tree's highest block
        if told is not None:
            met = met.union(keyed.filter(lambda b: levels_of(b[1][1]) > levels).join(told, n))
        told = met.flatMap(lambda x: _below(x, levels))
    return met


def manifest(docs: DataFrame, now: str = "text", id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, shape, folded_root, verified) of every row.

    proof: the digests of all siblings from the leaf's level to the root, left to right; shape: for each level the
    node's place in its run and the number of its siblings, a digit each. levels: of one superstep. now: the column with the text as it is
    stored now; folded_root is the root that its leaf and the proof make, verified whether that is the root.
    """
    spark = docs.sparkSession
    c = F.col
    fields = [c(id_col).cast("long"), c(source_col), c(lang_col), c(chars_col)]
    rows = docs.select(fields[0].alias("doc_id"), fields[1].cast("string").alias("source"), leaf(*fields, c(text_col)).alias("leaf"), leaf(*fields, c(now)).alias("stored"))
    leaves = cut(rows, "hashed")  # texts are read and hashed once
    numbered, sources, largest = _numbered(leaves)
    if not sources:
        return spark.createDataFrame([], RESULT)
    parts = numbered.rdd.getNumPartitions()
    size = RUN**levels
    nodes = numbered.rdd.map(lambda r: ((r[0], r[1] // size), (r[1] % size, r[2], r[4], (r[3], r[5]))))
    steps, subroots = _climb(nodes, leaves, largest, parts, levels, "merkle")
    top_steps, roots = _climb(subroots.map(lambda t: ((TOP, t[0] // size), (t[0] % size, sources, t[1], None))), leaves, sources, parts, levels, "top")
    ((_, root),) = roots.collect()

    def to_source(x) -> Iterator:
        digests = x[1][0][0]
        for k, ((_, tree), (path, _)) in enumerate(_below(x, levels)):
            yield (tree, 0), (path, digests[k])

    def to_leaves(x) -> Iterator:
        _, ((digests, _, rows), (_, subroot)) = x
        for k, (_, (path, _)) in enumerate(_below(x, levels)):
            doc_id, stored = rows[k]
            folded = fold(stored, path)
            yield doc_id, digests[k], subroot, root, "".join(d for _, others in path for d in others), "".join(f"{p}{len(others)}" for p, others in path), folded, folded == root

    to_sources = _descend(top_steps, spark.sparkContext.parallelize([((TOP, 0), ([], None))], 1), parts, levels).flatMap(to_source)
    found = _descend(steps, to_sources, parts, levels).flatMap(to_leaves)
    drop_tables(leaves, numbered)
    return spark.createDataFrame(found, RESULT, verifySchema=False)
