"""Near duplicates by the exact Jaccard similarity of word shingles; candidates by SimHash and Golay-code fuzzy hashing.

Two texts are linked if their sets of SHINGLE-word shingles have a Jaccard similarity of at least SIMILARITY. At 0.8
about 10 of 64 fingerprint bits differ, out of reach of the keys of simhash.classes(). So fingerprints are longer
here, and a text's keys are the likeliest KEYS sets of Golay codewords of BANDS triples of segments, ranked by the votes
behind the bits (simhash.likely_keys). A pair at 0.8 shares a key with a probability of about 0.9999, more above it.
Every candidate is confirmed on the whole sets, so no pair below the bound links.

Equal texts are one node from the start. As in simhash, buckets aren't expanded into pairs: every node is
first compared with the smallest nodes of its buckets, with the PIVOTS that it meets most often. Where many pairs across components are left, members with too many
shingles of their own to have a link leave the bucket, and the others are compared in rounds with single members of
its largest component; at last all members outside that component are compared with the members
of other components, for links inside a component change nothing: in buckets of at most SMALL members as pairs of a
join, in larger ones by blocks of two slices of members, whose bit maps of shingles are compared in numpy and of which only
pairs come out that the maps allow. Near copies meet in many buckets, so buckets that share members are gathered before: a bucket
goes to the root that its members know by two hops, where each of them is once, in however many of its buckets. Where that means
more than GATHER times the comparisons of the buckets by themselves, they stay as they are.
A map has four bits or more for each shingle, so long texts are told apart as well as
short ones, and never rules a linked pair out; of the pairs that it allows those whose long fingerprints are six standard
deviations too far apart go. The memory of a block is bounded. In a place that stays crowded the
comparisons of maps (half a byte to one byte a shingle) still grow with the square of its members; the pairs that are
shuffled and confirmed don't.

Defined results: words are split at ASCII white space and A-Z lower-cased; a text of fewer words than a
shingle is one shingle; texts without words (or null) are copies of one another. Texts whose words have the
same 128-bit digest are taken as equal. A node is the half of it; of texts that share only that half, the one with the smallest
other half is compared with others, and each further one is kept as a text of its own. Shingles are compared by 64-bit hashes
(of five words: too short for the known symmetric collisions of such hashes, which take long runs).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Hasher, cut, drop_tables, give_back, joined, map_batches, text_bytes, texts, window_starts, word_bounds
from tidemark.llm.components import components
from tidemark.llm.simhash import likely_keys, votes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, KEYS, SEED = 32, 8, 11
#: 64-bit words of the long fingerprint: 3 segments of 23 bits for each band.
WORDS = -(-BANDS * 69 // 64)
#: Smallest nodes of its buckets with which a node is compared first; what that leaves apart is compared later.
PIVOTS = 4
#: A bucket is crowded if the ordered pairs across its components are so many times its members.
CROWD = 4
#: Rounds end where one leaves more than this share of the pairs.
ENOUGH = 0.8
#: Buckets of at most so many members are joined as they are.
SMALL = 16
#: Members of a larger bucket in a slice; a block compares two slices.
SLICE = 512
#: Pairs of a block whose long fingerprints are compared at a time.
PAIRS = 1 << 13
#: Buckets are compared together if that takes at most so many times the comparisons of them one by one.
GATHER = 2
#: The narrowest and the widest bit map of a set, in 64-bit words; a bit for each remainder of a shingle.
MAP_WORDS, WIDEST = 16, 1024
#: Sets of fewer shingles aren't judged by their long fingerprints.
FEW = 64
#: Texts whose keys are made at a time.
TEXTS = 32

_HASHER = Hasher(SEED)


def shingles(column: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles by row, their bounds (rows + 1), and the digest of each row's words as two longs."""
    data, bounds = text_bytes(column)
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    starts, ends, first = word_bounds(data, bounds)
    words = _HASHER.words(data, starts, ends)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - length + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(at[-1], dtype=np.uint64)
    out[np.repeat(n >= length, count)] = _HASHER.runs(words, window_starts(first, length), length)
    for k in range(1, length):
        few = np.flatnonzero(n == k)
        out[at[few]] = _HASHER.runs(words, first[few], k)
    raw, edge = joined(data, starts, ends)
    digest, rows = xxhash.xxh3_128_digest, edge[first]
    whole = b"".join([digest(raw[i:j]) for i, j in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)])
    return out, at, np.frombuffer(whole, dtype=np.int64).reshape(-1, 2)


def bands(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows with shingles, their BANDS * KEYS keys). Repeated shingles count once, as in the similarity."""
    rows = np.flatnonzero(np.diff(at))
    keys = np.empty((len(rows), BANDS * KEYS), dtype=np.int64)
    for i in range(0, len(rows), TEXTS):
        sets = [np.unique(hashes[at[r] : at[r + 1]]) for r in rows[i : i + TEXTS]]
        vote = votes(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), WORDS)
        keys[i : i + TEXTS] = likely_keys(vote, BANDS, KEYS).reshape(len(sets), -1)
    return rows, keys


def long_print(grams: np.ndarray) -> bytes:
    """A bit for each vote of a set that is above 0; of no shingles, none."""
    return np.packbits(votes(grams, np.array([0, len(grams)]), WORDS)[0] > 0).tobytes() if len(grams) else bytes(8 * WORDS)


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, rest, keys) of every row; node and rest are the halves of the digest of its words."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes, at, node = shingles(b.column(1))
        rows, keys = bands(hashes, at)
        count = np.zeros(len(node), dtype=np.int64)
        count[rows] = BANDS * KEYS
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(keys.reshape(-1)))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(node[:, 0]), pa.array(node[:, 1]), lists], names=["doc_id", "digest", "node", "rest", "keys"])

    return map_batches(docs, run, "doc_id long, digest long, node long, rest long, keys array<long>")


def map_words(n: int) -> int:
    """Words of the map of a set of n shingles: a power of two, four bits or more a shingle unless at its widest."""
    return min(WIDEST, max(MAP_WORDS, 1 << (max(n, 1) * 4 - 1).bit_length() >> 6))


def bit_map(grams: np.ndarray, words: int) -> np.ndarray:
    """A bit for each remainder of a shingle modulo the bits of so many words (a power of two)."""
    out = np.zeros(words * 64, dtype=np.uint8)
    out[(grams % np.uint64(words * 64)).astype(np.int64)] = 1
    return np.packbits(out).view(np.int64)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """The maps of the same sets in so many words: the OR of their parts, unsigned (numpy counts the bits of absolute values)."""
    return np.bitwise_or.reduce(maps.view(np.uint64).reshape(len(maps), -1, words), axis=1)


def possible(maps_a: np.ndarray, n_a: np.ndarray, maps_b: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """(rows of a) x (rows of b): False only for sets too far apart by their maps.

    A bit that one of them lacks is a shingle of the other's alone, so the other shares at most its remaining ones.
    """
    words = min(maps_a.shape[1], maps_b.shape[1])
    a, b = folded(maps_a, words), folded(maps_b, words)
    # shingles that share a bit with another one of their set
    more_a, more_b = n_a - np.bitwise_count(a).sum(1, dtype=np.int64), n_b - np.bitwise_count(b).sum(1, dtype=np.int64)
    out = np.empty((len(a), len(b)), dtype=bool)
    for i in range(len(a)):
        both = np.bitwise_count(a[i] & b).sum(1, dtype=np.int64)
        out[i] = both + np.minimum(more_a[i], more_b) >= similarity / (1 + similarity) * (n_a[i] + n_b) - 1e-6
    return out


def in_reach(print_a: np.ndarray, n_a: np.ndarray, print_b: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Row by row: False if two long fingerprints differ in more bits than those of similar sets do.

    A bit flips with a probability of the angle between the sets over pi; the bound lies six standard deviations above that.
    Sets of fewer than FEW shingles are always in reach, for their votes are too coarse for it.
    """
    bits, flip = 64 * WORDS, np.arccos(2 * similarity / (1 + similarity)) / np.pi
    most = bits * flip + 6 * np.sqrt(bits * flip * (1 - flip))
    out = np.minimum(n_a, n_b) < FEW
    for i in range(0, len(out), 1 << 14):
        at = slice(i, i + (1 << 14))
        out[at] |= np.bitwise_count(print_a[at] ^ print_b[at]).sum(1, dtype=np.int64) <= most
    return out


def _block(similarity: float):
    """Of one block (at, low, high): the pairs (u, v) of its two slices, of different components, that may be linked."""

    def run(block: pa.Table) -> pa.Table:
        low, high = block["low"][0].as_py(), block["high"][0].as_py()
        slice_, node, c, n = (block[k].to_numpy() for k in ("slice", "node", "c", "n"))
        shared = block["shared"].to_numpy()  # null: NaN
        maps = block["bits"].combine_chunks()
        prints = np.frombuffer(b"".join(block["print"].to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
        width, values = maps.value_lengths().to_numpy(), maps.flatten().to_numpy()
        at = np.cumsum(width) - width
        found = [np.empty((0, 2), dtype=np.int64)]
        widths = np.unique(width)
        take = lambda rows: values[at[rows][:, None] + np.arange(width[rows[0]])]
        for wa in widths:
            for wb in widths:
                a, b = np.flatnonzero((slice_ == low) & (width == wa)), np.flatnonzero((slice_ == high) & (width == wb))
                if not len(a) or not len(b):
                    continue
                ok = possible(take(a), n[a], take(b), n[b], similarity) & (c[a][:, None] != c[b])
                # two sets have in common at most what the one of them shares with anyone
                ok &= ~(np.minimum(shared[a][:, None], shared[b]) < similarity / (1 + similarity) * (n[a][:, None] + n[b]) - 1e-6)
                i, j = np.nonzero(ok)
                for k in range(0, len(i), PAIRS):
                    x, y = a[i[k : k + PAIRS]], b[j[k : k + PAIRS]]
                    alike = in_reach(prints[x], n[x], prints[y], n[y], similarity)
                    found.append(np.stack([node[x[alike]], node[y[alike]]], axis=1))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        del block, maps, values, prints, found
        give_back()
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return run


def _apart(told: DataFrame) -> DataFrame:
    """(at, node, c, shared): members of buckets that hold more than one component, a node once in each place.

    A bucket's hub is the member with the smallest hash of those outside its largest component, a member's label the first hub
    of its buckets, and a bucket's root the first label of its members. Its place is its root, or itself where the members of
    the root's buckets are too many for the pairs in these.
    """
    bucket, own = Window.partitionBy("key"), Window.partitionBy("key", "c")
    of = told.withColumn("members", F.count("*").over(bucket)).withColumn("n", F.count("*").over(own)).withColumn("most", F.max(F.struct("n", "c")).over(bucket))
    of = of.withColumn("hub", F.min(F.when(F.col("c") != F.col("most.c"), F.struct(F.xxhash64("node").alias("hash"), "node"))).over(bucket)).where("hub is not null")
    of = of.withColumn("label", F.min("hub").over(Window.partitionBy("node"))).withColumn("root", F.min("label").over(bucket))
    of = cut(of.select("key", "members", F.col("root.node").alias("root"), "node", "c", "shared"), "rooted")
    met = of.groupBy("root", "node").agg(F.first("c").alias("c"), F.first("shared").alias("shared"), F.sum("members").alias("compared"))
    met = met.withColumns({"all": F.count("*").over(Window.partitionBy("root")), "compared": F.sum("compared").over(Window.partitionBy("root"))})
    met = cut(met.withColumn("gathered", F.col("all") * F.col("all") <= GATHER * F.col("compared")), "gathered")
    alone = of.join(met.where("not gathered").select("root").distinct(), "root", "left_semi")
    place = lambda by: F.struct((F.lit(by) == "key").alias("alone"), F.col(by).alias("id")).alias("at")
    out = met.where("gathered").select(place("root"), "node", "c", "shared").unionAll(alone.select(place("key"), "node", "c", "shared"))
    out = cut(out, "apart")
    drop_tables(of, met)
    return out


def _pairs(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of different components in one place that may be linked, by fingerprints, in a larger one by maps first.

    apart: (at, node, c, shared); shared is null where it isn't known.
    """
    sized = apart.withColumn("members", F.count("*").over(Window.partitionBy("at")))
    of = sets.select("node", "bits", "print", F.expr("length(grams) div 8").alias("n"))
    few = sized.where(F.col("members") <= SMALL).join(of.drop("bits"), "node")
    side = lambda x: few.select("at", *[F.col(c).alias(x + c) for c in ("node", "c", "n", "print")])
    made = side("u").join(side("v"), "at").where("unode < vnode and uc != vc").select("unode", "vnode", "un", "vn", "uprint", "vprint")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        u, v, n_u, n_v = (c.to_numpy() for c in b.columns[:4])
        prints = [np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint64).reshape(-1, WORDS) for c in b.columns[4:]]
        ok = in_reach(prints[0], n_u, prints[1], n_v, similarity)
        return pa.RecordBatch.from_pydict({"u": u[ok], "v": v[ok]})

    made = map_batches(made, run, "u long, v long")
    many = sized.where(F.col("members") > SMALL).withColumn("slices", F.ceil(F.col("members") / SLICE))
    many = many.withColumn("slice", F.pmod(F.xxhash64("node"), "slices")).join(of, "node")
    many = many.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    many = many.select("at", F.least("slice", "with").alias("low"), F.greatest("slice", "with").alias("high"), "slice", "node", "c", "n", "bits", "print", F.col("shared").cast("double"))
    return made.unionAll(many.groupBy("at", "low", "high").applyInArrow(_block(similarity), "u long, v long")).distinct()


def _sets(nodes: DataFrame) -> DataFrame:
    """(node, grams, bits, print): the sorted distinct shingles of each (node, text), their bit map and their long fingerprint."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes, at, _ = shingles(b.column(1))
        sets = [np.unique(hashes[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        maps = [bit_map(grams, map_words(len(grams))) for grams in sets]
        prints = [long_print(grams) for grams in sets]
        return pa.RecordBatch.from_pydict(
            {"node": b.column(0), "grams": pa.array([x.tobytes() for x in sets], pa.binary()), "bits": pa.array(maps, pa.list_(pa.int64())), "print": pa.array(prints, pa.binary())}
        )

    return map_batches(nodes, run, "node long, grams binary, bits array<long>, print binary")


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("grams").alias(f"{name}_grams"))
    # a set has at most 1 / similarity times the shingles of the other
    near = F.least(F.length("u_grams"), F.length("v_grams")) >= F.lit(similarity) * F.greatest(F.length("u_grams"), F.length("v_grams"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = [jaccard(x, y) >= similarity for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        return b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(side("u"), "u").join(side("v"), "v").where(near).select("u", "v", "u_grams", "v_grams")
    return map_batches(both, run, "u long, v long")


def _crowds(told: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(key, node, pivot, outside, cross) of the members of crowded buckets, and the ordered pairs across components in them.

    pivot: a member of the bucket's largest component, another one for each n; outside: whether the node isn't in that;
    cross: members of other components than the node's.
    """
    bucket = Window.partitionBy("key")
    of = told.withColumn("all", F.count("*").over(bucket)).withColumn("n", F.count("*").over(Window.partitionBy("key", "c")))
    of = of.withColumns({"cross": F.col("all") - F.col("n"), "most": F.max(F.struct("n", "c")).over(bucket)}).withColumn("pairs", F.sum("cross").over(bucket))
    inside = F.col("c") == F.col("most.c")
    of = of.withColumn("pivot", F.min(F.when(inside, F.struct(F.xxhash64("node", F.lit(n)).alias("hash"), "node"))).over(bucket))
    crowds = cut(of.where(F.col("pairs") > CROWD * F.col("all")).select("key", "node", F.col("pivot.node").alias("pivot"), (~inside).alias("outside"), "cross"), "crowds")
    return crowds, crowds.agg(F.sum("cross")).first()[0] or 0


def _without_lone(told: DataFrame, crowds: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """told without the members of crowded buckets that can't be linked there: too many of their shingles are in no other member.

    Adds size, a member's shingles, and shared, those that others have too; null for nodes of no crowded bucket.
    """

    def run(b: pa.RecordBatch):
        for node, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            grams = np.frombuffer(raw, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"gram": grams, "node": np.full(len(grams), node)})

    inside = crowds.select("key", "node")
    members = sets.join(inside.select("node").distinct(), "node", "left_semi")
    alone = map_batches(members.select("node", "grams"), run, "gram long, node long").groupBy("gram").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    # of a set that is linked no more than this share is missing in the other
    most = F.lit(1 - similarity) * (F.length("grams") / 8) + 1e-6
    counted = members.join(alone.groupBy("node").agg(F.count("*").alias("alone")), "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    counted = cut(counted.select("node", (F.col("alone") > most).alias("lone"), F.expr("length(grams) div 8").alias("size"), F.expr("length(grams) div 8 - alone").alias("shared")), "shared")
    rest = told.join(inside.join(counted.where("lone"), "node"), ["key", "node"], "left_anti").join(counted.drop("lone"), "node", "left")
    out = cut(rest.select("key", "node", "c", "size", "shared"), "labelled")
    drop_tables(counted)
    return out


def _settle_crowds(told: DataFrame, known: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Fewer pairs across components in crowded buckets: told (key, node, c) and known (node, component), both anew.

    Members that can't have a link leave the bucket. Then a member of the largest component, another one in each
    round, is compared with all members of the others: a group of near copies soon falls into one component. Rounds
    end when no bucket is crowded or the pairs left hardly shrink; those are compared in full afterwards.
    """
    crowds, left = _crowds(told, 0)
    if not left:
        none = F.lit(None).cast("long")
        return told.withColumns({"size": none, "shared": none}), known
    fewer = _without_lone(told, crowds, sets, similarity)
    drop_tables(told, crowds)
    told, n, before = fewer, 0, None
    while True:
        n += 1
        crowds, left = _crowds(told, n)
        if not left or before is not None and left > ENOUGH * before:
            drop_tables(crowds)
            return told, known
        before = left
        asked = crowds.where("outside").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
        links = known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(_confirmed(asked, sets, similarity))
        merged = cut(components(links), "components")
        later = cut(told.drop("c").join(merged, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"), "size", "shared"), "labelled")
        drop_tables(told, known, crowds)
        told, known = later, merged


def _linked(marked: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of every node that is linked to another. docs: (doc_id, text, digest), as marked."""
    keyed = marked.select("node", F.explode("keys").alias("key"))
    bucket = Window.partitionBy("key")
    # members of buckets in which another node can be found; the keys are shuffled once
    others = keyed.withColumns({"pivot": F.min("node").over(bucket), "last": F.max("node").over(bucket)}).where("pivot != last")
    met = cut(others.groupBy("key", "node").agg(F.min("pivot").alias("pivot")), "buckets")
    # one text for each node of these
    one = marked.groupBy("node").agg(F.min(F.struct("rest", "digest", "doc_id")).alias("of")).join(met.select("node").distinct(), "node", "left_semi")
    one = one.select("node", F.col("of.doc_id").alias("_id"), F.col("of.digest").alias("_digest"))
    found = docs.join(one, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("node").agg(F.first("text").alias("text"))
    sets = cut(_sets(found), "sets")
    asked = met.where("node != pivot").groupBy("node", "pivot").agg(F.count("*").alias("n"))
    asked = asked.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "pivot"))).where(F.col("nth") <= PIVOTS)
    first = _confirmed(asked.select(F.col("node").alias("u"), F.col("pivot").alias("v")), sets, similarity)
    known = cut(components(first), "components")
    told = cut(met.join(known, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "labelled")
    told, known = _settle_crowds(told, known, sets, similarity)
    apart = _apart(told)
    second = _pairs(apart, sets, similarity)
    second = cut(_confirmed(second, sets, similarity), "links")
    linked = cut(components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(second)), "linked")
    drop_tables(met, sets, known, told, apart, second)
    return linked


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked texts stays, with all its columns: the one with the smallest id, nulls last.

    Groups are of texts, not of ids: a row goes only where its own text is linked to that of the row that stays,
    whether ids repeat or are null. Of equal ids the text with the smaller hash stays, of rows that repeat both the
    one whose JSON form is the smallest.
    """
    plain = texts(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    marked = cut(_marked(plain), "marked")
    linked = _linked(marked, plain, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    best = marked.groupBy("node", "rest").agg(F.min(order).alias("best"))
    best = best.join(best.groupBy("node").agg(F.min("rest").alias("first")), "node").join(linked, "node", "left")
    same = F.col("rest") == F.col("first")
    group = [F.when(same, F.coalesce("component", "node")).alias("group"), F.when(~same, F.struct("node", "rest")).alias("apart")]
    kept = best.groupBy(*group).agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("_id"), F.col("best.digest").alias("_digest"))
    copies = marked.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count("*").alias("n")).where("n > 1")
    kept = cut(kept.join(copies, kept["_id"].eqNullSafe(copies["_id"]) & (kept["_digest"] == copies["_digest"]), "left").select(kept["_id"], kept["_digest"], "n"), "kept")
    drop_tables(marked, linked)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest"), F.struct(*map(F.col, docs.columns)).alias("row"))
    chosen = lambda which: rows.join(kept.where(which), F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    # of rows that repeat both, one; they are combined before they meet
    once = chosen("n is not null").groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return chosen("n is null").select("row.*").unionAll(once.select("row.*"))
