"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit b is set if it is set in more than half of the XXH64 values of the text's
word shingles. It falls into three segments of 23, 23 and 18 bits. The perfect Golay code of length 23
decodes any segment to one codeword at a distance of 3 or less; the codewords of all words within one
flip of a segment, 1 or 6 of them, are its keys. Two segments that differ in at most 2 bits share a key,
for the word halfway between them is within one flip of both; if they differ in at most 1 bit, the one's
own codeword is among the other's keys.

Fingerprints that differ in at most 4 bits either have a segment without errors, and then one of the other
two has at most 2: they meet under (the whole segment, a key of the other); or all three segments have
errors, and then two have exactly one: they meet under (keys of both) x (codewords of both), to which the
parities of both segments are added, as in the extended code. So no link is lost, and a random pair meets
rarely: under 26 bits or more.

Equal fingerprints are one row from the start. Buckets aren't expanded into pairs: every member is first
compared with the bucket's smallest fingerprint, and the links found make first components; then only
members outside the component of that smallest one are compared with the members of other components,
for links inside a component change nothing. The result has one row for each document.

Defined results: words are split at ASCII white space and A-Z lower-cased; a text of fewer words than a
shingle is one shingle, a text without words (or null) has fingerprint 0 and links like any other;
a null id never names a component unless all ids of it are null; repeated rows are kept.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_tables, map_batches, mix, texts
from tidemark.llm.components import components

DISTANCE, SHINGLE, SEED = 4, 4, 42
#: Shift and width of the three segments.
SEGMENTS = ((41, 23), (18, 23), (0, 18))
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Codewords of a segment that likely_keys() puts together.
LIKELY = 5


def _remainder(x: int) -> int:
    for b in range(22, 10, -1):
        if x >> b & 1:
            x ^= GENERATOR << (b - 11)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits, and the error of at most 3 bits that each remainder stands for."""
    high = np.array([_remainder(h << 11) for h in range(1 << 12)], dtype=np.int32)
    bits = [0, *(1 << i for i in range(23))]
    error = np.zeros(1 << 11, dtype=np.int32)
    for a in bits:
        for b in bits:
            for c in bits:
                e = a | b | c
                error[_remainder(e)] = e
    return high, error


_HIGH, _ERROR = _tables()


def codeword(x: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    return (x ^ _ERROR[_HIGH[x >> 11] ^ (x & 0x7FF)]) >> 11


def fuzzy(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word: (keys sorted by row, of 24 columns at most; mask of the distinct ones)."""
    flips = np.array([0, *(1 << i for i in range(width))], dtype=np.int32)
    keys = np.sort(codeword(x[:, None] ^ flips[None, :]), axis=1)
    fresh = np.ones(keys.shape, dtype=bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, fresh


def _pairs(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (row, left key, right key) of rows with several keys on both sides."""
    (lk, lm), (rk, rm) = left, right
    rows, columns = np.nonzero(lm)
    counts = rm.sum(1)[rows]
    stop = np.cumsum(counts)
    starts = np.concatenate([[0], np.cumsum(rm.sum(1))])[rows]
    flat = rk[rm]
    return np.repeat(rows, counts), np.repeat(lk[rows, columns], counts), flat[np.repeat(starts - (stop - counts), counts) + np.arange(int(stop[-1]) if len(stop) else 0)]


def keys_of(fp: np.ndarray, own_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, own) of all keys. own: others look for the fingerprint under this key."""
    part = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int32) for s, w in SEGMENTS]
    near = [fuzzy(p, w) for p, (_, w) in zip(part, SEGMENTS, strict=True)]
    code = [codeword(p) for p in part]
    rows, keys, own = [], [], []

    def put(kind: int, row: np.ndarray, a: np.ndarray, b: np.ndarray, mine: np.ndarray) -> None:
        rows.append(row)
        keys.append((np.int64(kind) << 40) | (a.astype(np.int64) << 12) | b.astype(np.int64))
        own.append(mine)

    parity = [np.bitwise_count(p) & 1 for p in part]
    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                k, fresh = near[j]
                r, c = np.nonzero(fresh)
                put(kind, r, part[i][r], k[r, c], np.ones(len(r), dtype=bool))
                kind += 1
    for i, j in ((0, 1), (0, 2), (1, 2)):
        # exactly one error in both: the other's parities are the opposite ones
        both = ((parity[i] << 1) | parity[j]).astype(np.int32) << 12
        put(kind, np.arange(len(fp)), both | code[i], code[j], np.ones(len(fp), dtype=bool))
        if not own_only:
            r, a, b = _pairs(near[i], near[j])
            put(kind, r, (both[r] ^ (3 << 12)) | a, b, np.zeros(len(r), dtype=bool))
        kind += 1
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(len(words) - shingle + 1, 1)
    stops = ends[-n:].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 15):  # bits of 32,768 hashes at a time
        ones += np.unpackbits(h[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@functools.cache
def _codewords() -> np.ndarray:
    """The 2,048 codewords whose lowest bit is 0, as columns of 23 signs; the others are their complements."""
    words = np.arange(1 << 23, dtype=np.int32)
    words = words[((_HIGH[words >> 11] ^ (words & 0x7FF)) == 0) & (words & 1 == 0)]
    return (2 * ((words[None, :] >> np.arange(23)[:, None]) & 1) - 1).astype(np.float32)


def votes(hashes: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """(rows, 64 * words): how many more hashes of a row set a bit of its long fingerprint than don't. at: bounds of the rows, none empty."""
    n = np.diff(at)
    # the bits of eight bytes are counted side by side in one long, of 255 hashes at most
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    starts = np.repeat(at[:-1], parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    out = np.empty((len(n), words, 8, 8), dtype=np.int32)
    for k in range(words):
        drawn = mix(hashes ^ mix(np.array([SEED + 1 + k], dtype=np.uint64)))
        for b in range(8):
            counts = np.add.reduceat((drawn >> np.uint64(b)) & np.uint64(0x0101010101010101), starts).view(np.uint8).reshape(-1, 8)
            out[:, k, b] = 2 * np.add.reduceat(counts, first, axis=0, dtype=np.int32) - n[:, None]
    return out.reshape(len(n), -1)


def likely_keys(vote: np.ndarray, designs: int, n: int) -> np.ndarray:
    """(rows, designs, n): keys of long fingerprints given by their votes; a design has three segments of 23 bits of its own.

    A bit with few votes to either side is the one that a near copy has flipped. So the words around a segment aren't all those
    within one flip, as in keys_of: its nearest codewords are ranked by the votes that agree with them, and the sets of
    codewords of a design by the sum of these; the n likeliest are its keys. At a cosine of 0.889 between two sets of
    shingles, where a bit flips with a probability of 0.15, texts share one of 8 keys with a probability of about 0.25.
    """
    rows = len(vote)
    scale = np.maximum(np.sqrt((vote.astype(np.float32) ** 2).mean(1, keepdims=True)), 1e-6)
    agree = (vote[:, : designs * 69] / scale).astype(np.float32).reshape(-1, 23) @ _codewords()
    weight, at = np.abs(agree), np.arange(len(agree))
    code, score = np.empty((len(agree), LIKELY), dtype=np.int64), np.empty((len(agree), LIKELY), dtype=np.float32)
    for k in range(LIKELY):
        best = weight.argmax(1)
        score[:, k] = weight[at, best]
        code[:, k] = best << 1 | (agree[at, best] < 0)
        weight[at, best] = -1
    code, score = code.reshape(rows, designs, 3, LIKELY), score.reshape(rows, designs, 3, LIKELY)
    key, total = np.arange(designs, dtype=np.int64)[None, :, None], np.zeros((1, 1, 1), dtype=np.float32)
    for k in range(3):
        key = (key[..., None] << 12 | code[:, :, k, None, :]).reshape(rows, designs, -1)
        total = (total[..., None] + score[:, :, k, None, :]).reshape(rows, designs, -1)
    return np.take_along_axis(key, np.argpartition(-total, n, axis=2)[..., :n], 2)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fp": pa.array(fps.view(np.int64))})

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, fp long")


def _keys(fps: DataFrame, own_only: bool) -> DataFrame:
    """(key, fp, own) of all fingerprints, or the keys under which others find them."""

    def run(b: pa.RecordBatch):
        every = b.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(every), 2000):
            fp = every[i : i + 2000]
            row, key, own = keys_of(fp.view(np.uint64), own_only)
            yield pa.RecordBatch.from_pydict({"key": key, "fp": fp[row], "own": own})

    return map_batches(fps.select("fp"), run, "key long, fp long, own boolean")


def _close(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def classes(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every document; component_id is the smallest id of its group."""
    docs_fp = cut(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    reps = cut(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    pivots = _keys(reps, True).where("own").groupBy("key").agg(F.min("fp").alias("pivot"), F.max("fp").alias("last"))
    # members of buckets in which another fingerprint can be found
    # (where a bucket has one such member only, its comparison is done here)
    # Spark takes the keys, some 120 rows for each fingerprint, for as many as there are fingerprints, and would broadcast them
    met = _keys(reps, False).join(pivots.hint("merge"), "key").where((F.col("pivot") != F.col("last")) | ((F.col("fp") != F.col("pivot")) & _close("fp", "pivot")))
    met = cut(met.select("key", "fp", "own", "pivot"), "buckets")
    first = met.where("fp != pivot").where(_close("fp", "pivot")).select(F.col("fp").alias("u"), F.col("pivot").alias("v")).distinct()
    known = cut(components(first), "components")
    label = lambda at, name: known.select(F.col("node").alias(at), F.col("component").alias(name))
    told = cut(
        met.join(label("fp", "c"), "fp", "left").join(label("pivot", "pc"), "pivot", "left").select("key", "fp", "own", F.coalesce("c", "fp").alias("c"), F.coalesce("pc", "pivot").alias("pc")),
        "labelled",
    )
    others = told.where("c != pc").select("key", F.col("fp").alias("u"), F.col("own").alias("u_own"), F.col("c").alias("u_c"))
    second = (
        others.join(told.select("key", F.col("fp").alias("v"), F.col("own").alias("v_own"), F.col("c").alias("v_c")), "key")
        .where("(u_own or v_own) and u_c != v_c")
        .where(_close("u", "v"))
        .select("u", "v")
        .distinct()
    )
    linked = components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(second))
    members = reps.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    named = cut(members, "members")
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = cut(named.join(names, "component").select("fp", "component_id"), "names")
    drop_tables(met, told, known, named, reps)
    return docs_fp.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays, the one with the smallest id, with all its columns.

    Rows with a null id take no part and stay; of rows that repeat an id the text with the smallest hash stays,
    and of these the one whose JSON form is the smallest.
    """
    has = docs.where(F.col(id_col).isNotNull())
    kept = classes(has, id_col=id_col, text_col=text_col).where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    rows = has.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("own"), F.struct(*map(F.col, docs.columns)).alias("row"))
    nth = F.row_number().over(Window.partitionBy("kept").orderBy("digest", "own", F.to_json("row")))
    first = rows.join(kept, F.col("id") == F.col("kept")).withColumn("nth", nth).where("nth = 1").select("row.*")
    return first.unionAll(docs.where(F.col(id_col).isNull()))
