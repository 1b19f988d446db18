"""The near-duplicate stage against a brute-force version on exact Jaccard similarities of five-word shingles."""

import random

import numpy as np
import pytest
from brute import WORD
from pyspark.sql import functions as F

from tidemark.llm import common, near

rng = random.Random(8)
WORDS = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 7))) for _ in range(3000)]


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    """The number of each text's group."""
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                old, new = sorted((group[i], group[j]), reverse=True)
                group = [new if g == old else g for g in group]
    return group


def prose(n):
    return [rng.choice(WORDS) for _ in range(n)]


def changed(words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = rng.choice(WORDS)
    return words


def planted():
    made = []
    for n in (60, 150, 400, 900):
        for _ in range(8):
            base = prose(n)
            made += [base, *[changed(base, k) for k in (1, max(2, n // 60), n // 45, n // 20)]]
    made += [prose(3), prose(5), prose(4), *[prose(30) for _ in range(60)]]
    made = [" ".join(w) for w in made]
    return made + [None, "", " \n", made[0].upper(), made[-1].replace(" ", "\t"), "Two Words", "two  words"]


def test_links_are_those_of_brute_force(spark):
    """Texts with up to one word in 60 replaced are near copies: with few differing bits in 64 most were missed."""
    texts = planted()
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, node int, digest string").repartition(5)
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns
    group = groups(texts)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({group.index(g) for g in group})
    assert near.keep_first(docs.limit(0)).count() == 0


def test_one_row_of_each_group_whatever_its_id(spark):
    """A repeated or null id neither takes a text of its own away nor keeps a copy."""
    a, b, c, d = (" ".join(prose(80)) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (5, c), (9, c), (None, b), (None, d), (None, d), (7, d + " more"), (None, None), (8, "  "), (None, "one"), (None, "one"), (5, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(((r["doc_id"], r["text"]) for r in near.keep_first(docs).collect()), key=str)
    assert kept == sorted([(3, a), (5, b), (5, c), (7, d + " more"), (8, "  "), (None, "one")], key=str)


@pytest.mark.parametrize("small", [1, 16])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, small):
    """Near copies with up to a tenth of their words replaced: many share a bucket, some link, others don't; by blocks and joins."""
    monkeypatch.setattr(near, "CROWD", 1)
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "SLICE", 8)
    base = prose(120)
    texts = [" ".join(changed(base, k)) for k in (0, 1, 2, 3, 4, 5, 7, 9, 12) for _ in range(12)] + planted()[:30]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    group = groups(texts)
    assert sorted(r["doc_id"] for r in near.keep_first(docs).collect()) == sorted({group.index(g) for g in group})


@pytest.mark.parametrize("gather", [0, 2])
def test_gathered_buckets_lose_no_link(spark, monkeypatch, gather):
    """The same groups whether buckets that share members are compared together or one by one; pairs of a block in small parts."""
    monkeypatch.setattr(near, "GATHER", gather)
    monkeypatch.setattr(near, "PIVOTS", 1)
    monkeypatch.setattr(near, "SMALL", 4)
    monkeypatch.setattr(near, "SLICE", 16)
    monkeypatch.setattr(near, "PAIRS", 7)
    base = prose(120)
    texts = [" ".join(changed(base, k)) for k in (1, 2, 3, 4, 6, 9) for _ in range(12)] + planted()[:30]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    group = groups(texts)
    assert sorted(r["doc_id"] for r in near.keep_first(docs).collect()) == sorted({group.index(g) for g in group})


def test_members_of_many_buckets_are_compared_in_one_place(spark):
    """Near copies that don't link meet in many buckets; their rows grow with the members, not with members times buckets.

    A bucket whose members know no others stays by itself, and pairs of each bucket keep a place in common.
    """
    draw = random.Random(5)
    buckets = {k: draw.sample(range(60), 30) for k in range(40)} | {100: [200, 201], 101: [300, 301, 302]}
    rows = [(k, n, 0 if n < 3 else n, None, None) for k, nodes in buckets.items() for n in nodes]
    told = spark.createDataFrame(rows, "key long, node long, c long, size long, shared long").repartition(3)
    got = [(r["at"], r["node"], r["c"]) for r in near._apart(told).collect()]
    assert len(got) == 60 + 2 + 3
    places = {n: {at for at, node, _ in got if node == n} for n in {node for _, node, _ in got}}
    assert all(places[u] & places[v] for nodes in buckets.values() for u in nodes for v in nodes)
    assert all(c == (0 if n < 3 else n) for _, n, c in got)
    one = spark.createDataFrame([(1, n, 0, None, None) for n in range(5)], told.schema)
    assert near._apart(one).count() == 0


def test_texts_that_share_half_a_digest_stay(spark, monkeypatch):
    """Where all texts of a node differ in the other half of their digests, none goes as a copy of another."""
    texts = [" ".join(prose(60)) for _ in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:2])], "doc_id long, text string").repartition(2)
    marked = near._marked
    monkeypatch.setattr(near, "_marked", lambda d: marked(d).withColumn("node", F.lit(7).cast("long")))
    assert sorted(r["doc_id"] for r in near.keep_first(docs).collect()) == list(range(6))


def test_maps_rule_out_no_linked_pair():
    """Sets of 1 to 9,000 shingles with any share in common, their maps of the same or of different widths."""
    draw = np.random.default_rng(3)
    for n in (1, 5, 200, 257, 1000, 1030, 9000):
        base = draw.integers(0, 2**63, n).astype(np.uint64)
        for part in (0.0, 0.05, 0.1, 0.12, 0.2, 0.3, 0.6):
            keep = base[int(n * part) :]
            other = np.unique(np.concatenate([keep, draw.integers(0, 2**63, int(n * part * draw.random())).astype(np.uint64)]))
            if not len(other):
                continue
            a, b = ((near.bit_map(x, near.map_words(len(x)))[None], np.array([len(x)])) for x in (np.unique(base), other))
            maybe = near.possible(*a, *b, 0.8)[0, 0]
            alike = near.jaccard(np.unique(base).tobytes(), other.tobytes())
            assert maybe or alike < 0.8
            assert not maybe or alike > 0.6 or n < 10


def test_pairs_of_shared_variants_grow_with_the_texts(spark, monkeypatch):
    """Texts that share a frame and choose one of two words in many places link nowhere: few of all pairs are confirmed."""
    asked, confirmed = [], near._confirmed

    def counted(pairs, sets, similarity):
        asked.append(pairs.count())
        return confirmed(pairs, sets, similarity)

    monkeypatch.setattr(near, "_confirmed", counted)
    frame, places = prose(1200), rng.sample(range(1200), 120)
    made = {i: (f"a{i}", f"b{i}") for i in places}
    texts = [" ".join(made[i][rng.randrange(2)] if i in made else w for i, w in enumerate(frame)) for _ in range(400)]
    assert near.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).count() == 400
    # each bucket's members meet one or two pivots; all pairs would be 79,800 for the last comparison alone
    assert sum(asked) <= 3 * near.BANDS * 400


def test_a_worker_gives_back_what_a_batch_took(spark):
    """Executors were ended for memory that their Python workers had freed but kept: here 190 MB of arrays below one that lives on."""
    if common._trim is None:
        pytest.skip("not glibc")
    held = []

    def run(b):
        with open("/proc/self/smaps_rollup") as f:
            kb = next(int(line.split()[1]) for line in f if line.startswith("Anonymous:"))
        if not held:
            parts = [np.ones(8000) for _ in range(3000)]
            held.append(parts[-1])
        return b.from_pydict({"kb": [kb]})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        first, second = (r["kb"] for r in common.map_batches(spark.range(0, 2, 1, 1), run, "kb long").collect())
    finally:
        spark.conf.set(key, before)
    assert second - first < 60_000
