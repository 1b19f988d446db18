"""Search over visited shards against scores of all documents."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical

rng = random.Random(12)
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
TOPICS = [["".join(rng.choice(a) for _ in range(rng.randint(2, 5))) for _ in range(150)] for a in ("aeiou", "bcdfg", "klmnp", "rstvé")]


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [b for b in bags if b[1]]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def prose(topic, n):
    return " ".join(rng.choice(TOPICS[topic]) for _ in range(n))


DOCS = [(i, prose(i % 4, rng.randint(1, 60)) + " the") for i in range(600)]
DOCS += [(700 + i, DOCS[8][1]) for i in range(200)]  # copies: ties by id
DOCS += [(1, "twice"), (1, "twice"), (None, DOCS[8][1]), (None, None), (990, None), (991, ""), (992, " .,;\n"), (993, "漢字 naïve ÉCOLE 1234 ÀB"), (994, "long " * 20_000 + prose(2, 5000)), (995, "ünï\x00x")]
ITEMS = [(i, prose(i % 4, 12)) for i in range(20)]
ITEMS += [(20, DOCS[8][1]), (20, "the the THE"), (None, "twice école naïve"), (21, None), (22, ""), (23, "nowhere"), (24, "long 1234 漢字 x ÀB"), (25, " ".join(prose(t, 300) for t in range(4)))]


def frame(spark, rows, key, clash):
    return spark.createDataFrame(rows, f"{key} long, text string").repartition(3).withColumns({c: F.lit(1) for c in clash})


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS, "doc_id", ("n", "terms", "cluster", "shard", "row"))


@pytest.mark.parametrize("few", [0, 200_000])
def test_search(spark, docs, few, monkeypatch):
    monkeypatch.setattr(lexical, "FEW_ROWS", few)
    items = frame(spark, ITEMS, "item_id", ("item", "term", "weight", "block", "rank"))
    visits = []
    out = lexical.search(lexical.build(docs, shard_docs=40), items, visits=visits)
    assert dict(out.dtypes)["rank"] == "int"
    assert result(out) == brute(DOCS, ITEMS)
    assert sum(visits[:-1]) < visits[-1]
    assert result(lexical.search(lexical.build(docs), items, 3)) == brute(DOCS, ITEMS, 3)


def test_like_documents_lie_together_and_others_are_not_visited(spark, docs):
    """Queries of one topic leave most shards of the other topics out."""
    index = lexical.build(docs, shard_docs=40)
    visits = []
    lexical.search(index, frame(spark, [(i, prose(i % 4, 12) + " the") for i in range(40)], "item_id", ()), visits=visits).collect()
    assert sum(visits[:-1]) < 0.5 * visits[-1]


def test_empty(spark, docs):
    items = frame(spark, ITEMS, "item_id", ())
    assert lexical.search(lexical.build(frame(spark, DOCS[:0], "doc_id", ())), items).collect() == []
    assert lexical.search(lexical.build(frame(spark, [(1, None), (2, "!")], "doc_id", ())), items).collect() == []
    assert lexical.search(lexical.build(docs), frame(spark, ITEMS[:0], "item_id", ())).collect() == []


def test_halves_part_topics_and_lower_the_cost():
    rows = [np.unique(np.array([40 * (i % 7 < 3) + rng.randrange(40) for _ in range(20)])) for i in range(70)]
    row, feature = np.repeat(np.arange(70), [len(r) for r in rows]), np.concatenate(rows)
    side, says = lexical.halves(row, feature, 70)
    assert side.sum() == 35

    def cost(side):
        d = [np.bincount(feature[side[row] == s], minlength=lexical.FEATURES).astype(float) for s in (False, True)]
        return lexical.gap_bits(*d, 35, 35).sum()

    assert cost(side) < cost(np.arange(70) % 2 == 1)
    topic = np.arange(70) % 7 < 3
    assert max((side == topic).mean(), (side != topic).mean()) > 0.9
    assert np.sign(says[:40].sum()) != np.sign(says[40:80].sum())
