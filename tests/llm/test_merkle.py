"""Supersteps against one loop over sorted rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

rng = random.Random(13)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, now string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def first(v):
    return (v is not None, v if not isinstance(v, str) else v.encode()) if v is not None else (False,)


def tree(nodes):
    """The root and each node's siblings."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = list(range(k - k % 3, min(k - k % 3 + 3, len(level))))
            paths[i].append((k % 3, [level[j] for j in run if j != k]))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [k // 3 for k in at]
    return level[0], paths


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=first)
    groups, roots, out = [], [], []
    for s in sources:
        group = sorted((r for r in rows if r[1] == s), key=lambda r: (first(r[0]), leaf(*r[:5]), leaf(*r[:4], r[5])))
        root, paths = tree([leaf(*r[:5]) for r in group])
        groups.append((group, paths))
        roots.append(root)
    if not rows:
        return []
    top, above = tree(roots)
    for (group, paths), sub, more in zip(groups, roots, above, strict=True):
        for r, p in zip(group, paths, strict=True):
            digest = leaf(*r[:4], r[5])
            for place, others in p + more:
                digest = sha("".join([*others[:place], digest, *others[place:]]))
            out.append((r[0], leaf(*r[:5]), sub, top, "".join("".join(o) for _, o in p + more), digest, digest == top))
    return out


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")) for r in df.collect()), key=str)


def rows(n, sources):
    texts = ["", "a\nb", "long " * 3000 + "\n", "ünï漢😀", *(f"text {i}\n" for i in range(5))]
    out = []
    for i in range(n):
        t = rng.choice(texts)
        out.append((i, rng.choice(sources), rng.choice(["en", None]), len(t), t, t.replace("\n", "") if i % 2 else t))
    return out


ODD = [(None, None, None, None, None, None), (None, "s", "en", 1, "x", "x"), (None, "s", "en", 1, "x", "x"), (7, "", None, 0, "", ""), (7, "s", "de", 5, "two", "two"), (7, "s", "de", 5, "too", "two"), (2, "é", "fr", 3, "1:a-", "1:a-"), (3, "Z", "fr", 3, None, None)]
CASES = {
    "one": rows(1, ["s"]),
    "single leaves": rows(5, ["a"])[:1] + [(9, "b", None, 1, "x", "y")],
    "hot source": rows(700, ["hot"] * 9 + ["a", "b", None]) + ODD,
    "many sources": rows(300, [f"s{i}" for i in range(200)]),
    "repeats": ODD * 10,
}


@pytest.mark.parametrize("levels", [2, 6])
@pytest.mark.parametrize("case", list(CASES))
def test_manifest(spark, case, levels):
    docs = spark.createDataFrame(CASES[case], SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("tree", "leaf", "stored", "number", "block")})
    assert result(merkle.manifest(docs, "now", levels=levels)) == sorted(brute(CASES[case]), key=str)


def test_proof_can_be_read(spark):
    data = rows(100, ["a", "b", None, "c"])
    out = merkle.manifest(spark.createDataFrame(data, SCHEMA)).collect()
    assert all(r["verified"] and merkle.fold(r["leaf"], merkle.read_proof(r["proof"], r["shape"])) == r["root"] for r in out)


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), "now").collect() == []
