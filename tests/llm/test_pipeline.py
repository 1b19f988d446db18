"""The stages of the corpus pipeline, each against a brute-force version on what its predecessor kept."""

import hashlib
import zlib

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from test_near import groups

from tidemark.llm import langid, toxicity
from tidemark.llm.common import cut
from tidemark.llm.queries import table, word_vocabulary

SF = "/root/testdata/sf0.001"
#: Columns named like those that stages use inside.
CLASHING = ["id", "node", "key", "digest", "rest", "c0", "row", "_id", "block", "tokens"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The documents of SF and hard cases: null and empty texts, repeated rows, ids and texts, null ids, a long text."""
    at = tmp_path_factory.mktemp("sf")
    for name in ("documents", "labels"):
        docs = table(spark, SF, name)
        if name == "documents":
            rows = docs.orderBy("doc_id").limit(12).collect()
            hard = [(900_001, None), (900_002, ""), (900_003, " \n\t"), (900_004, "12 34 !"), (None, rows[0]["text"]), (None, None), (rows[1]["doc_id"], rows[2]["text"]), (900_005, rows[3]["text"]), (900_005, rows[3]["text"])]
            hard += [(900_006, rows[4]["text"].upper()), (900_007, " ".join(r["text"] for r in rows) * 3)]
            more = spark.createDataFrame([(i, t, None, None, None) for i, t in hard], docs.schema)
            docs = docs.unionAll(more).selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHING])
        docs.write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """The rows of documents and of every stage."""
    docs, out = table(spark, sf_dir, "documents"), []
    columns = docs.columns
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        assert name == "packing" or docs.columns == columns
        out.append(docs.collect())
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def texts(rows):
    return [r["text"] or "" for r in rows]


def test_language_keeps_known_ones(spark, sf_dir, steps):
    names, score = langid.train(table(spark, sf_dir, "documents")).predict(pa.array(texts(steps[0]), pa.string()))
    assert ordered(steps[1]) == ordered(r for r, n, s in zip(steps[0], names, score, strict=True) if n != "und" and s >= langid.KEEP_SCORE)
    assert not {900_001, 900_002, 900_003, 900_004} & {r["doc_id"] for r in steps[1]}


def test_toxicity_keeps_what_scores_low(spark, sf_dir, steps):
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = model.scores(pa.array(texts(steps[1]), pa.string()))
    assert ordered(steps[2]) == ordered(r for r, s in zip(steps[1], np.asarray(score), strict=True) if s < toxicity.THRESHOLD)


def test_near_duplicates_keep_one_row_a_group(steps):
    before = sorted(steps[2], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    group, texts_of = groups(texts(before)), {}
    for g, r in zip(group, before, strict=True):
        texts_of.setdefault(g, set()).add(r["text"])
    assert len(steps[3]) == len(set(group))
    for g, kept in texts_of.items():
        least = next(r["doc_id"] for h, r in zip(group, before, strict=True) if h == g)
        assert [r["doc_id"] for r in steps[3] if r["text"] in kept] == [least]


def test_repeated_passages_go(steps):
    gone = brute.substring_dedup([(r["doc_id"], r["text"]) for r in steps[3]])
    kept = {(r["doc_id"], hashlib.sha256(" ".join(brute.WORD.findall(r["text"])).encode()).hexdigest()) for r in steps[4]}
    assert len(steps[4]) == len(steps[3]) and kept == {(i, digest) for i, _, _, digest in gone}
    same = {i for i, _, n, _ in gone if not n}
    assert ordered(r for r in steps[4] if r["doc_id"] in same) == ordered(r for r in steps[3] if r["doc_id"] in same)


def test_packing_holds_every_token_once(steps):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(word_vocabulary())
    library.no_truncation()
    library.no_padding()
    ids = {}
    for r in steps[4]:
        ids.setdefault(r["doc_id"], []).append(np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], dtype="<u4"))
    unique = {i: x[0] for i, x in ids.items() if len(x) == 1}
    at = dict.fromkeys(unique, 0)
    for p in sorted((p for p in steps[5] if p["doc_id"] in unique), key=lambda p: p["start"]):
        x = unique[p["doc_id"]]
        assert (p["start"], p["doc_tokens"]) == (at[p["doc_id"]], len(x))
        assert p["ids_crc32"] == zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes())
        at[p["doc_id"]] += p["length"]
    assert at == {i: len(x) for i, x in unique.items()}
    assert sum(p["length"] for p in steps[5]) == sum(len(x) for many in ids.values() for x in many)
    windows = {}
    for p in steps[5]:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for pieces in windows.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048


def test_stages_take_empty_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
