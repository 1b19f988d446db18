"""The queries that apply each operator to its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, langid, lexical, media, merkle, packing, quality, secret_scan, simhash, substring_dedup, toxicity, url_filter
from tidemark.llm.common import fresh_path, held_out

#: The rules that op4 applies: host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def word_vocabulary() -> str:
    """Where the installed vocabulary file is. Executors open it at the same place, as a package of the cluster's image."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score")


#: The share of the documents that op2 draws.
SAMPLE_SHARE = 0.5


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.resample(docs, good, SAMPLE_SHARE).drop("digest")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "width", "height")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(doc_ids, ids, tool):
        return {
            "doc_id": pa.array(doc_ids, pa.int64()),
            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(tool.decode(x).encode()).hexdigest() for x in ids],
        }

    return bpe.encode_rows(table(spark, sf_dir, "documents"), word_vocabulary(), digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_vocabulary())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"), fresh_path(spark, "ledger"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    counts = [F.size(secret_scan.of_kinds(F.col("findings"), [k])).cast("long").alias(f"n_{k}") for k in base]
    held = secret_scan.written(secret_scan.of_kinds(F.col("findings"), base))
    return out.select("doc_id", *counts, F.sha2(held.cast("binary"), 256).alias("base_sha256"), secret_scan.written(F.col("findings")).alias("spans"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    docs = table(spark, sf_dir, "documents").withColumn("tampered", F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    out = merkle.manifest(docs, "tampered")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_quality": op2_quality,
    "op3_media": op3_media,
    "op4_url_filter": op4_url_filter,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
    "op11_secret_scan": op11_secret_scan,
    "op12_lexical": op12_lexical,
    "op13_merkle": op13_merkle,
}



def _secrets_sql() -> str:
    """Each rule's matches and the text between them, numbered, with running sums of their lengths as places."""
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE_RULES)
    kinds = ", ".join("({}, '{}', {}, {})".format(k, r.kind, r.least, "'" + r.pattern.replace("'", "''") + "'") for k, r in enumerate(rules))
    found = " UNION ALL ".join(
        f"SELECT d, {k} AS k, regexp_extract_all(body, p, 0) AS whole, regexp_extract_all(body, p, {r.group}) AS counted, regexp_split_to_array(body, p) AS gaps FROM docs, (SELECT pattern AS p FROM rules WHERE k = {k}) WHERE regexp_matches(body, p)"
        for k, r in enumerate(rules)
    )
    return f"""
        WITH rules(k, kind, least, pattern) AS (VALUES {kinds}),
        docs AS (SELECT row_number() OVER () AS d, doc_id, COALESCE(text, '') AS body FROM documents),
        found AS ({found}),
        each AS (SELECT d, k, unnest(range(1, len(whole) + 1)) AS i, unnest(whole) AS w, unnest(counted) AS c, unnest(gaps[1:len(whole)]) AS g FROM found),
        placed AS (SELECT *, sum(length(g) + length(w)) OVER (PARTITION BY d, k ORDER BY i) AS e FROM each),
        kept AS (SELECT d, kind, p.k, (e - length(w))::BIGINT AS s, kind || ':' || (e - length(w))::BIGINT || ':' || e::BIGINT AS span
                 FROM placed p JOIN rules r ON p.k = r.k WHERE length(c) >= least)
        SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
               sha256(COALESCE(string_agg(span, ',' ORDER BY s, k) FILTER (kind IN ({base})), '')) AS base_sha256,
               COALESCE(string_agg(span, ',' ORDER BY s, k), '') AS spans
        FROM docs LEFT JOIN kept USING (d) GROUP BY d, doc_id"""


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": f"""
        WITH rules(rh, rp, rv) AS (VALUES {_RULES_SQL}),
        rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
            FROM rests),
        judged AS (
            SELECT p.*, rh || rp AS rule, rv,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rh) + length(rp) DESC NULLS LAST, length(rh) DESC, rh || rp DESC) AS k
            FROM parts p LEFT JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp))
        SELECT page_id, host, path, rule, COALESCE(rv, 'allow') AS verdict FROM judged WHERE k = 1""",
    "op11_secret_scan": _secrets_sql(),
    "op12_lexical": """
        WITH texts AS (SELECT row_number() OVER () AS d, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
        words AS (SELECT d, doc_id, unnest(regexp_extract_all(body, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
        lengths AS (SELECT d, count(*) AS n FROM words GROUP BY d),
        whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
        tfs AS (SELECT d, doc_id, term, count(*) AS tf FROM words GROUP BY d, doc_id, term),
        weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term, n_docs),
        asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        scores AS (
            SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (d), whole GROUP BY item_id, d, doc_id)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10""",
    "op13_merkle": """
        WITH RECURSIVE crc AS (
            SELECT doc_id, bytes[1:0] AS done, bytes, 4294967295::BIGINT AS c, 1 AS i
            FROM (SELECT DISTINCT doc_id, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT) AS bytes FROM documents WHERE doc_id IS NOT NULL)
            UNION ALL
            SELECT doc_id, done, bytes, list_reduce([xor(c, bytes[i])] || range(0, 8), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), i + 1
            FROM crc WHERE i <= len(bytes)),
        even AS (SELECT doc_id FROM crc WHERE i = len(bytes) + 1 AND xor(c, 4294967295) % 2 = 0),
        texts AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS d, *, CASE WHEN doc_id IN (FROM even) THEN replace(text, chr(10), '') ELSE text END AS now FROM documents),
        heads AS (SELECT d, doc_id, source, text, now,
                         COALESCE(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || COALESCE(strlen(source) || ':' || source, '-') || COALESCE(strlen(lang) || ':' || lang, '-') || COALESCE(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS h
                  FROM texts),
        leaves AS (SELECT d, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY d) - 1 AS k,
                          sha256(h || COALESCE(strlen(text) || ':' || text, '-')) AS leaf, sha256(h || COALESCE(strlen(now) || ':' || now, '-')) AS stored FROM heads),
        nodes AS (
            SELECT tree, 0 AS lvl, k, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM leaves
            UNION ALL
            SELECT tree, lvl + 1, k // 3, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, lvl, k // 3),
        subroots AS (SELECT tree, h FROM nodes WHERE n = 1),
        tops AS (
            SELECT 0 AS lvl, tree AS k, h, (SELECT count(*) FROM subroots) AS n FROM subroots
            UNION ALL
            SELECT lvl + 1, k // 3, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY lvl, k // 3),
        every AS (SELECT tree, lvl, k, h, n FROM nodes UNION ALL SELECT -1, lvl, k, h, n FROM tops),
        runs AS (SELECT tree, lvl, k // 3 AS run, list(h ORDER BY k) AS hs FROM every WHERE n > 1 GROUP BY tree, lvl, k // 3),
        folding AS (
            SELECT d, tree, tree AS source_tree, 0 AS lvl, k, stored AS now, '' AS proof, true AS more FROM leaves
            UNION ALL
            SELECT d, CASE WHEN hs IS NULL THEN -1 ELSE f.tree END, source_tree, CASE WHEN hs IS NULL THEN 0 ELSE f.lvl + 1 END, CASE WHEN hs IS NULL THEN source_tree ELSE k // 3 END,
                   CASE WHEN hs IS NULL THEN now ELSE sha256(array_to_string(hs[1:k % 3] || [now] || hs[k % 3 + 2:3], '')) END,
                   CASE WHEN hs IS NULL THEN proof ELSE proof || array_to_string(hs[1:k % 3] || hs[k % 3 + 2:3], '') END, hs IS NOT NULL OR f.tree >= 0
            FROM folding f LEFT JOIN runs r ON r.tree = f.tree AND r.lvl = f.lvl AND r.run = f.k // 3 WHERE more),
        root AS (SELECT h FROM tops WHERE n = 1)
        SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = root.h AS verified
        FROM leaves JOIN folding USING (d) JOIN subroots s ON s.tree = source_tree, root WHERE NOT more""",
}
