"""Secret scans by an incremental ledger of blobs.

Only DataFrame functions are used. Each version of each path is content-addressed by the SHA-256 of its text. The
ledger, a table in the shared store, holds for each blob which rules (kind and version) have seen it and what they
found. A scan takes the texts of those blobs alone that a rule hasn't seen, applies only those rules to them,
appends one row for each to the ledger in one commit, and joins findings back to every path and version that holds
the blob. Copies of one text are scanned once; a new version of one rule is applied alone.

The texts are combined by blob before they are shuffled. A blob that holds over 1/HOT of all rows (there can be
no more than HOT such blobs) is dealt over SPLIT keys when findings are joined back.

Defined results: matches are leftmost and don't overlap within one rule; those whose counted group is shorter than
the rule's least length are dropped after matching. Places are code points, the end exclusive. A null text is the
empty blob. Repeated rows and null paths are all kept, each with the findings of its blob. Rules must not match
the empty text. A scan that fails before its commit leaves the ledger as it was. Findings of rules (or versions of
rules) that aren't asked for stay in the ledger but aren't returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: A blob with over 1/HOT of all rows is dealt over SPLIT keys.
HOT, SPLIT = 1000, 64

#: Up to so many unseen blobs their digests (64 bytes each) are broadcast, so that no other text is shuffled.
FEW = 100_000

LEDGER = "blob string, rules array<string>, findings array<struct<rule: string, start: long, end: long>>"


class Rule(NamedTuple):
    """A pattern that Java and RE2 read alike, and the least length of one of its groups (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Case is spelled out: RE2's (?i) would also take letters beyond ASCII. Runs shorter than the least length can't
#: hide a longer match in "access" and "hex", so there the pattern says the length itself.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What the method adds: formats with a fixed mark of their own.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("login", r"://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def _matches(text: Column, number: int, rule: Rule) -> Column:
    """For each match its number, the length of the text between it and the one before, its own and its group's length.

    The text between the matches and the matches themselves come from the same pattern, so they alternate.
    """
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else whole
    place = F.zip_with(between, whole, lambda b, w: F.struct(b.alias("between"), w.alias("whole")))
    return F.filter(
        F.transform(F.zip_with(place, counted, lambda p, c: F.struct(p["between"].alias("between"), p["whole"].alias("whole"), c.alias("counted"))), lambda m, i: F.struct(F.lit(number).alias("rule"), i.alias("i"), m["between"].alias("between"), m["whole"].alias("whole"), m["counted"].alias("counted"))),
        lambda m: m["whole"].isNotNull(),
    )


def _scanned(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows for blobs (blob, text, rules): only the rules named in a row are applied to it."""
    none = F.array().cast("array<struct<rule:int,i:int,between:int,whole:int,counted:int>>")
    found = F.concat(*(F.when(F.array_contains("rules", r.name) & F.col("text").rlike(r.pattern), _matches(F.col("text"), k, r)).otherwise(none) for k, r in enumerate(rules)))
    rows = blobs.select("blob", "rules", F.explode_outer(found).alias("m")).select("blob", "rules", "m.*")
    rows = rows.withColumn("end", F.sum(F.col("between") + F.col("whole")).over(Window.partitionBy("blob", "rule").orderBy("i")))
    names, least = (F.array(*map(F.lit, x)) for x in zip(*((r.name, r.least) for r in rules), strict=True))
    kept = F.when(F.col("counted") >= least[F.col("rule")], F.struct(names[F.col("rule")].alias("rule"), (F.col("end") - F.col("whole")).alias("start"), F.col("end")))
    return rows.groupBy("blob").agg(F.first("rules").alias("rules"), F.collect_list(kept).alias("findings"))


def _ledger(spark, path: str) -> DataFrame:
    """What earlier scans left at a path; nothing if there were none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, keys: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The key columns, blob, copies (rows with this blob) and findings (kind, start, end; by start, then as the rules are listed) of every row.

    ledger: the folder of the ledger, made if it isn't there. keys: what names a path and its version.
    """
    spark = versions.sparkSession
    named = versions.select(*(F.col(k).alias(f"key{i}") for i, k in enumerate(keys)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = named.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    paths = cut(named.drop("text"), "paths")
    counts = cut(paths.groupBy("blob").agg(F.count("*").alias("copies")), "blobs")

    wanted = F.array(*(F.lit(r.name) for r in rules))
    before = _ledger(spark, ledger)
    seen = before.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # at most as many as there were rules
    texts = named.select("blob", "text")
    if before.isEmpty():
        unseen = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("rules", wanted)
    else:
        todo = counts.select("blob").join(seen, "blob", "left").select("blob", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
        todo = cut(todo, "unseen")
        if todo.count() <= FEW:
            texts = texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
        unseen = texts.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    _scanned(unseen, rules).write.mode("append").parquet(ledger)

    order = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.name), F.struct(F.lit(k).alias("k"), F.lit(r.kind).alias("kind")))))
    finding = F.col("f")
    known = _ledger(spark, ledger).select("blob", F.explode("findings").alias("f")).withColumn("at", order[finding["rule"]]).where("at is not null")
    known = known.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(finding["start"].alias("start"), F.col("at")["k"].alias("k"), finding["end"].alias("end"), F.col("at")["kind"].alias("kind")))).alias("f"))
    known = known.select("blob", F.transform("f", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings"))

    total = counts.agg(F.sum("copies")).first()[0] or 0
    many = F.col("copies") > total / HOT
    hot = F.broadcast(counts.where(many).select("blob", F.lit(True).alias("hot")))  # fewer than HOT rows
    salted = paths.join(hot, "blob", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SPLIT))).otherwise(F.lit(0)))
    dealt = counts.join(known, "blob", "left").withColumn("salt", F.explode(F.when(many, F.sequence(F.lit(0).cast("long"), F.lit(SPLIT - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return salted.join(dealt, ["blob", "salt"]).select(
        *(F.col(f"key{i}").alias(k) for i, k in enumerate(keys)), "blob", "copies", F.coalesce("findings", F.array().cast("array<struct<kind:string,start:long,end:long>>")).alias("findings")
    )


def written(findings: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def of_kinds(findings: Column, kinds: Sequence[str]) -> Column:
    """The findings of these kinds."""
    return F.filter(findings, lambda f: f["kind"].isin(list(kinds)))
