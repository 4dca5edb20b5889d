"""Secret scans with an incremental blob ledger. DataFrame functions only.

Every version of every file is content-addressed by SHA-256. The *ledger* records which
(blob, rule version) pairs have been scanned and what was found; a run scans one copy of
each unseen pair and joins the findings back to all paths that ever held the blob. ``scan_kept`` keeps the ledger
in a named folder, so that the next run (of any job) scans only what is new; entries are appended in one
commit at the end of the scan, and entries that two runs added count once.

What has been seen is found by hashes alone. Texts move once, by their hash, and only those of unseen blobs;
equal ones are combined in each task first.

Places are code points, end exclusive. They come from the pieces between matches: the regular
expression splits the text, and running sums of piece and match lengths (a window over the matches of one
blob and kind, so linear in their number) give the spans.

Defined results: null and empty texts have no spans; equal texts share one scan; rows with a null path are
scanned and reported like others; repeated rows give repeated rows; ties of start cannot occur within a kind, between kinds the rule order decides; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.storage import written


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; ``group`` is the part whose length must reach ``least``."""

    kind: str
    pattern: str
    group: int
    least: int


#: Fixed values of the base rules; letters of a keyword stand in either case.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


RULES = (
    Rule("assign", "(" + "|".join(map(either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a run of hex digits below 24 cannot hold a longer one, so the limit may stand in the pattern
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


def version_of(rules: tuple[Rule, ...]) -> str:
    """Digest of what the rules say, in their order: changed rules are another version."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()[:16]


SPANS = "array<struct<kind:string,start:int,stop:int>>"
MATCHES = "array<struct<rank:int,i:int,gap:int,len:int,size:int>>"


def matches_of(text: Column, rule: Rule, rank: int) -> Column:
    """Every match of one rule in order: number, length of the piece before it, its own length, that of its decisive group."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    one = F.transform(
        whole,
        lambda m, i: F.struct(
            F.lit(rank).alias("rank"), i.alias("i"), F.length(F.element_at(pieces, i + 1)).alias("gap"), F.length(m).alias("len"), F.length(F.element_at(part, i + 1)).alias("size")
        ),
    )
    return F.when(text.rlike(rule.pattern), one).otherwise(F.array().cast(MATCHES))


def spans_of(scanned: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, spans of the blobs that have any. ``scanned``: blob, matches."""
    each = scanned.filter(F.size("matches") > 0).select("blob", F.inline("matches"))
    until = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    by_rank = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("rank") + 1)
    placed = each.withColumn("stop", until.cast("int")).filter(F.col("size") >= by_rank([r.least for r in rules]))
    one = F.struct((F.col("stop") - F.col("len")).alias("start"), "rank", by_rank([r.kind for r in rules]).alias("kind"), "stop")
    return placed.groupBy("blob").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))


def scan_versions(
    versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str | None = None, path_col: str = "path", text_col: str = "content"
) -> tuple[DataFrame, DataFrame]:
    """(findings of every path, ledger entries that this run adds).

    ``ledger`` has columns blob, rule_version, spans; pairs in it are not scanned again. Findings have
    path, blob and spans (an array of kind, start, stop). Entries cover blobs without findings too.
    ``version`` names the entries' rules; without it that is ``version_of`` them.
    """
    version = version or version_of(rules)
    body = F.coalesce(F.col(text_col), F.lit(""))
    paths = written(versions.select(F.col(path_col).alias("path"), F.sha2(body, 256).alias("blob")), "secret-paths")
    texts = versions.select(F.sha2(body, 256).alias("blob"), body.alias("text"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == version).select("blob", "spans").dropDuplicates(["blob"])
        unseen = written(paths.select("blob").distinct().join(seen.select("blob"), "blob", "left_anti"), "secret-unseen")
        texts = texts.join(unseen, "blob", "left_semi")
    once = texts.dropDuplicates(["blob"])
    scanned = written(once.select("blob", F.concat(*[matches_of(F.col("text"), r, k) for k, r in enumerate(rules)]).alias("matches")), "secret-scanned")
    added = scanned.select("blob").join(spans_of(scanned, rules), "blob", "left")
    added = written(added.select("blob", F.lit(version).alias("rule_version"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), "secret-ledger")
    known = added.select("blob", "spans") if ledger is None else added.select("blob", "spans").unionByName(seen)
    found = paths.join(known.filter(F.size("spans") > 0), "blob", "left")
    return found.select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), added


def kept_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger in ``folder``, or nothing where no run has left one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"blob string, rule_version string, spans {SPANS}").parquet(folder)


def scan_kept(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, version: str | None = None, path_col: str = "path", text_col: str = "content") -> tuple[DataFrame, int]:
    """(findings of every path, number of blobs scanned); what is new is appended to the ledger in ``folder``."""
    found, added = scan_versions(versions, kept_ledger(versions.sparkSession, folder), rules, version, path_col, text_col)
    found = written(found, "secret-findings")  # before the ledger that it reads changes
    added.write.mode("append").parquet(folder)
    return found, added.count()


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str = "") -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256 and spans. ``ledger`` names a folder that keeps what was scanned."""
    found = scan_kept(docs, ledger, path_col=id_col, text_col=text_col)[0] if ledger else scan_versions(docs, path_col=id_col, text_col=text_col)[0]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in RULES]
    return found.select(F.col("path").alias("doc_id"), *counts, joined(F.col("spans")).alias("spans")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans"
    )
