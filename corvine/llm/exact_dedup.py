"""Exact deduplication through an extendible-hash index kept in shared files. DataFrame functions only.

1. Every text is normalised (white space deleted) and keyed by 64 hash bits plus its SHA-256. Rows of one key and hash are
   combined in their task before they move, as counts and the row that would stay, without texts.
2. *Insertion.* The directory has 2**depth entries over the leading key bits and starts with one bucket. New links go to the
   bucket that owns their entry. A bucket with more than ``capacity`` keys splits by its next bit, and the directory doubles when
   the split bucket had the full depth; buckets that nothing was added to keep their files. The directory has at most ``2**MAX_DEPTH``
   entries whatever the size of the data; a bucket that is still overfull then grows longer, which costs balance and changes no result.
3. *Owner tasks* take contiguous ranges of (bucket, key). They merge the new links of a key with those that its bucket holds, and
   set the *chain*: the links of equal keys in the order of their SHA-256, each with the size of its group and the row that stays.
4. *Bytes.* Links of one chain with other hashes are other texts. Rows that share key and hash are compared byte by byte: only their texts are
   read again, each task keeps the least and the greatest of them per link, and over all tasks both must be the same text and the
   number of texts compared must be the size of the group. Otherwise two texts share a SHA-256 value (or the index belongs to other rows), and the job stops.
   Texts are told apart from those of unique keys by ``SLOTS`` bits of their key, so a few unique ones may come along.
5. Each row finds its bucket through the directory and its link in the chain.

Rows are joined by key and hash, never by id, so ids may be of any type, repeat or be null.

An index under a named folder (``root``) takes further rounds: ``exact_dedup(new, root=..., earlier=old)`` decides ``new`` against all rows inserted
so far; ``earlier`` are those rows, of which only texts that a new one meets are read for their bytes. One writer at a time; an insertion that
fails leaves the index as it was, since the directory is written last.

Defined results: a null text is an empty one; texts of nothing but white space are equal to it; ties on
the most code points go to the smallest doc_id; a row that repeats id and text counts as one more copy and is kept with
its id; of rows with one id and different texts those that are as long as the longest are kept; a null id is larger than
any other; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.storage import drop_shared, shared_dir, written

MAX_DEPTH = 16
CAPACITY = 1 << 12  # keys of a bucket
SLOTS = 20  # leading key bits by which texts of repeated keys are found; at most 2**SLOTS values are broadcast


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return."""
    out = F.coalesce(text, F.lit(""))
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def laid_out(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, code points, normalised text, hash of the text as it is, and key of each row."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"), normalised(F.col(text_col)).alias("norm"), F.xxhash64(text_col).alias("mark"))
    return plain.withColumn("key", F.xxhash64("norm"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, length, key and SHA-256 of each text."""
    return laid_out(docs, id_col, text_col).select("doc_id", "mark", "n", "key", F.unhex(F.sha2("norm", 256)).alias("sha"))


def prefix(depth: int) -> Column:
    """The leading ``depth`` bits of the key as a number."""
    return F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("long")


def split(load: list[int], buckets: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """``buckets`` as (local depth, prefix), the overfull ones split by their next bit until none is overfull; ``load``: keys per entry of ``MAX_DEPTH`` bits."""
    total = [0]
    for x in load:
        total.append(total[-1] + x)
    done, todo = [], list(buckets)
    while todo:
        depth, at = todo.pop()
        width = 1 << (MAX_DEPTH - depth)
        if depth < MAX_DEPTH and total[(at + 1) * width] - total[at * width] > capacity:
            todo += [(depth + 1, 2 * at), (depth + 1, 2 * at + 1)]
        else:
            done.append((depth, at))
    return sorted(done, key=lambda b: b[1] << (MAX_DEPTH - b[0]))


def loads(keys: DataFrame) -> list[int]:
    """Distinct keys per entry of ``MAX_DEPTH`` bits: at most 2**MAX_DEPTH pairs of numbers come to the driver."""
    load = [0] * (1 << MAX_DEPTH)
    for row in keys.select("key").distinct().groupBy(prefix(MAX_DEPTH).alias("e")).agg(F.count(F.lit(1)).alias("c")).collect():
        load[row["e"]] = row["c"]
    return load


def named(depth: int, at: int) -> int:
    """The number of the bucket of ``depth`` bits ``at``."""
    return 1 << depth | at


def entries(spark: SparkSession, buckets: list[tuple[int, int]]) -> tuple[DataFrame, int]:
    """The directory, one row per entry with the bucket that owns it, and its depth."""
    top = max(d for d, _ in buckets)
    rows = [(e, named(d, at)) for d, at in buckets for e in range(at << (top - d), (at + 1) << (top - d))]
    return spark.createDataFrame(rows, "_entry long, bucket long"), top


def in_buckets(rows: DataFrame, buckets: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with the bucket of their key; the directory is broadcast, its size is bounded."""
    found, depth = entries(rows.sparkSession, buckets)
    return rows.withColumn("_entry", prefix(depth)).join(F.broadcast(found), "_entry").drop("_entry")


def best_row(n: str, doc_id: str) -> Column:
    """Orders rows of a group: the longest text first, then the smallest id, null last."""
    return F.struct((-F.col(n)).alias("minus"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"))


class Index:
    """Directory and buckets under ``root``: ``directory/<version>`` (bucket, depth, at, version) and ``buckets/version=<version>`` (bucket, key, sha, chain, group_size, keep_id, n_most, changed)."""

    def __init__(self, spark: SparkSession, root: str, capacity: int = CAPACITY):
        self.spark, self.root, self.capacity = spark, root.rstrip("/"), capacity
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/directory")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        whole = [int(f.getPath().getName()) for f in fs.listStatus(path) if fs.exists(f.getPath().suffix("/_SUCCESS"))] if fs.exists(path) else []
        self.version = max(whole, default=0)
        rows = spark.read.parquet(f"{self.root}/directory/{self.version}").collect() if self.version else []
        #: version of the files of each bucket (local depth, prefix)
        self.files = {(r["depth"], r["at"]): r["version"] for r in rows} or {(0, 0): 0}

    def buckets(self) -> list[tuple[int, int]]:
        return sorted(self.files, key=lambda b: b[1] << (MAX_DEPTH - b[0]))

    def links(self, of: list[tuple[int, int]] | None = None) -> DataFrame | None:
        """All links, or those of some buckets; None where nothing was inserted yet."""
        at = [(named(*b), v) for b, v in self.files.items() if v and (of is None or b in set(of))]
        if not at:
            return None
        which = self.spark.createDataFrame(at, "bucket long, version int")
        return self.spark.read.parquet(f"{self.root}/buckets").join(F.broadcast(which), ["bucket", "version"], "left_semi").drop("version")

    def insert(self, keys: DataFrame) -> DataFrame:
        """Add the rows of ``keys`` (see ``keyed``); the links of all buckets that they went to, ``changed`` where one of them is."""
        new = keys.groupBy("key", "sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(best_row("n", "doc_id")).alias("best")).withColumn("changed", F.lit(True))
        new = written(new, "dedup-links")
        load = loads(new)
        hit = [(d, at) for d, at in self.buckets() if any(load[at << (MAX_DEPTH - d) : (at + 1) << (MAX_DEPTH - d)])]
        old = self.links(hit)
        both = new
        if old is not None:
            both = new.unionByName(old.select("key", "sha", "group_size", best_row("n_most", "keep_id").alias("best"), F.lit(False).alias("changed")))
            load = loads(both)
        parts = split(load, hit, self.capacity)
        kept = {b: v for b, v in self.files.items() if b not in set(hit)}
        version = self.version + 1
        self.files = kept | {b: version for b in parts}
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        owned = in_buckets(both, self.buckets()).repartitionByRange(n, "bucket", "key")
        merged = owned.groupBy("bucket", "key", "sha").agg(F.sum("group_size").alias("group_size"), F.min("best").alias("best"), F.max("changed").alias("changed"))
        chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha")).alias("chain")
        rows = merged.select("bucket", "key", "sha", chain, "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.minus")).alias("n_most"), "changed")
        rows.write.mode("overwrite").parquet(f"{self.root}/buckets/version={version}")
        self.version = version
        drop_shared(self.spark, new)
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/buckets/version={version}")

    def commit(self) -> None:
        """Write the directory: from now on the inserted links belong to the index."""
        rows = [(named(*b), *b, v) for b, v in self.files.items()]
        self.spark.createDataFrame(rows, "bucket long, depth int, at long, version int").coalesce(1).write.parquet(f"{self.root}/directory/{self.version}")


def unequal(links: DataFrame, texts: DataFrame) -> DataFrame:
    """Links whose rows are not all the same bytes, or not as many as their group; ``texts`` as ``laid_out`` gives them."""
    many = links.filter("changed and group_size > 1").select("key", "sha", "group_size")
    slot = F.shiftrightunsigned(F.col("key"), 64 - SLOTS)
    some = texts.withColumn("_slot", slot).join(F.broadcast(many.select(slot.alias("_slot")).distinct()), "_slot", "left_semi")
    seen = some.select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "norm").groupBy("key", "sha").agg(F.min("norm").alias("low"), F.max("norm").alias("high"), F.count(F.lit(1)).alias("n"))
    seen = seen.select("key", "sha", "n", (F.col("low") == F.col("high")).alias("same"))
    return many.join(seen, ["key", "sha"], "left").filter(~F.coalesce(F.col("same") & (F.col("n") == F.col("group_size")), F.lit(False)))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", root: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, mark (hash of the text, which tells rows of one id apart).

    ``root``: folder of a kept index, ``earlier``: the rows inserted into it before (see above)."""
    spark = docs.sparkSession
    index = Index(spark, root or f"{shared_dir(spark)}/corvine/dedup-index-{uuid.uuid4().hex}", capacity)
    if index.version and earlier is None:
        raise ValueError("this index holds rows already: name them as earlier, so that bytes can be compared")
    keys = written(keyed(docs, id_col, text_col), "dedup-keys")
    links = index.insert(keys)
    texts = laid_out(docs, id_col, text_col).select("key", "norm")
    if index.version > 1:
        texts = texts.unionByName(laid_out(earlier, id_col, text_col).select("key", "norm"))
    if unequal(links, texts).limit(1).count():
        raise RuntimeError("texts with the same 64-bit key and SHA-256 value are not the same, or the index was made of other rows")
    index.commit()
    members = in_buckets(keys, index.buckets()).join(links.drop("chain", "changed"), ["bucket", "key", "sha"])
    return members.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("n_most"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "mark",
    )
