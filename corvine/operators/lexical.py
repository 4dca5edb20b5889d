"""BM25 over an inverted index held as tables.

``postings`` (tenant, term, doc_id, tf, len) is the one table that reads text, and it is written once.
Document frequencies and statistics derive from it; a query touches only postings whose term it has, by
an equi-join on (tenant, term).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions import vocab as V
from corvine.functions.text import tokens
from corvine.storage import broadcast_if_small, written


def tokenized(docs: DataFrame) -> DataFrame:
    """``docs``: tenant_id, doc_id, text. Adds the token array."""
    return docs.select("tenant_id", "doc_id", tokens(F.col("text")).alias("tokens"))


def lengths(docs: DataFrame) -> DataFrame:
    """Token count of every document, those without tokens included."""
    return tokenized(docs).select("tenant_id", "doc_id", F.size("tokens").cast("long").alias("len"))


def postings(docs: DataFrame) -> DataFrame:
    """One row per (tenant, term, document). A document's tokens are counted where it was read: its row
    carries its length along, and counting needs one shuffle with partial sums."""
    each = tokenized(docs).select("tenant_id", "doc_id", F.size("tokens").cast("long").alias("len"), F.explode("tokens").alias("term"))
    return each.groupBy("tenant_id", "term", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf"))


def statistics(lens: DataFrame) -> DataFrame:
    """tenant_id, n documents, average length."""
    return lens.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))


def collection(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """The same from ``posts``: texts are not tokenised again, and of ``docs`` only the tenant column is read."""
    n = docs.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
    total = posts.groupBy("tenant_id").agg(F.sum("tf").alias("total"))
    return n.join(total, "tenant_id", "left").select("tenant_id", "n", (F.coalesce("total", F.lit(0)) / F.col("n")).alias("avgdl"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("tenant_id", "term").agg(F.count(F.lit(1)).alias("df"))


def holders(docs: DataFrame) -> DataFrame:
    """``document_frequency`` of texts: a document's distinct tokens are counted at once, so no row of a posting is shuffled."""
    each = docs.select("tenant_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return document_frequency(each)


def idf_of(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def idf(posts: DataFrame, stats: DataFrame) -> DataFrame:
    return document_frequency(posts).join(stats, "tenant_id").select("tenant_id", "term", "df", idf_of(F.col("n"), F.col("df")).alias("idf"))


def query_terms(questions: DataFrame) -> DataFrame:
    """``questions``: tenant_id, query_id, text. A repeated token counts as often as it stands."""
    each = questions.select("tenant_id", "query_id", F.explode(tokens(F.col("text"))).alias("term"))
    return each.groupBy("tenant_id", "query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def scores(posts: DataFrame, stats: DataFrame, terms: DataFrame, k1: float = V.K1, b: float = V.B) -> DataFrame:
    """tenant_id, query_id, doc_id, raw score of every document that shares a term."""
    wanted = terms.select("tenant_id", "term").distinct()
    some = posts.join(wanted, ["tenant_id", "term"], "left_semi")
    known = document_frequency(some)
    met = some.join(terms, ["tenant_id", "term"]).join(known, ["tenant_id", "term"]).join(F.broadcast(stats), "tenant_id")
    part = F.col("qtf") * idf_of(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return met.groupBy("tenant_id", "query_id", "doc_id").agg(F.sum(part).alias("raw"))


def top_k(found: DataFrame, k: int = 10) -> DataFrame:
    """Positive scores, rounded to 4, the best ``k`` of each query; ties keep the order of ids."""
    rounded = found.filter("raw > 0").withColumn("bm25_score", F.round("raw", 4))
    order = F.row_number().over(Window.partitionBy("tenant_id", "query_id").orderBy(F.desc("bm25_score"), "doc_id"))
    return rounded.withColumn("bm25_rank", order).filter(F.col("bm25_rank") <= k).select("tenant_id", "query_id", "doc_id", "bm25_score", "bm25_rank")


def search(docs: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` documents of each question in its tenant. Tenants are few: their statistics are broadcast."""
    posts = written(postings(docs), "postings")
    return top_k(scores(posts, collection(docs, posts), query_terms(questions)), k)


def add_documents(index: DataFrame, new: DataFrame) -> DataFrame:
    """Documents of ``new`` whose id is unknown in the tenant, next to the old ones; the first of equal ids wins."""
    fresh = new.join(index.select("tenant_id", "doc_id"), ["tenant_id", "doc_id"], "left_anti")
    return index.unionByName(fresh)


def remove_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(broadcast_if_small(ids), ["tenant_id", "doc_id"], "left_anti")


def multi_search(docs: DataFrame, questions: DataFrame, k: int = 15) -> DataFrame:
    """``multi`` over postings that are built for this call."""
    posts = written(postings(docs), "postings")
    stats = collection(docs, posts)
    return multi(questions, lambda asked: top_k(scores(posts, stats, query_terms(asked)), k), k)


def multi(questions: DataFrame, search: Callable[[DataFrame], DataFrame], k: int = 15) -> DataFrame:
    """``questions`` has ordinal: 0 is the main query (top ``k``), the others add their unseen top ``k // 2``.

    ``search`` gives the top ``k`` of questions. Ranks are positions of appending, never resorted by score.
    """
    asked = questions.select("tenant_id", F.struct("query_id", "ordinal").alias("query_id"), "text")
    hits = search(asked)
    hits = hits.select("tenant_id", F.col("query_id.query_id").alias("query_id"), F.col("query_id.ordinal").alias("ordinal"), "doc_id", "bm25_score", "bm25_rank")
    hits = hits.filter((F.col("ordinal") == 0) | (F.col("bm25_rank") <= k // 2))
    first = F.row_number().over(Window.partitionBy("tenant_id", "query_id", "doc_id").orderBy("ordinal", "bm25_rank"))
    once = hits.withColumn("seen", first).filter("seen = 1")
    rank = F.row_number().over(Window.partitionBy("tenant_id", "query_id").orderBy("ordinal", "bm25_rank"))
    return once.select("tenant_id", "query_id", "doc_id", "bm25_score", rank.alias("bm25_rank"))
