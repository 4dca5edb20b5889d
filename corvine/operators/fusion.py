"""Reciprocal rank fusion, reranking decisions and the assembled context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions import vocab as V
from corvine.functions.text import tokens
from corvine.storage import broadcast_if_small, written

KEYS = ["tenant_id", "query_id", "doc_id"]


def rrf(vector: DataFrame, bm25: DataFrame, k: int = 60, top: int = 15) -> DataFrame:
    """Full outer join of both lists by document; score is the sum of 1 / (k + position), sorted unrounded."""
    v = vector.select(*KEYS, F.col("similarity").alias("vector_score"), "vector_rank")
    b = bm25.select(*KEYS, "bm25_score", "bm25_rank")
    both = v.join(b, KEYS, "full_outer")

    def part(rank: str) -> Column:
        return F.coalesce(1.0 / (k + F.col(rank)), F.lit(0.0))

    raw = both.withColumn("raw", part("vector_rank") + part("bm25_rank"))
    channels = F.array_compact(F.array(F.when(F.col("vector_rank").isNotNull(), "vector"), F.when(F.col("bm25_rank").isNotNull(), "bm25")))
    order = F.row_number().over(Window.partitionBy("tenant_id", "query_id").orderBy(F.desc("raw"), F.col("vector_rank").asc_nulls_last(), "bm25_rank", "doc_id"))
    ranked = raw.withColumn("final_rank", order).filter(F.col("final_rank") <= top)
    return ranked.select(
        *KEYS, F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), "vector_rank", F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), "bm25_rank",
        F.round("raw", 6).alias("rrf_score"), F.array_join(channels, ",").alias("origin_channels"), "final_rank",
    )


def rerank_decision(fused: DataFrame, questions: DataFrame, local_model: bool = False, enabled: bool = True) -> DataFrame:
    """Per query: whether to rerank, and why."""
    top = fused.groupBy("tenant_id", "query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("final_rank") == 1, F.col("rrf_score"))).alias("c0"), F.max(F.when(F.col("final_rank") == 2, F.col("rrf_score"))).alias("c1")
    )
    all_ = questions.join(top, ["tenant_id", "query_id"], "left")
    reason = (
        F.when(F.lit(not enabled), "RERANKER_DISABLED")
        .when(F.coalesce("n", F.lit(0)) < 2, "INSUFFICIENT_CANDIDATES")
        .when(F.lit(local_model), "EXECUTE_RERANKING_LOCAL")
        .when(F.lower("text").rlike(V.EXACT_CODE), "BYPASS_EXACT_IDENTIFIER")
        .when((F.col("c0") >= 0.032) & (F.col("c0") - F.col("c1") >= 0.008), "BYPASS_DOMINANT_RRF")
        .otherwise("EXECUTE_RERANKING")
    )
    return all_.select("tenant_id", "query_id", reason.alias("reason"), F.startswith(reason, F.lit("EXECUTE")).alias("should_rerank"))


def lexical_score(question: Column, passage: Column) -> Column:
    """Deterministic stand-in for a cross-encoder: share of the question's distinct tokens found in the passage."""
    asked = F.array_distinct(tokens(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(passage))) / F.size(asked)).otherwise(0.0)


def rerank(fused: DataFrame, questions: DataFrame, passages: DataFrame, pool: int = 10, chars: int = 500, top: int = 5, scorer=lexical_score, missing: float | None = None) -> DataFrame:
    """Score the first ``pool`` candidates' first ``chars`` characters and keep the best ``top``; a null score counts as ``missing``."""
    # questions first: what has none drops out, and the rest is few rows beside the passages
    some = fused.filter(F.col("final_rank") <= pool).join(questions.select("tenant_id", "query_id", F.col("text").alias("question")), ["tenant_id", "query_id"])
    asked = passages.select("tenant_id", "doc_id", F.substring("text", 1, chars).alias("passage")).join(broadcast_if_small(written(some, "rerank-pool")), ["tenant_id", "doc_id"])
    scored = asked.withColumn("reranker_score", F.round(F.coalesce(scorer(F.col("question"), F.col("passage")), F.lit(missing).cast("double")), 4))
    rank = F.row_number().over(Window.partitionBy("tenant_id", "query_id").orderBy(F.desc("reranker_score"), "final_rank"))
    return scored.withColumn("reranker_rank", rank).filter(F.col("reranker_rank") <= top).select(*KEYS, "reranker_score", "reranker_rank")


def rerank_by_model(fused: DataFrame, questions: DataFrame, passages: DataFrame, scorer, top: int = 5) -> DataFrame:
    """``rerank`` with a language model's column function; a candidate that it gives no score counts as 0.30."""
    return rerank(fused, questions, passages, V.MODEL_POOL, V.MODEL_CHARS, top, scorer, V.MODEL_MISSING)


def bypassed(fused: DataFrame, reason: str | Column, top: int = 5) -> DataFrame:
    """Fused order kept; the score is the fused one, marked so that evidence does not take it for a model's."""
    return fused.filter(F.col("final_rank") <= top).select(*KEYS, F.round("rrf_score", 4).alias("reranker_score"), F.col("final_rank").alias("reranker_rank"), F.concat(F.lit("Bypass: "), F.lit(reason)).alias("rerank_rationale"))


def overview(chunks: DataFrame, limit: int = 12) -> DataFrame:
    """First chunk of each file in store order (``ordinal``), for questions about the whole corpus."""
    first = F.row_number().over(Window.partitionBy("tenant_id", "filename").orderBy("ordinal"))
    heads = chunks.withColumn("n", first).filter("n = 1")
    rank = F.row_number().over(Window.partitionBy("tenant_id").orderBy("ordinal"))
    return heads.withColumn("position", rank).filter(F.col("position") <= limit).select("tenant_id", "filename", "doc_id", F.lit(0.88).alias("similarity"), F.lit("corpus_overview").alias("origin_channels"), "position")


def context_sources(fused: DataFrame, chunks: DataFrame, nodes: DataFrame, extra: DataFrame) -> DataFrame:
    """Source tags of every query: passages by channel and file, graph nodes by type and name, overview rows not yet present."""
    more = extra.join(fused.select(*KEYS), KEYS, "left_anti").select(*KEYS, F.lit("corpus_overview").alias("origin_channels"))
    passages = fused.select(*KEYS, "origin_channels").unionByName(more).join(chunks.select("tenant_id", "doc_id", "filename"), ["tenant_id", "doc_id"])
    tags = passages.select("tenant_id", "query_id", F.concat(F.lit("DocRRF["), "origin_channels", F.lit("]:"), "filename").alias("source"))
    graph = nodes.select("tenant_id", "query_id", F.concat(F.lit("Neo4j:"), "type", F.lit(":"), "name").alias("source"))
    return tags.unionByName(graph).distinct()
