"""Usage metrics over a request log: request_id, ts, latency_ms, from_cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_latency(log: DataFrame, n: int = 100) -> DataFrame:
    """Mean latency of the last ``n`` requests of a user at each request; partitioned, so no task sees the whole log."""
    w = Window.partitionBy("user_id").orderBy("ts", "request_id").rowsBetween(-(n - 1), 0)
    return log.select("user_id", "request_id", F.round(F.avg("latency_ms").over(w), 1).alias("latency_ms"))


def last_latency(log: DataFrame, n: int = 100) -> DataFrame:
    """Mean latency of the last ``n`` requests: a top-n, then one average."""
    return log.orderBy(F.desc("ts"), F.desc("request_id")).limit(n).agg(F.coalesce(F.round(F.avg("latency_ms"), 1), F.lit(0.0)).alias("latency_ms"))


def hit_rate(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.round(F.avg(F.col("from_cache").cast("double")) * 100, 1), F.lit(0.0)).alias("hit_rate"))


def uptime(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60)


def latency_status(ms: Column) -> Column:
    return F.when(ms < 3000, "ok").when(ms < 8000, "warn").otherwise("error")


def hit_status(rate: Column) -> Column:
    return F.when(rate > 30, "ok").when(rate > 10, "warn").otherwise("info")


def kpis(log: DataFrame, graph: DataFrame, n_chunks: DataFrame, model: str = "extractive", uptime_s: int = 0) -> DataFrame:
    """One row per figure: name, value, status. ``graph``: n_nodes, n_edges; ``n_chunks``: n_chunks."""
    one = last_latency(log).crossJoin(hit_rate(log)).crossJoin(graph.agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges"))).crossJoin(n_chunks)  # four tables of one row

    def row(name: str, value: Column, status: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), status.alias("status"))

    info, ok = F.lit("info"), F.lit("ok")
    rows = F.array(
        row("latency", F.format_string("%.1f ms", "latency_ms"), latency_status(F.col("latency_ms"))),
        row("cache hits", F.format_string("%.1f%%", "hit_rate"), hit_status(F.col("hit_rate"))),
        row("requests", F.col("total"), info),
        row("entities", F.col("n_nodes"), ok),
        row("relations", F.col("n_edges"), ok),
        row("chunks", F.col("n_chunks"), ok),
        row("model", F.lit(model), info),
        row("pagerank", F.lit("built in"), ok),
        row("uptime", uptime(F.lit(uptime_s)), ok),
        row("graph store", F.lit("connected"), ok),
        row("vector store", F.lit("connected"), ok),
    )
    return one.select(F.inline(rows))


def list_documents(chunks: DataFrame) -> DataFrame:
    """``chunks``: tenant_id, filename, char_count, header_path. One row per file."""
    ext = F.upper(F.regexp_extract("filename", "\\.([^.]+)$", 1))
    return chunks.groupBy("tenant_id", "filename").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("char_count").cast("long").alias("chars"), F.count_distinct(F.when(F.col("header_path") != "", F.col("header_path"))).alias("sections"), F.first(F.when(ext == "", "TXT").otherwise(ext)).alias("file_type")
    )
