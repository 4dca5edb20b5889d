"""Answer cache and suggestion keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions import vocab as V
from corvine.functions.text import cache_identifiers
from corvine.operators import vector

#: Fixed value: the DNS name space of RFC 4122.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, space: str = DNS) -> Column:
    """Name-based UUID, version 5: SHA-1 of name space and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def lookup(cache: DataFrame, queries: DataFrame, least: float = V.CACHE_SIMILARITY) -> DataFrame:
    """``cache``: tenant_id, doc_id, embedding, original_query; ``queries``: tenant_id, query_id, embedding, text.

    The nearest entry of the tenant is a hit when it is similar enough and has the same identifiers; the second best is never tried.
    """
    best = vector.top_k(cache, queries, 1)
    met = best.join(cache.select("tenant_id", "doc_id", "original_query"), ["tenant_id", "doc_id"]).join(queries.select("tenant_id", "query_id", "text"), ["tenant_id", "query_id"])
    same = cache_identifiers(F.col("original_query")) == cache_identifiers(F.col("text"))
    return met.select("tenant_id", "query_id", "doc_id", "similarity", ((F.col("similarity") >= least) & same).alias("hit"))


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by the identifier of (tenant, query): ``cache`` and ``new`` have tenant_id, query, answer, put_at; the latest wins."""
    both = cache.unionByName(new).withColumn("id", uuid5(F.concat_ws("|", "tenant_id", "query")))
    last = F.row_number().over(Window.partitionBy("tenant_id", "id").orderBy(F.desc("put_at"), F.desc("answer")))
    return both.withColumn("_n", last).filter("_n = 1").drop("_n")


def invalidate(cache: DataFrame, tenants: DataFrame) -> DataFrame:
    """The cache after the corpora of ``tenants`` changed."""
    return cache.join(tenants.select("tenant_id").distinct(), "tenant_id", "left_anti")


def suggestion_key(files: DataFrame, tops: DataFrame) -> DataFrame:
    """SHA-256 of tenant, sorted file names and number of top entities."""
    f = files.groupBy("tenant_id").agg(F.array_sort(F.collect_set("filename")).alias("names"))
    n = tops.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
    key = F.concat(F.col("tenant_id"), F.lit("|"), F.array_join("names", "|"), F.lit("|nodes:"), F.coalesce("n", F.lit(0)).cast("string"))
    return f.join(n, "tenant_id", "left").select("tenant_id", F.sha2(key, 256).alias("key"))


def suggestions(files: DataFrame) -> DataFrame:
    """Deterministic questions about a corpus: two general ones and one for each of the first two files."""
    f = files.groupBy("tenant_id").agg(F.array_sort(F.collect_set("filename")).alias("n"))
    first, second = F.get("n", F.lit(0)), F.get("n", F.lit(1))

    def row(place: int, category: str, text: Column, query: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(category).alias("category"), text.alias("text"), query.alias("query"))

    rows = F.array(
        row(1, "Visión General", F.lit("¿Qué tienen en común los documentos?"), F.lit("¿Qué tienen en común los documentos subidos y cuáles son sus temáticas principales?")),
        row(2, "Contenido", F.concat(F.lit("Resumen de "), F.substring(first, 1, 20)), F.concat(F.lit("¿Cuáles son los puntos clave y conceptos principales explicados en "), first, F.lit("?"))),
        row(3, "Análisis Detallado", F.concat(F.lit("Detalles de "), F.substring(second, 1, 20)), F.concat(F.lit("Explica en detalle los conceptos y normativas tratados en "), second, F.lit("."))),
        row(4, "Grafo Relacional", F.lit("Entidades y relaciones clave"), F.lit("¿Qué entidades, personas o conceptos principales conectan los documentos en el grafo de conocimiento?")),
    )
    return f.select("tenant_id", F.inline(F.filter(rows, lambda r: r["query"].isNotNull())))
