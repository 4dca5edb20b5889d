"""Cosine search. Queries are a stated set met in blocks: a block of checked size goes to every task and meets the task's vectors in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corvine.operators.best import CELLS, Best
from corvine.session import ship

BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(product: Column, norms: Column) -> Column:
    """Rounded to 4; 0 where a vector has no length."""
    return F.round(F.coalesce(F.try_divide(product, norms), F.lit(0.0)), 4)


def rows_of(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have ``dims`` numbers, and these as rows; a missing number is NaN."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    flat = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return fits.to_numpy(zero_copy_only=False), flat.reshape(-1, dims)


def cosines(column: pa.Array, asked: np.ndarray | None) -> np.ndarray:
    """Cosine of every vector (row) with every question (column); 0 where lengths differ or one of the two has no length."""
    if asked is None:
        return np.zeros((len(column), 1))
    fits, x = rows_of(column, asked.shape[1])
    out = np.zeros((len(column), len(asked)))
    norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(asked, axis=1)[None, :]
    with np.errstate(invalid="ignore"):
        out[fits] = np.nan_to_num(np.divide(x @ asked.T, norms, out=np.zeros_like(norms), where=norms > 0), nan=0.0)
    return out


def blocks_of(rows: list) -> dict[str, list[tuple[np.ndarray, np.ndarray | None]]]:
    """The questions of each tenant, those of one length together: their places in the block and their vectors (None for questions without one)."""
    groups: dict[tuple, list[int]] = {}
    for at, r in enumerate(rows):
        groups.setdefault((r["tenant_id"], None if r["embedding"] is None else len(r["embedding"])), []).append(at)
    out: dict[str, list] = {}
    for (tenant, dims), places in groups.items():
        if dims is None:
            out.setdefault(tenant, []).extend((np.array([p]), None) for p in places)
        else:
            out.setdefault(tenant, []).append((np.array(places), np.array([rows[p]["embedding"] for p in places], np.float64).reshape(-1, dims)))
    return out


def meet(best: Best, own: pa.RecordBatch, places: np.ndarray, x: np.ndarray | None) -> None:
    """``own``: doc_id, in its order, and embedding; ``x``: vectors of the questions at ``places``."""
    step = max(1, CELLS // max(1, own.num_rows))
    for s in range(0, len(places), step):
        best.add(own.column("doc_id"), places[s : s + step], cosines(own.column("embedding"), x if x is None else x[s : s + step]))


def ranked(found: DataFrame, rows: list, named: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of the rows (_q, doc_id, cosine) of each question of a block."""
    names = found.sparkSession.createDataFrame([(at, r["tenant_id"], r["query_id"]) for at, r in enumerate(rows)], StructType([StructField("_q", IntegerType()), *named.drop("embedding").schema.fields]))
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("similarity"), "doc_id"))
    best = found.withColumn("similarity", F.round("cosine", 4)).withColumn("vector_rank", rank).filter(F.col("vector_rank") <= k)
    return best.join(F.broadcast(names), "_q").select("tenant_id", "query_id", "doc_id", "similarity", "vector_rank")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 15, block: int = BLOCK) -> DataFrame:
    """``vectors``: tenant_id, doc_id, embedding; ``queries``: tenant_id, query_id, embedding. Exact: every vector is compared.

    Questions come to the driver in blocks of about ``block`` and meet the vectors of their tenant where these lie. A task keeps the best
    ``k`` of each question over all its batches (``Best``), so the shuffle sees few rows per task and question. A null vector, and one of
    another length than the question's, has similarity 0.
    """
    ship(vectors.sparkSession)
    parts = max(1, -(-queries.count() // block))
    v = vectors.select("tenant_id", "doc_id", "embedding")
    ids = vectors.schema["doc_id"].dataType.simpleString()
    named = queries.select("tenant_id", "query_id", "embedding")
    out = None
    for i in range(parts):
        rows = (named if parts == 1 else named.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)).collect()
        asked = blocks_of(rows)

        def run(batches: Iterator[pa.RecordBatch], asked=asked, n=len(rows)) -> Iterator[pa.RecordBatch]:
            best = Best(n, k)
            for b in batches:
                b = b.take(pc.sort_indices(b.column("doc_id"), null_placement="at_start"))
                tenants = b.column("tenant_id")
                for tenant in tenants.unique().to_pylist():
                    if tenant is not None and tenant in asked:
                        own = b.filter(pc.equal(tenants, tenant))
                        for places, x in asked[tenant]:
                            meet(best, own, places, x)
            yield from best.batches("cosine")

        best = ranked(v.mapInArrow(run, f"_q int, doc_id {ids}, cosine double"), rows, named, k)
        out = best if out is None else out.unionByName(best)
    return out


def multi(hits: DataFrame, k: int = 15) -> DataFrame:
    """Hits of several phrasings (``ordinal``) of a query: a document keeps the similarity of the first phrasing that found it."""
    first = F.row_number().over(Window.partitionBy("tenant_id", "query_id", "doc_id").orderBy("ordinal", "vector_rank"))
    once = hits.withColumn("seen", first).filter("seen = 1")
    rank = F.row_number().over(Window.partitionBy("tenant_id", "query_id").orderBy(F.desc("similarity"), "doc_id"))
    return once.withColumn("vector_rank", rank).filter(F.col("vector_rank") <= k).select("tenant_id", "query_id", "doc_id", "similarity", "vector_rank")


def hashed_embedding(terms: Column, dims: int = 64) -> Column:
    """Deterministic stand-in embedder: signed hashed term counts."""
    hashed = F.transform(terms, lambda t: F.xxhash64(t))
    # one-element array: what it holds is computed once, not once per dimension
    once = F.array(F.struct(hashed.alias("h")))

    def split(h: Column) -> Column:
        place = lambda x: F.pmod(x, F.lit(dims)).cast("int")
        even = lambda x: F.shiftright(x, 40).bitwiseAND(F.lit(1)) == 0
        return F.struct(F.transform(F.filter(h, even), place).alias("plus"), F.transform(F.filter(h, lambda x: ~even(x)), place).alias("minus"))

    def count(places: Column, d: Column) -> Column:
        return F.size(places) - F.size(F.array_remove(places, d))

    parts = F.transform(once, lambda s: split(s["h"]))
    sums = F.transform(parts, lambda s: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: (count(s["plus"], d) - count(s["minus"], d)).cast("double")))
    return F.when(terms.isNotNull(), F.element_at(sums, 1))
