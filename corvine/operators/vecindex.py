"""An approximate vector index: a coarse quantiser, lists of product-quantised codes, and an exact second look.

* *Training* sees at most ``SAMPLE`` vectors, picked by hash of their id; everything else covers all vectors. Centres come from ``pyspark.ml``
  k-means on unit vectors; the code books are centres of each of ``parts`` slices of the residuals (vector less its centre). Both are small arrays of a fixed size.
* *Lists.* Every vector goes to its nearest centre and is stored with one byte per slice. Rows are dealt by (list, piece): a list with
  more than ``LIST`` vectors is cut into pieces, so a crowded centre is no crowded task. The vector lies beside its code in another column, which a scan of codes does not read.
* *Probes.* How many lists must be probed depends on how the vectors lie. At most ``TRIED`` stored vectors, picked by hash, are asked exactly once; the number of lists that holds the share
  ``target`` of their neighbours is kept with the index.
* *Search.* A question probes the lists of its nearest centres. A block of at most ``BLOCK`` questions meets all codes of those lists where they lie,
  in arrays: the estimated product is that with the list's centre plus one table entry per slice. Tasks keep the best ``pool`` estimates of a question,
  the best ``pool`` of all are read as vectors, and their exact cosines give the answer. Where ``pool`` is no smaller than the index, every vector of the
  probed lists would be looked at again: then that happens in the task that reads the list, and only the best ``k`` of a question leave it.

Similarities are exact, as ``vector.cosine`` rounds them; only which documents are found is approximate. ``exact=True`` compares with all vectors.
``recall`` measures the share of the exact answer that is found.

Defined results: a null vector is not indexed; a vector of length 0 has similarity 0 to all; vectors of a length other than the index's are an error; an empty
table gives an index without lists, which answers nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvine.operators import vector
from corvine.operators.best import Best
from corvine.session import ship
from corvine.storage import broadcast_if_small, shared_dir, stamp, written

SAMPLE = 50_000
LIST = 100_000
BLOCK = 1024
WORDS = 256
TRIED = 256


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    if len(flat) != len(column) * dims:
        raise ValueError(f"vectors of another length than {dims}")
    return flat.reshape(len(column), dims)


def centres(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Plain k-means of a sample's slice."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


@dataclass
class Codes:
    """Centres (lists x dims) and code books (slices x words x width)."""

    centre: np.ndarray
    book: np.ndarray

    @property
    def dims(self) -> int:
        return self.centre.shape[1]

    def near(self, x: np.ndarray, k: int = 1) -> np.ndarray:
        """Numbers of the ``k`` nearest centres of unit vectors."""
        far = (self.centre * self.centre).sum(1)[None] - 2 * x @ self.centre.T
        k = min(k, far.shape[1])
        at = np.argpartition(far, k - 1, axis=1)[:, :k]
        return np.take_along_axis(at, np.take_along_axis(far, at, 1).argsort(1), 1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centre[lists]
        out = np.empty((len(x), len(self.book)), np.uint8)
        for s, words in enumerate(self.book):
            part = rest[:, s * words.shape[1] : (s + 1) * words.shape[1]]
            out[:, s] = ((words * words).sum(1)[None] - 2 * part @ words.T).argmin(1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """questions x slices x words: product of the question's slice with each word."""
        width = self.book.shape[2]
        return np.stack([q[:, s * width : (s + 1) * width] @ words.T for s, words in enumerate(self.book)], 1)


def places_of(rows: list) -> dict[str, list[int]]:
    """Places of each tenant's questions in a block."""
    out: dict[str, list[int]] = {}
    for j, r in enumerate(rows):
        out.setdefault(r.tenant_id, []).append(j)
    return out


def train(vectors: DataFrame, lists: int, slices: int, sample: int = SAMPLE, seed: int = 5) -> Codes:
    """Centres and code books from at most ``sample`` vectors, the first by hash of their id."""
    some = vectors.orderBy(F.xxhash64("tenant_id", "doc_id")).limit(sample)
    some = written(some.select(F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), "vector-sample")
    rows = [r[0] for r in some.collect()]
    if len(set(map(len, rows))) > 1:
        raise ValueError(f"vectors of another length than {len(rows[0])}")
    x = unit(np.array(rows, np.float32))
    lists = max(1, min(lists, len(x)))
    norm = F.sqrt(vector.dot(F.col("embedding"), F.col("embedding")))
    units = some.select(array_to_vector(F.transform("embedding", lambda v: F.coalesce(F.try_divide(v, norm), F.lit(0.0)))).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=15).fit(units) if lists > 1 else None
    centre = np.array(model.clusterCenters(), np.float32) if model else x.mean(0, keepdims=True)
    if x.shape[1] % slices:
        raise ValueError(f"{slices} slices do not divide {x.shape[1]} dimensions")
    codes = Codes(centre, np.zeros((slices, 1, x.shape[1] // slices), np.float32))
    rest = x - centre[codes.near(x)[:, 0]]
    books = [centres(part, WORDS, seed + s) for s, part in enumerate(np.split(rest, slices, axis=1))]
    return Codes(centre, np.stack(books).astype(np.float32))


@dataclass
class Index:
    spark: SparkSession
    root: str
    codes: Codes | None
    ids: str
    probes: int = 1
    vectors: int = 0

    @classmethod
    def build(cls, vectors: DataFrame, root: str, lists: int | None = None, slices: int = 16, sample: int = SAMPLE, target: float = 0.98) -> Index:
        """``vectors``: tenant_id, doc_id, embedding. Probes are set so that ``target`` of the first fifteen are in the probed lists. By default as many lists as the square root of the number of vectors, 65,536 at most."""
        spark = vectors.sparkSession
        ship(spark)
        own = vectors.filter(F.col("embedding").isNotNull()).select("tenant_id", "doc_id", "embedding")
        n, ids = own.count(), vectors.schema["doc_id"].dataType
        if not n:
            return cls(spark, root, None, ids.simpleString())
        codes = train(own, lists or min(max(int(n**0.5), 1), 1 << 16), slices, sample)
        held = spark.sparkContext.broadcast(codes)
        names = ["tenant_id", "doc_id", "embedding", "list", "code"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held.value
            for b in batches:
                x = unit(matrix(b.column(2), c.dims))
                near = c.near(x)[:, 0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array([r.tobytes() for r in c.encode(x, near)], pa.binary())], names)

        kind = vectors.schema["embedding"].dataType.simpleString()
        coded = written(own.mapInArrow(run, f"tenant_id string, doc_id {ids.simpleString()}, embedding {kind}, list int, code binary"), "vector-codes")
        sizes = coded.groupBy("tenant_id", "list").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("_pieces"))
        pieces = coded.join(broadcast_if_small(sizes), ["tenant_id", "list"]).withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("_pieces")).cast("int")).drop("_pieces")
        pieces.repartition("tenant_id", "list", "piece").sortWithinPartitions("list", "tenant_id", "doc_id").write.parquet(f"{root}/lists")
        index = cls(spark, root, codes, ids.simpleString(), vectors=n)
        index.probes = index._needed(target)
        size = json.dumps({"lists": len(codes.centre), "slices": slices, "vectors": n, "probes": index.probes})
        spark.createDataFrame([(size,)], "about string").coalesce(1).write.text(f"{root}/about")
        return index

    def _needed(self, target: float, k: int = 15) -> int:
        """Lists to probe for ``target`` of the first ``k`` of the tried vectors; at most ``TRIED * k`` pairs reach the driver."""
        own = self.lists()
        tried = written(own.orderBy(F.xxhash64("doc_id", "tenant_id")).limit(TRIED).select("tenant_id", F.xxhash64("tenant_id", "doc_id").alias("query_id"), "embedding"), "vector-tried")
        near = vector.top_k(own.select("tenant_id", "doc_id", "embedding"), tried, k).select("tenant_id", "query_id", "doc_id")
        where = own.select("tenant_id", "doc_id", "list").join(broadcast_if_small(near), ["tenant_id", "doc_id"]).select("query_id", "list").collect()
        rows = {r.query_id: r.embedding for r in tried.collect()}
        order = dict(zip(rows, self.codes.near(unit(np.array(list(rows.values()), np.float32)), 1 << 30).tolist(), strict=True))
        place = sorted(order[r.query_id].index(r.list) for r in where)
        return place[min(int(target * len(place)), len(place) - 1)] + 1

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/lists")

    def search(self, questions: DataFrame, k: int = 15, probes: int | None = None, pool: int = 200, exact: bool = False) -> DataFrame:
        """``questions``: tenant_id, query_id, embedding; ``probes`` lists each, by default those of the index. tenant_id, query_id, doc_id, similarity, vector_rank as ``vector.top_k`` gives them."""
        if self.codes is None or exact:
            base = self.lists() if self.codes is not None else self.spark.createDataFrame([], f"tenant_id string, doc_id {self.ids}, embedding array<double>")
            return vector.top_k(base.select("tenant_id", "doc_id", "embedding"), questions, k)
        asked = written(questions.select("tenant_id", "query_id", "embedding"), "vector-questions")
        n = asked.count()
        parts = max(1, -(-n // BLOCK))
        found = None
        for i in range(parts):
            some = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
            near = self._looked(some, probes or self.probes, k) if pool >= self.vectors else self._estimated(some, probes or self.probes, pool)
            found = near if found is None else found.unionByName(near)
        if pool >= self.vectors:
            return found
        ask = ["tenant_id", "query_id"]
        order = F.row_number().over(Window.partitionBy(*ask).orderBy(F.desc("estimate"), "doc_id"))
        best = found.withColumn("_n", order).filter(F.col("_n") <= pool).select(*ask, "list", "doc_id")
        met = self.lists().select("tenant_id", "list", "doc_id", "embedding").join(broadcast_if_small(best), ["tenant_id", "list", "doc_id"])
        both = met.join(broadcast_if_small(asked.withColumnRenamed("embedding", "asked")), ask)
        names, dims = [*ask, "doc_id", "cosine"], self.codes.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (matrix(b.column(c), dims).astype(np.float64) for c in (3, 4))
                norms = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.divide((x * y).sum(1), norms, out=np.zeros(len(x)), where=norms > 0))], names)

        kinds = {f.name: f.dataType.simpleString() for f in both.schema}
        scored = both.select(*ask, "doc_id", "embedding", "asked").mapInArrow(run, f"tenant_id string, query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, cosine double")
        scored = scored.select(*ask, "doc_id", F.round("cosine", 4).alias("similarity"))
        rank = F.row_number().over(Window.partitionBy(*ask).orderBy(F.desc("similarity"), "doc_id"))
        return scored.withColumn("vector_rank", rank).filter(F.col("vector_rank") <= k)

    def _probed(self, rows: list, probes: int) -> tuple[np.ndarray, dict[tuple[str, int], list[int]] | None]:
        """Unit vectors of a block of questions, and who asks which list of which tenant; None if all ask all."""
        c = self.codes
        q = unit(np.array([r.embedding for r in rows], np.float32).reshape(len(rows), c.dims)) if rows else np.zeros((0, c.dims), np.float32)
        if probes >= len(c.centre):
            return q, None
        who: dict[tuple[str, int], list[int]] = {}
        for j, near in enumerate(c.near(q, probes) if rows else ()):
            for x in near:
                who.setdefault((rows[j].tenant_id, int(x)), []).append(j)
        return q, who

    def _read(self, who: dict[tuple[str, int], list[int]] | None) -> DataFrame:
        return self.lists() if who is None else self.lists().filter(F.col("list").isin(sorted({x for _, x in who})))

    def _looked(self, asked: DataFrame, probes: int, k: int) -> DataFrame:
        """The exact best ``k`` of the probed lists for one block of questions."""
        rows = asked.collect()
        _, who = self._probed(rows, probes)
        held = self.spark.sparkContext.broadcast((who, places_of(rows), np.array([r.embedding for r in rows], np.float64).reshape(len(rows), self.codes.dims)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            who, every, x = held.value
            best = Best(len(x), k)
            for b in batches:
                b = b.take(pc.sort_indices(b.column("doc_id"), null_placement="at_start"))
                for t in b.column("tenant_id").unique().to_pylist():
                    own = b.filter(pc.equal(b.column("tenant_id"), t))
                    for one in [None] if who is None else own.column("list").unique().to_pylist():
                        places = np.array(every.get(t, []) if who is None else who.get((t, one), []), np.int64)
                        if len(places):
                            vector.meet(best, own if who is None else own.filter(pc.equal(own.column("list"), one)), places, x[places])
            yield from best.batches("cosine")

        near = self._read(who).select("tenant_id", "list", "doc_id", "embedding").mapInArrow(run, f"_q int, doc_id {self.ids}, cosine double")
        return vector.ranked(near, rows, asked, k)

    def _estimated(self, asked: DataFrame, probes: int, pool: int) -> DataFrame:
        """The best ``pool`` estimates of each task and question of one block; the questions, at most ``BLOCK`` of them by hash, go to all tasks, which
        make the tables of products themselves."""
        rows = asked.collect()
        q, who = self._probed(rows, probes)
        held = self.spark.sparkContext.broadcast((who, places_of(rows), self.codes, q, [r.query_id for r in rows]))
        id_type = to_arrow_type(asked.schema["query_id"].dataType)
        names = ["tenant_id", "query_id", "list", "doc_id", "estimate"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            who, every, c, q, ids = held.value
            tables, base = c.tables(q), q @ c.centre.T
            slices = np.arange(tables.shape[1])[None]
            best: dict[int, list] = {}
            for b in batches:
                lists = b.column(1).to_numpy()
                flat = b.column(3)
                codes = np.frombuffer(b"".join(flat.to_pylist()), np.uint8).reshape(b.num_rows, -1)
                for t in b.column(0).unique().to_pylist():
                    mine = pc.fill_null(pc.equal(b.column(0), t), False).to_numpy(zero_copy_only=False)
                    for x in np.unique(lists[mine]):
                        asks = every.get(t, ()) if who is None else who.get((t, int(x)), ())
                        if not asks:
                            continue
                        at = np.flatnonzero(mine & (lists == x))
                        some = codes[at]
                        for j in asks:
                            s = base[j, x] + tables[j][slices, some].sum(1)
                            keep = np.argpartition(-s, pool - 1)[:pool] if len(s) > pool else np.arange(len(s))
                            best.setdefault(j, []).append((t, int(x), s[keep], b.column(2).take(pa.array(at[keep]))))
            for j, parts in best.items():
                s = np.concatenate([p[2] for p in parts])
                docs = pa.concat_arrays([p[3] for p in parts])
                lists = np.concatenate([np.full(len(p[2]), p[1], np.int32) for p in parts])
                keep = np.argsort(-s, kind="stable")[:pool]
                n = len(keep)
                yield pa.RecordBatch.from_arrays([pa.array([parts[0][0]] * n), pa.array([ids[j]] * n, id_type), pa.array(lists[keep]), docs.take(pa.array(keep)), pa.array(s[keep].astype(np.float32))], names)

        kind = asked.schema["query_id"].dataType.simpleString()
        codes = self._read(who).select("tenant_id", "list", "doc_id", "code")
        return codes.mapInArrow(run, f"tenant_id string, query_id {kind}, list int, doc_id {self.ids}, estimate float")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_exact and n_found of each question: how many rows of the exact answer are found. A row with the same similarity as the last exact one counts as well."""
    ask = ["tenant_id", "query_id"]
    last = exact.groupBy(*ask).agg(F.min("similarity").alias("_least"), F.count(F.lit(1)).alias("n_exact"))
    hits = found.join(last, ask).groupBy(*ask).agg(F.sum((F.col("similarity") >= F.col("_least")).cast("long")).alias("n_found"))
    return last.join(hits, ask, "left").select(*ask, "n_exact", F.least(F.coalesce("n_found", F.lit(0)), F.col("n_exact")).alias("n_found"))


_kept: dict[tuple, Index] = {}


def kept(vectors: DataFrame, name: str) -> Index:
    """The index of an input of files, built once per application and state of the files."""
    spark = vectors.sparkSession
    key = (spark.sparkContext.applicationId, name, stamp(vectors))
    if key not in _kept:
        _kept[key] = Index.build(vectors, f"{shared_dir(spark)}/corvine/vectors-{uuid.uuid4().hex}")
    return _kept[key]
