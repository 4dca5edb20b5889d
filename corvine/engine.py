"""One object for the service's operations: ingest, delete, ask, list, graph, metrics, suggestions, reset.

Tables live under ``root``, partitioned by organisation and by a bucket of the key, and are changed by
overwriting only the partitions that hold touched keys: what is read is written aside first, so a job that
fails leaves the old partitions in place. One writer per organisation is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import text as T
from corvine.functions import vocab as V
from corvine.operators import cache, chunks, entities, graph, lexindex, metrics
from corvine.plans import ask as asking
from corvine.plans import decide
from corvine.sources import files
from corvine.storage import broadcast_if_small, written

SCHEMAS = {
    "chunks": "tenant_id string, filename string, chunk_id string, chunk_index int, header_path string, text string, is_table boolean, char_count int",
    "nodes": "tenant_id string, name string, type string, source_doc string, source_docs array<string>",
    "edges": "tenant_id string, src string, rel_type string, dst string, source_docs array<string>",
    "answers": "tenant_id string, query string, embedding array<double>, route string, level string, answer string, confidence double, n_sources long, put_at timestamp",
    "log": "tenant_id string, request_id long, user_id long, ts timestamp, latency_ms double, from_cache boolean",
}
KEYS = {"chunks": "filename", "nodes": "name", "edges": "src", "answers": "query", "log": "request_id"}


class Forbidden(PermissionError):
    pass


def mentioned(chunk_rows: DataFrame) -> DataFrame:
    """Default entity extractor: codes and runs of capitalised words, with the file they come from."""
    names = F.regexp_extract_all("text", F.lit(r"(?U)\b\p{Lu}[\w.&-]*(?:\s+\p{Lu}[\w.&-]*){1,4}"), F.lit(0))
    found = F.array_distinct(F.concat(T.exact_identifiers(F.col("text")), names))
    return chunk_rows.select("tenant_id", "filename", "chunk_index", F.posexplode(found).alias("place", "entity_name")).withColumn("entity_type", F.lit("Entity"))


class Engine:
    def __init__(self, spark: SparkSession, root: str, role: str = "admin", buckets: int = 16, extractor=mentioned):
        self.spark, self.root, self.role, self.buckets, self.extractor = spark, root.rstrip("/"), role, buckets, extractor

    # --- tables ---------------------------------------------------------------------------------------

    def _need(self, role: str) -> None:
        if not decide.role_allows(self.role, role):
            raise Forbidden(f"needs role {role}")

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(KEYS[name]), F.lit(self.buckets)).cast("int")

    def _stored(self, name: str) -> DataFrame:
        path, fs = self._path(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], SCHEMAS[name] + ", bucket int")
        return self.spark.read.schema(SCHEMAS[name] + ", bucket int").parquet(f"{self.root}/{name}")

    def table(self, name: str, tenant: str | None = None) -> DataFrame:
        """Rows of one organisation (its partitions alone are read) or of all."""
        t = self._stored(name).drop("bucket")
        return t if tenant is None else t.filter(F.col("tenant_id") == tenant)

    def _path(self, place: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{place}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, name: str, rows: DataFrame, keys: DataFrame | None = None) -> None:
        """Replace the partitions that ``rows`` holds, and empty those of ``keys`` (see ``_touched``) that it holds no more."""
        out = written(rows.withColumn("bucket", self._bucket(name)), name)
        had = set() if keys is None else {(r[0], r[1]) for r in keys.select("tenant_id", self._bucket(name).alias("bucket")).distinct().collect()}
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id", "bucket").parquet(f"{self.root}/{name}")
        if had:
            for tenant, bucket in had - {(r[0], r[1]) for r in out.select("tenant_id", "bucket").distinct().collect()}:
                path, fs = self._path(f"{name}/tenant_id={tenant}/bucket={bucket}")
                fs.delete(path, True)

    def _touched(self, name: str, keys: DataFrame) -> DataFrame:
        """All stored rows of the partitions that hold one of ``keys`` (tenant_id and the table's key)."""
        parts = keys.select("tenant_id", self._bucket(name).alias("bucket")).distinct()
        return self._stored(name).join(broadcast_if_small(parts), ["tenant_id", "bucket"], "left_semi").drop("bucket")

    # --- writing --------------------------------------------------------------------------------------

    def ingest(self, docs: DataFrame) -> dict[str, int]:
        """``docs``: tenant_id, filename, text. A file that is known is replaced, in chunks and in the graph."""
        self._need("standard")
        clean = docs.select(T.tenant_or_default(F.col("tenant_id")).alias("tenant_id"), "filename", T.clean_text(F.col("text")).alias("text"))
        clean = written(clean, "new-documents")
        known = clean.select("tenant_id", "filename").distinct()
        new = written(chunks.chunk_documents(clean), "new-chunks").select(*self._stored("chunks").drop("bucket").columns)
        self._index_replace(known, new)
        self._put("chunks", chunks.replace_files(self._touched("chunks", known), new, known), known)
        raw = self.extractor(new).withColumn("ordinal", F.monotonically_increasing_id())
        kept, _ = entities.filtered(raw)
        source = raw.select("tenant_id", "ordinal", "filename")
        found = written(kept.join(source, ["tenant_id", "ordinal"]).select("tenant_id", "name", "type", F.col("filename").alias("source_doc")), "new-nodes")
        self._forget(known, found)
        self._drop_answers(known)
        return {"chunks": new.count(), "entities": found.count()}

    def index(self) -> lexindex.Index:
        """The kept lexical index of all chunks."""
        return lexindex.Index.open(self.spark, f"{self.root}/lexical", ids="string")

    def _index_replace(self, files_: DataFrame, new: DataFrame | None) -> None:
        """The chunks of ``files_`` leave the index and those of ``new`` enter it, in one version."""
        old = self._touched("chunks", files_).join(files_, ["tenant_id", "filename"], "left_semi").select("tenant_id", F.col("chunk_id").alias("doc_id"))
        self.index().replace(old, None if new is None else new.select("tenant_id", F.col("chunk_id").alias("doc_id"), "text"))

    def _forget(self, files_: DataFrame, found: DataFrame) -> None:
        """Old nodes and edges of ``files_`` go unless other files support them; ``found`` nodes are merged in."""
        here = broadcast_if_small(files_.select("tenant_id").distinct())
        nodes, edges = (self._stored(name).drop("bucket").join(here, "tenant_id", "left_semi") for name in ("nodes", "edges"))
        hit = written(graph.supports(nodes, ["tenant_id", "name"], files_), "old-nodes")
        dead = hit.filter(F.size("left") == 0)
        ends = [edges.join(dead.select("tenant_id", F.col("name").alias(e)), ["tenant_id", e], "left_semi").select("tenant_id", "src") for e in ("src", "dst")]
        of_edges = graph.supports(edges, ["tenant_id", "src", "rel_type", "dst"], files_).select("tenant_id", "src").unionByName(ends[0]).unionByName(ends[1])
        of_edges = written(of_edges.distinct(), "old-edges")
        of_nodes = hit.select("tenant_id", "name").unionByName(found.select("tenant_id", "name")).distinct()
        left, _ = graph.forget(self._touched("nodes", of_nodes), edges.limit(0), files_)
        # dead nodes may lie in other partitions than the edges that end at them, so all of the organisations' nodes decide
        _, rest = graph.forget(nodes, self._touched("edges", of_edges), files_)
        rest = written(rest, "left-edges")
        self._put("nodes", graph.merge_nodes(left, found), of_nodes)
        self._put("edges", rest, of_edges)

    def _drop_answers(self, keys: DataFrame) -> None:
        """Cached answers of organisations whose corpus changed are void."""
        for r in keys.select("tenant_id").distinct().collect():
            self._drop_tenant("answers", r[0])

    def ingest_files(self, path: str, tenant: str, glob: str = "*") -> dict[str, int]:
        read = files.extracted(files.read_files(self.spark, path, glob)).filter("error is null")
        return self.ingest(read.select(F.lit(tenant).alias("tenant_id"), F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), "text"))

    def merge_entities(self, payloads: DataFrame, source_doc: str | None = None) -> None:
        """``payloads``: tenant_id, payload (see ``files.ENTITY``): nodes and oriented edges are merged with their provenance."""
        self._need("standard")
        p = payloads.select("tenant_id", entities.normalized(F.col("payload.entity_name")).alias("name"), entities.canonical_type(F.col("payload.entity_type")).alias("type"), F.col("payload.relations").alias("relations"))
        p = written(p.filter(entities.rejection(F.col("name")).isNull()), "payloads")
        doc = F.lit(source_doc).cast("string")
        r = p.select("tenant_id", F.col("name").alias("src"), F.col("type").alias("src_type"), F.explode("relations").alias("r"))
        r = r.select("tenant_id", "src", "src_type", entities.normalized(F.col("r.target_name")).alias("dst"), entities.canonical_type(F.col("r.target_type")).alias("dst_type"), T.relation_type(F.col("r.relation_type")).alias("rel_type"))
        r = r.filter(entities.rejection(F.col("dst")).isNull() & (F.lower("src") != F.lower("dst"))).withColumn("ordinal", F.monotonically_increasing_id())
        turned = written(entities.reoriented(r), "relations")
        ends = turned.select("tenant_id", F.col("n_src").alias("name"), F.col("n_src_type").alias("type")).unionByName(turned.select("tenant_id", F.col("n_dst").alias("name"), F.col("n_dst_type").alias("type")))
        named = p.select("tenant_id", "name", "type")
        rest = ends.join(named, ["tenant_id", "name"], "left_anti")
        nodes = written(named.unionByName(rest).groupBy("tenant_id", "name").agg(F.min("type").alias("type")).withColumn("source_doc", doc), "merged-nodes")
        self._put("nodes", graph.merge_nodes(self._touched("nodes", nodes), nodes))
        edges = written(turned.select("tenant_id", F.col("n_src").alias("src"), F.col("n_rel").alias("rel_type"), F.col("n_dst").alias("dst")).distinct().withColumn("source_doc", doc), "merged-edges")
        self._put("edges", graph.merge_edges(self._touched("edges", edges), edges))

    def delete_document(self, filename: str, tenant: str) -> bool:
        """False when no chunk has the file; then nothing else is touched."""
        self._need("confidential")
        old = self.table("chunks", tenant)
        left = chunks.delete_file(old, filename, tenant)
        if old.count() == left.count():
            return False
        gone = old.join(left.select("chunk_id"), "chunk_id", "left_anti").select("tenant_id", F.col("chunk_id").alias("doc_id"))
        self.index().remove(gone)
        nodes, edges = graph.delete_document(self.table("nodes", tenant), self.table("edges", tenant), filename, tenant)
        # an organisation's rows are exchanged as a whole: all new ones are complete aside before old ones go
        ready = [(name, written(rows.withColumn("bucket", self._bucket(name)), name)) for name, rows in (("chunks", left), ("nodes", nodes), ("edges", edges))]
        for name, rows in ready:
            self._drop_tenant(name, tenant)
            rows.write.mode("append").partitionBy("tenant_id", "bucket").parquet(f"{self.root}/{name}")
        self._drop_tenant("answers", tenant)
        return True

    def _drop_tenant(self, name: str, tenant: str) -> None:
        path, fs = self._path(f"{name}/tenant_id={tenant}")
        fs.delete(path, True)

    def reset(self, tenant: str | None = None) -> None:
        """Everything of one organisation, and of no other; without one, of all."""
        self._need("admin")
        if tenant is None:
            path, fs = self._path("lexical")
            fs.delete(path, True)
        elif self.index().parts["segments"]:
            self.index().remove(self.table("chunks", tenant).select("tenant_id", F.col("chunk_id").alias("doc_id")))
        for name in SCHEMAS:
            if tenant is None:
                path, fs = self._path(name)
                fs.delete(path, True)
            else:
                self._drop_tenant(name, tenant)

    def record(self, log: DataFrame) -> None:
        log.withColumn("bucket", self._bucket("log")).write.mode("append").partitionBy("tenant_id", "bucket").parquet(f"{self.root}/log")

    # --- reading --------------------------------------------------------------------------------------

    def ask(self, questions: DataFrame, cached: bool = True, **models) -> DataFrame:
        """``questions``: tenant_id, query_id, text. See ``plans.ask``; ``origin`` says whether an answer came from the cache.

        Questions that look like an attack are not answered. An answer is kept until the organisation's corpus changes.
        """
        safe = questions.filter(~T.is_injection(F.col("text")))
        embedder = models.get("embedder", asking.embed)
        columns = ["tenant_id", "query_id", "route", "level", "answer", "confidence", "n_sources", "retried"]
        c = self.table("chunks").select("tenant_id", F.col("chunk_id").alias("doc_id"), "filename", "text")
        nodes, edges = self.table("nodes").drop("source_doc", "source_docs"), self.table("edges").drop("source_docs")
        models.setdefault("index", self.index())
        if not cached:
            return asking.ask(safe, c, nodes, edges, **models).select(*columns, F.lit("generation").alias("origin"))
        known = self.table("answers")
        asked = safe.select("tenant_id", "query_id", "text", embedder(F.col("text")).alias("embedding"))
        entries = known.select("tenant_id", F.col("query").alias("doc_id"), "embedding", F.col("query").alias("original_query"))
        hits = written(cache.lookup(entries, asked).filter("hit").select("tenant_id", "query_id", F.col("doc_id").alias("query")), "cache-hits")
        again = written(known.join(hits, ["tenant_id", "query"]).withColumn("retried", F.lit(False)).select(*columns, F.lit("cache").alias("origin")), "cache-answers")
        fresh = safe.join(hits.select("tenant_id", "query_id"), ["tenant_id", "query_id"], "left_anti")
        new = written(asking.ask(fresh, c, nodes, edges, **models).select(*columns), "new-answers")
        put = new.join(asked, ["tenant_id", "query_id"]).select("tenant_id", F.col("text").alias("query"), "embedding", "route", "level", "answer", "confidence", "n_sources", F.current_timestamp().alias("put_at"))
        keys = put.select("tenant_id", "query").distinct()
        old = self._touched("answers", keys).join(keys, ["tenant_id", "query"], "left_anti")
        once = put.groupBy("tenant_id", "query").agg(F.max(F.struct("put_at", "embedding", "route", "level", "answer", "confidence", "n_sources")).alias("a")).select("tenant_id", "query", "a.*")
        self._put("answers", old.unionByName(once))
        return again.unionByName(new.withColumn("origin", F.lit("generation")))

    def documents(self, tenant: str) -> DataFrame:
        return metrics.list_documents(self.table("chunks", tenant)).orderBy(F.lower("filename"))

    def app_config(self, tenant: str) -> dict[str, object]:
        n = self.table("chunks", tenant).agg(F.count(F.lit(1)), F.count_distinct("filename")).first()
        return {"tenant_id": tenant, "chunks": n[0], "documents": n[1], "nodes": self.table("nodes", tenant).count(), "is_empty": n[0] == 0}

    def graph_data(self, tenant: str, limit: int = 500) -> tuple[DataFrame, DataFrame]:
        """(nodes, links) for drawing; ``limit`` is at most 2,000."""
        n, e, limit = self.table("nodes", tenant), self.table("edges", tenant), max(1, min(limit, 2000))
        return graph.viz_nodes(n, e, limit), graph.viz_links(n, e, limit)

    def metrics(self, tenant: str, uptime_s: int = 0) -> DataFrame:
        chunks_ = self.table("chunks", tenant).agg(F.count(F.lit(1)).alias("n_chunks"))
        return metrics.kpis(self.table("log", tenant), graph.counts(self.table("nodes", tenant), self.table("edges", tenant)), chunks_, uptime_s=uptime_s)

    def suggestions(self, tenant: str) -> DataFrame:
        return cache.suggestions(self.table("chunks", tenant))


def graded(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """``cases``: query_id, kind, expected (array); ``answers``: query_id, answer, level. Whether each abstained and holds an expected text."""
    met = cases.join(answers, "query_id", "left")
    quiet = (F.coalesce("level", F.lit(V.D)) == V.D) | T.is_abstention(F.col("answer"))
    right = F.exists("expected", lambda e: F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower(e)))
    return met.select("query_id", "kind", quiet.alias("abstained"), (right & ~quiet).alias("correct"))
