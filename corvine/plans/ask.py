"""Questions to answers in batch: guard, route, retrieve, rerank or not, grade, answer, audit, retry.

The answer cache stands before this in ``engine.Engine.ask``. Questions about the whole corpus, and those that nothing was found for, also get the
first chunk of each file.

Every stage is a table keyed by (tenant, question); a stage that costs more sees only the questions that
need it. Model calls are column functions that a caller may replace; the defaults are deterministic.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions import vocab as V
from corvine.functions.text import exact_identifiers, is_injection, redact, tokens
from corvine.operators import fusion, graph, lexical, lexindex, vector
from corvine.plans import decide
from corvine.storage import shared_dir, written

KEY = ["tenant_id", "query_id"]
NOTHING = "No consta en la documentación disponible."


def embed(text: Column) -> Column:
    return vector.hashed_embedding(tokens(text))


def extractive(question: Column, passage: Column) -> Column:
    """Default generator: the best passage's first 300 characters."""
    return F.when(passage.isNull(), NOTHING).otherwise(F.concat(F.lit(decide.LEAD), F.substring(passage, 1, 300)))


def entities_of(questions: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Names of the catalogue and identifiers that a question holds, each once; where it holds none, its words of more than three characters."""
    return plain_words(questions) if catalogue is None else entities_among(questions, decide.mentions(questions, catalogue))


def plain_words(questions: DataFrame) -> DataFrame:
    words = F.filter(tokens(F.col("text")), lambda t: F.length(t) > 3)
    return questions.select(*KEY, F.explode(F.array_distinct(words)).alias("entity"))


def entities_among(questions: DataFrame, mentions: DataFrame) -> DataFrame:
    """``entities_of`` by ``mentions`` (tenant_id, query_id, name) that are known already, of these questions and of others."""
    named = mentions.join(questions.select(*KEY), KEY, "left_semi").select(*KEY, F.col("name").alias("entity"))
    known = written(named.unionByName(questions.select(*KEY, F.explode(F.transform(exact_identifiers(F.col("text")), F.lower)).alias("entity"))).distinct(), "known-entities")
    return known.unionByName(plain_words(questions).join(known.select(*KEY).distinct(), KEY, "left_anti"))


def follow_ups(questions: DataFrame) -> DataFrame:
    """The phrasings of a second attempt: the question (ordinal 0) and its two follow-up questions."""
    ways = [F.col("text"), *[F.concat("text", F.lit(f" {w}")) for w in V.FOLLOW_UPS]]
    return questions.select(*KEY, F.posexplode(F.array(*ways)).alias("ordinal", "text"))


def ask(
    questions: DataFrame,
    chunks: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    scorer: Callable[[Column, Column], Column] = fusion.lexical_score,
    generator: Callable[[Column, Column], Column] = extractive,
    embedder: Callable[[Column], Column] = embed,
    judge: Callable[[Column, Column, Column], Column] = decide.judge,
    local_model: bool = True,
    index: lexindex.Index | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """tenant_id, query_id, route, level, answer, confidence, n_sources, retried, notes, unsupported. ``notes`` names what the plan did with a question: ``guard:`` and the
    rule that let it take the fast path or made it leave it, ``degree_fallback`` where the best connected nodes stood in for seeds, ``follow_ups`` where two more questions were asked. ``local_model``: reranking is cheap, so it is never passed over for
    exact identifiers or dominant candidates.

    Answers of the fast path get the cheap audit. All others go before ``judge`` (question, answer, passages; see ``decide.judge``) with the best passages of the question; ``unsupported`` holds the
    claims that no passage supports, redacted as the answer is. Questions of level D have no answer that could be judged.

    ``index`` and ``vectors`` (tenant_id, doc_id, embedding) are the kept index and embeddings of the chunks; without them they are made for this call. ``questions``: tenant_id, query_id, text; ``chunks``: tenant_id, doc_id, filename, text; ``nodes`` and ``edges`` as in the graph operators.
    """
    safe = questions.filter(~is_injection(F.col("text")))
    # every name is looked for, once: both attempts take their entities from here
    named = written(decide.mentions(safe, graph.all_names(nodes, 2)), "ask-mentions")
    routed = written(safe.join(decide.routed(safe, named), KEY), "ask-routes")
    if index is None:
        index = lexindex.Index.build(chunks, f"{shared_dir(chunks.sparkSession)}/corvine/ask-index-{uuid.uuid4().hex}")
    if vectors is None:
        vectors = written(chunks.select("tenant_id", "doc_id", embedder(F.col("text")).alias("embedding")), "ask-vectors")
    central = graph.most_connected(nodes, edges, 15).select("tenant_id", "name", "type")

    def near(asked: DataFrame) -> DataFrame:
        return vector.top_k(vectors, asked.select(*KEY, embedder(F.col("text")).alias("embedding")), 15)

    def hits_of(asked: DataFrame, again: bool) -> tuple[DataFrame, DataFrame]:
        """Lexical and vector hits; a second attempt asks the follow-up questions, too."""
        if not again:
            return written(index.search(asked, 15), "ask-lexical"), written(near(asked), "ask-near")
        ways = follow_ups(asked)
        each = near(ways.select("tenant_id", F.struct("query_id", "ordinal").alias("query_id"), "text"))
        each = each.select("tenant_id", F.col("query_id.query_id").alias("query_id"), F.col("query_id.ordinal").alias("ordinal"), "doc_id", "similarity", "vector_rank")
        return written(lexical.multi(ways, lambda q: index.search(q, 15)), "ask-lexical"), written(vector.multi(each), "ask-near")

    def guarded(asked: DataFrame, lex: DataFrame, vec: DataFrame) -> DataFrame:
        """Questions of the fast path whose hits do not suffice take the hybrid path."""
        fast = asked.filter("route = 'FAST_PATH'")
        said = decide.fast_path_guard(fast.select(*KEY, "text"), lex, vec, chunks)
        met = asked.join(said, KEY, "left")
        up = F.coalesce(~F.col("sufficient"), F.lit(False))
        return met.withColumn("route", F.when(up, "HYBRID_PATH").otherwise(F.col("route"))).withColumn("needs_graph", F.col("needs_graph") | up).withColumn("notes", F.concat(F.lit("guard:"), "verdict")).drop("verdict", "sufficient")

    heads = fusion.overview(chunks.withColumn("ordinal", F.col("doc_id"))).select("tenant_id", "doc_id", "similarity", "position")

    def passages(asked: DataFrame, lex: DataFrame, vec: DataFrame, k: int) -> DataFrame:
        fused = written(fusion.rrf(vec, lex), "ask-fused")
        decided = fusion.rerank_decision(fused, asked, local_model)
        ranked = fusion.rerank(fused.join(decided.filter("should_rerank"), KEY, "left_semi"), asked, chunks, top=k, scorer=scorer).withColumn("rerank_rationale", F.lit("model"))
        kept = fusion.bypassed(fused.join(decided.filter("not should_rerank").select(*KEY, "reason"), KEY), F.col("reason"), k)
        found = fused.select(*KEY, "doc_id", "vector_score", "bm25_score", F.col("vector_score").alias("similarity"))
        best = found.join(ranked.unionByName(kept), [*KEY, "doc_id"])
        wide = asked.filter("is_global").select(*KEY).unionByName(asked.join(fused, KEY, "left_anti").select(*KEY)).distinct()
        more = wide.join(heads, "tenant_id").join(fused, [*KEY, "doc_id"], "left_anti")
        more = more.select(
            *KEY, "doc_id", F.lit(0.0).alias("vector_score"), F.lit(0.0).alias("bm25_score"), "similarity", F.lit(None).cast("double").alias("reranker_score"),
            (F.col("position") + k).alias("reranker_rank"), F.lit("Bypass: corpus_overview").alias("rerank_rationale"),
        )
        return best.unionByName(more)

    def facts(asked: DataFrame, hops: int) -> DataFrame:
        need = asked.filter("needs_graph")
        found = written(graph.seeds(nodes, graph.expanded_terms(written(entities_among(need, named), "ask-entities"))), "ask-seeds").select(*KEY, "name", "type").withColumn("note", F.lit(None).cast("string"))
        # questions about everything that name nothing in the graph get its best connected nodes
        wide = need.filter("is_global").select(*KEY).join(found, KEY, "left_anti").join(central, "tenant_id").withColumn("note", F.lit("degree_fallback"))
        found = written(found.unionByName(wide), "ask-seeds")
        paths = graph.expand(edges, found.select("tenant_id", "query_id", "name"), hops)
        n = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_nodes"), F.max("note").alias("note"))
        return n.join(paths.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_paths")), KEY, "left")

    def attempt(asked: DataFrame, k: int, hops: int, iteration: int) -> DataFrame:
        lex, vec = hits_of(asked, iteration > 0)
        asked = written(guarded(asked, lex, vec) if iteration == 0 else asked.withColumn("notes", F.lit("follow_ups")), "ask-asked")
        hits = written(passages(asked, lex, vec, k), "ask-hits")
        known = written(facts(asked, hops), "ask-facts")
        levels = decide.evidence(asked, hits, known).select(*KEY, "level", "n_passages", "rerank").join(known.select(*KEY, "note"), KEY, "left")
        first = F.row_number().over(Window.partitionBy(*KEY).orderBy("reranker_rank"))
        best = hits.withColumn("_n", first).filter(F.col("_n") <= decide.JUDGED_PASSAGES).select(*KEY, "doc_id", "_n").join(chunks.select("tenant_id", "doc_id", "text"), ["tenant_id", "doc_id"])
        read = F.array_sort(F.collect_list(F.struct("_n", F.substring("text", 1, decide.JUDGED_CHARS).alias("text"))))
        top = best.groupBy(*KEY).agg(F.max(F.when(F.col("_n") == 1, F.col("text"))).alias("passage"), F.transform(read, lambda x: x["text"]).alias("passages"))
        met = asked.join(levels, KEY, "left").join(top, KEY, "left")
        answer = F.when(F.coalesce("level", F.lit(V.D)) == V.D, NOTHING).otherwise(generator(F.col("text"), F.col("passage")))
        met = met.withColumn("said", answer)
        # level D has nothing to judge
        heard = F.when(F.coalesce("level", F.lit(V.D)) != V.D, F.coalesce("passages", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
        full = written(met.withColumn("answer", redact(F.col("said"))).withColumn("verdict", judge(F.col("text"), F.col("said"), heard)).drop("passage", "passages", "said"), "ask-judged")
        grounding, confidence, _ = decide.fast_audit(F.coalesce("n_passages", F.lit(0)), F.col("answer"))
        level, fast = F.coalesce("level", F.lit(V.D)), F.col("route") == "FAST_PATH"
        held = decide.judged_audit(F.col("verdict"), level, F.col("answer"))
        quick = F.round(confidence * F.least(F.lit(1.0), F.greatest(F.coalesce("rerank", F.lit(0.0)), F.lit(0.0))), 2)
        none = F.array().cast("array<string>")
        checked = full.select("*", F.when(fast, quick).otherwise(held["confidence"]).alias("confidence"), F.when(fast, grounding >= 0.7).otherwise(held["is_faithful"]).alias("faithful"), F.when(fast, none).otherwise(F.transform(held["unsupported"], redact)).alias("unsupported"))
        step = decide.retry(level, F.col("faithful") & (F.col("confidence") >= 0.45), F.lit(iteration), F.col("confidence"))
        return checked.select(
            *KEY, "text", "route", "is_global", "needs_graph", decide.final_level(level, F.col("answer")).alias("level"), "answer", decide.final_confidence(level, F.col("answer"), F.col("confidence")).alias("confidence"),
            F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_sources"), step.alias("next"), F.lit(iteration > 0).alias("retried"), F.concat_ws(",", "notes", "note").alias("notes"), "unsupported",
        )

    one = written(attempt(routed, 5, 2, 0), "ask-first")
    again = one.filter("next = 'refine'").select(*KEY, "text", "route", "is_global", "needs_graph")
    columns = [*KEY, "route", "level", "answer", "confidence", "n_sources", "retried", "notes", "unsupported"]
    if not again.limit(1).count():  # no question is tried again
        return one.select(*columns)
    two = attempt(again, 8, 3, 1)
    return one.filter("next <> 'refine'").select(*columns).unionByName(two.select(*columns))


def context_text(nodes: DataFrame, most: int = 15) -> DataFrame:
    """The graph part of a prompt: at most ``most`` named nodes per question, one line each."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("name"))
    some = nodes.withColumn("_n", rank).filter(F.col("_n") <= most)
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit(")"))
    return some.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("context"))
