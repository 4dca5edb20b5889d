"""Decision rules: routing, evidence, audit and retry as ordered CASE expressions over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions import vocab as V
from corvine.functions.text import any_in, exact_identifiers, is_abstention, tokens
from corvine.operators.fusion import lexical_score
from corvine.operators.graph import holding
from corvine.storage import broadcast_if_small, written


def signals(questions: DataFrame) -> DataFrame:
    """``questions`` with ids, relational, global and factual signals."""
    q = F.trim(F.lower("text"))
    factual = reduce(lambda a, b: a | b, [q.rlike("(?U)\\b" + p + "\\b") for p in V.FACTUAL])
    return questions.select("*", exact_identifiers(F.col("text")).alias("detected_ids"), any_in(V.RELATIONAL, q).alias("is_relational"), any_in(V.GLOBAL, q).alias("is_global"), factual.alias("is_factual"))


def mentions(questions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue names inside a question, without those that a longer mentioned name contains."""
    q = questions.select("tenant_id", "query_id", F.trim(F.lower("text")).alias("q"))
    held = holding(q.select("tenant_id", F.col("q").alias("long")).distinct(), catalogue.select("tenant_id", F.col("name").alias("short")).distinct())
    met = written(q.join(held.select("tenant_id", F.col("long").alias("q"), F.col("short").alias("name")), ["tenant_id", "q"]).select("tenant_id", "query_id", "name"), "mentioned")
    other = met.select("tenant_id", "query_id", F.col("name").alias("longer"))
    inside = met.join(other, ["tenant_id", "query_id"]).filter(F.contains("longer", F.col("name")) & (F.length("longer") > F.length("name")))
    return met.join(inside.select("tenant_id", "query_id", "name").distinct(), ["tenant_id", "query_id", "name"], "left_anti")


def route(questions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The routes of questions by the names of ``catalogue`` that they hold; see ``routed``."""
    return routed(questions, mentions(questions, catalogue))


def routed(questions: DataFrame, named: DataFrame) -> DataFrame:
    """tenant_id, query_id, route, is_global, hops, needs_graph, n_ids, n_entities; ``named`` are the ``mentions`` of the questions."""
    found = named.groupBy("tenant_id", "query_id").agg(F.count(F.lit(1)).alias("n_entities"))
    s = signals(questions).join(found, ["tenant_id", "query_id"], "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)).cast("long"))
    n, ids = F.col("n_entities"), F.size("detected_ids")
    full, fast, mixed = F.lit("FULL_GRAPH_RAG"), F.lit("FAST_PATH"), F.lit("HYBRID_PATH")
    path = F.when(F.col("is_global"), full).when(F.col("is_relational") | (n >= 3), full).when((ids > 0) & (n <= 1), fast).when(F.col("is_factual") & (n <= 1), fast).otherwise(mixed)
    hops = F.when(F.col("is_global"), 2).when(path == full, F.when(n <= 3, 2).otherwise(3)).when(path == fast, 0).otherwise(1)
    return s.select("tenant_id", "query_id", path.alias("route"), "is_global", hops.alias("hops"), (path != fast).alias("needs_graph"), ids.cast("long").alias("n_ids"), "n_entities")


def fast_path_guard(questions: DataFrame, bm25: DataFrame, vector: DataFrame, texts: DataFrame) -> DataFrame:
    """Whether lexical and vector hits of a question suffice: the verdict names the rule."""
    key = ["tenant_id", "query_id"]
    b = bm25.groupBy(*key).agg(
        F.max(F.when(F.col("bm25_rank") == 1, F.col("doc_id"))).alias("b_doc"), F.max(F.when(F.col("bm25_rank") == 1, F.col("bm25_score"))).alias("b1"), F.max(F.when(F.col("bm25_rank") == 2, F.col("bm25_score"))).alias("b2")
    )
    v = vector.groupBy(*key).agg(F.max(F.when(F.col("vector_rank") == 1, F.col("doc_id"))).alias("v_doc"), F.max(F.when(F.col("vector_rank") == 1, F.col("similarity"))).alias("v1"))
    b = written(b, "guard-lexical")
    tops = texts.select("tenant_id", F.col("doc_id").alias("b_doc"), F.lower("text").alias("top_text")).join(broadcast_if_small(b.select("tenant_id", "b_doc").distinct()), ["tenant_id", "b_doc"], "left_semi")
    met = questions.join(b, key, "left").join(v, key, "left").join(tops, ["tenant_id", "b_doc"], "left")
    gap = F.when(F.col("b2").isNotNull(), F.col("b1") / F.greatest("b2", F.lit(0.001))).otherwise(2.0)
    sim, score = F.coalesce("v1", F.lit(0.0)), F.coalesce("b1", F.lit(0.0))
    named = F.exists(exact_identifiers(F.col("text")), lambda i: F.contains(F.coalesce("top_text", F.lit("")), F.lower(i)))
    verdict = (
        F.when(F.col("b_doc").isNull() & F.col("v_doc").isNull(), "NO_CANDIDATES")
        .when(named, "IDENTIFIER")
        .when((F.col("b_doc") == F.col("v_doc")) & (sim >= 0.70), "CONSENSUS")
        .when((sim >= 0.72) & (gap >= 1.35), "VECTOR")
        .when((score >= 4.5) & (gap >= 1.5), "LEXICAL")
        .otherwise("ESCALATE")
    )
    return met.select(*key, verdict.alias("verdict"), (~verdict.isin("NO_CANDIDATES", "ESCALATE")).alias("sufficient"))


def best_scores(passages: DataFrame) -> DataFrame:
    """Best score per channel; a reranker score counts only where a model gave it (-1: none did)."""
    real = ~F.coalesce(F.col("rerank_rationale"), F.lit("")).rlike("^(Bypass|Fallback)")
    vector = F.coalesce(F.when(F.col("vector_score") != 0, F.col("vector_score")), F.col("similarity"), F.lit(0.0))
    return passages.groupBy("tenant_id", "query_id").agg(
        F.coalesce(F.max(F.when(real, F.coalesce("reranker_score", F.lit(0.0)))), F.lit(-1.0)).alias("rerank"),
        F.max(F.coalesce("bm25_score", F.lit(0.0))).alias("bm25"),
        F.max(vector).alias("vector"),
        F.count(F.lit(1)).alias("n_passages"),
    )


def level(rerank: Column, bm25: Column, vector: Column, n_passages: Column, n_nodes: Column, n_paths: Column) -> Column:
    """Evidence level A to D. The reranker rules where it ran; lexical and vector scores otherwise."""
    ran, none = rerank >= 0, n_paths == 0
    nothing = F.when(ran, (rerank < V.GRAY_RERANK) & none).otherwise((bm25 < 1.0) & (vector < V.WEAK_VECTOR) & none)
    gray = ran & (rerank >= V.GRAY_RERANK) & (rerank < V.WEAK_RERANK) & none
    strong = (rerank >= V.STRONG_RERANK) | (bm25 >= V.STRONG_BM25) | (vector >= V.STRONG_VECTOR) | (~ran & (n_paths >= 2))
    return F.when((n_passages == 0) & (n_nodes == 0), V.D).when(nothing, V.D).when(gray, V.C).when(strong, V.A).otherwise(V.B_LEVEL)


def evidence(questions: DataFrame, passages: DataFrame, graph: DataFrame) -> DataFrame:
    """``graph``: tenant_id, query_id, n_nodes, n_paths. One level per question."""
    key = ["tenant_id", "query_id"]
    met = questions.select(*key).join(best_scores(passages), key, "left").join(graph, key, "left")
    filled = met.select(*key, F.coalesce("rerank", F.lit(-1.0)).alias("rerank"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("vector", F.lit(0.0)).alias("vector"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_passages", "n_nodes", "n_paths")])
    return filled.withColumn("level", level(*[F.col(c) for c in ("rerank", "bm25", "vector", "n_passages", "n_nodes", "n_paths")]))


def depth(route_: Column, retry: Column) -> tuple[Column, Column]:
    """(passages, hops) to retrieve: deeper for the full route and again when retried."""
    full = route_ == "FULL_GRAPH_RAG"
    return F.when(full & retry, 8).otherwise(5), F.when(full & retry, 3).when(full, 2).otherwise(1)


def fast_audit(n_passages: Column, response: Column) -> tuple[Column, Column, Column]:
    """(grounding, confidence, level) of an answer on the fast path."""
    quiet = is_abstention(response)
    share = F.round(F.least(F.lit(1.0), n_passages / 3), 2)
    grounding = F.when(n_passages == 0, 0.0).when(quiet, 1.0).otherwise(share)
    confidence = F.when((n_passages == 0) | quiet, 0.0).otherwise(F.round(0.85 + 0.15 * share, 2))
    return grounding, confidence, F.when((n_passages == 0) | quiet, V.D).otherwise(V.A)


def audit(faithfulness: Column, relevancy: Column, n_grounded: Column, n_claims: Column, n_unsupported: Column, given: Column, response: Column) -> dict[str, Column]:
    """Arithmetic over a judge's scores: confidence collapses when a claim is unsupported."""
    f, r = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in (faithfulness, relevancy))
    g = F.when(n_claims > 0, F.round(n_grounded / n_claims, 2)).otherwise(0.0)
    known = F.when(given.isin(V.A, V.B_LEVEL, V.C, V.D), given).otherwise(V.B_LEVEL)
    quiet = (known == V.D) & is_abstention(response)
    weak = (f < 0.5) | (n_unsupported > 0)
    return {
        "level": known,
        "grounding_ratio": g,
        "confidence": F.when(quiet, 0.0).when(weak, F.round(f * F.least(r, g), 2)).otherwise(F.round(g * (0.60 * f + 0.40 * r), 2)),
        "is_faithful": F.when(quiet, True).when(weak, False).otherwise((f >= 0.7) & (g >= 0.7)),
    }


#: How the default generator begins an answer; it is no claim.
LEAD = "Según la documentación: "
#: What a judge gets to read of a question: this many passages, this much of each.
JUDGED_PASSAGES, JUDGED_CHARS = 8, 900
#: Runs of so many tokens are looked for in a passage, and so large a share of a claim's must be there.
CLAIM_RUN, CLAIM_SHARE = 3, 0.8


def grounded(claim: Column, passages: Column) -> Column:
    """Whether a passage contains the claim, or most of its runs of ``CLAIM_RUN`` tokens (all tokens of a shorter claim)."""
    runs = lambda t: F.when(F.size(t) >= CLAIM_RUN, F.transform(F.sequence(F.lit(1), F.size(t) - (CLAIM_RUN - 1)), lambda i: F.concat_ws(" ", F.slice(t, i, CLAIM_RUN)))).otherwise(F.array(F.concat_ws(" ", t)))
    padded = lambda text: F.concat(F.lit(" "), text, F.lit(" "))
    # one-element array: the runs of the claim are cut once, not once per passage
    own = F.filter(F.array(tokens(claim)), lambda t: F.size(t) > 0)
    found = lambda p, r: F.size(F.filter(r, lambda x: F.contains(padded(F.concat_ws(" ", tokens(p))), padded(x)))) >= CLAIM_SHARE * F.size(r)
    return F.exists(passages, lambda p: F.contains(p, F.trim(claim)) | F.exists(own, lambda t: found(p, runs(t))))


def claims(answer: Column, passages: Column) -> Column:
    """Sentences of the answer, each with whether a passage supports it."""
    parts = F.filter(F.split(F.replace(answer, F.lit(LEAD), F.lit("")), r"(?<=[.?!])\s+"), lambda s: F.length(F.trim(s)) > 0)
    return F.transform(parts, lambda s: F.struct(s.alias("claim_text"), F.coalesce(grounded(s, passages), F.lit(False)).alias("is_grounded")))


def unsupported(claims_: Column, told: Column) -> Column:
    """Claims told to be unsupported and those found ungrounded, each once."""
    return F.array_union(F.coalesce(told, F.array().cast("array<string>")), F.transform(F.filter(claims_, lambda c: ~c["is_grounded"]), lambda c: c["claim_text"]))


def judge(question: Column, answer: Column, passages: Column) -> Column:
    """Default judge: faithfulness is the share of claims that a passage supports, relevancy that of the question's tokens in the answer.

    Any judge gives a struct of faithfulness, relevancy, claims (claim_text, is_grounded) and the claims that it calls unsupported.
    An abstention claims nothing; it is faithful and not relevant.
    """
    quiet = is_abstention(answer) | (F.size(passages) == 0)
    found = F.when(quiet, F.array().cast("array<struct<claim_text: string, is_grounded: boolean>>")).otherwise(claims(answer, passages))
    once = F.transform(F.array(found), lambda c: F.struct(
        F.when(F.size(c) == 0, 1.0).otherwise(F.size(F.filter(c, lambda x: x["is_grounded"])) / F.size(c)).alias("faithfulness"),
        F.when(quiet, 0.0).otherwise(lexical_score(question, answer)).alias("relevancy"), c.alias("claims"), F.array().cast("array<string>").alias("unsupported"),
    ))
    return F.element_at(once, 1)


def judged_audit(verdict: Column, given: Column, response: Column) -> dict[str, Column]:
    """``audit`` of what a judge said, with the ``unsupported`` claims."""
    bad = unsupported(verdict["claims"], verdict["unsupported"])
    n = F.size(F.filter(verdict["claims"], lambda c: c["is_grounded"]))
    return audit(verdict["faithfulness"], verdict["relevancy"], n, F.size(verdict["claims"]), F.size(bad), given, response) | {"unsupported": bad}


def retry(level_: Column, faithful: Column, iteration: Column, confidence: Column) -> Column:
    return F.when(level_.isin(V.D, V.C), "end").when(faithful | (iteration >= 1), "end").when(confidence >= 0.45, "end").otherwise("refine")


def final_level(level_: Column, response: Column) -> Column:
    return F.when((level_ == V.A) & is_abstention(response), V.C).otherwise(level_)


def final_confidence(level_: Column, response: Column, confidence: Column) -> Column:
    return F.when((level_ == V.A) & is_abstention(response), F.least(confidence, F.lit(0.5))).otherwise(confidence)


def display_level(level_: Column, confidence: Column) -> Column:
    return F.when(level_.isNull(), V.D).when((level_ == V.A) & (confidence < 0.6), V.B_LEVEL).otherwise(level_)


def ingest_warning(n_entities: Column, n_ingested: Column) -> Column:
    return F.when(n_entities == 0, "no entities found").when(n_ingested == 0, "entities found but none stored")


def role_allows(role: str, needed: str) -> bool:
    return V.ROLES.index(role) >= V.ROLES.index(needed)


def evaluation(results: DataFrame) -> DataFrame:
    """``results``: kind (answerable or not), abstained, correct, seconds. Counts and latencies of an evaluation run."""
    yes = F.col("kind") == "answerable"
    return results.groupBy("run").agg(
        F.sum(yes.cast("long")).alias("answerable"),
        F.sum((yes & ~F.col("abstained")).cast("long")).alias("answered"),
        F.sum((yes & F.col("correct")).cast("long")).alias("right"),
        F.sum((~yes).cast("long")).alias("unanswerable"),
        F.sum((~yes & F.col("abstained")).cast("long")).alias("abstained_right"),
        F.sum((~yes & ~F.col("abstained")).cast("long")).alias("invented"),
        F.expr("-percentile_disc(0.5) WITHIN GROUP (ORDER BY -seconds)").alias("median_s"),  # the upper one of two
        F.min("seconds").alias("min_s"),
        F.max("seconds").alias("max_s"),
    )
