"""Property graph as two tables: nodes(tenant_id, name, type, source_doc, source_docs) and
edges(tenant_id, src, rel_type, dst, source_docs). The tenant is part of every join key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions import vocab as V
from corvine.functions.text import basename
from corvine.operators.entities import clean_properties
from corvine.storage import broadcast_if_small, drop_shared, first_rows, written

KEY = ["tenant_id", "name"]
EDGE = ["tenant_id", "src", "rel_type", "dst"]


def hops_within(h: int) -> int:
    return max(1, min(int(h), 4))


# --- writing ----------------------------------------------------------------------------------------


def provenance(exists: Column, docs: Column, doc: Column, new: Column) -> Column:
    """Documents a row comes from after ``new`` wrote it; a row of unknown origin is marked as such."""
    empty = F.array().cast("array<string>")
    return (
        F.when(~exists, F.when(new.isNull(), empty).otherwise(F.array(new)))
        .when(new.isNull(), F.coalesce(docs, empty))
        .when(docs.isNotNull() & F.array_contains(docs, new), docs)
        .when(docs.isNotNull(), F.concat(docs, F.array(new)))
        .when(doc.isNotNull() & (doc != new), F.array(doc, new))
        .when(doc.isNotNull(), F.array(new))
        .otherwise(F.array(F.lit(V.UNKNOWN_ORIGIN), new))
    )


def merged_properties(old: DataFrame, new: DataFrame) -> list[Column]:
    """Column ``properties`` (map<string,string>) of an upsert of ``old`` (alias o) by ``new`` (alias n); none if neither has it.

    A key of the new row wins, other keys stay, and a row without properties changes nothing. Reserved keys and nulls are left out.
    """
    none = F.create_map().cast("map<string,string>")
    sides = [F.coalesce(f"{a}.properties", none) for a, df in (("o", old), ("n", new)) if "properties" in df.columns]
    if not sides:
        return []
    late = clean_properties(sides[-1]) if "properties" in new.columns else none
    early = F.map_filter(sides[0], lambda k, _: ~F.map_contains_key(late, k)) if "properties" in old.columns else none
    return [F.map_concat(early, late).alias("properties")]


def merge_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (tenant, name): ``new`` has name, type, source_doc. The new type wins, the first source_doc stays.

    Free ``properties`` of either side are merged key by key (``merged_properties``)."""
    o, n = nodes.withColumn("old", F.lit(True)).alias("o"), new.withColumn("hit", F.lit(True)).alias("n")
    both = o.join(n, (F.col("o.tenant_id") == F.col("n.tenant_id")) & (F.col("o.name") == F.col("n.name")), "full_outer")
    was, hit = F.col("old").isNotNull(), F.col("hit").isNotNull()
    docs = provenance(was, F.col("o.source_docs"), F.col("o.source_doc"), F.col("n.source_doc"))
    return both.select(
        F.coalesce("o.tenant_id", "n.tenant_id").alias("tenant_id"),
        F.coalesce("o.name", "n.name").alias("name"),
        F.when(hit, F.col("n.type")).otherwise(F.col("o.type")).alias("type"),
        F.coalesce("o.source_doc", "n.source_doc").alias("source_doc"),
        F.when(hit, docs).otherwise(F.col("o.source_docs")).alias("source_docs"),
        *merged_properties(nodes, new),
    )


def merge_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (tenant, src, type, dst): ``new`` has source_doc; documents accumulate, ``properties`` are merged key by key."""
    o, n = edges.withColumn("old", F.lit(True)).alias("o"), new.withColumn("hit", F.lit(True)).alias("n")
    both = o.join(n, reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in EDGE]), "full_outer")
    docs = provenance(F.col("old").isNotNull(), F.col("o.source_docs"), F.lit(None).cast("string"), F.col("n.source_doc"))
    return both.select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in EDGE], F.when(F.col("hit").isNotNull(), docs).otherwise(F.col("o.source_docs")).alias("source_docs"), *merged_properties(edges, new))


def implied_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets of edges that no node row names: they become nodes of unknown type."""
    ends = edges.select("tenant_id", F.col("dst").alias("name")).distinct()
    return ends.join(nodes, KEY, "left_anti").withColumn("type", F.lit("Entity"))


def targets_of(filename: str) -> Column:
    name = F.lit(filename.strip())
    return F.array_distinct(F.array(F.lower(name), F.lower(F.trim(basename(name)))))


def delete_document(nodes: DataFrame, edges: DataFrame, filename: str, tenant: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a document is gone: rows that only it supports go, shared ones forget it."""
    aim = targets_of(filename)

    def rest(docs: Column) -> Column:
        return F.filter(F.coalesce(docs, F.array().cast("array<string>")), lambda d: ~F.array_contains(aim, F.lower(d)))

    mine = F.col("tenant_id") == tenant
    from_doc = F.array_contains(aim, F.lower(F.coalesce("source_doc", F.lit(""))))
    touched = mine & (from_doc | F.exists(F.coalesce("source_docs", F.array().cast("array<string>")), lambda d: F.array_contains(aim, F.lower(d))))
    marked = nodes.withColumn("touched", touched).withColumn("rest", rest(F.col("source_docs")))
    dead = marked.filter(F.col("touched") & (F.size("rest") == 0)).select(*KEY)
    kept = marked.filter(~(F.col("touched") & (F.size("rest") == 0))).select(
        "tenant_id", "name", "type",
        F.when(F.col("touched") & from_doc, F.get("rest", F.lit(0))).otherwise(F.col("source_doc")).alias("source_doc"),
        F.when(F.col("touched"), F.col("rest")).otherwise(F.col("source_docs")).alias("source_docs"), *(["properties"] if "properties" in nodes.columns else []),
    )
    hit = mine & F.exists(F.coalesce("source_docs", F.array().cast("array<string>")), lambda d: F.array_contains(aim, F.lower(d)))
    e = edges.withColumn("hit", hit).withColumn("rest", rest(F.col("source_docs"))).filter(~(F.col("hit") & (F.size("rest") == 0)))
    e = e.join(dead.select("tenant_id", F.col("name").alias("src")), ["tenant_id", "src"], "left_anti").join(dead.select("tenant_id", F.col("name").alias("dst")), ["tenant_id", "dst"], "left_anti")
    free = ["properties"] if "properties" in edges.columns else []
    return kept, e.select(*EDGE, F.when(F.col("hit"), F.col("rest")).otherwise(F.col("source_docs")).alias("source_docs"), *free)


# --- counting ---------------------------------------------------------------------------------------


def supports(rows: DataFrame, key: list[str], files: DataFrame) -> DataFrame:
    """Key, ``left`` (documents that still support a row, in order) of the rows that one of ``files`` (tenant_id, filename) supports."""
    gone = files.select("tenant_id", F.lower("filename").alias("_doc")).distinct()
    none = F.array().cast("array<string>")
    first = F.when(F.col("source_doc").isNotNull(), F.array("source_doc")).otherwise(none) if "source_doc" in rows.columns else none
    each = rows.select(*key, F.posexplode(F.array_distinct(F.concat(F.coalesce("source_docs", none), first))).alias("_n", "_by")).withColumn("_doc", F.lower("_by"))
    marked = each.join(gone.withColumn("_gone", F.lit(True)), ["tenant_id", "_doc"], "left")
    one = F.when(F.col("_gone").isNull(), F.struct("_n", "_by"))
    by_key = marked.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("_left"), F.count("_gone").alias("_hits"))
    return by_key.filter("_hits > 0").select(*key, F.transform("_left", lambda x: x["_by"]).alias("left"))


def forget(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges once ``files`` (tenant_id, filename) are replaced: rows that only they support go, shared ones forget them.

    Edges of a node that goes, go with it. Rows without any provenance stay.
    """
    hit = supports(nodes, KEY, files)
    kept = nodes.join(hit, KEY, "left").filter(F.col("left").isNull() | (F.size("left") > 0))
    still = F.col("left").isNull() | F.col("source_doc").isNull() | F.array_contains("left", F.col("source_doc"))
    kept = kept.withColumn("source_doc", F.when(still, F.col("source_doc")).otherwise(F.get("left", F.lit(0)))).withColumn("source_docs", F.coalesce("left", "source_docs")).drop("left")
    dead = hit.filter(F.size("left") == 0).select(*KEY)
    whole = ["tenant_id", "src", "rel_type", "dst"]
    rest = edges.join(supports(edges, whole, files), whole, "left").filter(F.col("left").isNull() | (F.size("left") > 0))
    rest = rest.withColumn("source_docs", F.coalesce("left", "source_docs")).drop("left")
    for end in ("src", "dst"):
        rest = rest.join(dead.select("tenant_id", F.col("name").alias(end)), ["tenant_id", end], "left_anti")
    return kept.select(*nodes.columns), rest.select(*edges.columns)


def inner_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ends = nodes.select(*KEY)
    out = edges.join(ends.select("tenant_id", F.col("name").alias("src")), ["tenant_id", "src"], "left_semi")
    return out.join(ends.select("tenant_id", F.col("name").alias("dst")), ["tenant_id", "dst"], "left_semi")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = inner_edges(nodes, edges).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_edges"))
    out = n.join(e, "tenant_id", "left")
    return out.select("tenant_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"), (F.col("n_nodes") == 0).alias("is_empty"))


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = inner_edges(nodes, edges).groupBy("tenant_id", F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(*KEY, "type").join(e, KEY, "left").select(*KEY, "type", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def most_connected(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("degree"), "name"))
    return out_degree(nodes, edges).withColumn("rank", rank).filter(F.col("rank") <= limit)


def legend(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tenant_id", "type").agg(F.count(F.lit(1)).alias("n"))


# --- searching --------------------------------------------------------------------------------------


def expanded_terms(entities: DataFrame) -> DataFrame:
    """``entities``: tenant_id, query_id, entity. Each entity and its words of more than three characters."""
    whole = F.trim("entity")
    words = F.transform(F.split(whole, "\\s+"), lambda w: F.regexp_replace(w, "[^a-zA-Z0-9áéíóúÁÉÍÓÚñÑ]", ""))
    terms = F.array_distinct(F.concat(F.array(whole), F.filter(words, lambda w: F.length(w) > 3)))
    return entities.filter(F.length(whole) >= 2).select("tenant_id", "query_id", F.explode(terms).alias("term")).distinct()


#: Lengths of the runs of characters that texts are matched by; a text uses the longest that it holds.
GRAMS = (8, 3)


def grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; none of a shorter text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))


def hashed_grams(text: str, size: int) -> Column:
    """The runs of ``text`` as numbers, with the tenant in them."""
    return F.transform(grams(F.col(text), size), lambda g: F.xxhash64("tenant_id", g))


def candidates(long: DataFrame, short: DataFrame) -> DataFrame:
    """Pairs (tenant_id, long, short) that share the run of ``short`` that the fewest texts of ``long`` hold; texts shorter than any run are left out.

    Who holds a text holds all its runs, so the join may go by any of them: frequencies are counted first, and the rarest is taken. A run that
    all names begin with brings nobody together unless a text has no other. Runs and texts of ``long`` meet as numbers of 64 bits; equal numbers of
    unlike ones only add candidates.
    """
    wide, narrow = GRAMS
    each = long.select(F.xxhash64("tenant_id", "long").alias("_long"), F.explode(F.concat(hashed_grams("long", wide), hashed_grams("long", narrow))).alias("gram"))
    own = written(short.select("tenant_id", "short", F.explode(F.when(F.length("short") >= wide, hashed_grams("short", wide)).otherwise(hashed_grams("short", narrow))).alias("gram")), "grams-of-short")
    asked = own.select("gram").distinct()
    # what nobody asks for is neither kept nor dealt out twice
    each = written(each.join(asked, "gram", "left_semi"), "grams-of-long")
    counted = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a text one of whose runs nobody holds is held by nobody
    rarest = own.join(counted, "gram", "left").groupBy("tenant_id", "short").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    keys = rarest.filter("r.n > 0").select("tenant_id", "short", F.col("r.gram").alias("gram"))
    met = written(each.join(keys, "gram").select("tenant_id", "_long", "short"), "grams-met")
    texts = long.select("tenant_id", "long", F.xxhash64("tenant_id", "long").alias("_long"))
    return met.join(texts, ["tenant_id", "_long"]).select("tenant_id", "long", "short")


def holding(long: DataFrame, short: DataFrame) -> DataFrame:
    """Pairs (tenant_id, long, short) where the text of ``long`` holds that of ``short``; both have tenant_id and a distinct text column.

    Only texts shorter than any run of ``GRAMS`` meet all others of their tenant. Both tables are read several times, and are written first.
    """
    long, short = written(long.select("tenant_id", "long"), "holding-long"), written(short.select("tenant_id", "short"), "holding-short")
    met = candidates(long, short).filter(F.contains("long", F.col("short")))
    tiny = short.filter(F.length("short") < GRAMS[-1])
    if not tiny.limit(1).count():
        return met
    rest = long.join(tiny, "tenant_id").filter(F.contains("long", F.col("short"))).select("tenant_id", "long", "short")
    return met.unionByName(rest)


def seeds(nodes: DataFrame, terms: DataFrame, limit: int = 20) -> DataFrame:
    """Nodes whose name holds a term or is held by one, or whose type holds one.

    Distinct terms are matched, each keeps its first ``limit`` nodes (a query's first ones are among them), then
    queries meet the nodes of their terms.
    """
    terms = written(terms, "seed-terms")
    words = terms.select("tenant_id", F.lower("term").alias("word")).distinct()
    named = nodes.select(*KEY, "type", F.lower("name").alias("low")).distinct()
    names, word = named.select("tenant_id", "low").distinct(), words.select("tenant_id", F.col("word").alias("short"))
    inside = holding(names.withColumnRenamed("low", "long"), word).select("tenant_id", F.col("long").alias("low"), F.col("short").alias("word"))
    around = holding(words.withColumnRenamed("word", "long"), names.withColumnRenamed("low", "short")).select("tenant_id", F.col("short").alias("low"), F.col("long").alias("word"))
    by_name = named.join(inside.unionByName(around).distinct(), ["tenant_id", "low"]).select("tenant_id", "word", "name", "type")
    kinds = named.filter("type is not null").select("tenant_id", "type", F.lower("type").alias("kind"))
    typed = holding(kinds.select("tenant_id", F.col("kind").alias("long")).distinct(), word).select("tenant_id", F.col("long").alias("kind"), F.col("short").alias("word"))
    heads = first_rows(named.filter("type is not null").select(*KEY, "type", F.lower("type").alias("kind")), ["tenant_id", "kind"], [F.col("name"), F.col("type")], limit, "_k")
    by_type = heads.join(typed, ["tenant_id", "kind"]).select("tenant_id", "word", "name", "type")
    some = first_rows(by_name.unionByName(by_type).distinct(), ["tenant_id", "word"], [F.col("name"), F.col("type").asc_nulls_first()], limit, "_n").drop("_n")
    met = terms.select("tenant_id", "query_id", F.lower("term").alias("word")).join(some, ["tenant_id", "word"]).select("tenant_id", "query_id", "name", "type").distinct()
    rank = F.row_number().over(Window.partitionBy("tenant_id", "query_id").orderBy("name", F.col("type").asc_nulls_first()))
    return met.withColumn("rank", rank).filter(F.col("rank") <= limit)


def both_ways(edges: DataFrame) -> DataFrame:
    """tenant_id, at, rel_type, next, forward."""
    return edges.select("tenant_id", F.col("src").alias("at"), "rel_type", F.col("dst").alias("next"), F.lit(True).alias("forward")).unionByName(
        edges.select("tenant_id", F.col("dst").alias("at"), "rel_type", F.col("src").alias("next"), F.lit(False).alias("forward"))
    )


def first_step(starts: DataFrame) -> DataFrame:
    """Paths of no edge at ``starts`` (tenant_id, query_id, name)."""
    return starts.select("tenant_id", "query_id", F.col("name").alias("at"), F.array("name").alias("node_names"), F.array().cast("array<string>").alias("relationships"), F.array().cast("array<boolean>").alias("forward"))


def tail() -> Column:
    """What an edge adds to the print of a path."""
    return F.concat(F.lit(" -[:"), "rel_type", F.lit("]-> ("), "next", F.lit(")"))


def first_tails(edges: DataFrame, hops: int, trails: int) -> DataFrame:
    """``both_ways`` with as many edges of each node as the first ``trails`` paths can need, in the order in which paths are printed.

    A path extends by the smallest tails that do not lead back to one of its at most ``hops`` nodes. Of the edges to one neighbour ``trails`` are enough; of
    what is left at most ``trails`` lead to each node of a path, so ``trails * (hops + 1)`` are enough. A hub of a million edges is cut to that before anybody walks through it.
    """
    step = both_ways(edges).withColumn("_tail", tail())
    order = [F.col("_tail"), F.desc("forward")]
    some = first_rows(step, ["tenant_id", "at", "next"], order, trails, "_n").drop("_n")
    return first_rows(some, ["tenant_id", "at"], order, trails * (hops + 1), "_n").drop("_n", "_tail")


def longer(paths: DataFrame, step: DataFrame) -> DataFrame:
    """Every node-simple path one edge longer."""
    met = paths.join(step.withColumnRenamed("forward", "_forward"), ["tenant_id", "at"]).filter(~F.array_contains("node_names", F.col("next")))
    return met.select(
        "tenant_id", "query_id", F.col("next").alias("at"), F.concat("node_names", F.array("next")).alias("node_names"),
        F.concat("relationships", F.array("rel_type")).alias("relationships"), F.concat("forward", F.array("_forward")).alias("forward"),
    )


def path_string() -> Column:
    """(A) -[:R]-> (B) ..., always printed from left to right."""
    tail = F.zip_with(F.col("relationships"), F.slice("node_names", 2, F.size("relationships")), lambda r, n: F.concat(F.lit(" -[:"), r, F.lit("]-> ("), n, F.lit(")")))
    return F.concat(F.lit("("), F.get("node_names", F.lit(0)), F.lit(")"), F.array_join(tail, ""))


def formatted(paths: DataFrame, most: int = 15) -> DataFrame:
    """Distinct node-simple paths with at most one ALIAS_OF, shortest first."""
    ok = (F.size("node_names") >= 2) & (F.size(F.array_distinct("node_names")) == F.size("node_names")) & (F.size(F.filter("relationships", lambda r: r == "ALIAS_OF")) <= 1)
    out = paths.filter(ok).select("tenant_id", "query_id", path_string().alias("path_str"), F.size("relationships").alias("hop_count")).distinct()
    rank = F.row_number().over(Window.partitionBy("tenant_id", "query_id").orderBy("hop_count", "path_str"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= most)


def trails_of(edges: DataFrame, starts: DataFrame, hops: int, trails: int = 25) -> DataFrame:
    """The ``trails`` shortest node-simple paths of each query, equal lengths in the order of their print: tenant_id, query_id, node_names, relationships, forward
    (whether each edge is walked in its direction), path_str, hop_count.

    A level is cut to the first ``trails`` of a query before it is stored, and a query that has its trails goes no further; with fewer, all its paths are
    kept. Prints grow at their end, so the first paths of a level come from the first tails of each node (``first_tails``).
    """
    h = hops_within(hops)
    step, at, found = written(first_tails(edges, h, trails), "steps"), first_step(starts), []
    rank = F.row_number().over(Window.partitionBy("tenant_id", "query_id").orderBy("path_str", "forward"))
    for i in range(h):
        best = longer(at, step).withColumn("path_str", path_string()).withColumn("hop_count", F.size("relationships")).withColumn("r", rank).filter(F.col("r") <= trails).drop("r")
        best = written(best, "walks")
        found.append(best.drop("at"))
        if i + 1 < h:
            full = reduce(DataFrame.unionByName, found).groupBy("tenant_id", "query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= trails)
            at = best.join(full, ["tenant_id", "query_id"], "left_anti").drop("path_str", "hop_count")
    every = reduce(DataFrame.unionByName, found)
    last = F.row_number().over(Window.partitionBy("tenant_id", "query_id").orderBy("hop_count", "path_str", "forward"))
    return every.withColumn("r", last).filter(F.col("r") <= trails).drop("r")


def expand(edges: DataFrame, starts: DataFrame, hops: int, trails: int = 25, most: int = 15) -> DataFrame:
    """Contextual expansion: the ``trails`` shortest paths of each query, formatted."""
    return formatted(trails_of(edges, starts, hops, trails), most)


def path_graph(trails: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What paths (``trails_of``) show of the graph: (tenant_id, query_id, name, type) once per name, the smallest type of equal names first,
    and (tenant_id, query_id, src, rel_type, dst) with the direction that the edge has, whichever way it was walked."""
    names = trails.select("tenant_id", "query_id", F.explode("node_names").alias("name")).distinct()
    types = nodes.groupBy(*KEY).agg(F.min("type").alias("type"))
    places = F.transform(F.sequence(F.lit(0), F.size("relationships") - 1), lambda i: F.struct(F.get("node_names", i).alias("a"), F.get("relationships", i).alias("rel_type"), F.get("node_names", i + 1).alias("b"), F.get("forward", i).alias("forward")))
    each = trails.filter(F.size("relationships") > 0).select("tenant_id", "query_id", F.explode(places).alias("e"))
    ends = [F.when(F.col("e.forward"), F.col(f"e.{x}")).otherwise(F.col(f"e.{y}")) for x, y in ("ab", "ba")]
    return names.join(types, KEY, "left"), each.select("tenant_id", "query_id", ends[0].alias("src"), "e.rel_type", ends[1].alias("dst")).distinct()


def shortest_paths(edges: DataFrame, starts: DataFrame, hops: int, first: int = 4, each: int = 3) -> DataFrame:
    """Shortest paths between the first seeds of every query (``starts`` has rank), at most ``each`` per pair, the first in print.

    Both ends search level by level. A seed reaches a node once, on the level of its distance, and keeps there the first ``each`` prints of ways from it (as
    the beginning of a path) and to it (as its end): for a given rest of the path only those can be among the first. A path of length n has one
    node ceil(n / 2) steps from its first end, where both halves meet. Seeds whose pairs have all met search no further.
    """
    h = hops_within(hops)
    step = both_ways(edges)
    seed = ["tenant_id", "query_id", "seed"]
    some = starts.filter(F.col("rank") <= first).select("tenant_id", "query_id", F.col("name").alias("seed"), "rank")
    pairs = some.select("tenant_id", "query_id", F.col("seed").alias("a"), F.col("rank").alias("_a")).join(some.select("tenant_id", "query_id", F.col("seed").alias("b"), F.col("rank").alias("_b")), ["tenant_id", "query_id"]).filter("_a < _b")
    pairs = written(pairs.filter("a <> b").select("tenant_id", "query_id", "a", "b").distinct(), "path-pairs")
    zero = pairs.select("tenant_id", "query_id", F.col("a").alias("seed")).unionByName(pairs.select("tenant_id", "query_id", F.col("b").alias("seed"))).distinct()
    # a level: seed, at, prefix ("(seed) ... (at)") and suffix (what follows "(at)" on the way to the seed)
    level = written(zero.select(*seed, F.col("seed").alias("at"), F.concat(F.lit("("), "seed", F.lit(")")).alias("prefix"), F.lit("").alias("suffix")), "path-level")
    seen, left, found, halves = level.select(*seed, "at"), pairs, [], [level]

    def kept(rows: DataFrame, text: str) -> DataFrame:
        order = F.row_number().over(Window.partitionBy(*seed, "at").orderBy(text))
        return rows.select(*seed, "at", text).distinct().withColumn("_n", order).filter(F.col("_n") <= each)

    def prints(open_: DataFrame, up: DataFrame, down: DataFrame, n: int) -> DataFrame:
        """Paths of ``n`` edges of pairs that have none yet: ways from a to a node meet ways from it to b."""
        begin = up.filter("prefix is not null").select("tenant_id", "query_id", F.col("seed").alias("a"), "at", "prefix")
        end = down.filter("suffix is not null").select("tenant_id", "query_id", F.col("seed").alias("b"), "at", "suffix")
        both = open_.join(begin, ["tenant_id", "query_id", "a"]).join(end, ["tenant_id", "query_id", "b", "at"])
        return both.select("tenant_id", "query_id", "a", "b", F.concat("prefix", "suffix").alias("path_str"), F.lit(n).alias("hop_count")).distinct()

    pair = Window.partitionBy("tenant_id", "query_id", "a", "b")
    for i in range(1, (h + 1) // 2 + 1):
        # only seeds of pairs that have not met go on
        going = left.select("tenant_id", "query_id", F.col("a").alias("seed")).unionByName(left.select("tenant_id", "query_id", F.col("b").alias("seed"))).distinct()
        ahead = halves[-1].join(broadcast_if_small(going), seed, "left_semi").join(step, ["tenant_id", "at"]).withColumn("_from", F.col("at"))
        ahead = ahead.withColumn("prefix", F.concat("prefix", tail())).withColumn("suffix", F.concat(F.lit(" -[:"), "rel_type", F.lit("]-> ("), "_from", F.lit(")"), "suffix"))
        ahead = ahead.select(*seed, F.col("next").alias("at"), "prefix", "suffix").join(seen, [*seed, "at"], "left_anti")
        firsts = [kept(ahead.filter(F.col(text).isNotNull()), text) for text in ("prefix", "suffix")]
        halves.append(written(firsts[0].join(firsts[1], [*seed, "at", "_n"], "full_outer").drop("_n"), "path-level"))
        seen = seen.unionByName(halves[-1].select(*seed, "at").distinct())
        both = reduce(DataFrame.unionByName, [prints(left, halves[i], halves[n - i], n) for n in (2 * i - 1, 2 * i) if n <= h])
        best = both.withColumn("_least", F.min("hop_count").over(pair)).filter("hop_count = _least").withColumn("_n", F.row_number().over(pair.orderBy("path_str"))).filter(F.col("_n") <= each)
        found.append(written(best.drop("_n", "_least"), "paths"))
        if 2 * i < h:
            left = written(left.join(found[-1].select("tenant_id", "query_id", "a", "b").distinct(), ["tenant_id", "query_id", "a", "b"], "left_anti"), "path-pairs")
    return reduce(DataFrame.unionByName, found).select("tenant_id", "query_id", "a", "b", "path_str", "hop_count")


def central_paths(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """One-hop paths shown when no term is given."""
    rank = F.row_number().over(Window.partitionBy("tenant_id").orderBy("src", "rel_type", "dst"))
    e = inner_edges(nodes, edges).filter("src <> dst").withColumn("n", rank).filter(F.col("n") <= limit)
    return e.select("tenant_id", F.concat(F.lit("("), "src", F.lit(") -[:"), "rel_type", F.lit("]-> ("), "dst", F.lit(")")).alias("path_str"), "n")


# --- ranking and drawing --------------------------------------------------------------------------------


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, cut: int = 5) -> DataFrame:
    """Fixed rounds of unnormalised PageRank. Sums are combined before the shuffle; lineage is cut every ``cut`` rounds."""
    e = inner_edges(nodes, edges).select("tenant_id", "src", "dst")
    deg = e.groupBy("tenant_id", "src").agg(F.count(F.lit(1)).alias("deg"))
    links = written(e.join(deg, ["tenant_id", "src"]), "rank-links")
    every = nodes.select(*KEY).distinct()
    ranks, last = every.withColumn("rank", F.lit(1.0 - damping)), None
    for i in range(rounds):
        given = links.join(ranks.select("tenant_id", F.col("name").alias("src"), "rank"), ["tenant_id", "src"])
        got = given.groupBy("tenant_id", F.col("dst").alias("name")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        ranks = every.join(got, KEY, "left").select(*KEY, (F.lit(1.0 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if (i + 1) % cut == 0 and i + 1 < rounds:
            ranks = written(ranks, "ranks")
            if last is not None:
                drop_shared(nodes.sparkSession, last)
            last = ranks
    return ranks.select(*KEY, F.round("rank", 6).alias("pagerank"))


def rank_sizes(ranks: DataFrame) -> DataFrame:
    """Sizes 3 to 15 by the place of a PageRank between the organisation's smallest and largest."""
    ends = ranks.groupBy("tenant_id").agg(F.min("pagerank").alias("lo"), F.max("pagerank").alias("hi"))
    width = F.when(F.col("hi") != F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return ranks.join(F.broadcast(ends), "tenant_id").select(*KEY, F.round(3 + (F.col("pagerank") - F.col("lo")) / width * 12, 2).alias("size"))


def display_name(props: Column) -> Column:
    """The most telling of the free properties, at most 40 characters."""
    found = [F.when(props[k] != "", props[k]) for k in ("name", "nombre", "title", "id", "type")]
    return F.substring(F.coalesce(*found, F.lit("Nodo")), 1, 40)


def shown_properties(props: Column) -> Column:
    return F.transform_values(F.map_filter(props, lambda k, v: v.isNotNull()), lambda k, v: F.substring(v, 1, 100))


def central_graph(nodes: DataFrame, edges: DataFrame, limit: int = 40) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the first ``limit`` rows of nodes with their out-edges, shown when no term is given."""
    met = nodes.select(*KEY).join(inner_edges(nodes, edges).withColumnRenamed("src", "name"), KEY, "left")
    some = first_rows(met, ["tenant_id"], [F.col("name"), F.col("rel_type"), F.col("dst")], limit, "n")
    return some.select(*KEY).distinct(), some.filter("dst is not null").select("tenant_id", F.col("name").alias("src"), "rel_type", "dst").distinct()


def color(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in V.COLORS.items() for x in kv])
    return F.coalesce(table[kind], F.lit(V.DEFAULT_COLOR))


def viz_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> DataFrame:
    """First nodes by name with display name, colour and a size that grows with the degree."""
    rank = F.row_number().over(Window.partitionBy("tenant_id").orderBy("name"))
    some = nodes.withColumn("n", rank).filter(F.col("n") <= limit)
    out = edges.join(some.select("tenant_id", F.col("name").alias("src")), ["tenant_id", "src"], "left_semi")
    ends = out.select("tenant_id", F.col("src").alias("name")).unionByName(out.select("tenant_id", F.col("dst").alias("name")))
    deg = ends.groupBy(*KEY).agg(F.count(F.lit(1)).alias("degree"))
    top = deg.groupBy("tenant_id").agg(F.max("degree").alias("top"))
    met = some.join(deg, KEY, "left").join(F.broadcast(top), "tenant_id", "left")
    size = F.round(3 + F.coalesce("degree", F.lit(0)) / F.coalesce("top", F.lit(1)) * 10, 2)
    return met.select("tenant_id", F.col("name").alias("id"), F.substring("name", 1, 40).alias("label"), color(F.col("type")).alias("color"), size.alias("size"))


def viz_links(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("tenant_id").orderBy("name"))
    return inner_edges(nodes.withColumn("n", rank).filter(F.col("n") <= limit), edges).select("tenant_id", F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel_type").alias("type"))


def all_names(nodes: DataFrame, least: int = 0) -> DataFrame:
    """Distinct lower-case names of ``least`` characters or more, however many."""
    return nodes.select("tenant_id", F.lower(F.trim("name")).alias("name")).filter(F.length("name") >= least).distinct()


def catalogue(nodes: DataFrame, limit: int = 10_000) -> DataFrame:
    """The ``limit`` longest distinct lower-case names of two characters or more. Only ``router_catalogue`` shows it; names are looked for among ``all_names``."""
    return first_rows(all_names(nodes, 2), ["tenant_id"], [F.desc(F.length("name")), F.col("name")], limit, "n")


def lookup(nodes: DataFrame, questions: DataFrame, limit: int = 15) -> DataFrame:
    """Names that hold a significant word of the question."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zA-Z0-9áéíóúÁÉÍÓÚñÑüÜ]{3,}"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in V.LOOKUP_STOP])
    asked = questions.select("tenant_id", "query_id", F.explode(F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stop, w)))).alias("word"))
    names = nodes.select("tenant_id", F.lower(F.trim("name")).alias("long")).distinct()
    met = holding(names, asked.select("tenant_id", F.col("word").alias("short")).distinct()).select("tenant_id", F.col("short").alias("word"), F.col("long").alias("name"))
    some = first_rows(met.distinct(), ["tenant_id", "word"], [F.col("name")], limit, "_n").drop("_n")
    once = asked.join(some, ["tenant_id", "word"]).select("tenant_id", "query_id", "name").distinct()
    rank = F.row_number().over(Window.partitionBy("tenant_id", "query_id").orderBy("name"))
    return once.withColumn("n", rank).filter(F.col("n") <= limit)
