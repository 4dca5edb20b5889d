"""Substring joins and path searches: the rows of plain loops, and how many rows they make on the way."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corvine.operators import entities, graph


def frame(spark, texts, name):
    return spark.createDataFrame([("t", x) for x in texts], f"tenant_id string, {name} string")


def test_common_beginnings_bring_nobody_together(spark):
    codes = spark.range(3000).select(F.lit("t").alias("tenant_id"), F.format_string("contract-2023-%04d", F.col("id").cast("int")).alias("long"))
    pairs = graph.candidates(codes, codes.withColumnRenamed("long", "short"))
    assert pairs.count() <= 4 * 3000
    assert graph.holding(codes, codes.withColumnRenamed("long", "short")).count() == 3000


def test_holding_equals_a_plain_loop(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcñ ") for _ in range(n))
    long = sorted({word(rnd.randint(0, 40)) for _ in range(80)})
    short = sorted({word(rnd.randint(1, 12)) for _ in range(80)} | {x[3:14] for x in long} | set(long[:9]))
    got = {(r.long, r.short) for r in graph.holding(frame(spark, long, "long"), frame(spark, short, "short")).collect()}
    assert got == {(x, y) for x in long for y in short if y and y in x} | {(x, "") for x in long if "" in short}


def random_graph(seed, n=14, m=34):
    rnd = random.Random(seed)
    edges = sorted({("t", f"n{rnd.randrange(n)}", rnd.choice(["R", "S", "ALIAS_OF"]), f"n{rnd.randrange(n)}") for _ in range(m)})
    return edges + [("u", "n0", "R", "n1"), ("u", "n1", "R", "n2")]


def plain_walks(edges, tenant, start, hops):
    step = {}
    for t, a, r, b in edges:
        if t == tenant:
            step.setdefault(a, []).append((r, b, True))
            step.setdefault(b, []).append((r, a, False))
    at, out = [((start,), (), ())], []
    for _ in range(hops):
        at = [((*nn, b), (*rr, r), (*ff, f)) for nn, rr, ff in at for r, b, f in step.get(nn[-1], []) if b not in nn]
        out += at
    return out


def shown(nn, rr):
    return f"({nn[0]})" + "".join(f" -[:{r}]-> ({b})" for r, b in zip(rr, nn[1:], strict=True))


@pytest.fixture(scope="module", params=[1, 2])
def edges(request):
    return random_graph(request.param)


SEEDS = [("t", 1, "n0", 1), ("t", 1, "n3", 2), ("t", 1, "n5", 3), ("t", 1, "n7", 4), ("t", 1, "n8", 5), ("t", 2, "n1", 1), ("t", 2, "lonely", 2), ("t", 2, "n9", 3), ("u", 1, "n0", 1), ("u", 1, "n2", 2), ("t", 3, "n2", 1)]


@pytest.mark.parametrize("hops", [1, 3, 4])
def test_shortest_paths_equal_a_plain_search(spark, edges, hops):
    e = spark.createDataFrame(edges, "tenant_id string, src string, rel_type string, dst string")
    got = sorted(map(tuple, graph.shortest_paths(e, spark.createDataFrame(SEEDS, "tenant_id string, query_id long, name string, rank int"), hops).collect()))
    want = []
    for (t, q, a, ra), (t2, q2, b, rb) in itertools.product(SEEDS, SEEDS):
        if (t, q) == (t2, q2) and ra < rb <= 4:
            found = [(len(rr), shown(nn, rr)) for nn, rr, _ in plain_walks(edges, t, a, hops) if nn[-1] == b]
            least = [x for x in sorted(set(found)) if x[0] == min(found)[0]]
            want += [(t, q, a, b, text, n) for n, text in least[:3]]
    assert got == sorted(want)


@pytest.mark.parametrize("trails", [3, 25])
def test_trails_equal_a_plain_search(spark, edges, trails):
    e = spark.createDataFrame(edges, "tenant_id string, src string, rel_type string, dst string")
    s = spark.createDataFrame(SEEDS, "tenant_id string, query_id long, name string, rank int")
    found = graph.trails_of(e, s.drop("rank"), 3, trails)
    got = sorted((r.tenant_id, r.query_id, tuple(r.node_names), tuple(r.relationships), r.path_str) for r in found.collect())
    want = []
    for t, q in sorted({x[:2] for x in SEEDS}):
        every = [w for x in SEEDS if x[:2] == (t, q) for w in plain_walks(edges, t, x[2], 3)]
        every.sort(key=lambda w: (len(w[1]), shown(w[0], w[1]), w[2]))
        want += [(t, q, nn, rr, shown(nn, rr)) for nn, rr, _ in every[:trails]]
    assert got == sorted(want)
    _, shown_edges = graph.path_graph(found, e.select("tenant_id", F.col("src").alias("name"), F.lit("T").alias("type")).distinct())
    assert {(r.tenant_id, r.src, r.rel_type, r.dst) for r in shown_edges.collect()} <= set(edges)


def test_a_hub_is_cut_before_it_is_walked_through(spark):
    hub = spark.range(20_000).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("leaf"), "id").alias("src"), F.lit("R").alias("rel_type"), F.lit("hub").alias("dst"))
    assert graph.first_tails(hub, 2, 25).filter("at = 'hub'").count() == 25 * 3
    starts = spark.createDataFrame([("t", 1, "leaf7"), ("t", 2, "leaf9")], "tenant_id string, query_id long, name string")
    got = graph.expand(hub, starts, 2)
    assert [r.n for r in got.groupBy("query_id").agg(F.count("*").alias("n")).collect()] == [15, 15]
    ranked = spark.createDataFrame([("t", 1, "leaf7", 1), ("t", 1, "leaf9", 2)], "tenant_id string, query_id long, name string, rank int")
    assert [r.path_str for r in graph.shortest_paths(hub, ranked, 4).collect()] == ["(leaf7) -[:R]-> (hub) -[:R]-> (leaf9)"]


def test_equal_relations_of_two_organisations(spark):
    rows = [(t, i, "Acme", "Organization", "Beta", "Organization", "WORKS_WITH") for i, t in enumerate("tuu")]
    r = spark.createDataFrame(rows, "tenant_id string, ordinal long, src string, src_type string, dst string, dst_type string, rel_type string")
    assert sorted(x.tenant_id for x in entities.reoriented(r).collect()) == ["t", "u"]
