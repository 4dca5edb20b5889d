"""Queries take every row of their tables."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from corvine.inputs import Inputs


def test_lines_of_every_document(spark, sf):
    docs = {r.doc_id: r.text for r in Inputs(spark, sf).documents.collect()}
    got = {r.doc_id: r.lines for r in entry.queries()["chunk_lines"](spark, sf).collect()}
    assert got == {i: t.count("\n") + 1 for i, t in docs.items() if t is not None}


def test_lookup_takes_real_questions(spark, sf):
    asked = Inputs(spark, sf).asked.filter("query_id >= 0 and lower(text) like '%customer%'")
    found = entry.queries()["entity_lookup"](spark, sf)
    assert asked.count() == 0 or found.filter(F.col("query_id") >= 0).count() > 0
    assert found.filter(F.col("query_id") < 0).count() > 0


def test_paths_start_at_every_node(spark, sf):
    i = Inputs(spark, sf)
    names = lambda df: {tuple(r) for r in df.select("tenant_id", "name").collect()}
    assert names(i.starts) == names(i.nodes)
    got = entry.queries()["expand_1hop"](spark, sf)
    assert {r.tenant_id for r in got.select("tenant_id").distinct().collect()} == {"acme", "beta"}


def test_stored_chunks_of_every_organisation(spark, sf):
    tenants = {r[0] for r in Inputs(spark, sf).documents.filter("length(trim(text)) > 0").select("source").distinct().collect()}
    assert {r[0] for r in entry.queries()["stored_chunks"](spark, sf).select("tenant_id").distinct().collect()} == tenants
