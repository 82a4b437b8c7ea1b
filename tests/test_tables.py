"""The adapters over the given tables."""

from chartspark.harness import load_queries
from chartspark.harness.registry import _STORED, Tables
from chartspark.harness.tables import candidate_items, candidate_items_once

SMALL = "/root/testdata/sf0.001"


def test_candidates_are_stored_narrow_and_read_as_records(spark):
    t = Tables(spark, SMALL)
    items = candidate_items(t)
    stored = _STORED[(spark.sparkContext.applicationId, SMALL, "candidate_items")]
    assert "item" not in stored.columns and len(stored.columns) < 30
    once = candidate_items_once(t)
    assert once.schema.simpleString() == items.schema.simpleString()
    assert once.count() == items.count() and once.exceptAll(items).isEmpty()


def test_a_query_of_one_pass_stores_nothing_and_reads_what_it_names(spark):
    before = set(_STORED)
    folder = f"{SMALL}/"
    found = load_queries()["reviewable"](spark, folder)
    assert set(_STORED) == before
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "p_partkey" in plan and "p_name" not in plan and "p_type" not in plan


def test_collapses_pass_over_merged_candidates_once(spark, tmp_path):
    from chartspark.harness.merging import _marker_items
    from chartspark.operators import merge

    merged, refs = _marker_items(Tables(spark, SMALL))
    merged.write.parquet(f"{tmp_path}/merged")
    refs.write.parquet(f"{tmp_path}/refs")
    merged, refs = spark.read.parquet(f"{tmp_path}/merged"), spark.read.parquet(f"{tmp_path}/refs")
    for collapse in (merge.collapse_markers, merge.collapse_multifocal):
        collapsed, moved = collapse(merged, refs)
        leaves = [x for x in collapsed._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" in x]
        assert sum("encounter_key" in x for x in leaves) == 1
        assert sum("document_id" in x for x in leaves) == 1
        # Every note of a reference stays with the row that it moved to.
        ids = {r["merged_id"] for r in collapsed.select("merged_id").collect()}
        assert {r["merged_id"] for r in moved.select("merged_id").collect()} == ids
        assert moved.select("document_id").distinct().count() == refs.select("document_id").distinct().count()


def test_assess_local_reads_the_elements_of_a_resource_once(spark):
    from chartspark.operators import conformance

    texts = ['{"resourceType":"Condition","meta":{"profile":["http://x/p"]},"category":"c","odd":1}', '{"resourceType":"Observation"}', "[1]", "{", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, resource string")
    found = conformance.assess_local(rows)
    assert found.columns == ["id", "resource", "issues", "valid", "level", "supported"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.resourceType)") == 1 and plan.count("AS _keys") == 1
    alone = rows.withColumn("alone", conformance.structure_issues(rows["resource"]))
    together = {r["id"]: r["issues"] for r in found.collect()}
    for r in alone.collect():
        notes = [i for i in together[r["id"]] if i["severity"] == "information"]
        assert [i for i in together[r["id"]] if i["severity"] != "information"] == r["alone"]
        assert len(notes) == (r["id"] == 0)
