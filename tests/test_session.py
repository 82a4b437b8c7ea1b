from pyspark.sql import functions as F

from chartspark.harness.registry import Tables
from chartspark.session import fixed


def test_wide_rows_are_stored_by_column(spark):
    rows = spark.range(50).select("id", F.array(F.struct(F.lit("x").alias("code"), F.col("id").alias("n"))).alias("codings"))
    kept = fixed(rows)
    assert kept.schema.simpleString() == rows.schema.simpleString() and sorted(kept.collect()) == sorted(rows.collect())
    plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    bare = rows.select("id", F.lit(None).alias("nothing"))
    assert sorted(fixed(bare).collect()) == sorted(bare.collect())


def test_adapters_and_rules_run_in_methods_that_the_jvm_compiles(spark, tmp_path):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8_000
    seen = []
    tables = Tables(spark, str(tmp_path))
    rows = tables.stored("some", lambda: seen.append(spark.conf.get("spark.sql.codegen.wholeStage")) or spark.range(3))
    assert seen == ["false"] and spark.conf.get("spark.sql.codegen.wholeStage") == "true" and rows.count() == 3


def test_held_tables_know_how_rows_lie_and_go(spark, tmp_path):
    """A table in buckets needs no exchange by its key, and neither files nor the table outlive the block, also where it fails."""
    import os

    import pytest

    from chartspark.operators.reconcile import LOCAL
    from chartspark.session import Held, checkpoint_folder, settings

    rows = spark.createDataFrame([(None if i % 7 == 0 else f"p{i % 5}", i, [i]) for i in range(60)], "patient_id string, n int, xs array<int>")
    folder = checkpoint_folder(spark).removeprefix("file:")
    before, tables = set(os.listdir(folder)), len(spark.catalog.listTables())
    with pytest.raises(RuntimeError), Held(spark) as held:
        dealt = held.dealt(rows, "patient_id")
        assert sorted(map(str, dealt.collect())) == sorted(map(str, rows.collect()))
        with settings(spark, **LOCAL, spark__sql__autoBroadcastJoinThreshold="-1"):
            again = held.kept(dealt.where("n > 5"), "patient_id")
            plan = again.join(dealt.groupBy("patient_id", "n").count(), ["patient_id", "n"])
            assert plan.count() == sum(i % 7 > 0 for i in range(6, 60)) and "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        assert len(set(os.listdir(folder)) - before) == 2
        raise RuntimeError
    assert set(os.listdir(folder)) == before and len(spark.catalog.listTables()) == tables


def test_reconcile_leaves_its_verdicts_alone_on_disk(spark):
    """What led to the verdicts is deleted with them written: one small table stays."""
    import os

    from chartspark.functions.clinical import no_codings
    from chartspark.operators import reconcile
    from chartspark.schemas import make_item
    from chartspark.session import checkpoint_folder

    base = spark.createDataFrame([(f"p{i % 3}", i, f"thing {i % 4}") for i in range(40)], "patient_id string, n int, name string")
    none = F.lit(None).cast("string")
    items = base.select("patient_id", F.concat(F.lit("c"), "n").alias("cand_id"), F.lit("Condition").alias("resource_type"), make_item(name=F.col("name")).alias("item"))
    facts = base.where("n < 10").select(
        "patient_id", F.col("n").alias("entry_pos"), F.lit("Condition").alias("resource_type"), F.concat(F.lit("r"), "n").alias("resource_id"), no_codings().alias("codings"),
        F.col("name").alias("text"), none.alias("status"), none.alias("clinical_status"), none.alias("value"), none.alias("dose"), none.alias("performed"),
    )
    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = reconcile.match_candidates(items, facts)
    new = set(os.listdir(folder)) - before
    assert len(new) == 2 and all(name.startswith("fixed-") for name in new)  # the verdicts, and the list of large patients
    charted = {(i % 3, i % 4) for i in range(10)}
    assert found.where("classification = 'AMBIGUOUS'").count() == sum((i % 3, i % 4) in charted for i in range(40))
