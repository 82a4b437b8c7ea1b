"""Evaluation metrics over mapped facts, and the mapping of candidates to labelled facts.

``rows``: ``run_id, note, tier, fact_id, expected, actual, expected_systems, code_matched,
provenance_count``.  Runs are a column, not a loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions import text as T


def _hit() -> Column:
    return F.when(F.col("expected") == F.col("actual"), 1.0).otherwise(0.0)


def _over_runs(per_run: DataFrame, keys: list[str]) -> DataFrame:
    return per_run.groupBy(*keys).agg(
        F.avg("rate").alias("mean"), F.min("rate").alias("min"), F.max("rate").alias("max")
    )


def confusion_matrix(rows: DataFrame) -> DataFrame:
    actual = [*V.CLASSIFICATIONS, "MISSING"]
    return rows.groupBy("expected").pivot("actual", actual).count().fillna(0)


def class_accuracy(rows: DataFrame, n_runs: int) -> DataFrame:
    """Hit rate per expected class over the runs; ``n`` is the number of facts per run."""
    per_run = rows.groupBy("expected", "run_id").agg(F.avg(_hit()).alias("rate"), F.count(F.lit(1)).alias("n_rows"))
    return per_run.groupBy("expected").agg(
        F.avg("rate").alias("mean"),
        F.min("rate").alias("min"),
        F.max("rate").alias("max"),
        F.floor(F.sum("n_rows") / n_runs).alias("n"),
    )


def tier_accuracy(rows: DataFrame) -> DataFrame:
    tiered = rows.where(F.coalesce("tier", F.lit("")) != "")
    return _over_runs(tiered.groupBy("tier", "run_id").agg(F.avg(_hit()).alias("rate")), ["tier"])


def overall_accuracy(rows: DataFrame) -> DataFrame:
    return _over_runs(rows.groupBy("run_id").agg(F.avg(_hit()).alias("rate")), [])


def fact_stability(rows: DataFrame, n_runs: int) -> DataFrame:
    """Per fact: hits, agreement and whether it is right in all runs, in none, or in some."""
    counts = rows.groupBy("note", "fact_id", "expected", "actual").agg(
        F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first_run")
    )
    return (
        counts.groupBy("note", "fact_id", "expected")
        .agg(
            F.sum(F.when(F.col("actual") == F.col("expected"), F.col("n")).otherwise(0)).alias("hits"),
            F.max_by("actual", F.struct("n", -F.col("first_run"))).alias("most_common_actual"),
            F.max("n").alias("top_count"),
            # At most one entry per class.
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("actual", "n")))).alias("distribution"),
        )
        .withColumn("agreement", F.round(F.col("top_count") / n_runs, 2))
        .withColumn(
            "stability",
            F.when(F.col("hits") == n_runs, "stable_right").when(F.col("hits") == 0, "stable_wrong").otherwise("flaky"),
        )
        .drop("top_count")
    )


def stability_order(stability: DataFrame) -> DataFrame:
    return stability.orderBy(
        F.col("stability") != "stable_wrong", F.col("stability") != "flaky", "fact_id", "note"
    )


def consistency(stability: DataFrame, n_runs: int) -> DataFrame:
    """Share of facts right in at least 80 % of the runs, and the counts by stability."""
    threshold = max(-(-8 * n_runs // 10), 1)
    return stability.agg(
        F.avg(F.when(F.col("hits") >= threshold, 1.0).otherwise(0.0)).alias("consistency"),
        *[F.count_if(F.col("stability") == s).alias(s) for s in ("stable_right", "flaky", "stable_wrong")],
    )


def hit_histogram(stability: DataFrame) -> DataFrame:
    return stability.groupBy("hits").agg(F.count(F.lit(1)).alias("n_facts"))


def stable_wrong_cases(stability: DataFrame) -> DataFrame:
    return stability.where(F.col("stability") == "stable_wrong").select(
        "note", "fact_id", "expected", F.col("most_common_actual").alias("always_actual"), "distribution"
    )


def code_accuracy(rows: DataFrame) -> DataFrame:
    """Share of matched facts with a right code: overall (system null) and per expected system."""
    judged = rows.where(F.col("code_matched").isNotNull()).withColumn("ok", F.when(F.col("code_matched"), 1.0).otherwise(0.0))
    overall = judged.agg(F.avg("ok").alias("accuracy"), F.count(F.lit(1)).alias("n")).select(
        F.lit(None).cast("string").alias("system"), "accuracy", "n"
    )
    per_system = (
        judged.select(F.explode("expected_systems").alias("system"), "ok")
        .groupBy("system")
        .agg(F.avg("ok").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    )
    return overall.unionByName(per_system)


def error_decomposition(rows: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("actual") == "MISSING", "extraction_miss")
        .when(~F.col("code_matched"), "coding_miss")
        .otherwise("reconciler_miss")
    )
    missed = rows.where(F.col("expected") != F.col("actual"))
    return missed.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def trap_rejection(traps: DataFrame) -> DataFrame:
    """Share of rejected traps per run, then over runs. ``traps``: ``run_id, rejected``."""
    per_run = traps.groupBy("run_id").agg(F.avg(F.when(F.col("rejected"), 1.0).otherwise(0.0)).alias("rate"))
    return _over_runs(per_run, [])


def provenance_coverage(rows: DataFrame) -> DataFrame:
    counted = rows.where((F.col("expected") != "DUPLICATE") & (F.col("actual") != "MISSING"))
    return counted.agg(F.avg(F.when(F.col("provenance_count") > 0, 1.0).otherwise(0.0)).alias("coverage"))


def spurious_facts(mapped: DataFrame, expected: DataFrame) -> DataFrame:
    """Mapped fact ids that were not expected."""
    return mapped.select("note", "fact_id").distinct().join(expected, ["note", "fact_id"], "left_anti")


# -- retrieval metrics ---------------------------------------------------------------------


def recall_at_k(expected: DataFrame, hits: DataFrame, k: int, by_display: bool = False) -> DataFrame:
    """Share of expected codes among the first k hits, per system and in total.

    ``expected``: ``query_id, system, code, display``; ``hits`` the same plus ``rank``.
    With ``by_display`` an equal normalized display counts as well.
    """
    want = expected.select(
        "query_id", "system", T.bench_normal_code(F.col("system"), F.col("code")).alias("w_code"),
        T.bench_normal_display(F.col("display")).alias("w_display"),
    )
    got = hits.where(F.col("rank") <= k).select(
        "query_id", T.bench_normal_code(F.col("system"), F.col("code")).alias("g_code"),
        T.bench_normal_display(F.col("display")).alias("g_display"),
    )
    by_code = want.join(got, (want.query_id == got.query_id) & (want.w_code == got.g_code), "left_semi")
    found = by_code
    if by_display:
        by_text = want.join(got, (want.query_id == got.query_id) & (want.w_display == got.g_display), "left_semi")
        found = by_code.unionByName(by_text).distinct()
    judged = want.withColumn("hit", F.lit(0.0)).unionByName(found.withColumn("hit", F.lit(1.0)))
    per_query = judged.groupBy("query_id", "system", "w_code").agg(F.max("hit").alias("hit"))
    return per_query.rollup("system").agg(F.avg("hit").alias("recall"), F.count(F.lit(1)).alias("n"))


def rank_buckets(expected: DataFrame, hits: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Per system: expected codes in the index, found first, found within k, missed."""
    present = expected.join(index.select("system", "code").distinct().withColumn("in_index", F.lit(1)), ["system", "code"], "left")
    ranked = present.join(
        hits.groupBy("query_id", "system", "code").agg(F.min("rank").alias("rank")), ["query_id", "system", "code"], "left"
    )
    return ranked.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("in_index").alias("in_index"),
        F.count_if(F.col("rank") == 1).alias("top1"),
        F.count_if(F.col("rank") <= k).alias("topk"),
        F.count_if(F.coalesce(F.col("rank"), F.lit(k + 1)) > k).alias("miss"),
    )


def selection_accuracy(expected: DataFrame, chosen: DataFrame) -> DataFrame:
    """Share of chosen codes right by code or by display. ``chosen``: ``query_id, code, display``."""
    picked = chosen.select("query_id", F.col("code").alias("c_code"), F.col("display").alias("c_display"))
    right = F.coalesce(
        (T.bench_normal_code(F.col("system"), F.col("code")) == T.bench_normal_code(F.col("system"), F.col("c_code")))
        | (T.bench_normal_display(F.col("display")) == T.bench_normal_display(F.col("c_display"))),
        F.lit(False),
    )
    return (
        expected.join(picked, "query_id", "left")
        .groupBy("system")
        .agg(F.avg(F.when(right, 1.0).otherwise(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    )


# -- mapping candidates to labelled facts -----------------------------------------------------


def _taken_first(choices: Column, taken: Column) -> Column:
    """The first of ``choices`` that is not ``taken``, or null."""
    return F.get(F.filter(choices, lambda f: ~F.array_contains(taken, f)), 0)


def greedy_pairs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """In reading order each candidate takes its first fact that is still free.

    ``edges``: ``keys + (cand_pos, fact_pos)``.  One fold over the sorted candidates of a group, whose state is the facts taken
    so far.  A group's edges must fit a task; groups are independent and need one exchange.
    """
    kind = edges.schema["fact_pos"].dataType.simpleString()
    own = edges.schema["cand_pos"].dataType.simpleString()
    choices = edges.repartition(*keys).groupBy(*keys, "cand_pos").agg(F.sort_array(F.collect_set("fact_pos")).alias("facts"))
    groups = choices.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cand_pos", "facts"))).alias("cands"))
    start = F.struct(F.array().cast(f"array<{kind}>").alias("taken"), F.array().cast(f"array<struct<cand_pos:{own},fact_pos:{kind}>>").alias("pairs"))

    def step(state: Column, cand: Column) -> Column:
        return T.let(
            _taken_first(cand["facts"], state["taken"]),
            lambda fact: F.when(fact.isNull(), state).otherwise(
                F.struct(
                    F.array_append(state["taken"], fact).alias("taken"),
                    F.array_append(state["pairs"], F.struct(cand["cand_pos"].alias("cand_pos"), fact.alias("fact_pos"))).alias("pairs"),
                )
            ),
        )

    return groups.select(*keys, F.inline(F.aggregate("cands", start, step, lambda s: s["pairs"])))


def map_facts(cand_codes: DataFrame, fact_codes: DataFrame, cand_spans: DataFrame, fact_spans: DataFrame) -> DataFrame:
    """Three passes: code overlap, ingredient overlap of medications, span overlap.

    ``cand_codes``: ``note, cand_pos, resource_type, system, code, display``;
    ``fact_codes``: ``note, fact_pos, category, system, code, display``;
    spans: ``note, cand_pos|fact_pos, start, end``; positions are longs.
    Returns ``note, fact_pos, cand_pos, pass_no``: the candidate each fact is judged by.

    In the first pass a candidate takes its first fact that shares a code, and the first candidate of a fact judges it; a
    candidate that met any fact is done.  In the others it takes its first fact that is still free.  All rows of a note meet once,
    in one exchange, and the passes are folds over its sorted candidates; a note's candidates and facts must fit a task.
    """
    code = F.when(F.col("code").isNotNull(), F.to_json(F.array("system", "code")))
    ingredient = F.nullif(T.normalize_ingredient(F.coalesce("display", F.lit(""))), F.lit(""))
    none, nowhere = F.lit(None).cast("string"), F.lit(None).cast("struct<start:bigint,end:bigint>")
    span = F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))

    def side(codes: DataFrame, spans: DataFrame, pos: str, drug: Column, n: int) -> DataFrame:
        at = ["note", F.lit(n).alias("side"), F.col(pos).cast("bigint").alias("pos")]
        return codes.select(*at, code.alias("code"), F.when(drug, ingredient).alias("ingredient"), nowhere.alias("span")).unionByName(
            spans.select(*at, none.alias("code"), none.alias("ingredient"), F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), span).alias("span"))
        )

    rows = side(cand_codes, cand_spans, "cand_pos", F.col("resource_type") == "MedicationRequest", 0).unionByName(
        side(fact_codes, fact_spans, "fact_pos", F.col("category") == "medication_request", 1)
    )
    each = rows.repartition("note").groupBy("note", "side", "pos").agg(
        F.collect_set("code").alias("codes"), F.collect_set("ingredient").alias("ingredients"), F.collect_set("span").alias("spans")
    )
    entry = F.struct("pos", "codes", "ingredients", "spans")
    notes = each.groupBy("note").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 0, entry)), lambda a, b: F.when(a["pos"] < b["pos"], -1).otherwise(1)).alias("cands"),
        F.array_sort(F.collect_list(F.when(F.col("side") == 1, entry)), lambda a, b: F.when(a["pos"] < b["pos"], -1).otherwise(1)).alias("facts"),
    )
    pair = "struct<fact_pos:bigint,cand_pos:bigint,pass_no:int>"
    start = F.struct(F.array().cast(f"array<{pair}>").alias("pairs"), F.array().cast("array<bigint>").alias("used"))

    def overlaps(c: Column, f: Column) -> Column:
        return F.exists(c["spans"], lambda x: F.exists(f["spans"], lambda y: (x["end"] > y["start"]) & (y["end"] > x["start"])))

    def run(state: Column, number: int, meets: Callable[[Column, Column], Column]) -> Column:
        """One pass over the candidates; in the first one a fact that is taken still settles the candidate."""

        def step(s: Column, c: Column) -> Column:
            free = lambda f: ~F.exists(s["pairs"], lambda p: p["fact_pos"] == f["pos"])
            open_ = F.filter("facts", lambda f: meets(c, f) if number == 1 else meets(c, f) & free(f))

            def taken(f: Column) -> Column:
                new = F.struct(f["pos"].alias("fact_pos"), c["pos"].alias("cand_pos"), F.lit(number).alias("pass_no"))
                pairs = F.when(free(f), F.array_append(s["pairs"], new)).otherwise(s["pairs"])
                return F.struct(pairs.alias("pairs"), F.array_append(s["used"], c["pos"]).alias("used"))

            return T.let(F.get(open_, 0), lambda f: F.when(f.isNull() | F.array_contains(s["used"], c["pos"]), s).otherwise(taken(f)))

        return F.aggregate("cands", state, step)

    passes = (
        (1, lambda c, f: F.arrays_overlap(c["codes"], f["codes"])),
        (2, lambda c, f: F.arrays_overlap(c["ingredients"], f["ingredients"])),
        (3, overlaps),
    )
    state = start
    for number, meets in passes:
        notes = notes.withColumn("state", run(state, number, meets))
        state = F.col("state")
    return notes.select("note", F.inline("state.pairs")).select("note", "fact_pos", "cand_pos", "pass_no")
