"""Prices, run totals and the usage ledger over model-call events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions.clinical import call_cost
from chartspark.functions.text import blank_to_null, model_key

TOKENS = ("input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens")


def default_rates(spark) -> DataFrame:
    """Fixed price list: a handful of rows."""
    rows = [tuple(r) for r in V.MODEL_RATES]
    raw = spark.createDataFrame(rows, "model_key string, input string, cached string, output string")
    return raw.select("model_key", *[F.col(c).cast("decimal(10,3)").alias(c) for c in ("input", "cached", "output")])


def price_calls(calls: DataFrame, rates: DataFrame, regional: str | None = None) -> DataFrame:
    """Adds ``usd_cost``; the date tail of a model name is ignored, unknown models cost 0."""
    uplift = F.col(regional) if regional else F.lit(False)
    priced = calls.withColumn("model_key", model_key(F.col("model"))).join(
        rates.select("model_key", F.struct("input", "cached", "output").alias("_rates")), "model_key", "left"
    )
    return priced.withColumn(
        "usd_cost",
        call_cost(F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens"), F.col("_rates"), uplift),
    ).drop("model_key", "_rates")


def run_totals(calls: DataFrame) -> DataFrame:
    """Tokens, cost, duration and notes per run. Needs ``run_id, started_at, finished_at, document_id``."""
    return calls.groupBy("run_id").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("reasoning_tokens").alias("reasoning_tokens"),
        F.sum("usd_cost").alias("cost_usd"),
        F.floor(
            (F.unix_micros(F.max("finished_at").cast("timestamp")) - F.unix_micros(F.min("started_at").cast("timestamp"))) / 1000
        ).alias("duration_ms"),
        F.count_distinct("document_id").alias("doc_count"),
    )


def usage_summary(ledger: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Totals per user; users without a run get zeros."""
    totals = ledger.groupBy("user_key").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("cost_usd").alias("total_cost_usd"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    if users is None:
        return totals
    return users.select("user_key").distinct().join(totals, "user_key", "left").fillna(0)


def recent_runs(ledger: DataFrame, limit: int = 50) -> DataFrame:
    """Newest runs of each user; the limit is kept within 1 to 200.

    The rank filter is pushed below the shuffle, so no user's history is sorted whole.
    """
    from pyspark.sql import Window

    keep = max(1, min(limit, 200))
    newest = Window.partitionBy("user_key").orderBy(F.desc("created_at"), "id")
    return ledger.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= keep)


def stage_usage(calls: DataFrame) -> DataFrame:
    """Calls, tokens, time and cost per stage; the row without a stage is the grand total."""
    return calls.rollup("stage").agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.sum(c).alias(c) for c in TOKENS],
        F.sum("latency_ms").alias("wall_ms"),
        F.sum("usd_cost").alias("usd"),
    )


def stage_models(calls: DataFrame) -> DataFrame:
    """Calls per stage and model, in long form."""
    return calls.groupBy("stage", "model").agg(F.count(F.lit(1)).alias("calls"))


def run_averages(calls: DataFrame) -> DataFrame:
    per_run = calls.groupBy("run_id").agg(
        F.sum("latency_ms").alias("wall_ms"), F.sum("usd_cost").alias("usd"),
        F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"),
    )
    return per_run.agg(
        F.count(F.lit(1)).alias("n_runs"),
        *[F.avg(c).cast("double").alias(c) for c in ("wall_ms", "usd", "tokens_in", "tokens_out")],
    )


def unit_economics(averages: DataFrame, n_notes: int, n_facts: int) -> DataFrame:
    """Cost per note, per fact and per 3- and 8-note chart, from one row of run averages."""
    per_note = F.col("usd") / n_notes
    return averages.select(
        per_note.alias("cost_per_note"),
        (F.col("usd") / n_facts).alias("cost_per_fact"),
        (per_note * 3).alias("cost_per_chart_3"),
        (per_note * 8).alias("cost_per_chart_8"),
        (F.col("wall_ms") / 1000 / n_notes).alias("wall_s_per_note"),
    )


def usage_rows(totals: DataFrame, runs: DataFrame) -> DataFrame:
    """Ledger rows of finished runs: no patient, no text; a missing cost becomes 0."""
    return runs.join(totals, "run_id", "left").select(
        F.col("run_id").alias("id"),
        "user_key",
        "created_at",
        "status",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens")],
        F.coalesce("cost_usd", F.lit(0)).cast("decimal(12,6)").alias("cost_usd"),
        F.col("duration_ms").cast("bigint").alias("duration_ms"),
        F.coalesce("doc_count", F.lit(0)).cast("bigint").alias("doc_count"),
    )


def append_usage(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def clinician_activity(sessions: DataFrame) -> DataFrame:
    """One row per user: visits, first and last, last non-empty name, workspace and role."""

    def last_filled(name):
        return F.max_by(name, F.when(blank_to_null(F.col(name)).isNotNull(), F.struct("ts", "event_id"))).alias(name)

    return sessions.groupBy("user_key").agg(
        F.count(F.lit(1)).alias("seen_count"),
        F.min("ts").alias("first_seen_at"),
        F.max("ts").alias("last_seen_at"),
        last_filled("display_name"),
        last_filled("workspace_id"),
        last_filled("role"),
    )
