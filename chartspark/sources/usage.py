"""Model-call events as JSON lines: batch and streaming share one parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.schemas import LLM_EVENT


def parse_llm_events(lines: DataFrame) -> DataFrame:
    """``value`` JSON text to typed events; lines that are not JSON are dropped."""
    parsed = lines.select(F.from_json("value", LLM_EVENT).alias("e")).select("e.*")
    return parsed.where(F.col("event").isNotNull())


def read_llm_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_llm_events(spark.read.text(path))


def stream_llm_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_llm_events(spark.readStream.format("text").load(path))
