"""Registry of check queries: a Spark job over the given tables and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from chartspark.session import UNFUSED, fixed, settings, tune

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """The given tables of one scale, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._read: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """An adapter's rows, written once per session and folder.

        Operators then start from a stored table, as they do in production, instead of
        planning the adapter's expressions again in every branch.
        """
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            with settings(self.spark, **UNFUSED):
                _STORED[key] = fixed(build())
        return _STORED[key]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Portable SQL with ``{table}`` placeholders."""
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used, **frames)


_STORED: dict[tuple[str, str, str], DataFrame] = {}


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(Tables(tune(spark), folder))


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register a query for the survey entries ``ids`` (blank-separated)."""

    def wrap(run):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, tuple(ids.split()), run, for_duckdb(sql) if sql else None)
        return run

    return wrap


def with_json(text: str) -> str:
    """Portable SQL whose texts hold JSON: braces that name no table are doubled, and backslashes, which Spark reads as escapes."""
    text = text.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}")
    for table in TABLES:
        text = text.replace("{{" + table + "}}", "{" + table + "}")
    return text


def for_duckdb(text: str) -> str:
    """Placeholders become the registered view names."""
    for table in TABLES:
        text = text.replace("{" + table + "}", table)
    return text
