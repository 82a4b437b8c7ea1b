"""Half-open character spans: overlap joins by position buckets, and merged ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 512


def _bucketed(spans: DataFrame, start: str, end: str) -> DataFrame:
    """One row per position bucket a span touches; empty spans touch none."""
    return spans.where(F.col(start) < F.col(end)).withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col(start) / BUCKET), F.floor((F.col(end) - 1) / BUCKET)))
    )


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of overlapping spans. ``left`` has ``start, end``, ``right`` has ``r_start, r_end``.

    A pair is reported in the bucket of its later start, so it appears once.
    """
    pairs = _bucketed(left, "start", "end").join(_bucketed(right, "r_start", "r_end"), [*keys, "_bucket"])
    return pairs.where(
        (F.col("start") < F.col("r_end"))
        & (F.col("r_start") < F.col("end"))
        & (F.col("_bucket") == F.floor(F.greatest("start", "r_start") / BUCKET))
    ).drop("_bucket")


def merge_ranges(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Union of spans per key; overlapping or touching spans become one.

    Equal spans are folded first, so a window holds at most the distinct spans of one note.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.select(*keys, "start", "end")
        .distinct()
        .withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
        .withColumn("_island", F.sum("_new").over(order))
        .groupBy(*keys, "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_island")
    )


def touched(spans: DataFrame, by: DataFrame, keys: list[str]) -> DataFrame:
    """Spans some span of ``by`` overlaps (exists, not pairs). ``by`` has ``start, end``.

    ``by`` is reduced to disjoint ranges first: a much-cited place is one range.
    """
    ranges = merge_ranges(by, keys).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    near = _bucketed(spans, "start", "end").join(_bucketed(ranges, "r_start", "r_end"), [*keys, "_bucket"])
    return near.where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))).select(*spans.columns).distinct()


def note_segments(notes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Alternating plain and highlighted slices of each note, in order, tail included.

    ``notes``: ``document_id, text``; ``ranges``: disjoint ``document_id, start, end``.
    """
    order = Window.partitionBy("document_id").orderBy("start")
    placed = ranges.join(notes.select("document_id", "text"), "document_id").withColumn(
        "gap_from", F.coalesce(F.lag("end").over(order), F.lit(0))
    )
    marked = placed.select("document_id", "text", F.col("start"), F.col("end"), F.lit(True).alias("highlight"))
    plain = placed.select("document_id", "text", F.col("gap_from").alias("start"), F.col("start").alias("end"), F.lit(False).alias("highlight"))
    last = ranges.groupBy("document_id").agg(F.max("end").alias("start"))
    tail = notes.join(last, "document_id").select(
        "document_id", "text", "start", F.length("text").alias("end"), F.lit(False).alias("highlight")
    )
    return (
        marked.unionByName(plain).unionByName(tail)
        .where(F.col("start") < F.col("end"))
        .select("document_id", "start", "end", "highlight", F.expr("substring(text, start + 1, end - start)").alias("text"))
    )
