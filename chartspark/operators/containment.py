"""Exact "one text contains the other" lookup without comparing every pair.

A text is contained in another exactly when it equals one of its substrings, so the
longer side is expanded to the substrings whose *length* occurs on the other side and the
match becomes an equality join.  The work grows with the text lengths, never with the
number of pairs in a group, and a hot group is an ordinary skewed hash key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _substrings(text: Column, shapes: Column) -> Column:
    """Distinct substrings of a text that have one of the wanted shapes."""
    per_shape = F.transform(
        F.filter(shapes, lambda s: s["n"] <= F.length(text)),
        lambda s: F.transform(
            F.filter(
                F.sequence(F.lit(1), F.length(text) - s["n"] + 1),
                lambda at: F.substring(text, at, F.length(s["head"])) == s["head"],
            ),
            lambda at: F.substring(text, at, s["n"]),
        ),
    )
    return F.array_distinct(F.flatten(per_shape))


def _shapes(df: DataFrame, group: list[str], text: str) -> DataFrame:
    """Distinct (length, first two characters) per group.

    The set is bounded by text lengths and the alphabet, not by the number of rows.
    """
    shape = F.struct(F.length(text).alias("n"), F.substring(text, 1, 2).alias("head"))
    return df.groupBy(*group).agg(F.collect_set(F.when(F.length(text) > 0, shape)).alias("_shapes"))


def first_containment(
    names: DataFrame,
    displays: DataFrame,
    group: list[str],
    name: str = "name",
    display: str = "display",
    position: str = "position",
    prefer_equal: Column | None = None,
) -> DataFrame:
    """For each (group, name): the first display, by position, where either text contains the other.

    Returns ``group + (name, display, position)``; names without a partner are absent.
    Empty texts have no shape, so they never match.  Where ``prefer_equal`` (an expression over ``group``) holds, an
    equal display comes before earlier displays that only overlap.
    """
    names = names.select(*group, F.col(name).alias("_name")).distinct()
    displays = (
        displays.groupBy(*group, F.col(display).alias("_display"))
        .agg(F.min(position).alias("_position"))
    )
    # name inside display: the wanted substrings of a display look the names up ...
    inner = (
        displays.join(_shapes(names, group, "_name"), group)
        .select(*group, "_display", "_position", F.explode(_substrings(F.col("_display"), F.col("_shapes"))).alias("_name"))
        .join(names, [*group, "_name"], "left_semi")
    )
    # ... and display inside name the other way round.
    outer = (
        names.join(_shapes(displays, group, "_display"), group)
        .select(*group, "_name", F.explode(_substrings(F.col("_name"), F.col("_shapes"))).alias("_display"))
        .join(displays, [*group, "_display"])
    )
    columns = [*group, "_name", "_display", "_position"]
    unequal = (F.col("_name") != F.col("_display")) & (F.lit(False) if prefer_equal is None else prefer_equal)
    return (
        inner.select(*columns)
        .unionByName(outer.select(*columns))
        .withColumn("_rank", F.when(unequal, 1).otherwise(0))
        .groupBy(*group, F.col("_name").alias(name))
        .agg(F.min(F.struct("_rank", "_position", "_display")).alias("_hit"))
        .select(*group, name, F.col("_hit._display").alias(display), F.col("_hit._position").alias(position))
    )


def first_needle(
    names: DataFrame, needles: DataFrame, group: list[str], name: str, needle: str, position: str
) -> DataFrame:
    """For each (group, name): the first needle, by position, that occurs inside the name."""
    names = names.select(*group, F.col(name).alias("_name")).distinct()
    needles = (
        needles.groupBy(*group, F.col(needle).alias("_needle"))
        .agg(F.min(position).alias("_position"))
    )
    return (
        names.join(_shapes(needles, group, "_needle"), group)
        .select(*group, "_name", F.explode(_substrings(F.col("_name"), F.col("_shapes"))).alias("_needle"))
        .join(needles, [*group, "_needle"])
        .groupBy(*group, F.col("_name").alias(name))
        .agg(F.min(F.struct("_position", "_needle")).alias("_hit"))
        .select(*group, name, F.col("_hit._needle").alias(needle), F.col("_hit._position").alias(position))
    )
