"""The chart as typed facts, and the look-up tables derived from it.

``facts`` has one row per chart resource::

    patient_id, entry_pos, resource_type, resource_id, codings, text, status,
    clinical_status, value, dose, performed

Look-up tables hold one row per key (partial aggregation on the map side), so a join
against them can never multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions import text as T
from chartspark.functions.clinical import no_codings


def fact_display() -> F.Column:
    """Text of the concept, else the display of its first coding, else ''."""
    first = F.get(F.col("codings"), F.lit(0))["display"]
    return F.coalesce(T.blank_to_null(F.col("text")), first, F.lit(""))


def chart_codes(facts: DataFrame) -> DataFrame:
    """One row per coding of a chart resource; observations keep LOINC only."""
    return (
        facts.withColumn("display", fact_display())
        .select("*", F.posexplode(F.coalesce("codings", no_codings())).alias("coding_pos", "coding"))
        .where(F.col("coding.system").isNotNull() & F.col("coding.code").isNotNull())
        .where((F.col("resource_type") != "Observation") | (F.col("coding.system") == V.LOINC))
        .withColumn("system", F.col("coding.system"))
        .withColumn("code", T.normalize_code(F.col("coding.system"), F.col("coding.code")))
        .drop("coding", "codings")
    )


def is_active() -> F.Column:
    """Unset status means active, for medications and conditions alike."""
    return (
        F.when(F.col("resource_type") == "Condition", F.coalesce("clinical_status", F.lit("active")))
        .otherwise(F.coalesce("status", F.lit("active")))
        == "active"
    )


def _matches(df: DataFrame, keys: list[str], order) -> DataFrame:
    """First member, first active member, first shown display and the size of each key."""
    member = F.struct(
        order.alias("order"), "resource_id", "display", F.coalesce("value", F.lit("")).alias("value"),
        F.coalesce("dose", F.lit("")).alias("dose"),
    )
    return df.groupBy(*keys).agg(
        F.min(member).alias("first"),
        F.min(F.when(is_active(), member)).alias("first_active"),
        F.min(F.when(F.col("display") != "", member)).alias("first_shown"),
        F.count(F.lit(1)).alias("n_matches"),
    )


def code_index(facts: DataFrame) -> DataFrame:
    """(patient, type, system, code) -> matches in chart order."""
    return _matches(
        chart_codes(facts), ["patient_id", "resource_type", "system", "code"], F.struct("entry_pos", "coding_pos")
    )


def display_index(facts: DataFrame) -> DataFrame:
    """(patient, type, normalized display) -> matches in chart order; no observations."""
    shown = (
        facts.where(F.col("resource_type") != "Observation")
        .withColumn("display", fact_display())
        .withColumn("key", T.normalize_display(F.col("display")))
    )
    return _matches(shown, ["patient_id", "resource_type", "key"], F.struct("entry_pos", F.lit(0).alias("coding_pos")))


def ingredient_index(facts: DataFrame) -> DataFrame:
    """(patient, 'MedicationRequest', normalized ingredient) -> matches; coding displays only."""
    drugs = (
        facts.where(F.col("resource_type") == "MedicationRequest")
        .withColumn("display", fact_display())
        .select("*", F.posexplode(F.coalesce("codings", no_codings())).alias("coding_pos", "coding"))
        .withColumn("key", T.normalize_ingredient(F.coalesce("coding.display", F.lit(""))))
    )
    return _matches(drugs, ["patient_id", "resource_type", "key"], F.struct("entry_pos", "coding_pos"))


def no_known_allergy(facts: DataFrame) -> DataFrame:
    """Patients whose chart records no known drug allergy, with the first such resource."""
    recorded = F.exists(F.coalesce("codings", no_codings()), lambda c: c["code"] == V.NKDA_CODE)
    return (
        facts.where((F.col("resource_type") == "AllergyIntolerance") & F.coalesce(recorded, F.lit(False)))
        .groupBy("patient_id")
        .agg(
            F.min(F.struct("entry_pos", "resource_id")).getField("resource_id").alias("nkda_resource_id"),
            F.count(F.lit(1)).alias("nkda_matches"),
        )
    )


def observation_values(facts: DataFrame) -> DataFrame:
    """(patient, LOINC code) -> first chart entry and its value."""
    return code_index(facts.where(F.col("resource_type") == "Observation")).select(
        "patient_id", "code", F.col("first.resource_id").alias("resource_id"), F.col("first.value").alias("value"), "n_matches"
    )


def first_chart_entry(facts: DataFrame, *keys: str) -> DataFrame:
    """First chart row per key in bundle order, by aggregation: no group is sorted in one task."""
    rest = [c for c in facts.columns if c not in keys and c != "entry_pos"]
    return (
        facts.groupBy(*keys)
        .agg(F.min_by(F.struct("entry_pos", *rest), F.struct("entry_pos", "resource_id")).alias("_first"))
        .select(*keys, "_first.*")
    )


def match_members(facts: DataFrame) -> DataFrame:
    """Every chart row of every match key, in long form, for review screens.

    Kept apart from the candidates: a key shared by many candidates is stored once.
    """
    codes = chart_codes(facts).select(
        "patient_id", "resource_type", F.lit("exact_code").alias("match_type"),
        F.concat_ws("|", "system", "code").alias("match_key"), "entry_pos", "coding_pos", "resource_id", "display",
    )
    names = (
        facts.where(F.col("resource_type") == "Condition")
        .withColumn("match_key", T.normalize_display(fact_display()))
        .where(F.col("match_key") != "")
        .select(
            "patient_id", "resource_type", F.lit("display_text").alias("match_type"), "match_key", "entry_pos",
            F.lit(0).alias("coding_pos"), "resource_id", F.col("match_key").alias("display"),
        )
    )
    drugs = (
        facts.where(F.col("resource_type") == "MedicationRequest")
        .withColumn("display", fact_display())
        .select("*", F.posexplode(F.coalesce("codings", no_codings())).alias("coding_pos", "coding"))
        .withColumn("match_key", T.normalize_ingredient(F.coalesce("coding.display", F.lit(""))))
        .where(F.col("match_key") != "")
        .select(
            "patient_id", "resource_type", F.lit("ingredient").alias("match_type"), "match_key", "entry_pos",
            "coding_pos", "resource_id", "display",
        )
    )
    return codes.unionByName(names).unionByName(drugs)
