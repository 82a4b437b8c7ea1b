"""Declared schemas of the records that flow between operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartspark.functions.clinical import CODINGS

# One wide record for the six kinds of candidate item: field -> Spark type.
ITEM_FIELDS = {
    "source_sentences": "array<int>",
    "reasoning": "string",
    "certainty": "string",
    "category": "string",
    "name": "string",
    "full_name": "string",
    "code_queries": "array<string>",
    "severity": "string",
    "onset": "string",
    "body_site": "array<string>",
    "caused_by": "array<string>",
    "negated": "boolean",
    "value": "string",
    "unit": "string",
    "codeset_hint": "string",
    "effective_date": "string",
    "status": "string",
    "intent": "string",
    "route": "string",
    "frequency": "string",
    "dose": "struct<value:string,unit:string>",
    "reason": "string",
    "performed": "string",
    "outcome": "string",
    "substance": "string",
    "substance_queries": "array<string>",
    "criticality": "string",
    "reaction": "string",
    "reaction_queries": "array<string>",
    "onset_age": "string",
    "exposure_route": "string",
    "verification": "string",
    "relationship": "string",
    "conditions": (
        "array<struct<name:string,queries:array<string>,onset_age:string,outcome:string,coding:" + CODINGS + ">>"
    ),
}
# Added by the coding step.
CODED_FIELDS = {
    "coding": CODINGS,
    "reaction_coding": CODINGS,
    "body_site_coding": CODINGS,
    "mcode_role": "string",
}
ALL_ITEM_FIELDS = {**ITEM_FIELDS, **CODED_FIELDS}

_CERTAINTY = ("definite", "probable", "uncertain")
# Per type: required fields, and enumerations of the typed fields.
ITEM_REQUIRED = {
    "Condition": ("source_sentences", "category", "name"),
    "Observation": ("source_sentences", "name", "value"),
    "MedicationRequest": ("source_sentences", "name", "status", "intent"),
    "Procedure": ("source_sentences", "name", "status"),
    "AllergyIntolerance": ("source_sentences", "substance"),
    "FamilyMemberHistory": ("source_sentences", "relationship"),
}
ITEM_ALLOWED = {
    "Condition": ("category", "name", "code_queries", "severity", "onset", "body_site", "caused_by", "negated"),
    "Observation": ("name", "full_name", "code_queries", "value", "unit", "codeset_hint", "effective_date", "category"),
    "MedicationRequest": ("name", "code_queries", "status", "intent", "route", "frequency", "dose", "reason"),
    "Procedure": ("name", "code_queries", "status", "category", "performed", "reason", "body_site", "outcome"),
    "AllergyIntolerance": (
        "substance", "substance_queries", "category", "criticality", "reaction", "reaction_queries", "severity",
        "onset_age", "exposure_route", "verification",
    ),
    "FamilyMemberHistory": ("relationship", "conditions"),
}
ITEM_COMMON = ("source_sentences", "reasoning", "certainty")
ITEM_ENUMS = {
    "Condition": {
        "certainty": _CERTAINTY,
        "category": ("diagnosis", "problem"),
        "severity": ("mild", "moderate", "severe"),
    },
    "Observation": {
        "certainty": _CERTAINTY,
        "codeset_hint": ("LOINC", "SNOMED"),
        "category": ("vital-signs", "laboratory", "social-history", "exam", "imaging", "survey"),
    },
    "MedicationRequest": {
        "certainty": _CERTAINTY,
        "status": ("active", "on-hold", "cancelled", "completed", "stopped", "draft", "unknown"),
        "intent": ("proposal", "plan", "order", "original-order", "instance-order"),
    },
    "Procedure": {
        "certainty": _CERTAINTY,
        "status": (
            "preparation", "in-progress", "not-done", "on-hold", "stopped", "completed", "entered-in-error", "unknown",
        ),
        "category": ("surgical", "diagnostic", "counselling", "education"),
    },
    "AllergyIntolerance": {
        "certainty": _CERTAINTY,
        "category": ("food", "medication", "environment", "biologic"),
        "criticality": ("low", "high", "unable-to-assess"),
        "severity": ("mild", "moderate", "severe"),
        "verification": ("unconfirmed", "confirmed", "refuted", "entered-in-error"),
    },
    "FamilyMemberHistory": {"certainty": _CERTAINTY},
}
ITEM_DATES = {"Observation": ("effective_date",), "Procedure": ("performed",)}


def make_item(**fields: Column) -> Column:
    """The wide item record; fields left out are typed nulls."""
    unknown = set(fields) - set(ALL_ITEM_FIELDS)
    if unknown:
        raise ValueError(f"unknown item fields: {sorted(unknown)}")
    return F.struct(
        *[
            fields.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in ALL_ITEM_FIELDS.items()
        ]
    )


def completeness_fields() -> dict[str, bool]:
    return {name: kind.startswith("array") for name, kind in ITEM_FIELDS.items()}


NOTE = (
    "patient_id string, document_id string, type string, date string, author string, text string, encounter_id string"
)
SOURCE_REFS = "array<struct<document_id:string,source_sentences:array<int>>>"
LLM_EVENT = (
    "event string, ts string, run_id string, call_id string, stage string, call_type string, model string, "
    "prompt_version string, document_id string, input_tokens bigint, cached_tokens bigint, output_tokens bigint, "
    "reasoning_tokens bigint, latency_ms bigint, usd_cost string, status string, error string, "
    "patient_id string, triggered_by string, field string, value string, reason string"
)
USAGE_RUN = (
    "id string, user_key string, workspace_id string, created_at timestamp, model string, input_tokens bigint, "
    "output_tokens bigint, reasoning_tokens bigint, cost_usd decimal(12,6), duration_ms bigint, doc_count bigint, "
    "status string, triggered_by string"
)
