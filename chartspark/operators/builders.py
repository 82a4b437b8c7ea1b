"""Candidate rows to FHIR R4 JSON: one struct expression per resource type.

``to_json`` leaves nulls out, and every optional element below is null when it is empty, so
no empty object or list is ever written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions import clinical as C
from chartspark.functions import text as T

_TERMINOLOGY = "http://terminology.hl7.org/CodeSystem/"


def obj(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def optional(condition: Column, value: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), value)


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def code_concept(system: str, code: Column) -> Column:
    return obj(coding=F.array(obj(system=F.lit(system), code=code)))


def text_concept(text: Column) -> Column:
    return obj(text=text)


def reference(kind: str, identifier: Column) -> Column:
    return obj(reference=F.concat(F.lit(kind + "/"), identifier))


def encounter_reference() -> Column:
    return optional(filled(F.col("encounter_ref")), obj(reference=F.col("encounter_ref")))


def subject() -> Column:
    return reference("Patient", F.col("patient_id"))


def profile(*urls: Column) -> Column:
    return obj(profile=F.array_compact(F.array(*urls)))


def age(text: Column) -> Column:
    years = T.parse_onset_age(text)
    return optional(years.isNotNull(), obj(value=years, unit=F.lit("a"), system=F.lit(V.UCUM), code=F.lit("a")))


def condition() -> Column:
    item = F.col("item")
    visit = (item["category"] == "diagnosis") & filled(F.col("encounter_ref"))
    visit = F.coalesce(visit, F.lit(False))
    category = F.when(visit, "encounter-diagnosis").otherwise("problem-list-item")
    sites = F.transform(
        item["body_site"],
        lambda s, i: obj(coding=F.array_compact(F.array(F.get(item["body_site_coding"], i))), text=s),
    )
    sites = F.transform(sites, lambda s: F.when(F.size(s["coding"]) > 0, s).otherwise(s.withField("coding", F.lit(None).cast(C.CODINGS))))
    dated = T.is_valid_partial_date(item["onset"])
    return obj(
        resourceType=F.lit("Condition"),
        meta=profile(F.when(visit, V.RESOURCE_PROFILES["Condition-encounter"]).otherwise(V.RESOURCE_PROFILES["Condition-problem"])),
        clinicalStatus=code_concept(_TERMINOLOGY + "condition-clinical", F.lit("active")),
        verificationStatus=code_concept(_TERMINOLOGY + "condition-ver-status", C.condition_verification(F.coalesce(item["certainty"], F.lit("probable")))),
        category=F.array(code_concept(_TERMINOLOGY + "condition-category", category)),
        severity=optional(filled(item["severity"]), text_concept(item["severity"])),
        code=C.codeable_concept(T.normalize_codings(item["coding"]), item["name"]),
        bodySite=optional(F.size(item["body_site"]) > 0, sites),
        subject=subject(),
        encounter=encounter_reference(),
        onsetDateTime=optional(filled(item["onset"]) & dated, item["onset"]),
        onsetString=optional(filled(item["onset"]) & ~dated, item["onset"]),
    )


def _loinc_codes(item: Column) -> Column:
    return F.transform(F.filter(F.coalesce(item["coding"], C.no_codings()), lambda c: c["system"] == V.LOINC), lambda c: c["code"])


def observation_profile(item: Column) -> Column:
    codes = _loinc_codes(item)
    vitals = F.create_map(*[F.lit(x) for code, key in V.VITAL_PROFILE_BY_LOINC.items() for x in (code, V.OBSERVATION_PROFILES[key])])
    by_category = F.create_map(*[F.lit(x) for pair in V.OBSERVATION_PROFILES.items() for x in pair])
    vital = F.get(F.filter(F.transform(codes, lambda c: vitals[c]), lambda p: p.isNotNull()), F.lit(0))
    return (
        F.when(F.array_contains(codes, V.BP_LOINC), V.OBSERVATION_PROFILES["bp"])
        .when(F.array_contains(codes, V.TOBACCO_LOINC), V.OBSERVATION_PROFILES["smokingstatus"])
        .when(F.array_contains(codes, V.OCCUPATION_LOINC), V.OBSERVATION_PROFILES["occupation"])
        .when(F.array_contains(codes, V.SEXUAL_ORIENTATION_LOINC), V.OBSERVATION_PROFILES["sexual-orientation"])
        .otherwise(F.coalesce(vital, by_category[F.coalesce(item["category"], F.lit("exam"))]))
    )


def observation() -> Column:
    item = F.col("item")
    value, unit = F.coalesce(item["value"], F.lit("")), item["unit"]
    codes, category = _loinc_codes(item), F.coalesce(item["category"], F.lit("exam"))
    concept = C.concept_by_code(item["coding"])
    amount, integer, pressure = C.quantity(value, unit), T.parse_integer(value), T.parse_blood_pressure(value)
    tobacco = F.array_contains(codes, V.TOBACCO_LOINC)
    # Shape of the value, first rule that applies.
    shape = (
        F.when(concept["kind"] == "integer", F.when(integer.isNotNull(), "integer").otherwise("string"))
        .when(concept["kind"] == "quantity", F.when(amount.isNotNull(), "quantity").otherwise("string"))
        .when(concept.isNotNull(), "concept")
        .when(item["mcode_role"] == V.ROLE_TUMOR_MARKER, F.when(amount.isNotNull(), "quantity").otherwise("concept"))
        .when(F.array_contains(codes, V.BP_LOINC), F.when(pressure.isNotNull(), "pressure").otherwise("string"))
        .when(tobacco, "tobacco")
        .when(category == "social-history", "concept")
        .when(filled(unit) & T.is_numeric(value), F.when(amount.isNotNull(), "quantity").otherwise("with_unit"))
        .otherwise("string")
    )
    lowered = T.strip(F.lower(value))
    habit = F.when(F.lit(False), C.coding(None, None))
    for word, code, display in V.TOBACCO_SNOMED:
        habit = habit.when(lowered.contains(word), C.coding(V.SNOMED, code, display))

    def part(code, display, number):
        return obj(
            code=obj(coding=F.array(obj(system=F.lit(V.LOINC), code=F.lit(code), display=F.lit(display)))),
            valueQuantity=obj(value=number, unit=F.lit("mmHg"), system=F.lit(V.UCUM), code=F.lit("mm[Hg]")),
        )

    url = observation_profile(item)
    return obj(
        resourceType=F.lit("Observation"),
        meta=optional(url.isNotNull(), profile(url)),
        status=F.lit("final"),
        category=F.array(code_concept(_TERMINOLOGY + "observation-category", category)),
        code=C.codeable_concept(item["coding"], T.first_text(item["full_name"], item["name"])),
        subject=subject(),
        encounter=encounter_reference(),
        effectiveDateTime=T.first_text(item["effective_date"], F.col("note_date")),
        valueInteger=optional(shape == "integer", integer),
        valueQuantity=optional(shape == "quantity", amount),
        valueCodeableConcept=optional(
            shape.isin("concept", "tobacco"), obj(coding=optional((shape == "tobacco") & habit.isNotNull(), F.array(habit)), text=value)
        ),
        valueString=optional(
            shape.isin("string", "with_unit"), F.when(shape == "with_unit", T.strip(F.concat(value, F.lit(" "), unit))).otherwise(value)
        ),
        component=optional(
            shape == "pressure",
            F.array(
                part("8480-6", "Systolic blood pressure", pressure["systolic"]),
                part("8462-4", "Diastolic blood pressure", pressure["diastolic"]),
            ),
        ),
    )


def medication_request() -> Column:
    item = F.col("item")
    dose = item["dose"]
    dose_text = T.strip(F.concat(F.coalesce(dose["value"], F.lit("")), F.lit(" "), F.coalesce(dose["unit"], F.lit(""))))
    number = dose["value"].try_cast("double")
    has_dosage = dose.isNotNull() | filled(item["route"]) | filled(item["frequency"])
    text = F.concat_ws(" ", F.when(dose.isNotNull(), dose_text), T.blank_to_null(item["route"]), T.blank_to_null(item["frequency"]))
    amount = F.array(obj(doseQuantity=obj(value=number, unit=F.coalesce(dose["unit"], F.lit("")))))
    return obj(
        resourceType=F.lit("MedicationRequest"),
        meta=profile(F.lit(V.RESOURCE_PROFILES["MedicationRequest"])),
        status=F.coalesce(item["status"], F.lit("active")),
        intent=F.coalesce(item["intent"], F.lit("order")),
        category=F.array(code_concept(_TERMINOLOGY + "medicationrequest-category", F.lit("outpatient"))),
        reportedBoolean=F.lit(True),
        medicationCodeableConcept=C.codeable_concept(item["coding"], item["name"]),
        subject=subject(),
        encounter=encounter_reference(),
        authoredOn=T.blank_to_null(F.col("note_date")),
        reasonCode=optional(filled(item["reason"]), F.array(text_concept(item["reason"]))),
        dosageInstruction=optional(has_dosage, F.array(obj(text=text, doseAndRate=optional(number.isNotNull(), amount)))),
    )


def procedure() -> Column:
    item = F.col("item")
    return obj(
        resourceType=F.lit("Procedure"),
        meta=profile(F.lit(V.RESOURCE_PROFILES["Procedure"])),
        status=F.coalesce(item["status"], F.lit("completed")),
        code=C.codeable_concept(item["coding"], item["name"]),
        subject=subject(),
        encounter=encounter_reference(),
        performedDateTime=T.first_text(item["performed"], F.col("note_date")),
        reasonCode=optional(filled(item["reason"]), F.array(text_concept(item["reason"]))),
        bodySite=optional(F.size(item["body_site"]) > 0, F.transform(item["body_site"], text_concept)),
        outcome=optional(filled(item["outcome"]), text_concept(item["outcome"])),
    )


def allergy_intolerance() -> Column:
    item = F.col("item")
    verification = C.allergy_verification(F.coalesce(item["certainty"], F.lit("probable")), item["verification"])
    has_reaction = filled(item["reaction"]) | filled(item["severity"]) | filled(item["exposure_route"])
    reaction = obj(
        manifestation=F.array(text_concept(F.coalesce(T.blank_to_null(item["reaction"]), F.lit("unknown")))),
        severity=T.blank_to_null(item["severity"]),
        exposureRoute=optional(filled(item["exposure_route"]), text_concept(item["exposure_route"])),
    )
    return obj(
        resourceType=F.lit("AllergyIntolerance"),
        meta=profile(F.lit(V.RESOURCE_PROFILES["AllergyIntolerance"])),
        clinicalStatus=optional(
            verification != "entered-in-error", code_concept(_TERMINOLOGY + "allergyintolerance-clinical", F.lit("active"))
        ),
        verificationStatus=code_concept(_TERMINOLOGY + "allergyintolerance-verification", verification),
        category=optional(filled(item["category"]), F.array(item["category"])),
        criticality=T.blank_to_null(item["criticality"]),
        code=C.codeable_concept(item["coding"], item["substance"]),
        patient=subject(),
        onsetAge=age(item["onset_age"]),
        reaction=optional(has_reaction, F.array(reaction)),
    )


def family_member_history() -> Column:
    item = F.col("item")
    conditions = F.transform(
        item["conditions"],
        lambda c: obj(
            code=C.codeable_concept(c["coding"], c["name"]), onsetAge=age(c["onset_age"]),
            outcome=optional(filled(c["outcome"]), text_concept(c["outcome"])),
        ),
    )
    return obj(
        resourceType=F.lit("FamilyMemberHistory"),
        status=F.lit("completed"),
        patient=subject(),
        relationship=C.codeable_concept(item["coding"], item["relationship"]),
        condition=optional(F.size(item["conditions"]) > 0, conditions),
    )


# Registry: resource type -> struct expression.
BUILDERS: dict[str, Callable[[], Column]] = {
    "Condition": condition,
    "Observation": observation,
    "MedicationRequest": medication_request,
    "Procedure": procedure,
    "AllergyIntolerance": allergy_intolerance,
    "FamilyMemberHistory": family_member_history,
}


def resource_json() -> Column:
    """FHIR JSON of a row with ``resource_type, item, patient_id, encounter_ref, note_date``."""
    rule = F.when(F.lit(False), F.lit(""))
    for kind, build in BUILDERS.items():
        rule = rule.when(F.col("resource_type") == kind, F.to_json(build()))
    return rule


def with_profiles(resource: Column, extra: Column) -> Column:
    """Add profile URLs to a resource's JSON text, keeping order and without repeats."""
    existing = F.from_json(F.get_json_object(resource, "$.meta.profile"), "array<string>")
    united = F.array_union(F.coalesce(existing, F.array().cast("array<string>")), F.coalesce(extra, F.array().cast("array<string>")))
    body = F.regexp_replace(resource, r'"meta":\{"profile":\[[^\]]*\]\},?', "")
    with_meta = F.concat(F.lit('{"meta":'), F.to_json(obj(profile=united)), F.lit(","), F.substr(body, F.lit(2)))
    return F.when(F.size(F.coalesce(extra, F.array().cast("array<string>"))) > 0, with_meta).otherwise(resource)


def extension_json(url: Column, datatype: Column, value: Column) -> Column:
    """One extension element; an unknown type or a missing value gives null."""
    number = value.try_cast("double")
    return F.when(
        filled(url) & value.isNotNull(),
        F.when(datatype == "boolean", F.to_json(obj(url=url, valueBoolean=value.try_cast("boolean"))))
        .when(datatype == "integer", F.to_json(obj(url=url, valueInteger=value.try_cast("int"))))
        .when(datatype == "code", F.to_json(obj(url=url, valueCode=value)))
        .when(datatype == "dateTime", F.to_json(obj(url=url, valueDateTime=value)))
        .when(datatype == "CodeableConcept", F.to_json(obj(url=url, valueCodeableConcept=obj(text=value))))
        .when(datatype == "Quantity", F.to_json(obj(url=url, valueQuantity=obj(value=number))))
        .when(F.coalesce(datatype, F.lit("string")) == "string", F.to_json(obj(url=url, valueString=value))),
    )


def with_extensions(resource: Column, extensions: Column) -> Column:
    """Append valued extensions (``array<struct<url,datatype,value>>``) to a resource's JSON text."""
    built = F.filter(
        F.transform(extensions, lambda e: extension_json(e["url"], e["datatype"], e["value"])), lambda j: j.isNotNull()
    )
    joined = F.array_join(built, ",")
    return F.when(
        F.size(built) > 0,
        F.concat(F.regexp_replace(resource, r"\}$", ""), F.lit(',"extension":['), joined, F.lit("]}")),
    ).otherwise(resource)
