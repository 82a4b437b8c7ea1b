"""Coding and resource expressions over coding arrays and item fields, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions.text import blank_to_null, contains_any, first_text, is_tumor_marker, squeezed_marker, strip

CODING = "struct<system:string,code:string,display:string,text:string>"
CODINGS = f"array<{CODING}>"


def coding(system, code, display=None, text=None) -> Column:
    def as_column(value):
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    return F.struct(
        as_column(system).alias("system"),
        as_column(code).alias("code"),
        as_column(display).alias("display"),
        as_column(text).alias("text"),
    )


def text_coding(text: Column) -> Column:
    return coding(None, None, None, text)


def no_codings() -> Column:
    return F.array().cast(CODINGS)


def real_codings(codings: Column) -> Column:
    """Codings with both a system and a code."""
    return F.filter(
        F.coalesce(codings, no_codings()),
        lambda c: (F.coalesce(c["system"], F.lit("")) != "") & (F.coalesce(c["code"], F.lit("")) != ""),
    )


def codeable_concept(codings: Column, text: Column) -> Column:
    """``struct(coding, text)``: real codings, else a text, else null."""
    real = real_codings(codings)
    fallback = F.get(
        F.filter(
            F.transform(F.coalesce(codings, no_codings()), lambda c: first_text(c["text"], c["display"])),
            lambda t: t.isNotNull(),
        ),
        F.lit(0),
    )
    label = first_text(text, fallback)
    return F.when(F.size(real) > 0, F.struct(real.alias("coding"), text.alias("text"))).otherwise(
        F.when(label.isNotNull(), F.struct(F.lit(None).cast(CODINGS).alias("coding"), label.alias("text")))
    )


# -- fixed codings --------------------------------------------------------------------------


def fixed_us_core(name: Column) -> Column:
    """Fixed LOINC coding of vital signs and social facts: exact term, then first contained term."""
    n = F.lower(F.coalesce(name, F.lit("")))
    rule = F.when(contains_any(n, V.SMOKING_TERMS), coding(V.LOINC, *V.SMOKING_CODING))
    for term, code, display in V.US_CORE_FIXED:
        rule = rule.when(n == term, coding(V.LOINC, code, display))
    for term, code, display in V.US_CORE_FIXED:
        rule = rule.when(n.contains(term), coding(V.LOINC, code, display))
    return rule


def fixed_family_role(relationship: Column) -> Column:
    key = strip(F.lower(relationship))
    rule = F.when(F.lit(False), text_coding(relationship))
    for term, code, display in V.FAMILY_ROLES:
        rule = rule.when(key == term, coding(V.ROLE_SYSTEM, code, display))
    return rule.otherwise(text_coding(relationship))


def tnm_coding(value: Column) -> Column:
    """LOINC of one TNM token: ``p`` in the prefix means pathologic, else clinical."""
    letter = F.upper(F.regexp_extract(value, V.TNM_TOKEN, 2))
    pathologic = F.lower(F.regexp_extract(value, V.TNM_TOKEN, 1)).contains("p")
    rule = F.when(F.lit(False), coding(None, None))
    for want, is_path, code, display, _ in V.TNM_CODES:
        rule = rule.when((letter == want) & (pathologic if is_path else ~pathologic), coding(V.LOINC, code, display))
    return rule


def oncology_concept(name: Column) -> Column:
    """Coding of the first oncology concept whose term occurs in the name."""
    n = F.lower(F.coalesce(name, F.lit("")))
    rule = F.when(F.lit(False), coding(None, None))
    for terms, system, code, display, _, _ in V.ONCOLOGY_CONCEPTS:
        rule = rule.when(contains_any(n, terms), coding(system, code, display))
    return rule


def marker_coding(name: Column) -> Column:
    n = squeezed_marker(name)
    rule = F.when(F.lit(False), coding(None, None))
    for _, forms, _, code, display in V.MARKER_FAMILIES:
        rule = rule.when(contains_any(n, forms), coding(V.LOINC, code, display))
    return rule


def _concept_table():
    for _, system, code, _, profile, kind in V.ONCOLOGY_CONCEPTS:
        yield system, code, profile, kind
    for _, _, code, _, profile in V.TNM_CODES:
        yield V.LOINC, code, profile, "codeable"


def concept_by_code(codings: Column) -> Column:
    """``struct(profile, kind)`` of the first coding that is an oncology concept; else null."""

    def look_up(c):
        rule = F.when(F.lit(False), F.struct(F.lit("").alias("profile"), F.lit("").alias("kind")))
        for system, code, profile, kind in _concept_table():
            rule = rule.when(
                (c["system"] == system) & (c["code"] == code),
                F.struct(F.lit(profile).alias("profile"), F.lit(kind).alias("kind")),
            )
        return rule

    found = F.transform(F.coalesce(codings, no_codings()), look_up)
    return F.get(F.filter(found, lambda s: s.isNotNull()), F.lit(0))


def tumor_marker_role(resource_type: Column, name: Column, specialty_on: Column) -> Column:
    """Role tag of a marker observation whose code is not fixed by an oncology concept."""
    tagged = (
        (resource_type == "Observation") & specialty_on & oncology_concept(name).isNull() & is_tumor_marker(name)
    )
    return F.when(tagged, F.lit(V.ROLE_TUMOR_MARKER))


def observation_systems(hint: Column, category: Column) -> Column:
    c = F.lower(F.coalesce(category, F.lit("")))
    return (
        F.when(hint == "LOINC", F.array(F.lit("loinc")))
        .when(hint == "SNOMED", F.array(F.lit("snomed")))
        .when(c.isin("vital-signs", "laboratory", "survey"), F.array(F.lit("loinc")))
        .otherwise(F.array(F.lit("snomed")))
    )


def default_systems(resource_type: Column, hint: Column, category: Column) -> Column:
    rule = F.when(resource_type == "Observation", observation_systems(hint, category))
    for kind, systems in V.DEFAULT_SYSTEMS.items():
        rule = rule.when(resource_type == kind, F.array(*[F.lit(s) for s in systems]))
    return rule.otherwise(F.array(F.lit("snomed")))


def systems_for(resource_type: Column, open_systems: Column, pinned_systems: Column) -> Column:
    """Open systems, then pinned-only systems; allergy and family history stay with their own."""
    return F.when(resource_type.isin("FamilyMemberHistory", "AllergyIntolerance"), open_systems).otherwise(
        F.array_union(open_systems, pinned_systems)
    )


# -- statuses ------------------------------------------------------------------------------------


def clinical_status(codings: Column) -> Column:
    """First status code; unset means active."""
    codes = F.filter(
        F.transform(F.coalesce(codings, no_codings()), lambda c: c["code"]), lambda code: F.coalesce(code, F.lit("")) != ""
    )
    return F.coalesce(F.get(codes, F.lit(0)), F.lit("active"))


def _mapped(value: Column, table: dict, default: str) -> Column:
    rule = F.when(F.lit(False), F.lit(""))
    for key, mapped in table.items():
        rule = rule.when(value == key, mapped)
    return rule.otherwise(default)


def condition_verification(certainty: Column) -> Column:
    return _mapped(certainty, V.CONDITION_VERIFICATION, "provisional")


def allergy_verification(certainty: Column, explicit: Column) -> Column:
    return F.when(explicit.isin(*V.ALLERGY_VERIFICATION_CODES), explicit).otherwise(
        _mapped(certainty, V.ALLERGY_VERIFICATION, "unconfirmed")
    )


def is_discontinued(resource_type: Column, status: Column) -> Column:
    return F.coalesce((resource_type == "MedicationRequest") & status.isin(*V.DISCONTINUED_STATUSES), F.lit(False))


def is_negated(resource_type: Column, negated: Column) -> Column:
    return F.coalesce((resource_type == "Condition") & negated, F.lit(False))


# -- cancer -------------------------------------------------------------------------------------------


def names_cancer(text: Column) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), V.CANCER_TERMS)


def cancer_role(codings: Column, text: Column) -> Column:
    """``primary`` / ``secondary`` / null from ICD-10-CM ranges and wording."""
    codings = F.coalesce(codings, no_codings())
    words = F.lower(
        F.concat_ws(" ", text, F.array_join(F.transform(codings, lambda c: F.coalesce(c["display"], F.lit(""))), " "))
    )
    icd = F.filter(
        F.transform(F.filter(codings, lambda c: c["system"] == V.ICD10CM), lambda c: F.upper(c["code"])),
        lambda code: code.startswith("C"),
    )
    secondary = contains_any(words, V.SECONDARY_TERMS) | F.exists(
        icd, lambda code: F.substring(code, 1, 3).isin("C77", "C78", "C79")
    )
    return F.when(
        contains_any(words, V.CANCER_TERMS) | (F.size(icd) > 0), F.when(secondary, "secondary").otherwise("primary")
    )


def site_tokens(site_texts: Column) -> Column:
    """Organ words of body-site texts; sides and generic words are dropped."""
    words = F.flatten(
        F.transform(
            F.coalesce(site_texts, F.array().cast("array<string>")),
            lambda t: F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"([a-z]+)"), F.lit(1)),
        )
    )
    long_enough = F.filter(words, lambda w: F.length(w) > 2)
    return F.array_except(long_enough, F.array(*[F.lit(w) for w in V.SITE_STOPWORDS]))


# -- quantities ---------------------------------------------------------------------------------------


def quantity(value: Column, unit: Column) -> Column:
    """FHIR quantity of a number with an optional comparator; null when it is not a number."""
    text = strip(F.coalesce(value, F.lit("")))
    number = F.regexp_extract(text, V.NUMBER_WITH_COMPARATOR, 2).try_cast("double")
    sign = F.regexp_extract(text, V.NUMBER_WITH_COMPARATOR, 1)
    comparator = F.when(F.lit(False), F.lit(""))
    for symbol, mapped in V.COMPARATORS.items():
        comparator = comparator.when(sign == symbol, mapped)
    ucum = F.when(F.lit(False), F.lit(""))
    for shown, code in V.UCUM_CODES.items():
        ucum = ucum.when(unit == shown, code)
    return F.when(
        number.isNotNull(),
        F.struct(
            number.alias("value"),
            comparator.alias("comparator"),
            blank_to_null(unit).alias("unit"),
            F.when(ucum.isNotNull(), F.lit(V.UCUM)).alias("system"),
            ucum.alias("code"),
        ),
    )


def call_cost(input_tokens: Column, cached_tokens: Column, output_tokens: Column, rates: Column, regional: Column) -> Column:
    """USD of one call, exact decimals, six places half-even. ``rates``: struct(input, cached, output) per million."""
    dec = "decimal(20,0)"
    billed = F.greatest(input_tokens - cached_tokens, F.lit(0)).cast(dec)
    micro = (
        billed * rates["input"] + cached_tokens.cast(dec) * rates["cached"] + output_tokens.cast(dec) * rates["output"]
    ).cast("decimal(28,6)")
    uplift = F.when(regional, F.lit(V.REGIONAL_UPLIFT)).otherwise(F.lit("1")).cast("decimal(4,2)")
    # Dividing by a million moves the point: scale 6 + 2 becomes 12 + 2, nothing is lost.
    exact = micro * uplift * F.lit("0.000001").cast("decimal(6,6)")
    return F.coalesce(F.bround(exact, 6), F.lit(0)).cast("decimal(12,6)")
