"""Scored facts to reviewable proposals: filter, build, profile, gate, cite, link."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions import clinical as C
from chartspark.functions import text as T
from chartspark.functions.fhir import display_label, view
from chartspark.operators import builders
from chartspark.sources.catalog import rule_key

MCODE = "mcode-"
Stage = Callable[[DataFrame, str], DataFrame]


def is_negated_assertion() -> Column:
    kind = F.col("resource_type")
    return C.is_negated(kind, F.col("item.negated")) | C.is_discontinued(kind, F.col("item.status"))


def reviewable(scored: DataFrame) -> DataFrame:
    """Duplicates leave, and so do new facts that deny something."""
    kind = F.col("classification")
    return scored.where((kind != "DUPLICATE") & ~((kind == "NEW") & is_negated_assertion()))


def primary_codings() -> Column:
    """Codings a preset gates: those of the resource's own concept, or of family conditions."""
    family = F.flatten(
        F.transform(
            F.coalesce("item.conditions", F.lit(None)), lambda c: C.real_codings(c["coding"])
        )
    )
    own = C.real_codings(T.normalize_codings(F.coalesce("item.coding", C.no_codings())))
    return F.when(F.col("resource_type") == "FamilyMemberHistory", F.coalesce(family, C.no_codings())).otherwise(own)


def open_uris(open_systems: Column) -> Column:
    uris = F.create_map(*[F.lit(x) for pair in V.SYSTEM_URIS.items() for x in pair])
    return F.filter(F.transform(open_systems, lambda k: uris[k]), lambda u: u.isNotNull())


def code_allowed(codings: Column, open_systems: Column, pinned: Column, fixed: Column) -> Column:
    """True unless the rule restricts codes and none of the primary codings is open, pinned or fixed."""
    exact = F.concat(F.coalesce(pinned, F.array().cast(f"array<{_CODE}>")), F.coalesce(fixed, F.array().cast(f"array<{_CODE}>")))
    unrestricted = open_systems.isNull()
    hit = F.exists(
        codings,
        lambda c: unrestricted
        | F.array_contains(open_uris(open_systems), c["system"])
        | F.exists(exact, lambda p: (p["system"] == c["system"]) & (p["code"] == c["code"])),
    )
    return (F.size(codings) == 0) | F.coalesce(hit, F.lit(False))


_CODE = "struct<system:string,code:string,display:string>"


def coding_subset_issues(rows: DataFrame) -> DataFrame:
    """One row per primary coding outside the rule. Needs ``id, codings, open_systems, pinned, fixed``."""
    exact = F.concat("pinned", "fixed")
    outside = F.filter(
        "codings",
        lambda c: ~F.array_contains(open_uris(F.col("open_systems")), c["system"])
        & ~F.exists(exact, lambda p: (p["system"] == c["system"]) & (p["code"] == c["code"])),
    )
    return rows.where(F.col("open_systems").isNotNull()).select("id", F.explode(outside).alias("c")).select(
        "id", F.lit("error").alias("severity"), F.concat(F.lit("coding "), "c.system", F.lit("|"), "c.code", F.lit(" outside preset allow-list")).alias("message")
    )


# -- specialty profiles --------------------------------------------------------------------------------


def cancer_sites(rows: DataFrame) -> DataFrame:
    """(patient, token) of the body sites of cancer conditions, and whether a primary has it."""
    role = C.cancer_role(F.col("item.coding"), F.col("item.name"))
    return (
        rows.where((F.col("resource_type") == "Condition") & role.isNotNull())
        .select("patient_id", role.alias("role"), F.explode(C.site_tokens(F.col("item.body_site"))).alias("token"))
        .groupBy("patient_id", "token")
        .agg(F.bool_or(F.col("role") == "primary").alias("of_primary"))
    )


def surgery_by_cancer_site(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Surgical procedures whose reason names a cancer or whose site is a cancer's site."""
    surgical = rows.where((F.col("resource_type") == "Procedure") & (F.col("item.category") == "surgical"))
    by_reason = surgical.where(C.names_cancer(F.col("item.reason"))).select("cand_id")
    by_site = (
        surgical.select("cand_id", "patient_id", F.explode(C.site_tokens(F.col("item.body_site"))).alias("token"))
        .join(sites.select("patient_id", "token"), ["patient_id", "token"], "left_semi")
        .select("cand_id")
    )
    return by_reason.unionByName(by_site).distinct()


def leaked_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Secondary cancers whose site words all belong to the patient's primary cancers."""
    role = C.cancer_role(F.col("item.coding"), F.col("item.name"))
    return (
        rows.where((F.col("resource_type") == "Condition") & (role == "secondary"))
        .select("cand_id", "patient_id", F.explode(C.site_tokens(F.col("item.body_site"))).alias("token"))
        .join(sites.where("of_primary").select("patient_id", "token", F.lit(True).alias("known")), ["patient_id", "token"], "left")
        .groupBy("cand_id")
        .agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("leaked"))
        .where("leaked")
        .select("cand_id")
    )


def drop_leaked_site(rows: DataFrame, sites: DataFrame) -> DataFrame:
    leaked = leaked_sites(rows, sites).withColumn("leaked", F.lit(True))
    bare = F.col("item").withField("body_site", F.lit(None).cast("array<string>"))
    return (
        rows.join(leaked, "cand_id", "left")
        .withColumn("item", F.when(F.coalesce("leaked", F.lit(False)), bare).otherwise(F.col("item")))
        .drop("leaked")
    )


def specialty_profile(candidate_profiles: Column, cancer_surgery: Column) -> Column:
    """The one candidate profile that fits the row, or null."""
    kind = F.col("resource_type")
    role = C.cancer_role(F.col("item.coding"), F.col("item.name"))
    concept = C.concept_by_code(C.real_codings(F.col("item.coding")))
    needle = (
        F.when((kind == "Condition") & role.isNotNull(), F.concat(F.lit(MCODE), role, F.lit("-cancer-condition")))
        .when((kind == "Observation") & concept.isNotNull(), F.concat(F.lit(MCODE), concept["profile"]))
        .when((kind == "Observation") & (F.col("item.mcode_role") == V.ROLE_TUMOR_MARKER), F.lit("mcode-tumor-marker-test"))
        .when((kind == "Procedure") & F.coalesce(cancer_surgery, F.lit(False)), F.lit("mcode-cancer-related-surgical-procedure"))
        .when((kind == "MedicationRequest") & C.names_cancer(F.col("item.reason")), F.lit("mcode-cancer-related-medication-request"))
    )
    return F.get(F.filter(candidate_profiles, lambda p: p.contains(needle)), F.lit(0))


# -- proposals ---------------------------------------------------------------------------------------------


def with_rules(rows: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Rule columns of the row's type and, where rules are by preset, of its ``preset_id``; nothing is restricted without rules.

    ``rules``: ``resource_type, open_systems, pinned, fixed, profiles, candidate_profiles, extensions``, and ``preset_id`` as from ``effective_rules``.
    """
    codes = f"array<{_CODE}>"
    empty = {
        "open_systems": "array<string>", "pinned": codes, "fixed": codes, "profiles": "array<string>",
        "candidate_profiles": "array<string>", "extensions": "array<struct<url:string,attach_to:string,datatype:string,value:string>>",
    }
    if rules is None:
        return rows.withColumns({name: F.lit(None).cast(kind) for name, kind in empty.items()})
    key = rule_key(rows, rules)
    return rows.join(rules.select(*key, *[F.col(c).cast(k).alias(c) for c, k in empty.items()]), key, "left")


def assemble(
    scored: DataFrame, note_dates: DataFrame, encounters: DataFrame, rules: DataFrame | None = None, stage: Stage = lambda df, name: df
) -> DataFrame:
    """Proposals of the reviewable facts. ``stage`` fixes the outputs that several steps read.

    ``scored`` as from ``with_confidence`` plus ``encounter_key, merge_reasoning``;
    ``note_dates``: ``cand_id, note_date`` (first source note with a date);
    ``encounters``: ``patient_id, encounter_id, encounter_ref``.
    """
    from chartspark.operators.citations import with_encounter_ref

    rows = stage(with_rules(with_encounter_ref(reviewable(scored), encounters).join(note_dates, "cand_id", "left"), rules), "reviewable")
    sites = cancer_sites(rows)
    surgery = surgery_by_cancer_site(rows, sites).withColumn("cancer_surgery", F.lit(True))
    rows = drop_leaked_site(rows, sites.where("of_primary")).join(surgery, "cand_id", "left")
    allowed = rows.where(code_allowed(primary_codings(), F.col("open_systems"), F.col("pinned"), F.col("fixed")))
    chosen = specialty_profile(F.col("candidate_profiles"), F.col("cancer_surgery"))
    extra = F.concat(F.coalesce("profiles", F.array().cast("array<string>")), F.array_compact(F.array(chosen)))
    # One step per column: each builds on the finished text of the one before.
    built = (
        allowed.withColumn("extra_profiles", extra)
        .withColumn("resource", builders.resource_json())
        .withColumn("resource", builders.with_profiles(F.col("resource"), F.col("extra_profiles")))
        .withColumn("resource", builders.with_extensions(F.col("resource"), F.col("extensions")))
    )
    proposals = built.select(
        T.stable_id("prop", F.col("patient_id"), F.col("cand_id")).alias("id"),
        "patient_id", "cand_id", "cand_pos", "resource_type", "resource", "item", "classification",
        F.col("reasoning").alias("classification_reasoning"),
        F.coalesce("item.reasoning", F.lit("")).alias("extraction_reasoning"),
        "merge_reasoning", "match_type", "match_key", "match_resource_id", "confidence_score", "confidence_tier", "flags", "confidence_breakdown",
        F.when(F.col("classification") == "UPDATING", F.array("match_resource_id")).otherwise(F.array().cast("array<string>")).alias("supersedes"),
    )
    return link_conflicts(stage(proposals, "proposals"))


def medication_ingredient() -> Column:
    shown = F.filter(
        F.transform(C.real_codings(F.col("item.coding")), lambda c: T.normalize_ingredient(F.coalesce(c["display"], F.lit("")))),
        lambda i: i != "",
    )
    return T.first_text(F.get(shown, F.lit(0)), T.normalize_ingredient(F.coalesce("item.name", F.lit(""))))


def medication_conflicts(proposals: DataFrame) -> DataFrame:
    """Proposals of ingredients that are both stopped and not stopped: ``id, conflict_group_id, stopped``.

    Only group facts are aggregated; who contradicts whom is read by joining members on the
    group id, so a large group is never expanded into pairs.
    """
    drugs = (
        proposals.where(F.col("resource_type") == "MedicationRequest")
        .withColumn("ingredient", medication_ingredient())
        .withColumn("stopped", C.is_discontinued(F.col("resource_type"), F.col("item.status")))
        .where("ingredient IS NOT NULL")
    )
    groups = (
        drugs.groupBy("patient_id", "ingredient")
        .agg(F.count(F.lit(1)).alias("members"), F.bool_or("stopped").alias("any_stopped"), F.bool_and("stopped").alias("all_stopped"))
        .where("any_stopped AND NOT all_stopped")
        .withColumn("conflict_group_id", T.stable_id("cg", F.col("patient_id"), F.col("ingredient")))
    )
    return drugs.join(groups, ["patient_id", "ingredient"]).select("id", "cand_pos", "conflict_group_id", "stopped", "members", F.coalesce("item.name", F.lit("")).alias("label"))


def conflict_members(proposals: DataFrame) -> DataFrame:
    """One row per member of a conflict group: ``conflict_group_id, later, cand_pos, id, label``; stopped ones are not ``later``.

    A reader of a proposal finds whom it contradicts here, in the order ``later, cand_pos``.
    """
    return medication_conflicts(proposals).select("conflict_group_id", (~F.col("stopped")).alias("later"), "cand_pos", "id", "label")


def link_conflicts(proposals: DataFrame) -> DataFrame:
    """Adds ``conflict_group_id``, lifts members to ATTENTION and flags each with the number of others.

    Names of the others are rows of ``conflict_members``: a flag has one size however large its group is.
    """
    flag = F.concat(F.lit("Inter-note conflict: contradicts "), (F.col("members") - 1).cast("string"), F.lit(" in its group"))
    own = medication_conflicts(proposals).select("id", "conflict_group_id", flag.alias("conflict_flag"))
    linked = proposals.join(own, "id", "left")
    return (
        linked.withColumn("confidence_tier", F.when(F.col("conflict_group_id").isNotNull(), "ATTENTION").otherwise(F.col("confidence_tier")))
        .withColumn("flags", F.concat("flags", F.array_compact(F.array("conflict_flag"))))
        .drop("conflict_flag")
    )


def auto_reject_siblings(decisions: DataFrame, groups: DataFrame) -> DataFrame:
    """Accepting one proposal of a conflict group rejects the undecided rest.

    ``decisions``: ``id, action``; ``groups``: ``id, conflict_group_id``.
    """
    accepted = decisions.where("action = 'accept'").join(groups, "id").select("conflict_group_id").distinct()
    rest = groups.join(accepted, "conflict_group_id", "left_semi").join(decisions, "id", "left_anti")
    return rest.select("id", F.lit("reject").alias("action"))


# -- review ------------------------------------------------------------------------------------------------------


def review_records(proposals: DataFrame, run_id: str) -> DataFrame:
    """The review record: 24 keys less the nested evidence, which stays in its own tables by ``id``."""
    none = F.lit(None).cast("string")
    return proposals.select(
        "id", F.lit(run_id).alias("run_id"), "resource_type", "classification", "confidence_tier",
        F.round("confidence_score", 3).alias("confidence_score"), F.lit("pending").alias("status"),
        display_label(view(F.col("resource"))).alias("display_label"), "flags", "conflict_group_id", "resource",
        "classification_reasoning", "extraction_reasoning", "merge_reasoning", "confidence_breakdown", "supersedes",
        none.alias("reviewed_at"), none.alias("reviewed_by"), none.alias("rejection_reason"), none.alias("provenance_resource"), none.alias("write_result"),
    )


def review_queue(records: DataFrame, status=None, tier=None, resource_type=None, classification=None, text=None) -> DataFrame:
    """Filtered queue, ATTENTION first, then by type."""
    for column, value in (("status", status), ("confidence_tier", tier), ("resource_type", resource_type), ("classification", classification)):
        if value:
            records = records.where(F.col(column) == value)
    if text:
        records = records.where(F.lower("display_label").contains(text.lower()))
    place = F.array_position(F.array(*[F.lit(x) for x in V.TIER_ORDER]), F.col("confidence_tier"))
    return records.orderBy(place, "resource_type", "id")


def facet_counts(records: DataFrame) -> DataFrame:
    """Counts by tier, type, class and status, in one pass."""
    from chartspark.operators.quality import corpus_manifest

    return corpus_manifest(records, ["confidence_tier", "resource_type", "classification", "status"]).where("dimension <> 'total'")


def headline() -> Column:
    """One-line text of a candidate item."""
    i, kind = F.col("item"), F.col("resource_type")

    def shown(label, text):
        return F.concat(F.lit(label), F.coalesce(text, F.lit("None")))

    def plain(text):
        return F.coalesce(text, F.lit(""))

    conditions = F.array_join(F.transform(i["conditions"], lambda c: F.concat(c["name"], F.lit(" @ "), F.coalesce(T.blank_to_null(c["onset_age"]), F.lit("?")))), ", ")
    return (
        F.when(kind == "Condition", F.concat_ws(
            " | ", T.blank_to_null(i["name"]), F.concat(F.lit("severity="), T.blank_to_null(i["severity"])), F.concat(F.lit("onset="), T.blank_to_null(i["onset"]))))
        .when(kind == "Observation", T.strip(F.concat(plain(i["name"]), F.lit(" = "), plain(i["value"]), F.lit(" "), plain(i["unit"]))))
        .when(kind == "MedicationRequest", T.strip(F.concat(
            plain(i["name"]), F.lit(" "), plain(F.concat(i["dose"]["value"], i["dose"]["unit"])), F.lit(" "), plain(i["frequency"]), F.lit(" ["), plain(i["status"]), F.lit("]"))))
        .when(kind == "Procedure", F.concat_ws(" ", plain(i["name"]), shown("performed=", i["performed"]), shown("status=", i["status"])))
        .when(kind == "AllergyIntolerance", F.concat_ws(
            " ", plain(i["substance"]), shown("reaction=", i["reaction"]), shown("severity=", i["severity"]), shown("criticality=", i["criticality"]),
            shown("route=", i["exposure_route"]), shown("onset_age=", i["onset_age"])))
        .when(kind == "FamilyMemberHistory", F.concat(plain(i["relationship"]), F.lit(": "), plain(conditions)))
        .otherwise(F.to_json(i))
    )


def candidate_trace(items: DataFrame, classified: DataFrame) -> DataFrame:
    """What happened to each observation: parsed fields, systems, fixed coding, final coding, verdict."""
    name = T.first_text(F.col("item.full_name"), F.col("item.name"))
    parsed = items.where(F.col("resource_type") == "Observation").select(
        "cand_id", name.alias("name"), F.col("item.value").alias("value"),
        F.array_join(C.observation_systems(F.col("item.codeset_hint"), F.col("item.category")), ",").alias("systems"),
        C.fixed_us_core(name)["code"].alias("fixed_code"),
        F.array_join(F.transform(C.real_codings(F.col("item.coding")), lambda c: c["code"]), ",").alias("final_codes"),
    )
    return parsed.join(classified.select("cand_id", "classification", "reasoning"), "cand_id", "left")


def coding_coverage(proposals: DataFrame) -> DataFrame:
    """Proposals with and without a real code."""
    real = F.exists(F.coalesce("item.coding", C.no_codings()), lambda c: c["system"].isNotNull() & (F.coalesce(c["code"], F.lit("")) != ""))
    return proposals.agg(F.count_if(real).alias("coded"), F.count_if(~real).alias("uncoded"))


def stage_counters(**stages: DataFrame) -> DataFrame:
    """Row counts of named stages, as rows."""
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out


def patient_header(resources: DataFrame) -> DataFrame:
    """Name, birth date, sex and record number from Patient resources (``patient_id, resource``)."""
    kind = (
        "name array<struct<given:array<string>,family:string>>, birthDate string, gender string,"
        "identifier array<struct<value:string,type:struct<text:string,coding:array<struct<code:string>>>>>"
    )
    p = resources.select("patient_id", F.from_json("resource", kind).alias("p"))
    first = F.get("p.name", F.lit(0))
    name = F.trim(F.concat(F.coalesce(F.array_join(first["given"], " "), F.lit("")), F.lit(" "), F.coalesce(first["family"], F.lit(""))))
    record = F.filter(
        "p.identifier",
        lambda i: F.coalesce(F.get(i["type"]["coding"], F.lit(0))["code"] == "MR", F.lit(False))
        | F.coalesce(F.lower(i["type"]["text"]).contains("medical record"), F.lit(False)),
    )
    return p.select(
        "patient_id", T.blank_to_null(name).alias("patient_name"), F.col("p.birthDate").alias("birth_date"), F.col("p.gender").alias("sex"),
        F.coalesce(F.get(record, F.lit(0))["value"], F.get("p.identifier", F.lit(0))["value"]).alias("mrn"),
    )
