"""Check queries of builders, assembly, review and conformance."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions import clinical as C
from chartspark.functions import text as T
from chartspark.functions.fhir import display_label, summary_rows, view
from chartspark.harness import merging
from chartspark.harness import sqltext as S
from chartspark.harness.registry import query, with_json
from chartspark.harness.tables import CANDIDATES, candidate_items, candidate_items_once, chart_facts
from chartspark.operators import assembly, builders, conformance, merge, structure
from chartspark.plans.augmentation import reconcile_and_score
from chartspark.plans.counters import RunCounters
from chartspark.session import fixed
from chartspark.sources.notes import guardrail_check

_K = "CAST(split_part(cand_id, '-', 4) AS BIGINT)"
CLASS = f"CASE {_K} % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'DUPLICATE' WHEN 2 THEN 'UPDATING' ELSE 'CONFLICTING' END"
TIER = f"CASE {_K} % 3 WHEN 0 THEN 'ATTENTION' WHEN 1 THEN 'REVIEW' ELSE 'CONFIDENT' END"
CLASSED = f"classed AS (SELECT *, {CLASS} AS classification, {TIER} AS confidence_tier FROM ({CANDIDATES}))"


def _with_classes(items):
    """``CLASS`` and ``TIER`` by position: their CASE forms would work out the id and its part again for every branch."""
    pick = lambda n, *names: F.get(F.array(*(F.lit(x) for x in names)), F.expr(f"{_K} % {n}").cast("int"))
    return items.withColumn("classification", pick(4, "NEW", "DUPLICATE", "UPDATING", "CONFLICTING")).withColumn(
        "confidence_tier", pick(3, "ATTENTION", "REVIEW", "CONFIDENT")
    )


def _classed(t):
    return _with_classes(candidate_items(t))


_KEEP = "classification <> 'DUPLICATE' AND NOT (classification = 'NEW' AND (coalesce(negated, false) OR coalesce(status = 'stopped' AND resource_type = 'MedicationRequest', false)))"
_MED_STOP = f"coalesce(status IN ({S.names(V.DISCONTINUED_STATUSES)}) AND resource_type = 'MedicationRequest', false)"


@query("reviewable", "B4", f"WITH {CLASSED} SELECT cand_id, classification FROM classed WHERE classification <> 'DUPLICATE' AND NOT (classification = 'NEW' AND (coalesce(negated, false) OR {_MED_STOP}))")
def _(t):
    return assembly.reviewable(_with_classes(candidate_items_once(t))).select("cand_id", "classification")


def _rules(t):
    """One rule row per type, keyed off the five regions: some types open, some pinned, some free."""
    code = "struct<system:string,code:string,display:string>"
    k = F.col("r_regionkey")
    kinds = F.array(*[F.lit(x) for x in V.RESOURCE_TYPES])
    pins = F.transform(
        F.sequence(F.lit(0), F.lit(149)),
        lambda i: F.struct(F.lit(V.SNOMED).alias("system"), (1000000 + i * 2 + 1).cast("string").alias("code"), F.lit("").alias("display")),
    )
    return t.region.select(
        F.get(kinds, k).alias("resource_type"),
        F.when(k == 0, F.array(F.lit("icd10"))).when(k == 3, F.array().cast("array<string>")).alias("open_systems"),
        F.when(k == 3, pins).otherwise(F.array().cast(f"array<{code}>")).alias("pinned"), F.array().cast(f"array<{code}>").alias("fixed"),
        F.array().cast("array<string>").alias("profiles"), F.array().cast("array<string>").alias("candidate_profiles"),
        F.array().cast("array<struct<url:string,attach_to:string,datatype:string,value:string>>").alias("extensions"),
    )


_CODE3 = "TRY_CAST(code0 AS BIGINT)"
# Condition: icd10 open (every coded condition has one); Procedure: nothing open, odd concepts pinned; others free.
@query(
    "code_allowed", "B5 H42",
    f"SELECT cand_id, uncoded OR resource_type <> 'Procedure' OR ({_CODE3} BETWEEN 1000001 AND 1000299 AND {_CODE3} % 2 = 1) AS allowed FROM ({CANDIDATES}) WHERE resource_type IN ('Condition', 'Procedure', 'Observation')",
)
def _(t):
    rows = assembly.with_rules(candidate_items(t).where("resource_type IN ('Condition', 'Procedure', 'Observation')"), _rules(t))
    return rows.select("cand_id", assembly.code_allowed(assembly.primary_codings(), F.col("open_systems"), F.col("pinned"), F.col("fixed")).alias("allowed"))


@query(
    "check_coding_subset", "J2",
    f"""SELECT cand_id AS id, 'coding http://snomed.info/sct|' || code0 || ' outside preset allow-list' AS message FROM ({CANDIDATES})
        WHERE NOT uncoded AND (resource_type = 'Condition' OR (resource_type = 'Procedure' AND NOT ({_CODE3} BETWEEN 1000001 AND 1000299 AND {_CODE3} % 2 = 1)))""",
)
def _(t):
    rows = assembly.with_rules(candidate_items(t), _rules(t)).withColumn("codings", assembly.primary_codings())
    return assembly.coding_subset_issues(rows.withColumnRenamed("cand_id", "id")).select("id", "message")


# -- cancer rules: the name of a condition decides, body sites come from the lines ---------------------------

_CONDITION = "CASE WHEN name LIKE 'Acute%' THEN name || ' carcinoma' WHEN name LIKE '%red%' OR name LIKE '%old%' THEN 'metastatic cancer of ' || name ELSE name END"
CANCER = f"""onc AS (SELECT *, {_CONDITION} AS label FROM ({CANDIDATES}) WHERE resource_type IN ('Condition', 'Procedure')),
    roles AS (SELECT *, CASE WHEN resource_type = 'Condition' AND {S.any_of('lower(label)', V.CANCER_TERMS)} THEN CASE WHEN {S.any_of('lower(label)', V.SECONDARY_TERMS)} THEN 'secondary' ELSE 'primary' END END AS role,
      CASE WHEN resource_type = 'Procedure' THEN split_part(name, ' ', 2) || ' of left arm' ELSE body_site END AS site FROM onc),
    words AS (SELECT DISTINCT cand_id, patient_id, role, resource_type, category, unnest(regexp_extract_all(lower(coalesce(site, '')), '[a-z]+')) AS token FROM roles),
    kept AS (SELECT * FROM words WHERE length(token) > 2 AND token NOT IN ({S.names(V.SITE_STOPWORDS)}))"""


def _oncology(t):
    items = candidate_items(t).where("resource_type IN ('Condition', 'Procedure')")
    name = F.col("item.name")
    label = F.when(F.col("resource_type") == "Procedure", name).when(name.startswith("Acute"), F.concat(name, F.lit(" carcinoma"))).when(
        name.contains("red") | name.contains("old"), F.concat(F.lit("metastatic cancer of "), name)
    ).otherwise(name)
    site = F.when(F.col("resource_type") == "Procedure", F.array(F.concat(F.split_part(name, F.lit(" "), F.lit(2)), F.lit(" of left arm")))).otherwise(F.col("item.body_site"))
    bare = F.col("item").withField("name", label).withField("body_site", site).withField("coding", C.no_codings())
    return items.withColumn("item", bare)


@query(
    "surgery_by_cancer_site", "C23",
    f"""WITH {CANCER} SELECT DISTINCT cand_id FROM kept p WHERE resource_type = 'Procedure' AND category = 'surgical' AND EXISTS (SELECT 1 FROM kept c WHERE c.role IS NOT NULL AND c.patient_id = p.patient_id AND c.token = p.token)""",
)
def _(t):
    rows = _oncology(t)
    return assembly.surgery_by_cancer_site(rows, assembly.cancer_sites(rows))


@query(
    "drop_leaked_site", "C24",
    f"""WITH {CANCER} SELECT cand_id FROM kept m WHERE role = 'secondary' GROUP BY cand_id, patient_id
        HAVING bool_and(EXISTS (SELECT 1 FROM kept c WHERE c.role = 'primary' AND c.patient_id = m.patient_id AND c.token = m.token))""",
)
def _(t):
    rows = _oncology(t)
    return assembly.leaked_sites(rows, assembly.cancer_sites(rows))


_PROFILES = ("primary-cancer-condition", "secondary-cancer-condition", "cancer-related-surgical-procedure")


@query(
    "specialty_profile", "I9",
    f"""WITH {CANCER}, s AS (SELECT DISTINCT cand_id FROM kept p WHERE resource_type = 'Procedure' AND category = 'surgical' AND EXISTS (SELECT 1 FROM kept c WHERE c.role IS NOT NULL AND c.patient_id = p.patient_id AND c.token = p.token))
        SELECT r.cand_id, CASE WHEN role IS NOT NULL THEN 'http://x/mcode-' || role || '-cancer-condition' WHEN s.cand_id IS NOT NULL THEN 'http://x/mcode-cancer-related-surgical-procedure' END AS profile FROM roles r LEFT JOIN s USING (cand_id)""",
)
def _(t):
    rows = _oncology(t)
    surgery = assembly.surgery_by_cancer_site(rows, assembly.cancer_sites(rows)).withColumn("cancer_surgery", F.lit(True))
    offered = F.array(*[F.lit("http://x/mcode-" + p) for p in _PROFILES])
    return rows.join(surgery, "cand_id", "left").select("cand_id", assembly.specialty_profile(offered, F.col("cancer_surgery")).alias("profile"))


# -- conflicts between proposals ------------------------------------------------------------------------------------

_ING = S.normalize_ingredient("display0")
DRUGS = f"""drugs AS (SELECT *, coalesce(CASE WHEN NOT uncoded THEN nullif({_ING}, '') END, {S.normalize_ingredient("name")}) AS ingredient, status = 'stopped' AS stopped FROM ({CANDIDATES}) WHERE resource_type = 'MedicationRequest'),
    clash AS (SELECT *, count(*) OVER w AS members FROM drugs WINDOW w AS (PARTITION BY patient_id, ingredient) QUALIFY bool_or(stopped) OVER w AND NOT bool_and(stopped) OVER w)"""


def _proposals(t):
    return _classed(t).withColumn("id", F.col("cand_id")).withColumn("flags", F.array().cast("array<string>"))


@query(
    "inter_proposal_conflicts", "C25",
    f"WITH {DRUGS} SELECT cand_id, {S.stable_id('cg', 'patient_id || chr(31) || ingredient')} AS conflict_group_id, 'Inter-note conflict: contradicts ' || (members - 1) || ' in its group' AS flag FROM clash",
)
def _(t):
    linked = assembly.link_conflicts(_proposals(t)).where("conflict_group_id IS NOT NULL AND confidence_tier = 'ATTENTION'")
    return linked.select("cand_id", "conflict_group_id", F.array_join("flags", "|").alias("flag"))


@query(
    "conflict_members", "C25",
    f"WITH {DRUGS} SELECT {S.stable_id('cg', 'patient_id || chr(31) || ingredient')} AS conflict_group_id, cand_id AS id, NOT stopped AS later, coalesce(name, '') AS label FROM clash",
)
def _(t):
    return assembly.conflict_members(_proposals(t)).select("conflict_group_id", "id", "later", "label")


@query(
    "auto_reject_siblings", "C26",
    f"""WITH {DRUGS}, d AS (SELECT *, {_K} % 3 = 0 AS accepted FROM clash) SELECT cand_id AS id FROM d WHERE NOT accepted AND (patient_id, ingredient) IN (SELECT (patient_id, ingredient) FROM d WHERE accepted)""",
)
def _(t):
    groups = assembly.medication_conflicts(_proposals(t)).select("id", "conflict_group_id")
    decisions = groups.where(_K.replace("cand_id", "id") + " % 3 = 0").select("id", F.lit("accept").alias("action"))
    return assembly.auto_reject_siblings(decisions, groups).select("id")


# -- texts ---------------------------------------------------------------------------------------------------------------

_N = "coalesce(name, '')"


@query(
    "candidate_headline", "B19",
    f"""SELECT cand_id, CASE resource_type WHEN 'Condition' THEN concat_ws(' | ', name, 'severity=' || severity) WHEN 'Observation' THEN trim(name || ' = ' || value)
        WHEN 'MedicationRequest' THEN name || ' ' || coalesce(dose_value || 'mg', '') || '  [' || status || ']' WHEN 'Procedure' THEN name || ' performed=' || performed || ' status=' || status
        WHEN 'AllergyIntolerance' THEN substance || ' reaction=None severity=' || coalesce(severity, 'None') || ' criticality=None route=None onset_age=None' ELSE relationship || ': ' END AS headline FROM ({CANDIDATES})""",
)
def _(t):
    return candidate_items(t).select("cand_id", assembly.headline().alias("headline"))


@query(
    "candidate_trace", "B20",
    f"""WITH {CLASSED} SELECT cand_id, name, value, CASE WHEN category IN ('vital-signs', 'laboratory', 'survey') THEN 'loinc' ELSE 'snomed' END AS systems, CASE WHEN uncoded THEN '' ELSE code0 END AS final_codes, classification
        FROM classed WHERE resource_type = 'Observation'""",
)
def _(t):
    rows = _classed(t).withColumn("reasoning", F.lit(""))
    return assembly.candidate_trace(rows, rows).select("cand_id", "name", "value", "systems", "final_codes", "classification")


@query("coding_coverage", "D35", f"SELECT count(*) FILTER (NOT uncoded) AS coded, count(*) FILTER (uncoded) AS uncoded FROM ({CANDIDATES})")
def _(t):
    return assembly.coding_coverage(candidate_items(t))


@query(
    "stage_counters", "D34",
    f"""WITH {CLASSED} SELECT 'candidates' AS stage, count(*) AS n FROM classed UNION ALL SELECT 'reviewable', count(*) FROM classed WHERE classification <> 'DUPLICATE' AND NOT (classification = 'NEW' AND (coalesce(negated, false) OR {_MED_STOP}))
        UNION ALL SELECT 'documents', count(*) FROM {{documents}}""",
)
def _(t):
    rows = _classed(t)
    return assembly.stage_counters(candidates=rows, reviewable=assembly.reviewable(rows), documents=t.documents)


@query(
    "run_counters", "D34",
    f"""WITH {merging.KEYED}, {merging.GROUPS}, {merging.MERGED}, {merging.MERGED_EVIDENCE}, {merging.SETTLED}
        SELECT 'documents accepted' AS counter, count(*) AS n FROM {{documents}} WHERE strlen(text) <= 9000 UNION ALL SELECT 'sentences', count(*) FROM {{conversations}}
        UNION ALL SELECT 'candidates', count(*) FROM ({CANDIDATES}) UNION ALL SELECT 'merged', count(*) FROM merged UNION ALL SELECT 'coded', count(*) FROM merged WHERE NOT uncoded
        UNION ALL SELECT 'verdict ' || kind, (SELECT count(*) FROM settled WHERE classification = kind) FROM (SELECT unnest([{S.names(V.CLASSIFICATIONS)}]) AS kind)
        UNION ALL SELECT 'proposals', count(*) FROM settled WHERE classification <> 'DUPLICATE' AND NOT (classification = 'NEW' AND (coalesce(negated, false) OR {_MED_STOP}))""",
)
def _(t):
    """Seven counters (the verdicts by class) of one run, from gate to proposals; each stage is written once and counted as it is written."""
    counters = RunCounters()
    notes = t.documents.select(F.col("doc_id").alias("document_id"), "text")
    counters.stage(guardrail_check(notes, max_bytes=9000).where("reject_reason IS NULL"), "accepted")
    counters.stage(t.conversations.select("conv_id", "turn", "text"), "sentences")
    keyed = merge.with_merge_key(counters.stage(candidate_items(t), "candidates"))
    groups = fixed(merge.merge_groups(keyed))
    merged = counters.stage(merge.exact_merge(keyed, groups).withColumnRenamed("merged_id", "cand_id"), "merged")
    scored = counters.stage(reconcile_and_score(merged, chart_facts(t)), "reconciled")
    built = assembly.reviewable(scored).withColumn("encounter_ref", F.lit(None).cast("string")).withColumn("note_date", F.lit(None).cast("string"))
    counters.stage(built.select("cand_id", builders.resource_json().alias("resource")), "assembled")
    return counters.rows(t.spark)


# -- resources --------------------------------------------------------------------------------------------------------------


def _resources(t):
    rows = candidate_items(t).withColumn("encounter_ref", F.col("encounter_id"))
    return rows.withColumn("resource", builders.resource_json())


@query(
    "build_condition", "I1 I7",
    f"""SELECT cand_id, CASE WHEN category = 'diagnosis' AND encounter_id IS NOT NULL THEN 'encounter-diagnosis' ELSE 'problem-list-item' END AS category, name AS text,
        CASE WHEN NOT uncoded AND length(code1) > 3 THEN substr(code1, 1, 3) || '.' || substr(code1, 4) END AS icd, encounter_id AS encounter, body_site AS site FROM ({CANDIDATES}) WHERE resource_type = 'Condition'""",
)
def _(t):
    g = lambda p: F.get_json_object("resource", p)
    return _resources(t).where("resource_type = 'Condition'").select(
        "cand_id", g("$.category[0].coding[0].code").alias("category"), g("$.code.text").alias("text"), g("$.code.coding[1].code").alias("icd"),
        g("$.encounter.reference").alias("encounter"), g("$.bodySite[0].text").alias("site"),
    )


@query(
    "build_observation", "I2",
    f"""SELECT cand_id, coalesce(effective_date, note_date) AS effective, CASE WHEN category = 'social-history' OR (NOT uncoded AND code0 = '72166-2') THEN value END AS concept,
        CASE WHEN category = 'social-history' OR (NOT uncoded AND code0 = '72166-2') THEN NULL ELSE value END AS string,
        CASE WHEN NOT uncoded AND code0 = '72166-2' THEN CASE WHEN contains(lower(value), 'current') THEN '449868002' WHEN contains(lower(value), 'former') OR contains(lower(value), 'quit') THEN '8517006' ELSE '266919005' END END AS habit
        FROM ({CANDIDATES}) WHERE resource_type = 'Observation'""",
)
def _(t):
    g = lambda p: F.get_json_object("resource", p)
    return _resources(t).where("resource_type = 'Observation'").select(
        "cand_id", g("$.effectiveDateTime").alias("effective"), g("$.valueCodeableConcept.text").alias("concept"), g("$.valueString").alias("string"),
        g("$.valueCodeableConcept.coding[0].code").alias("habit"),
    )


@query(
    "build_medication", "I3",
    f"""SELECT cand_id, status, note_date AS authored, CASE WHEN dose_value IS NOT NULL THEN dose_value || ' mg' END AS dosage, TRY_CAST(dose_value AS DOUBLE) AS amount FROM ({CANDIDATES}) WHERE resource_type = 'MedicationRequest'""",
)
def _(t):
    g = lambda p: F.get_json_object("resource", p)
    return _resources(t).where("resource_type = 'MedicationRequest'").select(
        "cand_id", g("$.status").alias("status"), g("$.authoredOn").alias("authored"), g("$.dosageInstruction[0].text").alias("dosage"),
        g("$.dosageInstruction[0].doseAndRate[0].doseQuantity.value").cast("double").alias("amount"),
    )


@query(
    "build_other_types", "I4 I5 I6",
    f"""SELECT cand_id, coalesce(name, substance, relationship) AS text, CASE resource_type WHEN 'Procedure' THEN performed WHEN 'AllergyIntolerance' THEN CASE certainty WHEN 'definite' THEN 'confirmed' ELSE 'unconfirmed' END ELSE 'completed' END AS detail
        FROM ({CANDIDATES}) WHERE resource_type IN ('Procedure', 'AllergyIntolerance', 'FamilyMemberHistory')""",
)
def _(t):
    g = lambda p: F.get_json_object("resource", p)
    kind = F.col("resource_type")
    return _resources(t).where("resource_type IN ('Procedure', 'AllergyIntolerance', 'FamilyMemberHistory')").select(
        "cand_id", F.coalesce(g("$.code.text"), g("$.relationship.text")).alias("text"),
        F.when(kind == "Procedure", g("$.performedDateTime")).when(kind == "AllergyIntolerance", g("$.verificationStatus.coding[0].code")).otherwise(g("$.status")).alias("detail"),
    )


@query(
    "display_label", "B15",
    f"""SELECT cand_id, CASE WHEN resource_type = 'Observation' AND (category = 'social-history' OR (NOT uncoded AND code0 = '72166-2')) THEN name || ': ' || value
        WHEN resource_type = 'AllergyIntolerance' AND severity IS NOT NULL THEN substance || ' (unknown)' ELSE coalesce(name, substance, relationship) END AS label FROM ({CANDIDATES})""",
)
def _(t):
    return _resources(t).select("cand_id", display_label(view(F.col("resource"))).alias("label"))


@query(
    "resource_summary", "B16",
    f"""SELECT cand_id, 'Procedure' AS label, name AS value FROM ({CANDIDATES}) WHERE resource_type = 'Procedure' UNION ALL SELECT cand_id, 'Status', 'completed' FROM ({CANDIDATES}) WHERE resource_type = 'Procedure'
        UNION ALL SELECT cand_id, 'Performed', performed FROM ({CANDIDATES}) WHERE resource_type = 'Procedure'""",
)
def _(t):
    return _resources(t).where("resource_type = 'Procedure'").select("cand_id", F.inline(summary_rows(view(F.col("resource")))))


@query("overlay_profiles", "I8 G4 H29", f"SELECT cand_id, '{V.RESOURCE_PROFILES['Procedure']},http://x/extra' AS profiles, name AS note FROM ({CANDIDATES}) WHERE resource_type = 'Procedure'")
def _(t):
    extra = F.array(F.lit(V.RESOURCE_PROFILES["Procedure"]), F.lit("http://x/extra"))
    extensions = F.array(F.struct(F.lit("http://x/note").alias("url"), F.lit("string").alias("datatype"), F.col("item.name").alias("value")))
    rows = _resources(t).where("resource_type = 'Procedure'").withColumn("resource", builders.with_extensions(builders.with_profiles(F.col("resource"), extra), extensions))
    return rows.select(
        "cand_id", F.array_join(F.from_json(F.get_json_object("resource", "$.meta.profile"), "array<string>"), ",").alias("profiles"),
        F.get_json_object("resource", "$.extension[0].valueString").alias("note"),
    )


@query("overlay_all_types", "I8 G4 H29", f"SELECT cand_id, 'http://x/extra' AS last, true AS kept, coalesce(name, substance, relationship) AS note FROM ({CANDIDATES})")
def _(t):
    """Resources of all types: a profile more, behind those that the builders gave, and a valued extension."""
    url = F.array(F.lit("http://x/extra"))
    label = T.first_text(F.col("item.name"), F.col("item.substance"), F.col("item.relationship"))
    extensions = F.array(F.struct(F.lit("http://x/note").alias("url"), F.lit("string").alias("datatype"), label.alias("value")))
    profiles = lambda c: F.coalesce(F.from_json(F.get_json_object(c, "$.meta.profile"), "array<string>"), F.array().cast("array<string>"))
    rows = _resources(t).withColumn("overlaid", builders.with_extensions(builders.with_profiles(F.col("resource"), url), extensions))
    before, after = profiles("resource"), profiles("overlaid")
    return rows.select(
        "cand_id", F.element_at(after, -1).alias("last"), (after == F.concat(before, url)).alias("kept"), F.get_json_object("overlaid", "$.extension[0].valueString").alias("note"),
    )


@query(
    "extension_values", "H44",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'valueString' WHEN 1 THEN 'valueInteger' WHEN 2 THEN 'valueQuantity' END AS key FROM {part}""",
)
def _(t):
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, "string").when(k == 1, "integer").when(k == 2, "Quantity").otherwise("Colour")
    j = builders.extension_json(F.lit("http://x"), kind, F.col("p_size").cast("string"))
    return t.part.select("p_partkey", F.get(F.filter(F.json_object_keys(j), lambda n: n.startswith("value")), F.lit(0)).alias("key"))


# -- conformance ----------------------------------------------------------------------------------------------------------------


def _assessed(t):
    broken = F.when(
        F.expr(f"{_K} % 5 = 0"), F.regexp_replace("resource", r'"subject":\{[^}]*\},?', "")
    ).when(F.expr(f"{_K} % 5 = 1"), F.concat(F.lit('{"colour":"red",'), F.substr("resource", F.lit(2)))).otherwise(F.col("resource"))
    rows = _resources(t).where("resource_type = 'Procedure'").select(F.col("cand_id").alias("id"), "cand_id", broken.alias("resource"))
    return rows


_RULE = f"CASE {_K} % 5 WHEN 0 THEN 'subject' WHEN 1 THEN 'colour' END"


@query("validate_structure", "J1", f"SELECT cand_id AS id, {_RULE} AS path FROM ({CANDIDATES}) WHERE resource_type = 'Procedure' AND {_K} % 5 < 2")
def _(t):
    return _assessed(t).select("id", F.explode(conformance.structure_issues(F.col("resource"))).alias("i")).select("id", "i.path")


# One fault a resource, by the part's number, put in front of what the builders wrote; every fifth also has its subject under a wrong name.
_FAULTS = {
    0: ('"colour":"red",', (("colour", "unknown element"),)),
    1: ('"extension":[{"url":"x","valueString":"a","shade":1}],', (("extension.0.shade", "unknown element"),)),
    2: ('"id":5,', (("id", "must be a string"),)),
    3: ('"extension":{"url":"x"},', (("extension", "must be a list"),)),
    4: ('"implicitRules":["x"],', (("implicitRules", "must be a single value"),)),
    5: ('"text":{"status":"generated"},', (("text.div", "required element is missing"),)),
    6: (
        '"language":"en  gb","modifierExtension":[{"url":"x","valueString":"a","valueInteger":1.5}],',
        (("language", "is not a valid code"), ("modifierExtension.0.valueInteger", "is not a valid integer"), ("modifierExtension.0.valueString or valueInteger", "only one of these may be there")),
    ),
}
_SIGNED = """SELECT concat('p', o_orderkey) AS id, concat('{"resourceType":"Provenance","target":[{"reference":"Condition/', o_orderkey, '"}],"recorded":"2001-02-03', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'T04:05:06Z' END,
    '","agent":[{"who":{"reference":"Practitioner/1"}}],"entity":[{"role":"source"', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',"what":{"reference":"DocumentReference/1"}' END, '}]}') AS resource FROM {orders}
    UNION ALL SELECT concat('d', o_orderkey), concat('{"resourceType":"DocumentReference","status":"current","content":[{"attachment":{"contentType":"text/plain","data":"', CASE WHEN o_orderkey % 5 = 0 THEN '#' ELSE 'YQ==' END,
    '","size":', CASE WHEN o_orderkey % 2 = 0 THEN '"1"' ELSE '1' END, '}}]}') FROM {orders}"""
_FAULT_ROWS = " UNION ALL ".join(
    f"SELECT cand_id AS id, '{path}' AS path, '{message}' AS message FROM c WHERE k % 7 = {n}" for n, (_, issues) in _FAULTS.items() for path, message in issues
)


@query(
    "validate_r4", "J1",
    f"""WITH c AS (SELECT *, {_K} AS k FROM ({CANDIDATES})) {_FAULT_ROWS}
        UNION ALL SELECT cand_id, CASE WHEN resource_type IN ('AllergyIntolerance', 'FamilyMemberHistory') THEN 'patient' ELSE 'subject' END, 'required element is missing' FROM c WHERE k % 5 = 0 AND resource_type <> 'Observation'
        UNION ALL SELECT cand_id, 'person', 'unknown element' FROM c WHERE k % 5 = 0
        UNION ALL SELECT cand_id, 'medicationCodeableConcept.coding.0.display', 'is not a valid string' FROM c WHERE display0 = '' AND NOT uncoded
        UNION ALL SELECT 'p' || o_orderkey, 'recorded', 'is not a valid instant' FROM {{orders}} WHERE o_orderkey % 3 = 0
        UNION ALL SELECT 'p' || o_orderkey, 'entity.0.what', 'required element is missing' FROM {{orders}} WHERE o_orderkey % 4 = 0
        UNION ALL SELECT 'd' || o_orderkey, 'content.0.attachment.data', 'is not a valid base64Binary' FROM {{orders}} WHERE o_orderkey % 5 = 0
        UNION ALL SELECT 'd' || o_orderkey, 'content.0.attachment.size', 'must be a number' FROM {{orders}} WHERE o_orderkey % 2 = 0""",
)
def _(t):
    """All resources that the builders make of the candidates, with faults, and two kinds of records that go along."""
    fault = F.lit("")
    for n, (text, _) in _FAULTS.items():
        fault = F.when(F.expr(f"{_K} % 7 = {n}"), text).otherwise(fault)
    named = F.when(F.expr(f"{_K} % 5 = 0"), F.regexp_replace("resource", r'"(subject|patient)":', '"person":')).otherwise(F.col("resource"))
    broken = _resources(t).select(F.col("cand_id").alias("id"), F.concat(F.lit("{"), fault, F.substr(named, F.lit(2))).alias("resource"))
    return structure.validate_r4(broken.unionByName(t.sql(with_json(_SIGNED))))


_PIN_BAD = f"(NOT uncoded AND (resource_type = 'Condition' OR (resource_type = 'Procedure' AND NOT ({_CODE3} BETWEEN 1000001 AND 1000299 AND {_CODE3} % 2 = 1))))"
# Every fifth resource of all types is without its subject, and the next ones have an unknown element; some types need no subject.
_BROKEN = f"({_K} % 5 = 1 OR ({_K} % 5 = 0 AND resource_type IN ('Condition', 'MedicationRequest', 'Procedure')))"


def _all_broken(t):
    without = F.regexp_replace(F.regexp_replace("resource", r'"subject":\{[^}]*\},?', ""), r",\}$", "}")
    broken = F.when(F.expr(f"{_K} % 5 = 0"), without).when(F.expr(f"{_K} % 5 = 1"), F.concat(F.lit('{"colour":"red",'), F.substr("resource", F.lit(2)))).otherwise(F.col("resource"))
    return _resources(t).select(F.col("cand_id").alias("id"), "cand_id", broken.alias("resource"))


def _local(t):
    rows = assembly.with_rules(candidate_items(t), _rules(t)).withColumn("codings", assembly.primary_codings())
    return conformance.assess_local(_all_broken(t), assembly.coding_subset_issues(rows.withColumnRenamed("cand_id", "id")))


@query("assess_local", "J3", f"SELECT cand_id AS id, NOT {_BROKEN} AND NOT {_PIN_BAD} AS valid, ({_BROKEN}::INT + {_PIN_BAD}::INT)::BIGINT AS n_issues FROM ({CANDIDATES})")
def _(t):
    return _local(t).select("id", "valid", F.size("issues").cast("bigint").alias("n_issues"))


def _remote(t):
    issues = F.when(F.expr(f"{_K} % 7 = 0"), F.array(F.struct(F.lit("error").alias("severity"), F.lit("x").alias("path"), F.lit("remote").alias("message")))).otherwise(
        F.array().cast(f"array<{conformance.ISSUE}>")
    )
    rows = candidate_items(t).where(f"{_K} % 2 = 0")
    one = rows.select(F.col("cand_id").alias("id"), F.lit("profile").alias("source"), issues.alias("remote_issues"))
    two = rows.where(f"{_K} % 4 = 0").select(F.col("cand_id").alias("id"), F.lit("validator").alias("source"), F.array().cast(f"array<{conformance.ISSUE}>").alias("remote_issues"))
    return one.unionByName(two)


_LOCAL_OK = f"(NOT {_BROKEN} AND NOT {_PIN_BAD})"


@query(
    "merge_remote_outcomes", "J4",
    f"""SELECT cand_id AS id, CASE WHEN {_K} % 4 = 0 THEN 'validator' WHEN {_K} % 2 = 0 THEN 'profile' ELSE 'r4' END AS level,
        {_LOCAL_OK} AND NOT ({_K} % 2 = 0 AND {_K} % 4 <> 0 AND {_K} % 7 = 0) AS valid FROM ({CANDIDATES})""",
)
def _(t):
    return conformance.merge_remote_outcomes(_local(t), _remote(t)).select("id", "level", "valid")


@query("conformance_gate", "J5", f"SELECT cand_id AS id, 'conformance gate failed (r4)' AS reason FROM ({CANDIDATES}) WHERE NOT {_LOCAL_OK}")
def _(t):
    return conformance.conformance_gate(_local(t))[1]


# -- review screen ------------------------------------------------------------------------------------------------------------------


def _records(t):
    rows = _resources(t).withColumn("classification", F.expr(CLASS)).withColumn("confidence_tier", F.expr(TIER))
    return rows.select(
        F.col("cand_id").alias("id"), "resource_type", "classification", "confidence_tier",
        F.when(F.expr(f"{_K} % 10 = 0"), "accepted").otherwise("pending").alias("status"), T.first_text(F.col("item.name"), F.col("item.substance"), F.col("item.relationship")).alias("display_label"),
    )


@query("review_queue", "B14", f"WITH {CLASSED} SELECT cand_id AS id FROM classed WHERE {_K} % 10 <> 0 AND confidence_tier = 'REVIEW' AND contains(lower(coalesce(name, substance, relationship)), 'ring')")
def _(t):
    return assembly.review_queue(_records(t), status="pending", tier="REVIEW", text="RING").select("id")


@query(
    "facet_counts", "D30",
    f"""WITH {CLASSED} SELECT 'confidence_tier' AS dimension, confidence_tier AS value, count(*) AS n FROM classed GROUP BY ALL UNION ALL SELECT 'resource_type', resource_type, count(*) FROM classed GROUP BY ALL
        UNION ALL SELECT 'classification', classification, count(*) FROM classed GROUP BY ALL UNION ALL SELECT 'status', CASE WHEN {_K} % 10 = 0 THEN 'accepted' ELSE 'pending' END, count(*) FROM classed GROUP BY ALL""",
)
def _(t):
    return assembly.facet_counts(_records(t))


@query(
    "patient_header", "B17",
    """SELECT CAST(c_custkey AS STRING) AS patient_id, 'Ann ' || c_mktsegment AS patient_name, CASE WHEN c_custkey % 3 = 2 THEN 'A' ELSE 'M' END || c_custkey AS mrn FROM {customer}""",
)
def _(t):
    k = F.col("c_custkey")
    body = F.concat(
        F.lit('{"resourceType": "Patient", "name": [{"given": ["Ann"], "family": "'), "c_mktsegment", F.lit('"}], "identifier": [{"value": "A'), k, F.lit('"}, {"value": "M'), k, F.lit('", "type": '),
        F.when(k % 3 == 0, '{"coding": [{"code": "MR"}]}').when(k % 3 == 1, '{"text": "Medical Record Number"}').otherwise('{"text": "other"}'), F.lit("}]}"),
    )
    return assembly.patient_header(t.customer.select(k.cast("string").alias("patient_id"), body.alias("resource"))).select("patient_id", "patient_name", "mrn")
