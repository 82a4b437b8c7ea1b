"""Check queries of notes, guardrail, merge, chart index, reconcile and confidence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions import text as T
from chartspark.harness import sqltext as S
from chartspark.harness.registry import query
from chartspark.harness.tables import CANDIDATES, CHART, candidate_items, chart_facts, with_n_docs
from chartspark.operators import chart, confidence, merge, reconcile
from chartspark.plans import augmentation
from chartspark.schemas import completeness_fields
from chartspark.session import checkpoint_folder, fixed
from chartspark.sources import sinks
from chartspark.streaming import jobs

# -- merge ----------------------------------------------------------------------------------------

KEYED = f"""keyed AS (SELECT *, {S.merge_key()} AS merge_key FROM (
    SELECT *, CASE WHEN resource_type = 'Observation' AND effective_date IS NOT NULL THEN 'obs:' || substr(effective_date, 1, 7) ELSE encounter END AS encounter_key,
      (4 - CASE WHEN true THEN 1 ELSE 0 END) - 1
        + (category IS NOT NULL)::INT + (name IS NOT NULL)::INT + (severity IS NOT NULL)::INT + (body_site IS NOT NULL)::INT
        + (negated IS NOT NULL)::INT + (value IS NOT NULL)::INT + (effective_date IS NOT NULL)::INT + (status IS NOT NULL)::INT
        + (intent IS NOT NULL)::INT + (dose_value IS NOT NULL)::INT + (performed IS NOT NULL)::INT + (substance IS NOT NULL)::INT
        + (relationship IS NOT NULL)::INT AS completeness,
      coalesce(resource_type = 'MedicationRequest' AND status IN ({S.names(V.DISCONTINUED_STATUSES)}), false)
        OR coalesce(resource_type = 'Condition' AND negated, false) AS conflict_signal
    FROM (SELECT *, coalesce(encounter_id, note_date, document_id) AS encounter FROM ({CANDIDATES}))))"""
GROUPS = """groups AS (SELECT patient_id, merge_key, resource_type, count(*) AS n_items, count(DISTINCT document_id) AS n_docs,
    arg_max(cand_id, (completeness, -cand_pos)) AS survivor_id, bool_or(conflict_signal) AS protected,
    CASE WHEN resource_type IN ('Observation', 'Procedure') THEN arg_min(encounter_key, cand_pos) END AS encounter_key
    FROM keyed GROUP BY patient_id, merge_key, resource_type)"""
MARKED = "marked AS (SELECT *, count(*) OVER (PARTITION BY patient_id, resource_type) > 1 AS ambiguous FROM groups)"
MERGED = """merged AS (SELECT k.*, g.n_docs, g.encounter_key AS group_encounter,
    CASE WHEN g.n_docs > 1 THEN 'exact match across ' || g.n_docs || ' notes' END AS merge_reasoning
    FROM keyed k JOIN groups g USING (patient_id, merge_key) WHERE g.n_docs <= 1 OR k.cand_id = g.survivor_id)"""


@query("completeness", "H9", f"WITH {KEYED} SELECT cand_id, completeness FROM keyed")
def _(t):
    return candidate_items(t).select("cand_id", T.completeness(F.col("item"), completeness_fields()).alias("completeness"))


@query("merge_key", "H12", f"WITH {KEYED} SELECT cand_id, encounter_key, merge_key FROM keyed")
def _(t):
    return merge.with_merge_key(candidate_items(t)).select("cand_id", "encounter_key", "merge_key")


@query(
    "merge_groups", "D1",
    f"WITH {KEYED}, {GROUPS} SELECT patient_id, merge_key, n_items::BIGINT AS n_items, n_docs, survivor_id, protected, encounter_key FROM groups",
)
def _(t):
    return merge.merge_groups(merge.with_merge_key(candidate_items(t))).select(
        "patient_id", "merge_key", "n_items", "n_docs", "survivor_id", "protected", "encounter_key"
    )


@query(
    "merge_exact", "D2",
    f"WITH {KEYED}, {GROUPS}, {MERGED} SELECT cand_id AS merged_id, resource_type, group_encounter AS encounter_key, n_docs, merge_reasoning FROM merged",
)
def _(t):
    keyed = merge.with_merge_key(candidate_items(t))
    return merge.exact_merge(keyed, merge.merge_groups(keyed)).select(
        "merged_id", "resource_type", "encounter_key", "n_docs", "merge_reasoning"
    )


@query(
    "merge_refs", "D2",
    f"""WITH {KEYED}, {GROUPS} SELECT CASE WHEN n_docs > 1 THEN survivor_id ELSE cand_id END AS merged_id, document_id,
        sentence FROM keyed JOIN groups USING (patient_id, merge_key)""",
)
def _(t):
    keyed = merge.with_merge_key(candidate_items(t))
    return merge.merge_refs(keyed, merge.merge_groups(keyed)).select(
        "merged_id", "document_id", F.get("source_sentences", F.lit(0)).alias("sentence")
    )


@query("ambiguous_groups", "D3", f"WITH {KEYED}, {GROUPS}, {MARKED} SELECT patient_id, merge_key, ambiguous FROM marked")
def _(t):
    return merge.mark_ambiguous(merge.merge_groups(merge.with_merge_key(candidate_items(t)))).select(
        "patient_id", "merge_key", "ambiguous"
    )


SCOPED = f"""scoped AS (SELECT *, CASE WHEN raw_scope LIKE 'encounter::%' AND sum(n_items) OVER (PARTITION BY patient_id, raw_scope) <= 1
        THEN NULL ELSE raw_scope END AS scope FROM (SELECT *, CASE WHEN ambiguous AND NOT protected THEN
        CASE WHEN resource_type IN ({S.names(V.PATIENT_LEVEL_TYPES)}) THEN 'patient' ELSE 'encounter::' || encounter_key END END AS raw_scope FROM marked))"""


@query("adjudication_scopes", "D4", f"WITH {KEYED}, {GROUPS}, {MARKED}, {SCOPED} SELECT patient_id, merge_key, scope FROM scoped")
def _(t):
    groups = merge.mark_ambiguous(merge.merge_groups(merge.with_merge_key(candidate_items(t))))
    return merge.adjudication_scopes(groups).select("patient_id", "merge_key", "scope")


@query(
    "protected_groups", "B18",
    f"WITH {KEYED}, {GROUPS}, {MARKED} SELECT patient_id, merge_key FROM marked WHERE protected AND ambiguous",
)
def _(t):
    groups = merge.mark_ambiguous(merge.merge_groups(merge.with_merge_key(candidate_items(t))))
    return groups.where("protected AND ambiguous").select("patient_id", "merge_key")


IDS = "ids AS (SELECT *, row_number() OVER (PARTITION BY patient_id, scope ORDER BY merge_key) AS group_id FROM scoped WHERE scope IS NOT NULL)"


@query("adjudication_ids", "E10", f"WITH {KEYED}, {GROUPS}, {MARKED}, {SCOPED}, {IDS} SELECT patient_id, scope, merge_key, group_id FROM ids")
def _(t):
    groups = merge.mark_ambiguous(merge.merge_groups(merge.with_merge_key(candidate_items(t))))
    return merge.adjudication_ids(merge.adjudication_scopes(groups)).select("patient_id", "scope", "merge_key", "group_id")


@query(
    "apply_merge_decisions", "D5",
    f"""WITH {KEYED}, {GROUPS}, {MARKED}, {SCOPED}, {IDS},
    firsts AS (SELECT patient_id, scope, arg_min(survivor_id, group_id) AS keep_id FROM ids WHERE group_id <= 2 GROUP BY ALL HAVING count(*) = 2),
    taken AS (SELECT i.patient_id, i.merge_key, f.scope, f.keep_id FROM ids i JOIN firsts f USING (patient_id, scope) WHERE i.group_id <= 2),
    taken_refs AS (SELECT patient_id, t.keep_id || '#1' AS merged_id, k.document_id FROM taken t JOIN keyed k USING (patient_id, merge_key)),
    rest AS (SELECT k.cand_id AS merged_id, k.patient_id, g.n_docs, CASE WHEN g.n_docs > 1 THEN 'exact match across ' || g.n_docs || ' notes' END AS merge_reasoning
      FROM keyed k JOIN groups g USING (patient_id, merge_key) JOIN ids i USING (patient_id, merge_key)
      WHERE (g.n_docs <= 1 OR k.cand_id = g.survivor_id) AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.patient_id = k.patient_id AND t.merge_key = k.merge_key))
    SELECT merged_id, count(DISTINCT document_id) AS n_docs, 'same fact' AS merge_reasoning FROM taken_refs GROUP BY merged_id
    UNION ALL SELECT merged_id, n_docs, merge_reasoning FROM rest""",
)
def _(t):
    keyed = merge.with_merge_key(candidate_items(t))
    scoped = merge.adjudication_scopes(merge.mark_ambiguous(merge.merge_groups(keyed)))
    ids = merge.adjudication_ids(scoped)
    # One decision per scope with two groups or more: merge groups 1 and 2; id 0 and a bad survivor are ignored.
    decisions = (
        ids.where("group_id = 2")
        .select(
            "patient_id", "scope", F.lit(1).alias("decision_pos"), F.lit("merge").alias("action"),
            F.array(F.lit(0), F.lit(1), F.lit(2)).alias("group_ids"), F.lit(99).cast("bigint").alias("survivor_group_id"),
            F.lit(None).cast("string").alias("target_resource_type"), F.lit("same fact").alias("reasoning"),
        )
    )
    merged, _ = merge.apply_merge_decisions(keyed, ids, decisions)
    return merged.select("merged_id", "n_docs", "merge_reasoning")


@query(
    "collapse_multifocal", "D6 G5",
    f"""WITH RECURSIVE {KEYED}, {GROUPS}, {MERGED},
    foci AS (SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS focus_name,
        contains(lower(coalesce(body_site, '')), 'left') AS l, contains(lower(coalesce(body_site, '')), 'right') AS r
        FROM merged WHERE resource_type = 'Condition' AND NOT negated),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY patient_id, focus_name ORDER BY cand_pos) AS n FROM foci),
    fold AS (
      SELECT patient_id, focus_name, n, cand_id, 1 AS cluster, l AS l1, r AS r1, false AS l2, false AS r2, false AS open2 FROM ordered WHERE n = 1
      UNION ALL
      SELECT o.patient_id, o.focus_name, o.n, o.cand_id,
        CASE WHEN clash1 THEN 2 ELSE 1 END, f.l1 OR (NOT clash1 AND o.l), f.r1 OR (NOT clash1 AND o.r),
        f.l2 OR (clash1 AND o.l), f.r2 OR (clash1 AND o.r), f.open2 OR clash1
      FROM (SELECT f.*, o.n AS next_n, (f.l1 OR f.r1) AND (o.l OR o.r) AND NOT ((f.l1 AND o.l) OR (f.r1 AND o.r)) AS clash1
            FROM fold f JOIN ordered o ON o.patient_id = f.patient_id AND o.focus_name = f.focus_name AND o.n = f.n + 1) f
      JOIN ordered o ON o.patient_id = f.patient_id AND o.focus_name = f.focus_name AND o.n = f.next_n)
    SELECT arg_max(o.cand_id, (o.completeness, -o.cand_pos)) AS merged_id, count(*) AS n_foci,
      string_agg(DISTINCT o.body_site, '|' ORDER BY o.body_site) AS sites
    FROM fold f JOIN ordered o USING (patient_id, focus_name, n) GROUP BY f.patient_id, f.focus_name, f.cluster""",
)
def _(t):
    keyed = merge.with_merge_key(candidate_items(t))
    groups = fixed(merge.merge_groups(keyed))
    merged = merge.exact_merge(keyed, groups)
    refs = merge.merge_refs(keyed, groups)
    collapsed, _ = merge.collapse_multifocal(merged, refs)
    foci = F.regexp_extract("merge_reasoning", r"multifocal: merged (\d+)", 1).try_cast("bigint")
    return collapsed.where("resource_type = 'Condition' AND NOT item.negated").select(
        "merged_id", F.coalesce(foci, F.lit(1)).alias("n_foci"),
        T.blank_to_null(F.array_join(F.array_sort("item.body_site"), "|")).alias("sites"),
    )


MARKER_NAME = "CASE WHEN kind = 1 THEN CASE pk % 5 WHEN 0 THEN 'ER status' WHEN 1 THEN 'HER2/neu' WHEN 2 THEN 'Ki-67 index' ELSE p_name END END"


def _marker_items(t):
    """Observations renamed to markers, with a result word as their value."""
    part = F.split("cand_id", "-")[2].cast("bigint")
    amount = F.split("cand_id", "-")[4].cast("bigint")
    name = F.when(part % 5 == 0, "ER status").when(part % 5 == 1, "HER2/neu").when(part % 5 == 2, "Ki-67 index").otherwise("heart rate")
    value = F.when(amount % 4 == 0, "Positive").when(amount % 4 == 1, "negative").when(amount % 4 == 2, "80").otherwise("strongly positive")
    items = candidate_items(t).where("resource_type = 'Observation'")
    return items.select(
        "patient_id", F.col("cand_id").alias("merged_id"), "cand_pos", "resource_type",
        F.col("item").withField("name", name).withField("value", value).alias("item"),
        F.col("encounter").alias("encounter_key"), F.lit(1).cast("bigint").alias("n_docs"), F.lit(None).cast("string").alias("merge_reasoning"),
    ), items.select(
        "patient_id", F.col("cand_id").alias("merged_id"), F.col("cand_pos").alias("ref_pos"), "document_id",
        F.col("item.source_sentences").alias("source_sentences"),
    )


@query(
    "collapse_markers", "D7",
    f"""WITH {KEYED}, base AS (SELECT *, split_part(cand_id, '-', 3)::BIGINT AS part, split_part(cand_id, '-', 5)::BIGINT AS amount FROM keyed WHERE resource_type = 'Observation'),
    named AS (SELECT *, CASE part % 5 WHEN 0 THEN 'ER' WHEN 1 THEN 'HER2' WHEN 2 THEN 'KI67' END AS family,
        CASE amount % 4 WHEN 1 THEN 'neg' WHEN 2 THEN 'none' ELSE 'pos' END AS polarity FROM base),
    clash AS (SELECT *, bool_or(polarity = 'pos') OVER w AND bool_or(polarity = 'neg') OVER w AS clash FROM named WHERE family IS NOT NULL
        WINDOW w AS (PARTITION BY patient_id, family)),
    bucket AS (SELECT *, CASE WHEN clash THEN polarity ELSE 'all' END AS bucket FROM clash)
    SELECT arg_max(cand_id, (polarity <> 'none', completeness, -cand_pos)) AS merged_id, count(*) AS n_mentions, count(DISTINCT document_id) AS n_docs
    FROM bucket GROUP BY patient_id, family, bucket
    UNION ALL SELECT cand_id, 1, 1 FROM named WHERE family IS NULL""",
)
def _(t):
    merged, _ = merge.collapse_markers(*_marker_items(t))
    mentions = F.regexp_extract("merge_reasoning", r"merged (\d+)", 1).try_cast("bigint")
    return merged.select("merged_id", F.coalesce(mentions, F.lit(1)).alias("n_mentions"), "n_docs")


# -- chart index ------------------------------------------------------------------------------------------


@query(
    "chart_code_index", "D8 H46",
    f"""SELECT patient_id, resource_type, system, {S.normal_code('system', 'code')} AS norm_code, count(*) AS n_matches,
        arg_min(resource_id, entry_pos) AS first_resource FROM ({CHART}) GROUP BY ALL""",
)
def _(t):
    return chart.code_index(chart_facts(t)).select(
        "patient_id", "resource_type", "system", F.col("code").alias("norm_code"), "n_matches", F.col("first.resource_id").alias("first_resource")
    )


@query(
    "chart_display_index", "D8",
    f"""SELECT patient_id, resource_type, {S.normalize_display("coalesce(nullif(text, ''), display)")} AS shown, count(*) AS n_matches,
        arg_min(resource_id, entry_pos) AS first_resource FROM ({CHART}) WHERE resource_type <> 'Observation' GROUP BY ALL""",
)
def _(t):
    return chart.display_index(chart_facts(t)).select(
        "patient_id", "resource_type", F.col("key").alias("shown"), "n_matches", F.col("first.resource_id").alias("first_resource")
    )


@query(
    "chart_ingredient_index", "D8",
    f"""SELECT patient_id, {S.normalize_ingredient('display')} AS ingredient, count(*) AS n_matches,
        arg_min(resource_id, entry_pos) AS first_resource FROM ({CHART}) WHERE resource_type = 'MedicationRequest' GROUP BY ALL""",
)
def _(t):
    return chart.ingredient_index(chart_facts(t)).select(
        "patient_id", F.col("key").alias("ingredient"), "n_matches", F.col("first.resource_id").alias("first_resource")
    )


@query(
    "chart_observation_values", "D8 E6",
    f"""SELECT patient_id, code, arg_min(resource_id, entry_pos) AS resource_id, arg_min(value, entry_pos) AS value, count(*) AS n_matches
        FROM ({CHART}) WHERE resource_type = 'Observation' GROUP BY ALL""",
)
def _(t):
    return chart.observation_values(chart_facts(t))


@query(
    "first_chart_entry", "E6",
    f"SELECT patient_id, resource_type, arg_min(resource_id, entry_pos) AS resource_id FROM ({CHART}) GROUP BY ALL",
)
def _(t):
    return chart.first_chart_entry(chart_facts(t), "patient_id", "resource_type").select("patient_id", "resource_type", "resource_id")


@query(
    "no_known_allergy", "D8",
    f"SELECT patient_id, arg_min(resource_id, entry_pos) AS nkda_resource_id, count(*) AS nkda_matches FROM ({CHART}) WHERE resource_type = 'AllergyIntolerance' AND code = '409137002' GROUP BY ALL",
)
def _(t):
    return chart.no_known_allergy(chart_facts(t))


# -- reconcile ---------------------------------------------------------------------------------------------

CODINGS = f"""codings AS (SELECT cand_id, patient_id, resource_type, 0 AS coding_pos, system0 AS system, {S.normal_code('system0', 'code0')} AS code FROM cand WHERE NOT uncoded
    UNION ALL SELECT cand_id, patient_id, resource_type, 1, system1, {S.normal_code('system1', 'code1')} FROM cand WHERE NOT uncoded AND system1 IS NOT NULL)"""
FACTS = f"""facts AS (SELECT *, {S.normal_code('system', 'code')} AS norm_code, coalesce(nullif(text, ''), display) AS own_display,
    {S.normalize_display("coalesce(nullif(text, ''), display)")} AS norm_display, {S.normalize_ingredient('display')} AS ingredient,
    CASE resource_type WHEN 'Condition' THEN coalesce(clinical_status, 'active') ELSE coalesce(status, 'active') END = 'active' AS active FROM ({CHART}))"""
EXACT = """exact_rows AS (SELECT c.cand_id, c.coding_pos, c.system, c.code, f.* EXCLUDE (system, code, patient_id, resource_type)
      FROM codings c JOIN facts f ON f.patient_id = c.patient_id AND f.resource_type = c.resource_type AND f.system = c.system AND f.norm_code = c.code),
    exact AS (SELECT cand_id, arg_min(code, (coding_pos, entry_pos)) AS code, arg_min(system, (coding_pos, entry_pos)) AS system,
      arg_min(resource_id, (coding_pos, entry_pos)) AS resource_id, arg_min(value, (coding_pos, entry_pos)) AS value,
      count(*) FILTER (active) > 0 AS any_active, count(*) AS n_all,
      arg_min(own_display, (coding_pos, entry_pos)) FILTER (active) AS active_display,
      count(*) FILTER (coding_pos = first_pos) AS n_first
      FROM (SELECT *, min(coding_pos) OVER (PARTITION BY cand_id) AS first_pos FROM exact_rows) GROUP BY cand_id)"""
CAND = f"""cand AS (SELECT *, {S.normalize_display("coalesce(name, '')")} AS norm_name,
    CASE WHEN resource_type = 'MedicationRequest' THEN CASE WHEN NOT uncoded AND {S.normalize_ingredient('display0')} <> '' THEN {S.normalize_ingredient('display0')}
      ELSE {S.normalize_ingredient("coalesce(name, '')")} END END AS ingredient FROM ({CANDIDATES}))"""
NAMED = """pairs AS (SELECT c.cand_id, c.resource_type, CASE c.resource_type WHEN 'Condition' THEN f.norm_display ELSE f.ingredient END AS key,
      min(f.entry_pos) AS key_pos, bool_or(c.ingredient = f.ingredient) AS same
      FROM cand c JOIN facts f ON f.patient_id = c.patient_id AND f.resource_type = c.resource_type
      WHERE (c.resource_type = 'Condition' AND c.norm_name <> '' AND f.norm_display <> '' AND (contains(f.norm_display, c.norm_name) OR contains(c.norm_name, f.norm_display)))
         OR (c.resource_type = 'MedicationRequest' AND c.ingredient <> '' AND f.ingredient <> '' AND (contains(f.ingredient, c.ingredient) OR contains(c.ingredient, f.ingredient)))
      GROUP BY ALL),
    best AS (SELECT cand_id, resource_type, arg_min(key, (CASE WHEN resource_type = 'MedicationRequest' AND same THEN 0 ELSE 1 END, key_pos)) AS key FROM pairs GROUP BY ALL),
    named AS (SELECT b.cand_id, b.key, arg_min(f.resource_id, f.entry_pos) AS resource_id, arg_min(f.dose, f.entry_pos) AS dose, bool_or(f.active) AS any_active,
      arg_min(f.own_display, f.entry_pos) FILTER (f.active) AS active_display, count(*) AS n
      FROM best b JOIN cand c USING (cand_id) JOIN facts f ON f.patient_id = c.patient_id AND f.resource_type = b.resource_type
        AND b.key = CASE b.resource_type WHEN 'Condition' THEN f.norm_display ELSE f.ingredient END GROUP BY ALL)"""
DATED = """dated AS (SELECT c.cand_id, min(f.entry_pos) AS pos, arg_min(f.resource_id, f.entry_pos) AS resource_id FROM cand c JOIN exact e USING (cand_id)
      JOIN facts f ON f.patient_id = c.patient_id AND f.resource_type = 'Procedure' AND f.system = e.system AND f.norm_code = e.code AND f.performed = c.performed
      WHERE c.resource_type = 'Procedure' AND f.performed <> '' GROUP BY c.cand_id)"""
NKDA = "nkda AS (SELECT patient_id, arg_min(resource_id, entry_pos) AS resource_id FROM facts WHERE resource_type = 'AllergyIntolerance' AND code = '409137002' GROUP BY patient_id)"

_OWN, _OTHER = S.normalize_dose("coalesce(c.dose_value, '')"), S.normalize_dose("coalesce(n.dose, '')")
_TOB_OWN, _TOB_CHART = S.tobacco("coalesce(c.value, '')"), S.tobacco("e.value")
VERDICT = f"""judged AS (SELECT c.*, CASE c.resource_type
    WHEN 'Condition' THEN CASE WHEN c.negated THEN
        CASE WHEN e.cand_id IS NULL AND n.cand_id IS NULL THEN ('NEW', 'negated assertion has no chart anchor', NULL)
             WHEN coalesce(e.any_active, n.any_active) THEN ('CONFLICTING', 'note negates this; chart shows active: ' || coalesce(e.active_display, n.active_display), NULL)
             ELSE ('DUPLICATE', 'chart already records this as resolved/inactive', NULL) END
      WHEN e.cand_id IS NOT NULL THEN ('DUPLICATE', 'exact code match ' || e.code, e.resource_id)
      WHEN n.cand_id IS NOT NULL THEN ('AMBIGUOUS', 'display overlap: ''' || c.norm_name || ''' ~ ''' || n.key || '''', n.resource_id)
      ELSE ('NEW', 'no match in chart', NULL) END
    WHEN 'MedicationRequest' THEN CASE WHEN c.status = 'stopped' THEN
        CASE WHEN e.cand_id IS NULL AND n.cand_id IS NULL THEN ('NEW', 'discontinuation has no chart anchor', NULL)
             WHEN coalesce(e.any_active, n.any_active) THEN ('CONFLICTING', 'note says discontinued; chart shows active: ' || coalesce(e.active_display, n.active_display), NULL)
             ELSE ('DUPLICATE', 'chart already records this as discontinued', NULL) END
      WHEN e.cand_id IS NOT NULL THEN ('DUPLICATE', 'exact RxNorm match ' || e.code, e.resource_id)
      WHEN n.cand_id IS NOT NULL AND {_OWN} <> '' AND {_OTHER} <> '' AND {_OWN} <> {_OTHER}
        THEN ('UPDATING', 'same ingredient ''' || c.ingredient || ''', dose ' || n.dose || '->' || c.dose_value, n.resource_id)
      WHEN n.cand_id IS NOT NULL THEN ('DUPLICATE', 'same ingredient ''' || c.ingredient || '''', n.resource_id)
      ELSE ('NEW', 'no match in chart', NULL) END
    WHEN 'AllergyIntolerance' THEN CASE WHEN k.resource_id IS NOT NULL AND (c.uncoded OR c.code0 <> '409137002')
        THEN ('CONFLICTING', 'chart records NKDA but candidate asserts allergy to ' || c.substance, k.resource_id)
      WHEN e.cand_id IS NOT NULL THEN ('DUPLICATE', 'exact allergy code match ' || e.code, e.resource_id)
      ELSE ('NEW', 'no match in chart', NULL) END
    WHEN 'Observation' THEN CASE WHEN e.cand_id IS NULL THEN ('NEW', 'no LOINC match in chart', NULL)
      WHEN e.code = '72166-2' THEN CASE WHEN {_TOB_OWN} = {_TOB_CHART} THEN ('DUPLICATE', 'same tobacco status: ' || {_TOB_OWN}, e.resource_id)
        ELSE ('UPDATING', 'tobacco status changed: ' || {_TOB_CHART} || ' -> ' || {_TOB_OWN}, e.resource_id) END
      WHEN lower(trim(c.value)) = lower(trim(e.value)) THEN ('DUPLICATE', 'same LOINC ' || e.code || ', same value', e.resource_id)
      ELSE ('UPDATING', 'same LOINC ' || e.code || ', value changed: ''' || e.value || ''' -> ''' || c.value || '''', e.resource_id) END
    WHEN 'Procedure' THEN CASE WHEN d.cand_id IS NOT NULL THEN ('DUPLICATE', 'same procedure code + date ' || c.performed, d.resource_id)
      WHEN e.cand_id IS NOT NULL THEN ('NEW', 'same procedure code but different date', NULL) ELSE ('NEW', 'no match in chart', NULL) END
    ELSE CASE WHEN e.cand_id IS NOT NULL THEN ('DUPLICATE', 'same relationship code ' || e.code, e.resource_id) ELSE ('NEW', 'no match in chart', NULL) END
    END AS verdict FROM cand c LEFT JOIN exact e USING (cand_id) LEFT JOIN named n ON n.cand_id = c.cand_id AND e.cand_id IS NULL
      LEFT JOIN dated d ON d.cand_id = c.cand_id LEFT JOIN nkda k ON k.patient_id = c.patient_id)"""
EVIDENCE = f"{CAND}, {FACTS}, {CODINGS}, {EXACT}, {NAMED}, {DATED}, {NKDA}, {VERDICT}"
SHOW = "cand_id, verdict[1] AS classification, verdict[2] AS reasoning"


def _verdicts_of(t, kinds, ask=None):
    items = candidate_items(t).where(F.col("resource_type").isin(*kinds))
    return reconcile.match_candidates(items, chart_facts(t).where(F.col("resource_type").isin(*kinds)))


def _sql_of(where: str, extra: str = "") -> str:
    return f"WITH {EVIDENCE} SELECT {SHOW}{extra} FROM judged WHERE {where}"


def _register_matchers():
    plain = ["cand_id", "classification", "reasoning"]
    for name, ids, kind, where in (
        ("match_condition", "C1", "Condition", "NOT negated"),
        ("match_condition_negated", "C2", "Condition", "negated"),
        ("match_medication", "C3", "MedicationRequest", "status <> 'stopped'"),
        ("match_medication_discontinued", "C4", "MedicationRequest", "status = 'stopped'"),
        ("match_allergy", "C5", "AllergyIntolerance", "true"),
        ("match_observation", "C6", "Observation", "true"),
        ("match_procedure", "C7", "Procedure", "true"),
        ("match_family_history", "C8", "FamilyMemberHistory", "true"),
    ):
        spark_where = where if where == "true" else where.replace("negated", "item.negated").replace("status", "item.status")

        def run(t, kind=kind, spark_where=spark_where):
            items = candidate_items(t).where(F.col("resource_type") == kind).where(spark_where)
            facts = chart_facts(t).where(F.col("resource_type") == kind)
            return reconcile.match_candidates(items, facts).select(*plain)

        query(name, ids, _sql_of(f"resource_type = '{kind}' AND {where}"))(run)


_register_matchers()


@query(
    "reconcile", "C9 K8",
    f"""WITH {EVIDENCE} SELECT cand_id, CASE WHEN verdict[1] = 'AMBIGUOUS' THEN CASE WHEN qty_even THEN 'DUPLICATE' ELSE 'NEW' END ELSE verdict[1] END AS classification,
        verdict[2] || CASE WHEN verdict[1] <> 'AMBIGUOUS' THEN '' WHEN qty_even THEN '; LLM: same disease' ELSE '; LLM failed, defaulting to NEW' END AS reasoning,
        CASE WHEN resource_type IN ('Condition', 'MedicationRequest') AND (coalesce(negated, false) OR status = 'stopped') THEN NULL ELSE verdict[3] END AS match_resource_id
        FROM (SELECT *, split_part(cand_id, '-', 1)::BIGINT % 2 = 0 AS qty_even FROM judged)""",
)
def _(t):
    items = candidate_items(t)
    # Stored answers of the adjudicator for half of the ambiguous rows.
    verdicts = items.where((F.col("resource_type") == "Condition") & (F.split("cand_id", "-")[0].cast("bigint") % 2 == 0)).select(
        "cand_id", F.lit("DUPLICATE").alias("verdict_classification"), F.lit("same disease").alias("verdict_reasoning")
    )
    takes_all = F.coalesce(F.col("item.negated"), F.lit(False)) | (F.coalesce("item.status", F.lit("")) == "stopped")
    return reconcile.reconcile(items, chart_facts(t), verdicts).select(
        "cand_id", "classification", "reasoning", F.when(~takes_all, F.col("match_resource_id")).alias("match_resource_id")
    )


@query(
    "best_match_type", "E7",
    f"""WITH {EVIDENCE}, kinds AS (SELECT patient_id, resource_type, CASE WHEN verdict[2] LIKE 'display overlap%' THEN 1
          WHEN verdict[2] LIKE 'same ingredient%' THEN 2 ELSE 3 END AS strength FROM judged
          WHERE resource_type IN ('Condition', 'MedicationRequest') AND NOT coalesce(negated, false) AND coalesce(status, '') <> 'stopped' AND verdict[3] IS NOT NULL)
        SELECT patient_id, CASE max(strength) WHEN 3 THEN 'exact_code' WHEN 2 THEN 'ingredient' ELSE 'display_text' END AS best_match_type FROM kinds GROUP BY patient_id""",
)
def _(t):
    items = candidate_items(t).where(
        "resource_type IN ('Condition', 'MedicationRequest') AND NOT coalesce(item.negated, false) AND coalesce(item.status, '') <> 'stopped'"
    )
    return reconcile.best_match_type(
        reconcile.match_candidates(items, chart_facts(t)).where("match_type IS NOT NULL"), "patient_id"
    )


# -- confidence ----------------------------------------------------------------------------------------------

SETTLED = """settled AS (SELECT *, CASE WHEN verdict[1] = 'AMBIGUOUS' THEN 'NEW' ELSE verdict[1] END AS classification FROM judged)"""
SCORED = """scored AS (SELECT *, CASE certainty WHEN 'definite' THEN 1.0 WHEN 'probable' THEN CASE WHEN n_docs >= 2 THEN 1.0 ELSE 0.6 END
      ELSE CASE WHEN n_docs >= 2 THEN 0.6 ELSE 0.25 END END * 0.5 + CASE WHEN uncoded THEN 0.3 ELSE 1.0 END * 0.5 AS score FROM settled)"""
TIERED = """tiered AS (SELECT *, CASE WHEN classification = 'CONFLICTING' THEN 'ATTENTION'
      WHEN resource_type = 'AllergyIntolerance' AND (certainty = 'uncertain' OR uncoded) THEN 'ATTENTION'
      WHEN score >= 0.80 THEN CASE WHEN uncoded THEN 'REVIEW' ELSE 'CONFIDENT' END WHEN score >= 0.40 THEN 'REVIEW' ELSE 'ATTENTION' END AS tier FROM scored)"""
ONE_NOTE = EVIDENCE.replace("FROM (" + CANDIDATES + "))", "FROM (SELECT *, 1 AS n_docs FROM (" + CANDIDATES + ")))", 1)


def _scored(t):
    items = with_n_docs(candidate_items(t))
    return confidence.with_confidence(reconcile.reconcile(items, chart_facts(t)))


def _folder(t, name):
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "reload_patients", "A16",
    f"""SELECT patient_id, resource_id, CASE WHEN patient_id::BIGINT % 50 = 7 THEN 'reloaded' ELSE text END AS text FROM ({CHART})
        WHERE patient_id::BIGINT % 50 <> 7 OR resource_type <> 'Procedure'""",
)
def _(t):
    """The chart as a patient table; every fiftieth patient is loaded anew, without procedures, and the load is repeated."""
    facts, path = chart_facts(t), _folder(t, "patients")
    sinks.reload_patients(t.spark, facts, path, rows_per_bucket=2_000)
    again = facts.where("patient_id % 50 = 7")
    fresh = again.where("resource_type <> 'Procedure'").withColumn("text", F.lit("reloaded"))
    for _ in range(2):
        # A patient who has procedures alone comes without a row.
        sinks.reload_patients(t.spark, fresh, path, patients=again.select("patient_id"))
    return sinks.read_patients(t.spark, path).select("patient_id", "resource_id", "text")


@query("stream_reconcile", "L4", f"WITH {EVIDENCE}, {SETTLED} SELECT cand_id, classification, count(*) AS n FROM settled GROUP BY ALL")
def _(t):
    """Candidates arriving in three files against the patient table, all of them a second time; what lies there in the end."""
    chart_path, inbox, out = _folder(t, "chart"), _folder(t, "inbox"), _folder(t, "reconciled")
    sinks.reload_patients(t.spark, chart_facts(t), chart_path, rows_per_bucket=5_000)
    items = with_n_docs(candidate_items(t))
    items.repartition(3, "cand_id").write.parquet(inbox)
    for attempt in ("first", "second"):
        arriving = t.spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        jobs.stream_reconcile(arriving, chart_path, out, _folder(t, attempt)).awaitTermination()
    return t.spark.read.parquet(out).groupBy("cand_id", "classification").agg(F.count(F.lit(1)).alias("n"))


@query(
    "confidence", "K16",
    f"""WITH {ONE_NOTE}, {SETTLED}, {SCORED}, {TIERED} SELECT cand_id, round(score, 3)::DOUBLE AS score, tier,
        CASE certainty WHEN 'definite' THEN 'Stated assertively' WHEN 'probable' THEN 'Probable in source' ELSE 'Uncertain or secondhand' END AS certainty_reason,
        CASE WHEN uncoded THEN 'No terminology code' WHEN system1 IS NOT NULL THEN 'Coded in 2 systems (icd-10-cm, sct)' ELSE '1 terminology code' END AS coding_reason FROM tiered""",
)
def _(t):
    return _scored(t).select(
        "cand_id", F.col("confidence_score").alias("score"), F.col("confidence_tier").alias("tier"),
        F.col("confidence_breakdown.certainty.reason").alias("certainty_reason"), F.col("confidence_breakdown.coding.reason").alias("coding_reason"),
    )


@query(
    "flags", "K17",
    f"""WITH {ONE_NOTE}, {SETTLED} SELECT cand_id, concat_ws(' | ',
        CASE certainty WHEN 'uncertain' THEN 'Source language is uncertain or secondhand' WHEN 'definite' THEN 'Stated assertively in source' END,
        CASE WHEN uncoded THEN 'No terminology code found — verify manually' WHEN system1 IS NOT NULL THEN 'Coded in 2 systems (icd-10-cm, sct)' END,
        CASE classification WHEN 'UPDATING' THEN 'Updates existing: ' || CASE WHEN contains(verdict[2], ',') THEN trim(regexp_replace(verdict[2], '^[^,]*,', '')) ELSE verdict[2] END
          WHEN 'DUPLICATE' THEN 'Already in chart' END,
        CASE WHEN verdict[2] LIKE 'display overlap%' THEN 'Approximate match — verify' END) AS flags
        FROM settled WHERE classification <> 'CONFLICTING' AND NOT coalesce(negated, false) AND coalesce(status, '') <> 'stopped'""",
)
def _(t):
    return (
        _scored(t)
        .where("classification <> 'CONFLICTING' AND NOT coalesce(item.negated, false) AND coalesce(item.status, '') <> 'stopped'")
        .select("cand_id", F.array_join("flags", " | ").alias("flags"))
    )


# -- flagship ------------------------------------------------------------------------------------------------------

MERGED_EVIDENCE = EVIDENCE.replace("FROM (" + CANDIDATES + "))", "FROM merged)", 1)


@query(
    "augmentation_summary", "D1 D2 C9 K16",
    f"""WITH {KEYED}, {GROUPS}, {MERGED}, {MERGED_EVIDENCE}, {SETTLED}, {SCORED}, {TIERED}
        SELECT c_mktsegment AS segment, resource_type, classification, tier, count(*) AS n_facts, sum((score * 1000)::BIGINT)::BIGINT AS score_thousandths
        FROM tiered JOIN {{customer}} ON c_custkey = patient_id::BIGINT GROUP BY ALL""",
)
def _(t):
    items = candidate_items(t)
    keyed = merge.with_merge_key(items)
    groups = fixed(merge.merge_groups(keyed))
    merged = fixed(merge.exact_merge(keyed, groups).withColumnRenamed("merged_id", "cand_id"))
    scored = augmentation.reconcile_and_score(merged, chart_facts(t))
    segments = t.customer.select(F.col("c_custkey").cast("string").alias("patient_id"), F.col("c_mktsegment").alias("segment"))
    return (
        scored.join(segments, "patient_id")
        .groupBy("segment", "resource_type", "classification", F.col("confidence_tier").alias("tier"))
        .agg(F.count(F.lit(1)).alias("n_facts"), F.sum(F.round(F.col("confidence_score") * 1000).cast("bigint")).alias("score_thousandths"))
    )
