"""Check queries of the scalar expressions (H) over part, order and event texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions import clinical as C
from chartspark.functions import sql as registered
from chartspark.functions import text as T
from chartspark.harness import sqltext as S
from chartspark.harness.registry import Tables, query

# Part names dressed up with the words the rules look for.
PARTS = """
SELECT p_partkey, p_name, p_size, lower(p_type) AS p_type, p_brand, p_retailprice,
       concat(CASE p_partkey % 8 WHEN 0 THEN ' Chronic  ' WHEN 1 THEN 'Acute ' WHEN 2 THEN 'primary ' WHEN 3 THEN 'Severe'
                   WHEN 4 THEN 'minor mild ' ELSE '' END, p_name, CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE '' END, ' ',
              lower(p_type)) AS label,
       concat(CASE p_partkey % 4 WHEN 0 THEN 'Product containing precisely ' WHEN 1 THEN 'product containing ' ELSE '' END,
              p_name, CASE p_partkey % 3 WHEN 0 THEN ' Sodium' WHEN 1 THEN ' (as base)' ELSE '' END, ' ', p_size,
              CASE p_partkey % 5 WHEN 0 THEN ' milligram/1 each oral tablet' WHEN 1 THEN ' MG Oral Tablet'
                   WHEN 2 THEN '.5/100 mcg and extract' WHEN 3 THEN '' ELSE ' % cream' END) AS drug,
       concat(p_size, CASE p_partkey % 6 WHEN 0 THEN ' mg' WHEN 1 THEN 'MCG ' WHEN 2 THEN '/100 milligrams' WHEN 3 THEN ' %'
                   WHEN 4 THEN ' tablets' ELSE '' END) AS dose,
       concat(CASE p_partkey % 9 WHEN 0 THEN 'Current every day smoker' WHEN 1 THEN 'Former Smoker' WHEN 2 THEN 'never'
                   WHEN 3 THEN 'quit in 1999' WHEN 4 THEN 'inactive' WHEN 5 THEN ' Non-smoker ' WHEN 6 THEN 'heavy tobacco smoker'
                   WHEN 7 THEN 'ex-user' ELSE 'unknown' END, CASE WHEN p_partkey % 9 = 8 THEN p_brand ELSE '' END) AS habit,
       CASE p_partkey % 4 WHEN 0 THEN 'http://hl7.org/fhir/sid/icd-10-cm' WHEN 1 THEN 'urn:ICD10'
            WHEN 2 THEN 'http://loinc.org' ELSE 'http://snomed.info/sct' END AS system,
       CASE p_partkey % 3 WHEN 0 THEN concat('C', lpad(CAST(p_size AS STRING), 2, '0'), p_partkey % 7)
            WHEN 1 THEN concat('C7', p_size % 10, '.', p_partkey % 9) ELSE concat(p_partkey, '-', p_size % 10) END AS code,
       concat(p_name, CASE p_partkey % 11 WHEN 0 THEN ' ER status' WHEN 1 THEN ' HER2/neu' WHEN 2 THEN ' Estrogen-receptor'
                   WHEN 3 THEN ' Ki 67 index' WHEN 4 THEN ' receptor' WHEN 5 THEN ' PSA' WHEN 6 THEN ' progesterone receptor'
                   WHEN 7 THEN ' PR' WHEN 8 THEN ' ca 19-9' WHEN 9 THEN ' clinical stage' ELSE ' ECOG' END) AS assay,
       concat(CASE p_partkey % 6 WHEN 0 THEN 'Positive' WHEN 1 THEN 'not detected' WHEN 2 THEN 'Non-Reactive'
                   WHEN 3 THEN 'amplified ' WHEN 4 THEN 'weakly positive, focally negative ' ELSE '' END, p_size, '%') AS finding,
       concat(CASE p_partkey % 5 WHEN 0 THEN 'Left ' WHEN 1 THEN 'RIGHT ' WHEN 2 THEN 'left and right ' ELSE '' END, p_name) AS site,
       concat(CASE p_partkey % 7 WHEN 0 THEN 'p' WHEN 1 THEN 'c' WHEN 2 THEN 'yp' ELSE '' END,
              CASE p_partkey % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'n' WHEN 2 THEN 'M' ELSE 'X' END,
              CASE p_partkey % 5 WHEN 0 THEN 'is' WHEN 1 THEN '1a' WHEN 2 THEN 'x' WHEN 3 THEN '2' ELSE '2N1' END) AS stage,
       concat(CASE p_partkey % 6 WHEN 0 THEN '<' WHEN 1 THEN '≥ ' WHEN 2 THEN '-' ELSE '' END, p_size,
              CASE p_partkey % 5 WHEN 0 THEN '.25' WHEN 1 THEN '/80 mmHg' ELSE '' END) AS reading,
       CASE p_partkey % 6 WHEN 0 THEN 'mg' WHEN 1 THEN '%' WHEN 2 THEN 'mEq/L' WHEN 3 THEN 'bpm' WHEN 4 THEN 'furlong' ELSE NULL END
            AS unit,
       CASE p_partkey % 12 WHEN 0 THEN 'Blood Pressure' WHEN 1 THEN 'sitting BP, left arm' WHEN 2 THEN 'Smoking habit'
            WHEN 3 THEN 'SpO2 and heart rate' WHEN 4 THEN 'respiratory rate' WHEN 5 THEN 'resting heart rate' ELSE p_name END AS vital,
       CASE p_partkey % 8 WHEN 0 THEN ' Mother' WHEN 1 THEN 'maternal grandfather' WHEN 2 THEN 'AUNT ' WHEN 3 THEN 'step father'
            WHEN 4 THEN 'wife' ELSE p_name END AS relation,
       concat(p_name, CASE p_partkey % 6 WHEN 0 THEN ' carcinoma' WHEN 1 THEN ' metastatic cancer' WHEN 2 THEN ' lymphoma, secondary'
                   ELSE '' END) AS diagnosis
FROM {part}
"""
ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day,
       concat('seen on ', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2), '/',
              substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4), ' by clerk 12345') AS snippet,
       CASE o_orderkey % 7 WHEN 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7)
            WHEN 1 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)
            WHEN 2 THEN 'last spring' WHEN 3 THEN '1970-01-01' WHEN 4 THEN '' WHEN 5 THEN NULL
            ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS claimed,
       CASE o_orderkey % 3 WHEN 0 THEN '2024-06-01' WHEN 1 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS note_date
FROM {orders}
"""


def parts(t: Tables):
    return t.sql(PARTS)


def from_parts(select: str) -> str:
    return f"SELECT p_partkey, {select} FROM ({PARTS})"


@query("normalize_name", "H1", from_parts(f"{S.normalize_name('label')} AS name"))
def _(t):
    return parts(t).select("p_partkey", T.normalize_name(F.col("label")).alias("name"))


@query("normalize_display", "H2", from_parts(f"{S.normalize_display('label')} AS display"))
def _(t):
    return parts(t).select("p_partkey", T.normalize_display(F.col("label")).alias("display"))


@query("normalize_ingredient", "H3", from_parts(f"{S.normalize_ingredient('drug')} AS ingredient"))
def _(t):
    return parts(t).select("p_partkey", T.normalize_ingredient(F.col("drug")).alias("ingredient"))


@query("normalize_dose_value", "H4", from_parts(f"{S.normalize_dose('dose')} AS dose"))
def _(t):
    return parts(t).select("p_partkey", T.normalize_dose_value(F.col("dose")).alias("dose"))


@query(
    "chart_dose", "H5",
    from_parts(
        f"coalesce(nullif(regexp_extract(dose, {S.q(V.DOSE_IN_TEXT)}, 1), ''), "
        f"CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS STRING) END, '') AS dose"
    ),
)
def _(t):
    plain = F.struct(F.array().cast("array<string>").alias("quantities"), F.col("dose").alias("text"))
    coded = F.struct(
        F.array(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string"))).alias("quantities"), F.lit("9 mg").alias("text")
    )
    only_coded = coded.withField("text", F.lit(""))
    return parts(t).select("p_partkey", T.chart_dose(F.array(plain, only_coded)).alias("dose"))


@query("canonical_tobacco", "H6", from_parts(f"{S.tobacco('habit')} AS status"))
def _(t):
    return parts(t).select("p_partkey", T.canonical_tobacco(F.col("habit")).alias("status"))


@query("normalize_code", "H7", from_parts(f"{S.normal_code('system', 'code')} AS code"))
def _(t):
    return parts(t).select("p_partkey", T.normalize_code(F.col("system"), F.col("code")).alias("code"))


@query(
    "icd10_dotted", "H8",
    from_parts(r"CASE WHEN regexp_matches(trim(code), '^[A-Z]\d{2}\d+$') THEN substr(trim(code), 1, 3) || '.' || substr(trim(code), 4) ELSE code END AS code"),
)
def _(t):
    return parts(t).select("p_partkey", T.icd10_dotted(F.col("code")).alias("code"))


@query(
    "encounter_keys", "H10 H11",
    f"""SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 4 = 0 THEN 'Encounter/' || o_custkey END, ''),
          nullif(substr(note_date, 1, 10), ''), 'doc-' || o_orderkey) AS note_key,
        CASE WHEN claimed IS NOT NULL AND claimed <> '' THEN 'obs:' || substr(claimed, 1, 7)
             ELSE coalesce(substr(note_date, 1, 10), 'doc') END AS observation_key FROM ({ORDERS})""",
)
def _(t):
    return t.sql(ORDERS).select(
        "o_orderkey",
        T.encounter_key(
            F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Encounter/"), F.col("o_custkey"))), F.col("note_date"),
            F.concat(F.lit("doc-"), F.col("o_orderkey")),
        ).alias("note_key"),
        T.observation_encounter_key(F.col("claimed"), F.coalesce(F.substring("note_date", 1, 10), F.lit("doc"))).alias("observation_key"),
    )


@query(
    "item_name", "H13",
    from_parts("""CASE p_partkey % 3 WHEN 0 THEN relation WHEN 1 THEN drug ELSE label END AS name"""),
)
def _(t):
    kind = F.when(F.col("p_partkey") % 3 == 0, "FamilyMemberHistory").when(F.col("p_partkey") % 3 == 1, "AllergyIntolerance").otherwise("Condition")
    return parts(t).select("p_partkey", T.item_name(kind, F.col("label"), F.col("drug"), F.col("relation")).alias("name"))


@query(
    "laterality", "H14",
    f"""SELECT a.p_partkey, concat_ws(',', CASE WHEN contains(lower(a.site), 'left') THEN 'left' END,
          CASE WHEN contains(lower(a.site), 'right') THEN 'right' END) AS sides,
        (contains(lower(a.site), 'left') OR contains(lower(a.site), 'right'))
          AND (contains(lower(b.site), 'left') OR contains(lower(b.site), 'right'))
          AND NOT ((contains(lower(a.site), 'left') AND contains(lower(b.site), 'left'))
                OR (contains(lower(a.site), 'right') AND contains(lower(b.site), 'right'))) AS conflict
        FROM ({PARTS}) a JOIN ({PARTS}) b ON b.p_partkey = a.p_partkey + 1""",
)
def _(t):
    here = parts(t).select("p_partkey", T.laterality(F.array("site")).alias("sides"))
    following = here.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("sides").alias("next_sides"))
    return here.join(following, "p_partkey").select(
        "p_partkey", F.array_join("sides", ",").alias("sides"),
        T.laterality_conflict(F.col("sides"), F.col("next_sides")).alias("conflict"),
    )


@query(
    "marker_polarity", "H15",
    from_parts(f"CASE WHEN {S.any_of('lower(finding)', V.NEGATIVE_WORDS)} THEN 'neg' WHEN {S.any_of('lower(finding)', V.POSITIVE_WORDS)} THEN 'pos' ELSE 'none' END AS polarity"),
)
def _(t):
    return parts(t).select("p_partkey", T.marker_polarity(F.col("finding")).alias("polarity"))


SQUEEZED = r"regexp_replace(lower(assay), '[\s\-/,]+', '', 'g')"


@query("marker_family", "H16", from_parts(f"{S.marker_family('assay')} AS family"))
def _(t):
    return parts(t).select("p_partkey", T.marker_family(F.col("assay")).alias("family"))


@query(
    "is_tumor_marker", "H17",
    from_parts(f"{S.any_of(SQUEEZED, V.MARKER_LONG_FORMS)} OR regexp_matches(assay, {S.q(V.MARKER_SHORT_FORMS)}) AS is_marker"),
)
def _(t):
    return parts(t).select("p_partkey", T.is_tumor_marker(F.col("assay")).alias("is_marker"))


def _concept_case(column: str, value: int) -> str:
    whens = " ".join(f"WHEN {S.any_of(f'lower({column})', c[0])} THEN {S.q(c[value])}" for c in V.ONCOLOGY_CONCEPTS)
    return f"CASE {whens} END"


@query(
    "tumor_marker_role", "H18",
    from_parts(f"""CASE WHEN p_size % 2 = 0 AND {_concept_case('assay', 2)} IS NULL
        AND ({S.any_of(SQUEEZED, V.MARKER_LONG_FORMS)} OR regexp_matches(assay, {S.q(V.MARKER_SHORT_FORMS)})) THEN 'tumor-marker' END AS role"""),
)
def _(t):
    return parts(t).select(
        "p_partkey", C.tumor_marker_role(F.lit("Observation"), F.col("assay"), F.col("p_size") % 2 == 0).alias("role")
    )


@query(
    "observation_systems", "H19",
    from_parts("""CASE p_partkey % 5 WHEN 0 THEN 'loinc' WHEN 1 THEN 'snomed' WHEN 2 THEN 'loinc' WHEN 3 THEN 'loinc' ELSE 'snomed' END AS systems"""),
)
def _(t):
    k = F.col("p_partkey") % 5
    hint = F.when(k == 0, "LOINC").when(k == 1, "SNOMED")
    category = F.when(k == 2, "Laboratory").when(k == 3, "survey").otherwise("exam")
    return parts(t).select("p_partkey", F.array_join(C.observation_systems(hint, category), ",").alias("systems"))


def _tnm_sql() -> str:
    letter = f"upper(regexp_extract(stage, {S.q(V.TNM_TOKEN)}, 2))"
    path = f"contains(lower(regexp_extract(stage, {S.q(V.TNM_TOKEN)}, 1)), 'p')"
    whens = " ".join(f"WHEN {letter} = '{l}' AND {'' if p else 'NOT '}{path} THEN '{code}'" for l, p, code, _, _ in V.TNM_CODES)
    return f"CASE {whens} END"


@query("tnm_code", "H20", from_parts(f"{_tnm_sql()} AS code"))
def _(t):
    return parts(t).select("p_partkey", C.tnm_coding(F.col("stage"))["code"].alias("code"))


@query("oncology_concept", "H21", from_parts(f"{_concept_case('assay', 2)} AS code, {_concept_case('assay', 1)} AS system"))
def _(t):
    found = C.oncology_concept(F.col("assay"))
    return parts(t).select("p_partkey", found["code"].alias("code"), found["system"].alias("system"))


@query(
    "marker_code", "H22",
    from_parts("CASE " + " ".join(f"WHEN {S.any_of(SQUEEZED, f)} THEN '{c}'" for _, f, _, c, _ in V.MARKER_FAMILIES) + " END AS code"),
)
def _(t):
    return parts(t).select("p_partkey", C.marker_coding(F.col("assay"))["code"].alias("code"))


@query(
    "concept_by_code", "H23",
    f"""WITH coded AS (SELECT p_partkey, {_concept_case('assay', 2)} AS code, {_concept_case('assay', 1)} AS system,
            {_tnm_sql()} AS tnm FROM ({PARTS})),
        picked AS (SELECT p_partkey, coalesce(code, tnm) AS code, CASE WHEN code IS NULL THEN 'http://loinc.org' ELSE system END AS system FROM coded)
        SELECT p_partkey, CASE {' '.join(f"WHEN system = '{s}' AND code = '{c}' THEN '{p}'" for s, c, p, _ in C._concept_table())} END AS profile
        FROM picked""",
)
def _(t):
    pick = F.coalesce(C.oncology_concept(F.col("assay")), C.tnm_coding(F.col("stage")))
    return parts(t).select("p_partkey", C.concept_by_code(F.array_compact(F.array(pick)))["profile"].alias("profile"))


DIAGNOSIS = "lower(diagnosis || ' ' || p_name)"


@query(
    "cancer_role", "H24",
    from_parts(f"""CASE WHEN {S.any_of(DIAGNOSIS, V.CANCER_TERMS)} OR (p_partkey % 4 = 0 AND code LIKE 'C%') THEN
        CASE WHEN {S.any_of(DIAGNOSIS, V.SECONDARY_TERMS)}
               OR (p_partkey % 4 = 0 AND substr(code, 1, 3) IN ('C77', 'C78', 'C79')) THEN 'secondary' ELSE 'primary' END END AS role"""),
)
def _(t):
    codings = F.array(C.coding(F.col("system"), F.col("code"), F.col("p_name")))
    return parts(t).select("p_partkey", C.cancer_role(codings, F.col("diagnosis")).alias("role"))


@query(
    "site_tokens", "H25",
    f"""SELECT p_partkey, string_agg(token, ' ' ORDER BY token) AS tokens FROM (SELECT DISTINCT p_partkey,
          unnest(regexp_extract_all(lower(site || ' of upper region'), '[a-z]+')) AS token FROM ({PARTS}))
        WHERE length(token) > 2 AND token NOT IN ({S.names(V.SITE_STOPWORDS)}) GROUP BY p_partkey""",
)
def _(t):
    words = C.site_tokens(F.array(F.concat("site", F.lit(" of upper region"))))
    return parts(t).select("p_partkey", F.array_join(F.array_sort(words), " ").alias("tokens")).where("tokens <> ''")


@query(
    "parse_numbers", "H26",
    from_parts(r"""CAST(nullif(regexp_extract(reading, '(\d+)\s*/\s*(\d+)', 1), '') AS INT) AS systolic,
        CAST(nullif(regexp_extract(reading, '(\d+)\s*/\s*(\d+)', 2), '') AS INT) AS diastolic,
        CAST(nullif(regexp_extract(dose, '(\d+)', 1), '') AS INT) AS age,
        CAST(nullif(regexp_extract(reading, '(-?\d+)', 1), '') AS INT) AS whole"""),
)
def _(t):
    bp = T.parse_blood_pressure(F.col("reading"))
    return parts(t).select(
        "p_partkey", bp["systolic"].alias("systolic"), bp["diastolic"].alias("diastolic"),
        T.parse_onset_age(F.col("dose")).alias("age"), T.parse_integer(F.col("reading")).alias("whole"),
    )


_NUM = S.q(V.NUMBER_WITH_COMPARATOR)


@query(
    "quantity", "H27",
    from_parts(f"""TRY_CAST(nullif(regexp_extract(trim(reading), {_NUM}, 2), '') AS DOUBLE) AS value,
        CASE regexp_extract(trim(reading), {_NUM}, 1) WHEN '<' THEN '<' WHEN '≥' THEN '>=' END AS comparator,
        CASE WHEN regexp_matches(trim(reading), {_NUM}) THEN unit END AS unit,
        CASE WHEN regexp_matches(trim(reading), {_NUM}) THEN CASE unit WHEN 'mg' THEN 'mg' WHEN '%' THEN '%' WHEN 'mEq/L' THEN 'meq/L'
             WHEN 'bpm' THEN '/min' END END AS ucum"""),
)
def _(t):
    found = C.quantity(F.col("reading"), F.col("unit"))
    return parts(t).select(
        "p_partkey", found["value"].alias("value"), found["comparator"].alias("comparator"), found["unit"].alias("unit"),
        found["code"].alias("ucum"),
    )


@query(
    "codeable_concept", "H28",
    from_parts("""CASE WHEN p_partkey % 4 <> 3 THEN 1 ELSE 0 END::BIGINT AS n_codings,
        CASE WHEN p_partkey % 4 <> 3 THEN label ELSE CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE label END END AS text"""),
)
def _(t):
    broken = F.col("p_partkey") % 4 == 3
    codings = F.array(C.coding(F.when(~broken, F.col("system")), F.col("code"), F.col("p_name")))
    text = F.when(broken & (F.col("p_partkey") % 3 == 0), "").otherwise(F.col("label"))
    concept = C.codeable_concept(codings, text)
    return parts(t).select(
        "p_partkey", F.coalesce(F.size(F.coalesce(concept["coding"], C.no_codings())), F.lit(0)).cast("bigint").alias("n_codings"),
        concept["text"].alias("text"),
    )


TERMS = """SELECT p_partkey, concat(CASE p_partkey % 3 WHEN 0 THEN 'ultrasound-guided ' WHEN 1 THEN 'The size of the ' ELSE '' END, p_name,
       CASE p_partkey % 4 WHEN 0 THEN ', left side' WHEN 1 THEN ' with  contrast' WHEN 2 THEN '-type' ELSE '' END) AS term FROM {part}"""


@query(
    "backoff_variants", "H30",
    f"""WITH words AS (SELECT p_partkey, term, list_filter(string_split_regex(replace(term, '-', ' '), '\\s+'), lambda w: w <> '') AS w FROM ({TERMS})),
    raw AS (SELECT p_partkey, 1 AS pos, list_filter(string_split_regex(split_part(term, ',', 1), '\\s+'), lambda x: x <> '') AS v FROM words WHERE contains(term, ',')
      UNION ALL SELECT p_partkey, 2, w[2:] FROM words WHERE len(w) > 2
      UNION ALL SELECT p_partkey, 3, w[3:] FROM words WHERE len(w) > 3
      UNION ALL SELECT p_partkey, 4, w[len(w) - 2:] FROM words WHERE len(w) > 3
      UNION ALL SELECT p_partkey, 5, w[len(w) - 1:] FROM words WHERE len(w) > 2),
    cut AS (SELECT p_partkey, pos, array_to_string(CASE WHEN lower(v[1]) NOT IN ({S.names(V.LEADING_STOPWORDS)}) THEN v
        WHEN lower(v[2]) NOT IN ({S.names(V.LEADING_STOPWORDS)}) THEN v[2:] WHEN lower(v[3]) NOT IN ({S.names(V.LEADING_STOPWORDS)}) THEN v[3:]
        ELSE v[4:] END, ' ') AS variant FROM raw),
    firsts AS (SELECT p_partkey, min(pos) AS pos, arg_min(variant, pos) AS variant FROM cut WHERE variant <> '' GROUP BY p_partkey, lower(variant))
    SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY pos) - 1 AS pos, variant FROM firsts""",
)
def _(t):
    return t.sql(TERMS).select("p_partkey", F.posexplode(T.backoff_variants(F.col("term"))).alias("pos", "variant"))


VARIED = """SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN 'Severe ' WHEN 1 THEN 'HTN and left ' ELSE '' END, p_name,
       CASE p_partkey % 5 WHEN 0 THEN ' 10 mg' WHEN 1 THEN ' (finding)' WHEN 2 THEN ', NOS' ELSE '' END) AS term FROM {part}"""


def _variants_sql() -> str:
    steps = [S.strip(f"regexp_replace(regexp_replace(term, {S.q(p)}, {S.q(to)}, 'g'), '\\s+', ' ', 'g')") for p, to in V.VARIANT_STEPS]
    rows = " UNION ALL ".join(f"SELECT p_partkey, {i + 1} AS pos, {step} AS v FROM ({VARIED})" for i, step in enumerate(steps))
    spelled = "regexp_replace(lower(term), '(^| )htn( |$)', '\\1hypertension\\2')"
    return f"""WITH raw AS (SELECT p_partkey, 0 AS pos, term AS v FROM ({VARIED}) UNION ALL {rows} UNION ALL SELECT p_partkey, 9, {spelled} FROM ({VARIED}))
        SELECT p_partkey, arg_min(v, pos) AS variant FROM raw WHERE v <> '' GROUP BY p_partkey, lower(v)"""


@query("query_variants", "H31", _variants_sql())
def _(t):
    return t.sql(VARIED).select("p_partkey", F.explode(T.query_variants(F.col("term"))).alias("variant"))


@query(
    "search_tokens", "H32",
    f"""SELECT p_partkey, string_agg(token, ' ' ORDER BY token) AS tokens FROM (SELECT DISTINCT p_partkey,
        unnest(regexp_extract_all(lower(drug), '[\\p{{L}}\\p{{N}}]+')) AS token FROM ({PARTS})) GROUP BY p_partkey""",
)
def _(t):
    return parts(t).select("p_partkey", F.array_join(F.array_sort(T.tokens(F.col("drug"))), " ").alias("tokens"))


@query(
    "bench_normal_forms", "H33",
    from_parts(f"""trim(regexp_replace(regexp_replace(regexp_replace(lower(diagnosis || ' NOS (Disorder)'), {S.q(V.SEMANTIC_TAGS)}, '', 'g'),
        '\\b(?:nos|unspecified)\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS display,
        CASE WHEN p_partkey % 4 = 0 THEN replace(upper(trim(code)), '.', '') ELSE upper(trim(code)) END AS code"""),
)
def _(t):
    key = F.when(F.col("p_partkey") % 4 == 0, "icd10").otherwise("snomed")
    return parts(t).select(
        "p_partkey", T.bench_normal_display(F.concat("diagnosis", F.lit(" NOS (Disorder)"))).alias("display"),
        T.bench_normal_code(key, F.col("code")).alias("code"),
    )


@query(
    "content_key", "H38",
    "SELECT doc_id, sha256(text || chr(0) || lang || chr(0) || source) AS key, sha256(text || chr(0) || lang || chr(0)) AS closed_key FROM {documents}",
)
def _(t):
    return t.documents.select(
        "doc_id", T.content_key(F.col("text"), F.col("lang"), F.col("source")).alias("key"),
        T.content_key(F.col("text"), F.col("lang"), closing_nul=True).alias("closed_key"),
    )


@query("stable_id", "H39", f"SELECT doc_id, {S.stable_id('prop', 'text')} AS id FROM {{documents}}")
def _(t):
    return t.documents.select("doc_id", T.stable_id("prop", F.col("text")).alias("id"))


@query(
    "document_date", "H40",
    """SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE CAST(epoch_ms(CAST(date_trunc('second', ts) AS TIMESTAMP)) AS BIGINT) // 1000 END AS seconds FROM {events}""",
)
def _(t):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 3 == 1, iso).otherwise("soon")
    return t.events.select("event_id", F.unix_seconds(T.parse_document_date(raw)).alias("seconds"))


@query(
    "date_and_number_checks", "H41",
    from_parts(rf"""regexp_matches(trim(reading), {_NUM}) AS numeric, regexp_matches('20' || lpad(CAST(p_size AS STRING), 2, '0') || CASE p_partkey % 3 WHEN 0 THEN '-01'
        WHEN 1 THEN '-01-05' ELSE '-1' END, '^\d{{4}}(-\d{{2}}(-\d{{2}})?)?$') AS valid_date"""),
)
def _(t):
    k = F.col("p_partkey") % 3
    raw = F.concat(F.lit("20"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.when(k == 0, "-01").when(k == 1, "-01-05").otherwise("-1"))
    return parts(t).select("p_partkey", T.is_numeric(F.col("reading")).alias("numeric"), T.is_valid_partial_date(raw).alias("valid_date"))


@query(
    "model_key", "H34",
    "SELECT p_partkey, string_split(p_brand || '-flash' || CASE WHEN p_partkey % 2 = 0 THEN '-2026-01-20' ELSE '' END, '-20')[1] AS model FROM {part}",
)
def _(t):
    name = F.concat("p_brand", F.lit("-flash"), F.when(F.col("p_partkey") % 2 == 0, "-2026-01-20").otherwise(""))
    return t.part.select("p_partkey", T.model_key(name).alias("model"))


@query(
    "reference_from_location", "H43",
    r"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'Condition/' || o_custkey END AS ref FROM {orders}""",
)
def _(t):
    k = F.col("o_orderkey") % 3
    location = F.when(k == 0, F.concat(F.lit("https://x.example.org/fhir/Condition/"), F.col("o_custkey"), F.lit("/_history/2"))).when(
        k == 1, F.concat(F.lit("Condition/"), F.col("o_custkey"))
    )
    return t.orders.select("o_orderkey", T.reference_from_location(location).alias("ref"))


@query(
    "status_maps", "H45",
    from_parts("""CASE p_partkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'provisional' WHEN 2 THEN 'unconfirmed' ELSE 'provisional' END AS condition_status,
        CASE WHEN p_partkey % 5 = 0 THEN 'refuted' WHEN p_partkey % 4 = 0 THEN 'confirmed' ELSE 'unconfirmed' END AS allergy_status,
        CASE WHEN p_partkey % 2 = 0 THEN 'resolved' ELSE 'active' END AS clinical"""),
)
def _(t):
    k = F.col("p_partkey") % 4
    certainty = F.when(k == 0, "definite").when(k == 1, "probable").when(k == 2, "uncertain").otherwise("odd")
    explicit = F.when(F.col("p_partkey") % 5 == 0, "refuted")
    status = F.when(F.col("p_partkey") % 2 == 0, F.array(C.coding(None, ""), C.coding(None, "resolved")))
    return parts(t).select(
        "p_partkey", C.condition_verification(certainty).alias("condition_status"),
        C.allergy_verification(certainty, explicit).alias("allergy_status"), C.clinical_status(status).alias("clinical"),
    )


# -- dates against their note ---------------------------------------------------------------------

_REJECT = r"""CASE WHEN claimed IS NULL OR claimed = '' THEN NULL
    WHEN NOT regexp_matches(claimed, '^\d{4}(-\d{2}(-\d{2})?)?$') THEN 'bad_format'
    WHEN NOT list_contains(list_filter(regexp_extract_all(snippet, '\d+'), lambda y: len(y) = 4), substr(claimed, 1, 4)) THEN 'year_not_in_snippet'
    WHEN abs(CAST(substr(claimed, 1, 4) AS INT) - CAST(substr(note_date, 1, 4) AS INT)) > 20 THEN 'drift_gt_20y' END"""


@query(
    "validate_dates", "B8",
    f"SELECT o_orderkey, CASE WHEN {_REJECT} IS NULL THEN nullif(claimed, '') END AS kept, {_REJECT} AS reason FROM ({ORDERS})",
)
def _(t):
    args = (F.col("claimed"), F.col("snippet"), F.col("note_date"))
    return t.sql(ORDERS).select("o_orderkey", T.kept_date(*args).alias("kept"), T.date_reject_reason(*args).alias("reason"))


@query(
    "temporal_context", "H37",
    f"""SELECT o_orderkey, CASE WHEN note_date IS NULL AND claimed IS NULL THEN 'none'
        ELSE concat_ws('; ', 'note_date=' || note_date, 'discharge_date=' || claimed) END AS context FROM ({ORDERS})""",
)
def _(t):
    return t.sql(ORDERS).select(
        "o_orderkey", T.temporal_context(F.col("note_date"), F.lit(None).cast("string"), F.col("claimed")).alias("context")
    )


# -- the same rules as registered SQL functions ------------------------------------------------------


@query(
    "registered_functions", "M1",
    from_parts(f"""{S.normalize_name('label')} AS name, {S.normalize_ingredient('drug')} AS ingredient,
        {S.normalize_dose('dose')} AS dose, {S.tobacco('habit')} AS status, {S.normal_code('system', 'code')} AS code, {S.marker_family('assay')} AS family"""),
)
def _(t):
    registered.register_functions(t.spark)
    return t.spark.sql(
        """SELECT p_partkey, cs_normalize_name(label) AS name, cs_normalize_ingredient(drug) AS ingredient,
           cs_normalize_dose_value(dose) AS dose, cs_canonical_tobacco(habit) AS status, cs_normalize_code(system, code) AS code,
           cs_marker_family(assay) AS family FROM {parts}""",
        parts=parts(t),
    )
