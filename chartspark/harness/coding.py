"""Check queries of terminology, search, fixed codings and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions import clinical as C
from chartspark.harness import sqltext as S
from chartspark.harness.expressions import PARTS, SQUEEZED, _concept_case, _tnm_sql, from_parts, parts
from chartspark.harness.registry import query
from chartspark.harness.tables import CANDIDATES, candidate_items
from chartspark.operators import assembly, coding, search, vectors
from chartspark.schemas import make_item
from chartspark.session import fixed
from chartspark.sources import catalog, terminology

TERMS = """SELECT CASE p_partkey % 3 WHEN 0 THEN 'icd10' WHEN 1 THEN 'snomed' ELSE 'cpt' END AS system, CASE WHEN p_partkey % 50 = 7 THEN '' ELSE concat('c', p_partkey % 1500) END AS code,
       concat(p_name, ' ', lower(p_type), CASE WHEN p_size % 2 = 0 THEN ' left' ELSE '' END) AS display, p_partkey AS position FROM {part}"""
TERMINOLOGY = f"term AS (SELECT system, code, arg_min(display, position) AS display, min(position) AS position FROM ({TERMS}) WHERE system <> 'cpt' AND code <> '' GROUP BY system, code)"


def _terms(t):
    return terminology.read_terminology(t.sql(TERMS))


@query("read_terminology", "A9", f"WITH {TERMINOLOGY} SELECT * FROM term")
def _(t):
    return _terms(t)


@query(
    "read_value_sets", "A10 G7",
    f"""SELECT 'urn:oid:1.2.' || (position % 7) AS reference, system, code, arg_min(display, position) AS display, min(position) AS position, 'oid' AS reference_kind FROM ({TERMS}) WHERE code <> '' GROUP BY ALL
        UNION ALL SELECT 'http://x/' || (position % 3), system, code, arg_min(display, position), min(position), 'url' FROM ({TERMS}) WHERE code <> '' GROUP BY ALL""",
)
def _(t):
    rows = t.sql(TERMS)
    oid = rows.withColumn("reference", F.concat(F.lit("urn:oid:1.2."), F.col("position") % 7))
    url = rows.withColumn("reference", F.concat(F.lit("http://x/"), F.col("position") % 3))
    return terminology.read_value_sets(oid.where("position % 2 = 0"), oid.where("position % 2 = 1"), url)


@query("dedupe_codes", "G7", f"SELECT system, code, arg_min(display, position) AS display, min(position) AS position FROM ({TERMS}) GROUP BY ALL")
def _(t):
    return search.dedupe_codes(t.sql(TERMS))


_URI = "CASE p_partkey % 4 WHEN 0 THEN 'http://snomed.info/sct' WHEN 1 THEN 'http://loinc.org' WHEN 2 THEN 'http://www.ama-assn.org/go/cpt' ELSE 'urn:x' END"


def _codes(t):
    return t.part.select("p_partkey", F.expr(_URI).alias("system"), F.expr("CASE WHEN p_size % 9 = 0 THEN '' ELSE CAST(p_partkey AS STRING) END").alias("code"))


@query("supported_codes", "B12", f"SELECT p_partkey FROM {{part}} WHERE p_partkey % 4 <> 3 AND p_size % 9 <> 0")
def _(t):
    return terminology.supported_codes(_codes(t)).select("p_partkey")


@query("ground_codes", "C22", "SELECT p_partkey FROM {part} WHERE p_partkey % 4 >= 2 OR (p_partkey % 4 = 0 AND p_size % 9 <> 0 AND p_partkey IN (SELECT CASE WHEN l_quantity > 45 THEN l_partkey ELSE -l_partkey END FROM {lineitem}))")
def _(t):
    code = F.when(F.col("l_quantity") > 45, F.col("l_partkey")).otherwise(-F.col("l_partkey"))
    known = t.lineitem.select(F.lit(V.SNOMED).alias("uri"), code.cast("string").alias("code"))
    return terminology.ground_codes(_codes(t), known).select("p_partkey")


# -- search -------------------------------------------------------------------------------------------------

ASKED = """SELECT concat('j', p_partkey) AS job_id, CASE p_partkey % 2 WHEN 0 THEN 'icd10' ELSE 'snomed' END AS system,
    CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(lower(p_type), '  ', p_name) WHEN 2 THEN concat('very special ', p_name) ELSE concat(p_name, ' zzz') END AS query FROM {part}"""
_TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
SEARCH = f"""{TERMINOLOGY}, docs AS (SELECT *, {_TOK.format('display')} AS have FROM term), asked AS (SELECT DISTINCT system, query, {_TOK.format('query')} AS wanted FROM ({{asked}})),
    ranked AS (SELECT a.system, a.query, d.code, d.display, row_number() OVER (PARTITION BY a.system, a.query ORDER BY len(d.have), d.display, d.code) AS rank
      FROM asked a JOIN docs d ON a.system = d.system AND list_has_all(d.have, a.wanted))"""
_SCORE = "round(1 - CASE WHEN system IN ('icd10', 'loinc') THEN 0.05 ELSE 0.02 END * (rank - 1), 4)::DOUBLE"


@query("lexical_search", "C19 E9 F1", f"WITH {SEARCH.replace('{asked}', ASKED)} SELECT system, query, code, display, rank, {_SCORE} AS score FROM ranked WHERE rank <= 5")
def _(t):
    return search.lexical_search(t.sql(ASKED), _terms(t), 5).withColumn("rank", F.col("rank").cast("bigint"))


PAIR_QUERIES = f"SELECT job_id, system, 0 AS query_pos, query FROM ({ASKED}) UNION ALL SELECT job_id, system, 1, split_part(query, ' ', 1) FROM ({ASKED})"


@query(
    "union_search", "G1 E5 F1",
    f"""WITH {SEARCH.replace('{asked}', PAIR_QUERIES)}, hits AS (SELECT q.job_id, q.system, r.code, r.display, {_SCORE.replace('system', 'q.system').replace('rank', 'r.rank')} AS score, q.query_pos, r.rank FROM ({PAIR_QUERIES}) q JOIN ranked r ON r.system = q.system AND r.query = q.query AND r.rank <= 5),
        best AS (SELECT job_id, system, code, arg_min(display, (-score, query_pos, rank)) AS display, max(score) AS score, min((query_pos, rank)) AS pos FROM hits GROUP BY ALL)
        SELECT job_id, system, code, display, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id, system ORDER BY score DESC, pos, code) AS rank FROM best) WHERE rank <= 5""",
)
def _(t):
    jobs = t.sql(ASKED).withColumn("queries", F.array("query", F.split("query", " ")[0])).drop("query")
    return search.union_search(jobs, _terms(t), 5).withColumn("rank", F.col("rank").cast("bigint"))


def _backoff_sql(k: int) -> str:
    """Every job's query; where it finds nothing, all its shorter forms, united and ranked again."""
    kept = S.names(V.LEADING_STOPWORDS)
    return f"""WITH words AS (SELECT job_id, system, query, list_filter(string_split_regex(replace(query, '-', ' '), '\\s+'), lambda x: x <> '') AS w FROM ({ASKED})),
        raw AS (SELECT job_id, system, query, 1 AS pos, list_filter(string_split_regex(split_part(query, ',', 1), '\\s+'), lambda x: x <> '') AS v FROM words WHERE contains(query, ',')
          UNION ALL SELECT job_id, system, query, 2, w[2:] FROM words WHERE len(w) > 2 UNION ALL SELECT job_id, system, query, 3, w[3:] FROM words WHERE len(w) > 3
          UNION ALL SELECT job_id, system, query, 4, w[len(w) - 2:] FROM words WHERE len(w) > 3 UNION ALL SELECT job_id, system, query, 5, w[len(w) - 1:] FROM words WHERE len(w) > 2),
        cut AS (SELECT job_id, system, query AS own, pos, array_to_string(CASE WHEN lower(v[1]) NOT IN ({kept}) THEN v WHEN lower(v[2]) NOT IN ({kept}) THEN v[2:]
            WHEN lower(v[3]) NOT IN ({kept}) THEN v[3:] ELSE v[4:] END, ' ') AS query FROM raw),
        shorter AS (SELECT job_id, system, arg_min(query, pos) AS query, min(pos) AS pos FROM cut WHERE query <> '' AND lower(query) <> lower(own) GROUP BY job_id, system, lower(query)),
        {SEARCH.replace('{asked}', f"SELECT job_id, system, query FROM ({ASKED}) UNION ALL SELECT job_id, system, query FROM shorter")},
        found AS (SELECT q.job_id, q.system, r.code, r.display, r.rank, 0 AS pos FROM ({ASKED}) q JOIN ranked r ON r.system = q.system AND r.query = q.query AND r.rank <= {k}),
        again AS (SELECT v.job_id, v.system, r.code, r.display, r.rank, v.pos FROM shorter v JOIN ranked r ON r.system = v.system AND r.query = v.query AND r.rank <= {k}
          WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.job_id = v.job_id AND f.system = v.system)),
        hits AS (SELECT *, {_SCORE} AS score FROM (SELECT * FROM found UNION ALL SELECT * FROM again)),
        best AS (SELECT job_id, system, code, arg_min(display, (-score, pos, rank)) AS display, max(score) AS score, min((pos, rank)) AS first FROM hits GROUP BY ALL)
        SELECT job_id, system, code, display, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id, system ORDER BY score DESC, first, code) AS rank FROM best) WHERE rank <= {k}"""


@query("backoff_search", "C20", _backoff_sql(5))
def _(t):
    jobs = t.sql(ASKED).withColumn("queries", F.array("query")).drop("query")
    return search.backoff_search(jobs, _terms(t), 5).withColumn("rank", F.col("rank").cast("bigint"))


@query("search_terminology", "F3", _backoff_sql(25))
def _(t):
    return search.search_terminology(t.sql(ASKED), _terms(t), 99).withColumn("rank", F.col("rank").cast("bigint"))


PINS = "SELECT CASE p_partkey % 2 WHEN 0 THEN 'icd10' ELSE 'snomed' END AS system, p_partkey AS pin_pos, concat('p', p_partkey) AS code, concat(p_name, ' ', lower(p_type)) AS display FROM {part}"
PINNED = f"""pins AS (SELECT *, {_TOK.format('display')} AS have FROM ({PINS})), jobs AS (SELECT *, {_TOK.format('query')} AS wanted FROM ({ASKED})),
    o AS (SELECT job_id, j.system, code, display, pin_pos, len(list_intersect(wanted, have)) AS overlap FROM jobs j JOIN pins p ON p.system = j.system),
    pr AS (SELECT *, row_number() OVER (PARTITION BY job_id, system ORDER BY overlap DESC, pin_pos) AS rank FROM o)"""


@query("pinned_candidates", "C18 E9", f"WITH {PINNED} SELECT job_id, system, code, display, rank, round(1 - 0.02 * (rank - 1), 4)::DOUBLE AS score FROM pr WHERE rank <= 4")
def _(t):
    jobs = t.sql(ASKED).withColumn("queries", F.array("query")).drop("query")
    return search.pinned_candidates(jobs, t.sql(PINS), 4).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "open_and_pinned", "G2 E5",
    f"""WITH {SEARCH.replace('{asked}', ASKED)}, {PINNED}, hits AS (SELECT q.job_id, q.system, r.code, r.display, {_SCORE.replace('system', 'q.system').replace('rank', 'r.rank')} AS score, 0 AS src, r.rank FROM ({ASKED}) q JOIN ranked r ON r.system = q.system AND r.query = q.query AND r.rank <= 4
          UNION ALL SELECT job_id, system, code, display, round(1 - 0.02 * (rank - 1), 4)::DOUBLE, 1, rank FROM pr WHERE rank <= 4)
        SELECT job_id, system, code, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id, system ORDER BY score DESC, src, rank, code) AS rank FROM hits) WHERE rank <= 4""".replace("AS rank FROM hits) WHERE rank", "AS place FROM hits) WHERE place").replace("score, rank FROM (SELECT *", "score, place AS rank FROM (SELECT *"),
)
def _(t):
    jobs = t.sql(ASKED).withColumn("queries", F.array("query")).drop("query")
    both = search.open_and_pinned(search.union_search(jobs, _terms(t), 4), search.pinned_candidates(jobs, t.sql(PINS), 4), 4)
    return both.select("job_id", "system", "code", "score", F.col("rank").cast("bigint").alias("rank"))


# -- fixed codings ------------------------------------------------------------------------------------------

_V = "lower(vital)"
_US_CORE = (
    f"CASE WHEN {S.any_of(_V, V.SMOKING_TERMS)} THEN '72166-2' "
    + " ".join(f"WHEN {_V} = '{term}' THEN '{code}'" for term, code, _ in V.US_CORE_FIXED) + " "
    + " ".join(f"WHEN contains({_V}, '{term}') THEN '{code}'" for term, code, _ in V.US_CORE_FIXED) + " END"
)


@query("fixed_us_core", "C14", from_parts(f"{_US_CORE} AS code"))
def _(t):
    return parts(t).select("p_partkey", C.fixed_us_core(F.col("vital"))["code"].alias("code"))


_ROLE = "CASE lower(trim(relation)) " + " ".join(f"WHEN '{term}' THEN '{code}'" for term, code, _ in V.FAMILY_ROLES) + " END"


@query("fixed_family_role", "C15", from_parts(f"{_ROLE} AS code, CASE WHEN {_ROLE} IS NULL THEN relation END AS text"))
def _(t):
    found = C.fixed_family_role(F.col("relation"))
    return parts(t).select("p_partkey", found["code"].alias("code"), found["text"].alias("text"))


OVERRIDES = "SELECT 'Observation' AS resource_type, p_partkey AS priority, upper(p_name) AS match, 'urn:own' AS system, concat('own-', p_partkey) AS code, p_name AS display FROM {part}"


def _observations(t):
    return parts(t).select(
        "p_partkey", F.lit("Observation").alias("resource_type"), (F.col("p_size") % 2 == 0).alias("specialty"),
        make_item(name=F.col("assay"), full_name=F.when(F.col("p_partkey") % 3 == 0, F.col("vital")), value=F.col("stage")).alias("item"),
    )


_NAME = "CASE WHEN p_partkey % 3 = 0 THEN vital ELSE assay END"


@query(
    "code_overrides", "C16",
    f"SELECT p_partkey, (SELECT arg_min(o.code, o.priority) FROM ({OVERRIDES}) o WHERE contains(lower({_NAME}), lower(o.match))) AS code FROM ({PARTS})",
)
def _(t):
    return coding.code_overrides(_observations(t), t.sql(OVERRIDES)).select("p_partkey", F.col("override_coding.code").alias("code"))


_SQ = SQUEEZED.replace("assay", _NAME)
_MARKER = "CASE " + " ".join(f"WHEN {S.any_of(_SQ, f)} THEN '{c}'" for _, f, _, c, _ in V.MARKER_FAMILIES) + " END"


@query(
    "match_fixed", "C17",
    f"""SELECT p_partkey, coalesce((SELECT arg_min(o.code, o.priority) FROM ({OVERRIDES}) o WHERE contains(lower({_NAME}), lower(o.match))),
        CASE WHEN p_size % 2 = 0 THEN coalesce({_tnm_sql()}, {_concept_case(_NAME, 2)}, {_MARKER}) END, {_US_CORE.replace('vital', _NAME)}) AS code FROM ({PARTS})""",
)
def _(t):
    rows = coding.code_overrides(_observations(t), t.sql(OVERRIDES))
    return rows.select("p_partkey", coding.fixed_coding(F.col("override_coding"), F.col("specialty"))["code"].alias("code"))


@query(
    "systems_for", "G3",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'snomed,icd10,cpt' WHEN 1 THEN 'rxnorm,cpt,snomed' ELSE 'snomed' END AS systems FROM {part}""",
)
def _(t):
    k = F.col("p_partkey") % 3
    kind = F.when(k == 0, "Condition").when(k == 1, "MedicationRequest").otherwise("AllergyIntolerance")
    pins = F.array(F.lit("cpt"), F.lit("snomed"))
    none = F.lit(None).cast("string")
    return t.part.select("p_partkey", F.array_join(C.systems_for(kind, C.default_systems(kind, none, none), pins), ",").alias("systems"))


@query(
    "search_jobs", "K7",
    f"""SELECT cand_id, coalesce(name, substance) AS term, s.system FROM ({CANDIDATES}) JOIN (SELECT 'Condition' AS resource_type, unnest(['snomed', 'icd10']) AS system
        UNION ALL SELECT 'MedicationRequest', 'rxnorm' UNION ALL SELECT 'Procedure', unnest(['snomed', 'icd10pcs', 'hcpcs']) UNION ALL SELECT 'AllergyIntolerance', 'snomed') s USING (resource_type)
        UNION ALL SELECT cand_id, name, CASE WHEN category IN ('vital-signs', 'laboratory', 'survey') THEN 'loinc' ELSE 'snomed' END FROM ({CANDIDATES}) WHERE resource_type = 'Observation'
        UNION ALL SELECT cand_id, body_site, 'snomed' FROM ({CANDIDATES}) WHERE body_site IS NOT NULL""",
)
def _(t):
    systems = C.default_systems(F.col("resource_type"), F.col("item.codeset_hint"), F.col("item.category"))
    jobs = coding.search_jobs(candidate_items(t), systems, F.array().cast("array<string>"), F.col("resource_type") == "Condition")
    return jobs.select("cand_id", "term", "system")


_JOBS = f"""jobs AS (SELECT cand_id, coalesce(substance, name) AS term, s.system, s.pos FROM ({CANDIDATES}) c JOIN (SELECT 'snomed' AS system, 0 AS pos UNION ALL SELECT 'icd10', 1) s
    ON c.resource_type <> 'FamilyMemberHistory' AND (s.system = 'snomed' OR c.resource_type <> 'AllergyIntolerance'))"""
_TERMS_ASKED = "SELECT system, term AS query FROM jobs UNION ALL SELECT system, split_part(term, ' ', 1) FROM jobs"


@query(
    "select_and_attach", "K7",
    f"""WITH {_JOBS}, {SEARCH.replace('{asked}', _TERMS_ASKED)},
        chosen AS (SELECT j.cand_id, j.pos, coalesce(r.code, again.code) AS code FROM jobs j LEFT JOIN ranked r ON r.system = j.system AND r.query = j.term AND r.rank = 1
          LEFT JOIN ranked again ON again.system = j.system AND again.query = split_part(j.term, ' ', 1) AND again.rank = 1),
        codes AS (SELECT cand_id, string_agg(code, ',' ORDER BY pos) AS codes FROM chosen GROUP BY cand_id)
        SELECT cand_id, CASE WHEN resource_type = 'FamilyMemberHistory' THEN coalesce({_ROLE.replace('relation)', 'relationship)')}, relationship) ELSE coalesce(codes, substance, name) END AS codes
        FROM ({CANDIDATES}) LEFT JOIN codes USING (cand_id)""",
)
def _(t):
    """Select the first hit of every job, ask the others for a better term (the first word), try once more, and put the codings into the items."""
    items = candidate_items(t)
    jobs = fixed(coding.search_jobs(items, F.array(F.lit("snomed"), F.lit("icd10")), F.array().cast("array<string>"), F.lit(False)))

    def round_of(jobs, term, refined):
        names = jobs.select("job_id", "system", term.alias("query"))
        hits = names.join(search.lexical_search(names, _terms(t), 10), ["system", "query"])
        lanes = coding.select_requests(jobs, hits).select("job_id", "lane")
        first = hits.where("rank = 1").select("job_id", F.to_json(F.struct("code")).alias("chosen"))
        better = jobs.select("job_id", F.to_json(F.struct(refined.alias("refined_search_term"))).alias("better"))
        answers = lanes.join(first, "job_id", "left").join(better, "job_id").select("job_id", F.when(F.col("lane") == "select", F.col("chosen")).otherwise(F.col("better")).alias("response"))
        return coding.apply_selection(jobs, hits, answers)

    chosen, retry = round_of(jobs, F.col("term"), F.split("term", " ")[0])
    second, _ = round_of(fixed(retry), F.col("queries")[0], F.lit(None).cast("string"))
    return coding.attach_codings(items, chosen.unionByName(second)).select(
        "cand_id", F.array_join(F.transform("item.coding", lambda c: F.coalesce(c["code"], c["text"])), ",").alias("codes")
    )


# -- rules ----------------------------------------------------------------------------------------------------


def _presets(t):
    """A preset per customer as JSON text."""
    k = F.col("c_custkey")
    return t.customer.select(
        F.concat(
            F.lit('{"id": "p'), k, F.lit('", "resources": {"Condition": {"enabled": '), F.when(k % 2 == 0, "false").otherwise("true"),
            F.lit('}}, "coding": {"Condition": {'),
            F.when(k % 3 == 0, '"subset": [{"system": "urn:s", "code": "1"}]').when(k % 3 == 1, '"codes": [{"system": "urn:s", "code": "2"}], "systems": ["snomed"]').otherwise('"systems": []'),
            F.lit('}}, "prompts": {"Condition": {"active_version": '), k % 3, F.lit(', "versions": [{"version": 1, "text": "one"}, {"version": 2, "text": "two"}]}}}'),
        ).alias("value")
    )


@query(
    "resolve_rules", "K9 E8",
    """SELECT 'p' || c_custkey AS preset_id, CASE WHEN c_custkey % 2 = 0 THEN 'off' ELSE 'on' END AS state, CASE c_custkey % 3 WHEN 1 THEN 'snomed' ELSE '' END AS open_systems,
        CASE c_custkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '' END AS pinned, CASE c_custkey % 3 WHEN 1 THEN 'one' ELSE 'two' END AS prompt FROM {customer}""",
)
def _(t):
    rules = catalog.resolve_rules(_presets(t)).where("resource_type = 'Condition'")
    return rules.select(
        "preset_id", F.when(F.col("enabled"), "on").otherwise("off").alias("state"), F.array_join("open_systems", ",").alias("open_systems"),
        F.array_join(F.transform("pinned", lambda p: p["code"]), ",").alias("pinned"), F.col("extract_prompt").alias("prompt"),
    )


@query("drop_disabled_types", "B3", f"SELECT cand_id FROM ({CANDIDATES}) WHERE resource_type NOT IN ('Condition', 'Procedure')")
def _(t):
    rules = t.region.select(F.when(F.col("r_regionkey") == 0, "Condition").when(F.col("r_regionkey") == 1, "Procedure").otherwise("Observation").alias("resource_type"), (F.col("r_regionkey") > 1).alias("enabled"))
    return catalog.drop_disabled_types(candidate_items(t), rules).select("cand_id")


@query(
    "read_ig_catalog", "A12",
    """SELECT 'g' || n_nationkey AS guide, 'Observation' AS resource_type, 0 AS position, CASE n_nationkey % 2 WHEN 0 THEN 'http://loinc.org' ELSE 'urn:other' END AS system, 'c' || n_nationkey AS code FROM {nation}""",
)
def _(t):
    k = F.col("n_nationkey")
    guide = F.concat(
        F.lit('{"base": [{"id": "g'), k, F.lit('", "resources": {"Observation": {"profiles": ["http://p/1"], "fixed": [{"system": "'), F.when(k % 2 == 0, "loinc").otherwise("urn:other"),
        F.lit('", "code": "c'), k, F.lit('"}]}}}]}'),
    )
    return catalog.read_ig_catalog(t.nation.select(guide.alias("value")))[1].drop("display")


_GUIDES = """{"base": [{"id": "b1", "resources": {"Condition": {"profiles": ["http://b/never"], "fixed": [{"system": "snomed", "code": "1"}, {"system": "snomed", "code": "2", "display": "two"}]},
    "Procedure": {"fixed": [{"system": "cpt", "code": "9"}, {"system": "cpt", "code": ""}]}}}, {"id": "b1", "resources": {}}],
    "specialties": [{"id": "s1", "resources": {"Condition": {"profiles": ["http://s/1", "http://s/2"], "fixed": [{"system": "snomed", "code": "2", "display": "again"}, {"system": "urn:x", "code": "3"}]}}}]}"""


def _effective(t):
    """Presets of customers: with and without guides, some with conditions off and open or closed systems."""
    k = F.col("c_custkey")
    guides = F.when(k % 3 == 0, ', "ig": {"base": "b1", "specialty": "s1"}').when(k % 3 == 1, ', "ig": {"base": "b1"}').otherwise("")
    presets = t.customer.select(F.concat(
        F.lit('{"id": "p'), k, F.lit('"'), guides, F.lit(', "resources": {"Condition": {"enabled": '), F.when(k % 4 == 0, "false").otherwise("true"), F.lit('}}, "coding": {"Condition": {"systems": '),
        F.when(k % 5 == 0, "[]").otherwise("null"), F.lit("}}}"),
    ).alias("value"))
    return catalog.effective_rules(presets, *catalog.read_ig_catalog(t.region.where("r_regionkey = 0").select(F.lit(_GUIDES).alias("value"))))


@query(
    "effective_rules", "K9 A12",
    """SELECT 'p' || c_custkey AS preset_id, kind AS resource_type, CASE WHEN c_custkey % 3 = 2 THEN '' WHEN kind = 'Procedure' THEN 'http://www.ama-assn.org/go/cpt|9|' WHEN kind <> 'Condition' THEN ''
        WHEN c_custkey % 3 = 0 THEN 'http://snomed.info/sct|1|;http://snomed.info/sct|2|two;urn:x|3|' ELSE 'http://snomed.info/sct|1|;http://snomed.info/sct|2|two' END AS fixed,
        CASE WHEN c_custkey % 3 = 0 AND kind = 'Condition' THEN 'http://s/1,http://s/2' ELSE '' END AS candidate_profiles
        FROM {customer}, (SELECT unnest(['Condition', 'Observation', 'MedicationRequest', 'Procedure', 'AllergyIntolerance', 'FamilyMemberHistory']) AS kind)""",
)
def _(t):
    told = F.transform("fixed", lambda c: F.concat_ws("|", c["system"], c["code"], c["display"]))
    return _effective(t).select("preset_id", "resource_type", F.array_join(told, ";").alias("fixed"), F.array_join("candidate_profiles", ",").alias("candidate_profiles"))


@query(
    "rules_by_preset", "B3 K9 B5",
    f"""SELECT cand_id, uncoded OR resource_type <> 'Condition' OR patient_id::BIGINT % 5 <> 0 OR (patient_id::BIGINT % 3 <> 2 AND code0 IN ('1', '2')) AS allowed
        FROM ({CANDIDATES}) WHERE resource_type <> 'Condition' OR patient_id::BIGINT % 4 <> 0""",
)
def _(t):
    """Each patient's candidates under a preset of their own: all presets in one run, and a type switched off leaves for its own preset alone."""
    rules = _effective(t)
    rows = candidate_items(t).withColumn("preset_id", F.concat(F.lit("p"), "patient_id"))
    kept = assembly.with_rules(catalog.drop_disabled_types(rows, rules), rules)
    return kept.select("cand_id", assembly.code_allowed(assembly.primary_codings(), F.col("open_systems"), F.col("pinned"), F.col("fixed")).alias("allowed"))


__all__ = ["make_item"]


# -- vectors: every embedding is a term's vector, and a variant of a job of four ----------------------------------------

VECTORS = """SELECT CAST(label % 3 AS STRING) AS system, concat('c', CAST(vec_id % 200 AS STRING)) AS code, concat('term ', CAST(vec_id AS STRING)) AS display,
       embedding AS vector, CAST(floor(vec_id / 4) AS BIGINT) AS job_id, vec_id % 4 AS query_pos FROM {embeddings}"""


@query(
    "vector_search", "C21",
    f"""WITH v AS ({VECTORS}), u AS (SELECT *, vector::DOUBLE[] AS x, sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])) AS size FROM v),
        scored AS (SELECT q.job_id, q.system, q.query_pos, t.code, t.display, round(list_inner_product(q.x, t.x) / (q.size * t.size), 6) AS score FROM u q JOIN u t ON q.system = t.system),
        hits AS (SELECT *, row_number() OVER (PARTITION BY job_id, system, query_pos ORDER BY score DESC, code, display) AS place FROM scored QUALIFY place <= 5),
        codes AS (SELECT job_id, system, code, first(display ORDER BY score DESC, query_pos, place) AS display, max(score) AS score, min(query_pos * 10 + place) AS hit FROM hits GROUP BY ALL)
        SELECT job_id, system, code, display, score, row_number() OVER (PARTITION BY job_id, system ORDER BY score DESC, hit, code) AS rank FROM codes QUALIFY rank <= 10""",
)
def _(t):
    rows = t.sql(VECTORS)
    return vectors.vector_search(rows.select("job_id", "system", "query_pos", "vector"), rows.select("system", "code", "display", "vector"))
