"""Check queries of bundles, writeback, the rule lane, streams' batch twins and the end-to-end plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.harness.measuring import CALLS, PRICED, _priced
from chartspark.harness.registry import query
from chartspark.harness.reviewing import _classed, _records, _resources
from chartspark.harness.tables import CANDIDATES, candidate_items, chart_facts
from chartspark.operators import assembly, rule_lane, sentences, writeback
from chartspark.plans import augmentation
from chartspark.sources import bundles
from chartspark.streaming import jobs

# -- bundles: one bundle text per customer, with its orders as documents ---------------------


def _bundle_files(t):
    entries = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_custkey").alias("n"), "o_orderkey",
            F.concat(
                F.lit('{"fullUrl": "urn:uuid:'), "o_orderkey", F.lit('", "resource": {"resourceType": "DocumentReference", "id": "d'), "o_orderkey",
                F.lit('", "date": "2026-01-01", "type": {"text": "Progress note"}, "author": [{"display": "Dr", "reference": "Practitioner/p'), F.col("o_custkey") % 7,
                F.lit('"}], "content": [{"attachment": {"data": "'), F.base64(F.encode(F.concat(F.lit("Note of order "), "o_orderkey"), "UTF-8")),
                F.lit('"}}], "context": {"encounter": [{"reference": "Encounter/e'), "o_custkey", F.lit('"}]}}}'),
            ).alias("entry"),
        )
    )
    patient = F.concat(F.lit('{"resource": {"resourceType": "Patient", "id": "pat'), F.col("n"), F.lit('"}}'))
    return (
        entries.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "entry"))), lambda e: e["entry"]), ",").alias("body"))
        .select("n", F.concat(F.lit('{"resourceType": "Bundle", "entry": ['), F.when(F.col("n") % 6 != 0, F.concat(patient, F.lit(","))).otherwise(""), "body", F.lit("]}")).alias("value"))
    )


IN_BUNDLES = "SELECT c_custkey AS n, o_orderkey, o_custkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey"


@query(
    "read_bundles", "A1 A2",
    f"""SELECT CASE WHEN n % 6 <> 0 THEN 'pat' || n END AS patient_id, 'd' || o_orderkey AS resource_id, 'DocumentReference' AS resource_type FROM ({IN_BUNDLES})
        UNION ALL SELECT DISTINCT 'pat' || n, 'pat' || n, 'Patient' FROM ({IN_BUNDLES}) WHERE n % 6 <> 0""",
)
def _(t):
    return bundles.parse_bundles(_bundle_files(t)).select("patient_id", "resource_id", "resource_type")


@query("bundles_without_patient", "A2", f"SELECT count(DISTINCT n) AS n FROM ({IN_BUNDLES}) WHERE n % 6 = 0")
def _(t):
    return bundles.without_patient(bundles.parse_bundles(_bundle_files(t))).agg(F.count(F.lit(1)).alias("n"))


@query(
    "decode_documents", "A3",
    f"SELECT 'd' || o_orderkey AS document_id, 'Progress note' AS type, 'Dr' AS author, 'Note of order ' || o_orderkey AS text, 'Encounter/e' || o_custkey AS encounter_id FROM ({IN_BUNDLES})",
)
def _(t):
    return bundles.decode_documents(bundles.parse_bundles(_bundle_files(t))).select("document_id", "type", "author", "text", "encounter_id")


@query("referenced_actors", "A5", f"SELECT DISTINCT CASE WHEN n % 6 <> 0 THEN 'pat' || n END AS patient_id, 'Practitioner' AS kind, 'p' || o_custkey % 7 AS actor_id FROM ({IN_BUNDLES})")
def _(t):
    return bundles.referenced_actors(bundles.parse_bundles(_bundle_files(t)))


@query(
    "read_bulk_export", "A4",
    """SELECT CAST(o_custkey AS STRING) AS patient_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Condition' ELSE 'AllergyIntolerance' END AS resource_type, CAST(o_orderkey AS STRING) AS resource_id FROM {orders}""",
)
def _(t):
    k = F.col("o_orderkey")
    line = F.concat(
        F.lit('{"resourceType": "'), F.when(k % 2 == 0, "Condition").otherwise("AllergyIntolerance"), F.lit('", "id": "'), k, F.lit('", "'),
        F.when(k % 2 == 0, "subject").otherwise("patient"), F.lit('": {"reference": "Patient/'), "o_custkey", F.lit('"}}'),
    )
    return bundles.parse_bulk_lines(t.orders.select(line.alias("value"))).select("patient_id", "resource_type", "resource_id")


@query(
    "provenance_for", "A6",
    "SELECT DISTINCT CAST(o_custkey AS STRING) AS patient_id, CAST(l_orderkey * 10 + l_linenumber AS STRING) AS resource_id FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey",
)
def _(t):
    resources = t.orders.select(F.col("o_custkey").cast("string").alias("patient_id"), F.lit("Condition").alias("resource_type"), F.col("o_orderkey").cast("string").alias("resource_id"))
    provenances = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("resource_id"),
        F.concat(F.lit('{"target": [{"reference": "Condition/'), "l_orderkey", F.lit('"}, {"reference": "Device/1"}]}')).alias("resource"),
    )
    return bundles.provenance_for(resources, provenances)


@query(
    "chart_facts_from_resources", "D8 H5 H46",
    f"SELECT cand_id AS resource_id, coalesce(name, substance, relationship) AS text, CASE WHEN resource_type = 'MedicationRequest' THEN coalesce(CAST(TRY_CAST(dose_value AS DOUBLE) AS STRING), nullif(regexp_extract(coalesce(dose_value, ''), '[0-9]+', 0), ''), '') ELSE '' END AS dose FROM ({CANDIDATES}) WHERE resource_type IN ('MedicationRequest', 'Condition', 'AllergyIntolerance')",
)
def _(t):
    rows = _resources(t).where("resource_type IN ('MedicationRequest', 'Condition', 'AllergyIntolerance')").select(
        "patient_id", F.col("cand_pos").alias("entry_pos"), "resource_type", F.col("cand_id").alias("resource_id"), F.lit("").alias("full_url"), "resource"
    )
    return bundles.chart_facts(rows).select("resource_id", "text", "dose")


# -- writeback --------------------------------------------------------------------------------------------------------------

_K = "CAST(split_part(cand_id, '-', 4) AS BIGINT)"


@query(
    "superseded", "C27",
    f"""WITH p AS (SELECT cand_id AS id, patient_id, CASE WHEN {_K} % 8 = 2 THEN NULL ELSE 'r' || {_K} % 40 END AS target FROM ({CANDIDATES}) WHERE {_K} % 4 = 2)
        SELECT id, CASE WHEN target IS NULL THEN 'updating proposal without target' WHEN substr(target, 2)::BIGINT % 3 = 0 THEN 'superseded resource not found' ELSE target END AS outcome FROM p""",
)
def _(t):
    target = F.when(F.expr(f"{_K} % 8 = 2"), F.array().cast("array<string>")).otherwise(F.array(F.expr(f"concat('r', {_K} % 40)")))
    proposals = _classed(t).select(F.col("cand_id").alias("id"), "patient_id", "classification", target.alias("supersedes"))
    chart = (
        proposals.select("patient_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).where("k % 3 <> 0")
        .select("patient_id", F.concat(F.lit("r"), "k").alias("resource_id"), F.lit("1").alias("version_id"))
    )
    found, errors = writeback.superseded(proposals, chart)
    return found.select("id", F.col("resource_id").alias("outcome")).unionByName(errors.select("id", F.col("error").alias("outcome")))


def _accepted(t):
    rows = _resources(t).withColumn("classification", F.expr(f"CASE {_K} % 4 WHEN 2 THEN 'UPDATING' WHEN 3 THEN 'CONFLICTING' ELSE 'NEW' END")).where(f"{_K} % 10 = 2 OR {_K} % 10 = 3")
    accepted = rows.select(
        F.col("cand_id").alias("id"), "patient_id", "resource_type", "resource", "classification",
        F.when(F.col("classification") == "UPDATING", "old").alias("target_id"), F.when(F.col("classification") == "UPDATING", "7").alias("version_id"), F.lit("Dr Who").alias("attester"),
    )
    cited = rows.select(F.col("cand_id").alias("id"), F.when(F.expr(f"{_K} % 20 = 3"), F.concat(F.lit("inline_"), "document_id")).otherwise(F.col("document_id")).alias("document_id"), F.lit(3).alias("char_start"), F.lit(9).alias("char_end"), F.lit("quoted").alias("text"))
    notes = rows.select(F.concat(F.lit("inline_"), "document_id").alias("document_id"), F.lit("Note").alias("type"), F.lit("2026-01-01").alias("date"), F.lit("whole text").alias("text")).distinct()
    return accepted, cited, notes


@query(
    "transaction_bundles", "I11 I12 I13 I14 A15",
    f"""SELECT cand_id AS id, CASE WHEN {_K} % 20 = 3 THEN 1 ELSE 0 END AS n_inline, CASE {_K} % 4 WHEN 2 THEN 'PUT' ELSE 'POST' END AS method, CASE {_K} % 4 WHEN 2 THEN 'UPDATE' ELSE 'CREATE' END AS activity,
        CASE {_K} % 4 WHEN 2 THEN 'old' END AS target_id, '2' AS agents FROM ({CANDIDATES}) WHERE {_K} % 10 IN (2, 3)""",
)
def _(t):
    b = writeback.transaction_bundles(*_accepted(t), recorded="2026-01-01T00:00:00Z")
    entry = F.from_json("bundle", "entry array<struct<resource:struct<id:string,resourceType:string,activity:struct<coding:array<struct<code:string>>>,agent:array<struct<who:struct<display:string>>>>,request:struct<method:string>>>")["entry"]
    own = F.get(entry, F.col("n_inline"))
    prov = F.get(entry, F.col("n_inline") + 1)["resource"]
    return b.select(
        "id", "n_inline", own["request"]["method"].alias("method"), F.get(prov["activity"]["coding"], F.lit(0))["code"].alias("activity"), own["resource"]["id"].alias("target_id"),
        F.size(prov["agent"]).cast("string").alias("agents"),
    )


@query(
    "transaction_refs", "I15",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'Condition/c' || o_orderkey END AS resource_ref, CASE WHEN o_orderkey % 3 = 2 THEN 'transaction response had no resource entry' END AS error FROM {orders}""",
)
def _(t):
    k = F.col("o_orderkey")
    first = F.when(k % 3 == 0, F.concat(F.lit('{"response": {"location": "http://h/fhir/Condition/c'), k, F.lit('/_history/1"}}'))).when(
        k % 3 == 1, F.concat(F.lit('{"resource": {"resourceType": "Condition", "id": "c'), k, F.lit('"}}'))
    ).otherwise("{}")
    body = F.concat(F.lit('{"entry": ['), first, F.lit(', {"response": {"location": "Provenance/p'), k, F.lit('"}}]}'))
    return writeback.transaction_refs(t.orders.select(k.alias("id"), F.lit("Condition").alias("resource_type"), F.lit(0).alias("n_inline"), body.alias("response"))).select("id", "resource_ref", "error")


@query("decision_log", "I16", "SELECT 'accept' AS action, CAST(o_custkey AS STRING) AS run_id, 'Condition' AS resource_type, o_orderpriority AS reviewer, 'Condition/' || o_orderkey AS resource_ref FROM {orders}")
def _(t):
    return writeback.decision_log(
        t.orders.select(
            F.lit("accept").alias("action"), F.col("o_custkey").cast("string").alias("run_id"), F.lit("Condition").alias("resource_type"), F.col("o_orderpriority").alias("reviewer"),
            F.concat(F.lit("Condition/"), "o_orderkey").alias("resource_ref"), F.lit("private words").alias("reason"),
        )
    )


# -- rule lane: cue words are frequent words of the prose ---------------------------------------------------------------------

CUES = rule_lane.Cues(
    include={"Condition": ("the", "die"), "Observation": ("on", "la"), "AllergyIntolerance": ("thing", "heit"), "FamilyMemberHistory": ("her", "ich")},
    exclude={"Condition": ("of",)},
    social_history=("is", "en"),
)
TURNS = "SELECT conv_id AS document_id, CAST(turn + 1 AS INT) AS number, text FROM {conversations}"


def _word(column, words):
    return "regexp_matches(lower(' ' || regexp_replace(" + column + r", '[^\p{L}\p{N}]+', '  ', 'g') || ' '), ' (" + "|".join(words) + ") ')"


_A, _F, _O, _C = (_word("text", CUES.include[k]) for k in ("AllergyIntolerance", "FamilyMemberHistory", "Observation", "Condition"))
_SOCIAL, _NOT = _word("text", CUES.social_history), _word("text", CUES.exclude["Condition"])


@query(
    "route_sentences", "K11",
    f"""WITH r AS (SELECT *, {_A} AS a, {_F} AS f, {_O} AS o, {_C} AND NOT {_NOT} AS c, {_SOCIAL} AS s FROM ({TURNS}))
        SELECT document_id, number, 'AllergyIntolerance' AS resource_type FROM r WHERE a UNION ALL SELECT document_id, number, 'FamilyMemberHistory' FROM r WHERE f AND NOT a
        UNION ALL SELECT document_id, number, 'Observation' FROM r WHERE o AND NOT a AND NOT f UNION ALL SELECT document_id, number, 'Condition' FROM r WHERE c AND NOT a AND NOT f AND NOT (s AND o)""",
)
def _(t):
    return rule_lane.route_sentences(t.sql(TURNS), CUES).select("document_id", "number", "resource_type")


@query(
    "extract_dates", "K13",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN d WHEN 1 THEN substr(d, 1, 7) ELSE substr(d, 1, 4) END AS dates FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM {orders})""",
)
def _(t):
    k, d = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "MM/dd/yyyy")
    text = F.concat(F.lit("seen on "), F.when(k == 0, d).when(k == 1, F.date_format("o_orderdate", "MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy")), F.lit(" by clerk 12345."))
    return t.orders.select("o_orderkey", F.array_join(rule_lane.literal_dates(text), ",").alias("dates"))


def _grams(table: str, keys: str) -> str:
    """Words and runs of three words of a text column."""
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
    runs = "unnest(list_concat(w, [array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)]))"
    return f"SELECT {keys}{runs} AS gram FROM (SELECT *, {words} AS w FROM {table})"


@query(
    "gazetteer_candidates", "K14",
    f"SELECT DISTINCT document_id, number, gram AS code FROM ({_grams(f'({TURNS})', 'document_id, number, ')}) JOIN (SELECT DISTINCT gram FROM ({_grams('{benchmark}', '')})) USING (gram)",
)
def _(t):
    """Every word and every run of three words of the benchmark passages as a term."""
    return rule_lane.gazetteer_candidates(t.sql(TURNS), _terms(t)).select("document_id", "number", "code").distinct()


def _terms(t):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    runs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.array_join(F.slice("w", i + 1, 3), " "))
    terms = t.benchmark.select(words.alias("w")).select(F.explode(F.concat("w", runs)).alias("term")).distinct()
    return terms.select(F.lit("words").alias("system"), F.col("term").alias("code"), F.col("term").alias("display"))


@query(
    "parse_rules", "K12",
    """SELECT o_orderkey AS document_id, CASE o_orderkey % 3 WHEN 0 THEN 'stopped' WHEN 1 THEN 'active' ELSE 'on-hold' END AS status, CAST(o_orderkey % 90 AS STRING) AS dose, 'mg' AS unit, 'twice daily' AS frequency, CASE WHEN o_orderkey % 2 = 0 THEN 'uncertain' ELSE 'probable' END AS certainty FROM {orders}""",
)
def _(t):
    k = F.col("o_orderkey")
    text = F.concat(
        F.when(k % 3 == 0, "Stopped").when(k % 3 == 1, "Start").otherwise("Please hold"), F.lit(" metoprolol "), k % 90, F.lit(" mg twice daily"), F.when(k % 2 == 0, " for possible angina.").otherwise(".")
    )
    routed = t.orders.select(k.alias("document_id"), F.lit(1).alias("number"), text.alias("text"), F.lit("MedicationRequest").alias("resource_type"), F.lit("metoprolol").alias("name"))
    return rule_lane.parse_rules(routed).select(
        "document_id", "item.status", F.col("item.dose.value").alias("dose"), F.col("item.dose.unit").alias("unit"), "item.frequency", "item.certainty"
    )


@query(
    "parse_code_list", "K15",
    """SELECT p_partkey AS list_id, 'http://snomed.info/sct' AS system, CAST(100000 + p_partkey AS STRING) AS code FROM {part} UNION ALL SELECT p_partkey, 'http://loinc.org', (1000 + p_partkey % 9000) || '-' || p_size % 10 FROM {part}
        UNION ALL SELECT p_partkey, 'http://hl7.org/fhir/sid/icd-10-cm', 'E' || (10 + p_size % 80) || '.9' FROM {part}""",
)
def _(t):
    k = F.col("p_partkey")
    text = F.concat(F.lit("SNOMED: "), 100000 + k, F.lit("\n"), 1000 + k % 9000, F.lit("-"), F.col("p_size") % 10, F.lit(", E"), 10 + F.col("p_size") % 80, F.lit(".9\nplain 123456 number"))
    return rule_lane.parse_code_list(t.part.select(k.alias("list_id"), text.alias("text")))


@query(
    "contract_check", "C35",
    f"""WITH e AS (SELECT '1999-0' || (n_nationkey % 9 + 1) AS p, CASE n_nationkey % 2 WHEN 0 THEN 'Condition' ELSE 'Observation' END AS resource_type, CASE n_nationkey % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'bolt' ELSE 'gear' END AS needle FROM {{nation}}),
        d AS (SELECT DISTINCT document_id, note_date FROM ({CANDIDATES}))
        SELECT DISTINCT d.document_id, e.resource_type, e.needle, EXISTS (SELECT 1 FROM ({CANDIDATES}) c WHERE c.document_id = d.document_id AND c.resource_type = e.resource_type AND contains(lower(c.name), e.needle)) AS met FROM d JOIN e ON starts_with(d.note_date, e.p)""",
)
def _(t):
    n = F.col("n_nationkey")
    expectations = t.nation.select(
        F.concat(F.lit("1999-0"), n % 9 + 1).alias("date_prefix"), F.when(n % 2 == 0, "Condition").otherwise("Observation").alias("resource_type"),
        F.when(n % 3 == 0, "ring").when(n % 3 == 1, "bolt").otherwise("gear").alias("needle"),
    ).distinct()
    items = candidate_items(t)
    candidates = items.select("document_id", "resource_type", F.col("item.name").alias("headline"))
    return rule_lane.contract_check(candidates, items.select("document_id", F.col("note_date").alias("date")).distinct(), expectations).distinct()


@query("rule_lane_extract", "K11 K12 K14")
def _(t):
    """Whole documents through the rule lane, with words and phrases of the benchmark passages as the terms."""
    terms = _terms(t).withColumn("resource_type", F.lit("Condition"))
    notes = sentences.with_sentences(t.documents.select(F.col("doc_id").alias("document_id"), "text"))
    return rule_lane.extract(notes, terms, CUES).select("document_id", "number", "item.name", "item.negated", "item.certainty")


# -- batch twins of the streams ---------------------------------------------------------------------------------------------------


@query(
    "usage_windows", "L2",
    f"""WITH {PRICED} SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, finished_at)) AS window_us, stage, model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(cost)::BIGINT AS micro_usd FROM priced GROUP BY ALL""",
)
def _(t):
    rows = jobs.usage_windows(_priced(t).withColumn("ts", F.col("finished_at")))
    return rows.select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_us"), "stage", "model", "calls", "input_tokens", (F.col("usd_cost") * 1000000).cast("bigint").alias("micro_usd"))


@query(
    "pair_runs", "L3",
    """SELECT s.event_id AS run_id, coalesce(f.status, 'unfinished') AS status, (epoch_us(f.ts) - epoch_us(s.ts)) // 1000 AS duration_ms FROM {events} s LEFT JOIN (SELECT event_id - 1 AS run_id, ts, event_type AS status FROM {events} WHERE event_id % 3 = 1) f
        ON f.run_id = s.event_id AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 5 MINUTE WHERE s.event_id % 3 = 0""",
)
def _(t):
    started = t.events.where("event_id % 3 = 0").select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"))
    finished = t.events.where("event_id % 3 = 1").select((F.col("event_id") - 1).alias("run_id"), F.col("ts").alias("finished_at"), F.col("event_type").alias("status"))
    return jobs.pair_runs(started, finished, "5 minutes").select("run_id", "status", "duration_ms")


@query(
    "run_sessions", "L5",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opened FROM {events}),
        s AS (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
        SELECT CAST(user_id AS STRING) AS user_key, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_events FROM s GROUP BY user_id, session""",
)
def _(t):
    rows = jobs.run_sessions(t.events.select(F.col("user_id").cast("string").alias("user_key"), "ts"), 360)
    return rows.select("user_key", F.unix_micros(F.col("session_start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("session_end").cast("timestamp")).alias("end_us"), F.col("n_events").cast("bigint").alias("n_events"))


@query("stream_notes_twin", "L1", "SELECT min(doc_id) AS document_id, length(text) AS size FROM {documents} WHERE length(trim(text)) > 0 GROUP BY text")
def _(t):
    notes = t.documents.select(F.col("doc_id").alias("document_id"), "text", F.timestamp_seconds("doc_id").alias("arrived_at"))
    return jobs.stream_notes(notes).select("document_id", F.length("text").cast("bigint").alias("size"))


# -- end to end ------------------------------------------------------------------------------------------------------------------------


def _augment(t):
    notes = candidate_items(t).groupBy("document_id").agg(F.min("note_date").alias("date")).withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda n: F.concat(F.lit("Sentence "), n)), "\n"))
    spans = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda n: F.struct(n.alias("number"), ((n - 1) * 11).alias("start"), ((n - 1) * 11 + 10).alias("end"), F.concat(F.lit("Sentence "), n).alias("text")))
    encounters = candidate_items(t).where("encounter_id IS NOT NULL").select("patient_id", "encounter_id").distinct().withColumn("encounter_ref", F.col("encounter_id"))
    return augmentation.augment(candidate_items(t), notes.withColumn("sentences", spans), chart_facts(t), encounters)


@query("assemble_proposals", "I10")
def _(t):
    return _augment(t)[0].select("id", "resource_type", "classification", "confidence_tier", "conflict_group_id", "resource")


@query("write_proposals", "A14", f"SELECT cand_id AS id, 'pending' AS status, 24::BIGINT - 3 AS n_keys FROM ({CANDIDATES}) WHERE resource_type = 'Observation'")
def _(t):
    rows = _resources(t).where("resource_type = 'Observation'").select(
        F.col("cand_id").alias("id"), "resource_type", "resource", F.lit("NEW").alias("classification"), F.lit("REVIEW").alias("confidence_tier"), F.lit(0.8).alias("confidence_score"),
        F.array().cast("array<string>").alias("flags"), F.lit(None).cast("string").alias("conflict_group_id"), F.lit("").alias("classification_reasoning"), F.lit("").alias("extraction_reasoning"),
        F.lit(None).cast("string").alias("merge_reasoning"), F.lit(None).cast("string").alias("confidence_breakdown"), F.array().cast("array<string>").alias("supersedes"),
    )
    records = assembly.review_records(rows, "run")
    return records.select("id", "status", F.lit(len(records.columns)).cast("bigint").alias("n_keys"))


__all__ = ["CALLS", "V", "_records"]
