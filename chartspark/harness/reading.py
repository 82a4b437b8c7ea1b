"""Check queries of notes, sentences, citations and the request tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions import text as T
from chartspark.harness import merging
from chartspark.harness import sqltext as S
from chartspark.harness.registry import query
from chartspark.harness.tables import CANDIDATES, candidate_items, chart_facts
from chartspark.operators import citations, lanes, merge, reconcile, sentences, spans
from chartspark.session import fixed
from chartspark.sources import notes as N


def _notes(t):
    return t.documents.select(F.col("doc_id").alias("document_id"), "text", "source", "lang")


# Notes whose sentences are given: the turns of a conversation, one line each.
TURNS = """SELECT conv_id AS document_id, CAST(turn + 1 AS INT) AS number, trim(replace(text, chr(10), ' ')) AS text FROM {conversations}"""
PLACED = f"""turns AS ({TURNS}), placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM turns)"""


def _talks(t):
    """``document_id, text, sentences`` with exact offsets, from the turns."""
    turns = t.sql(TURNS).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("turns"))
    before = lambda i: F.aggregate(F.slice("turns", F.lit(1), i), F.lit(0), lambda a, s: a + F.length(s["text"]) + 1)
    return turns.select(
        "document_id", F.array_join(F.transform("turns", lambda s: s["text"]), "\n").alias("text"),
        F.transform(
            "turns",
            lambda s, i: F.struct(s["number"].alias("number"), before(i).alias("start"), (before(i) + F.length(s["text"])).alias("end"), s["text"].alias("text")),
        ).alias("sentences"),
    )


@query(
    "notes_from_text", "A7",
    r"""SELECT doc_id, 'inline_' || substr(sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')), 1, 12) AS document_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS size FROM {documents} WHERE doc_id % 10 <> 0""",
)
def _(t):
    raw = t.documents.withColumn("text", F.when(F.col("doc_id") % 10 == 0, "  \n ").otherwise(F.col("text")))
    return N.notes_from_text(raw.select("doc_id", "text")).select("doc_id", "document_id", F.length("text").cast("bigint").alias("size"))


@query(
    "guardrail_check", "B1",
    """SELECT doc_id AS document_id, CASE WHEN doc_id % 50 = 0 THEN 'empty' WHEN strlen(text) > 9000 THEN 'too_large' END AS reason,
        CASE WHEN doc_id % 50 = 0 THEN 'empty' WHEN strlen(text) > 9000 THEN 'binary_or_garbage' END AS category FROM {documents}""",
)
def _(t):
    notes = _notes(t).withColumn("text", F.when(F.col("document_id") % 50 == 0, " \n\t").otherwise(F.col("text")))
    return N.guardrail_check(notes, max_bytes=9000).select("document_id", F.col("reject_reason").alias("reason"), F.col("reject_category").alias("category"))


@query(
    "guardrail_printable", "B1",
    "SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'non_text' END AS reason FROM {documents}",
)
def _(t):
    # A third of the notes get one control character per four characters in front.
    junk = F.repeat(F.lit("\x01"), F.ceil(F.length("text") / 4).cast("int"))
    notes = _notes(t).withColumn("text", F.when(F.col("document_id") % 3 == 0, F.concat(junk, "text")).otherwise(F.col("text")))
    return N.guardrail_check(notes).select("document_id", F.col("reject_reason").alias("reason"))


@query(
    "guardrail_verdicts", "B2",
    """SELECT d.doc_id AS document_id, CASE WHEN strlen(text) > 9000 THEN 'too_large' WHEN l.quality = 0 THEN 'non_clinical_text' END AS reason
        FROM {documents} d LEFT JOIN {labels} l USING (doc_id)""",
)
def _(t):
    verdicts = t.labels.select(
        F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("accept"), F.lit("non_clinical_text").alias("category"), F.lit("prose").alias("reason")
    )
    return N.apply_guardrail_verdicts(N.guardrail_check(_notes(t), 9000), verdicts).select("document_id", F.col("reject_reason").alias("reason"))


@query("split_sentences", "K1 M2")
def _(t):
    return sentences.sentence_rows(_notes(t))


@query("span_roundtrip", "J15", "SELECT doc_id AS document_id, 0::BIGINT AS mismatches FROM {documents} WHERE length(trim(text)) > 0")
def _(t):
    notes = _notes(t)
    rows = fixed(sentences.sentence_rows(notes))
    wrong = sentences.span_mismatches(rows, notes).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("document_id").distinct().join(wrong, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("mismatches"))


@query("number_sentences", "E1", f"WITH {PLACED} SELECT document_id, number, start FROM placed")
def _(t):
    rows = _talks(t).select("document_id", F.inline("sentences")).drop("number")
    return sentences.number_sentences(rows).select("document_id", "number", "start")


@query("numbered_note", "H36", f"SELECT document_id, string_agg('[' || number || '] ' || trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) ORDER BY number) AS numbered_note FROM ({TURNS}) GROUP BY document_id")
def _(t):
    return sentences.numbered_notes(t.sql(TURNS))


# References: every conversation cites its even turns, its first turns and some that do not exist.
REFS = f"""refs AS (SELECT DISTINCT document_id, 'even' AS merged_id, number AS n FROM turns WHERE number % 3 <> 0 UNION SELECT DISTINCT document_id, 'head', number FROM turns WHERE number <= 3)"""


def _refs(t):
    turns = t.sql(TURNS)
    some = turns.where("number % 3 <> 0").select("document_id", F.lit("even").alias("merged_id"), "number").unionByName(
        turns.where("number <= 3").select("document_id", F.lit("head").alias("merged_id"), "number")
    )
    return some.groupBy("document_id", "merged_id").agg(F.concat(F.collect_list("number"), F.array(F.lit(0), F.lit(9999))).alias("source_sentences")).withColumn("ref_pos", F.lit(0))


@query(
    "sentence_runs", "E2",
    f"""WITH turns AS ({TURNS}), {REFS}, i AS (SELECT *, n - row_number() OVER (PARTITION BY document_id, merged_id ORDER BY n) AS island FROM refs)
        SELECT document_id, merged_id, min(n) AS first, max(n) AS last FROM i GROUP BY document_id, merged_id, island""",
)
def _(t):
    kept = F.filter("source_sentences", lambda n: (n > 0) & (n < 9999))
    return _refs(t).select("document_id", "merged_id", F.explode(citations.sentence_runs(kept)).alias("run")).select(
        "document_id", "merged_id", F.get("run", F.lit(0)).alias("first"), F.element_at("run", -1).alias("last")
    )


@query(
    "resolve_citations", "C10",
    f"""WITH {PLACED}, {REFS}, i AS (SELECT *, n - row_number() OVER (PARTITION BY document_id, merged_id ORDER BY n) AS island FROM refs),
        r AS (SELECT document_id, merged_id, min(n) AS a, max(n) AS b FROM i GROUP BY document_id, merged_id, island)
        SELECT r.document_id, merged_id, p.start AS char_start, q.start + length(q.text) AS char_end, (SELECT string_agg(text, chr(10) ORDER BY number) FROM placed x WHERE x.document_id = r.document_id AND x.number BETWEEN a AND b) AS text
        FROM r JOIN placed p ON p.document_id = r.document_id AND p.number = a JOIN placed q ON q.document_id = r.document_id AND q.number = b""",
)
def _(t):
    return citations.resolve_citations(_refs(t), _talks(t)).select("document_id", "merged_id", "char_start", F.col("char_end").cast("bigint").alias("char_end"), "text")


@query(
    "note_segments", "E4",
    f"""WITH {PLACED}, whole AS (SELECT document_id, string_agg(text, chr(10) ORDER BY number) AS note FROM turns GROUP BY document_id),
        m AS (SELECT document_id, start, start + length(text) AS stop FROM placed WHERE number % 2 = 0 AND length(text) > 0),
        g AS (SELECT document_id, lag(stop, 1, 0) OVER (PARTITION BY document_id ORDER BY start) AS start, start AS stop FROM m
              UNION ALL SELECT document_id, max(stop), any_value(length(note)) FROM m JOIN whole USING (document_id) GROUP BY document_id)
        SELECT document_id, start::BIGINT AS start, substr(note, start::INT + 1, (stop - start)::INT) AS text, highlight FROM (SELECT *, true AS highlight FROM m UNION ALL SELECT *, false FROM g) JOIN whole USING (document_id) WHERE start < stop""",
)
def _(t):
    talks = _talks(t)
    ranges = talks.select("document_id", F.inline("sentences")).where("number % 2 = 0").select("document_id", "start", "end").where("start < end")
    return spans.note_segments(talks, ranges).select("document_id", F.col("start").cast("bigint").alias("start"), "text", "highlight")


NOTE_OF = "SELECT CAST(o_custkey AS STRING) AS patient_id, concat('doc-', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '-note' ELSE '' END) AS document_id, o_orderkey AS note_pos, concat('key-', o_orderkey % 4) AS encounter_id FROM {orders}"
ENC_OF = "SELECT CAST(o_custkey AS STRING) AS patient_id, o_orderkey AS entry_pos, CASE o_orderkey % 5 WHEN 0 THEN concat('doc-', o_orderkey) ELSE concat('c-', o_orderkey % 100) END AS encounter FROM {orders} WHERE o_orderkey % 2 = 0"
ENC_MAP = f"""n AS ({NOTE_OF}), e AS ({ENC_OF}), f AS (SELECT n.*, (SELECT arg_min(encounter, entry_pos) FROM e WHERE e.patient_id = n.patient_id AND
      (contains(n.document_id, e.encounter) OR replace(replace(n.document_id, '-note', ''), '-summary', '') = e.encounter)) AS hit, (SELECT arg_min(encounter, entry_pos) FROM e WHERE e.patient_id = n.patient_id) AS first FROM n),
    m AS (SELECT patient_id, encounter_id, 'Encounter/' || coalesce(arg_max(hit, note_pos) FILTER (hit IS NOT NULL), min(first)) AS encounter_ref FROM f GROUP BY ALL)"""


@query("encounter_map", "C11", f"WITH {ENC_MAP} SELECT * FROM m WHERE encounter_ref IS NOT NULL")
def _(t):
    return citations.encounter_map(t.sql(NOTE_OF), t.sql(ENC_OF))


@query(
    "encounter_ref", "C12",
    f"""WITH {ENC_MAP}, r AS (SELECT CAST(o_custkey AS STRING) AS patient_id, o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN 'Encounter/x' WHEN 5 THEN NULL ELSE 'key-' || o_orderkey % 6 END AS k FROM {{orders}})
        SELECT o_orderkey, CASE WHEN k LIKE 'Encounter/%' THEN k ELSE encounter_ref END AS encounter_ref FROM r LEFT JOIN m ON m.patient_id = r.patient_id AND m.encounter_id = r.k""",
)
def _(t):
    k = F.col("o_orderkey") % 6
    rows = t.orders.select(
        F.col("o_custkey").cast("string").alias("patient_id"), "o_orderkey",
        F.when(k == 4, "Encounter/x").when(k != 5, F.concat(F.lit("key-"), k)).alias("encounter_key"),
    )
    return citations.with_encounter_ref(rows, citations.encounter_map(t.sql(NOTE_OF), t.sql(ENC_OF))).select("o_orderkey", "encounter_ref")


@query(
    "pending_requests", "C13 K2",
    """SELECT doc_id AS document_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {documents} s WHERE s.doc_id % 4 = 0 AND s.doc_id % 8 <> 0 AND s.text = d.text)""",
)
def _(t):
    requests = lanes.with_key(lanes.guardrail_requests(N.guardrail_check(_notes(t))), "m", "v1")
    stored = requests.where("document_id % 4 = 0").select("content_key", F.when(F.col("document_id") % 8 == 0, "{broken").otherwise('{"accept": true}').alias("response"))
    return lanes.pending_requests(requests, stored).select("document_id")


@query(
    "valid_groups", "B6 B11 K3",
    f"""WITH turns AS ({TURNS}), n AS (SELECT document_id, count(*) AS n FROM turns GROUP BY document_id)
        SELECT document_id, 'Condition' AS resource_type, '2' AS numbers FROM n WHERE n >= 2 UNION ALL SELECT document_id, 'Procedure', concat_ws(',', '1', CASE WHEN n >= 4 THEN '4' END) FROM n""",
)
def _(t):
    talks = _talks(t)
    answers = talks.select("document_id", F.lit('{"condition": [2, 77], "observation": [1], "procedure": [[1, 4, 99], [88]]}').alias("response"))
    routes, _ = lanes.apply_scan(talks, answers)
    return lanes.valid_groups(lanes.restrict_types(routes, ["Condition", "Procedure"]), talks).select(
        "document_id", "resource_type", F.array_join("numbers", ",").alias("numbers")
    )


@query(
    "parse_requests", "K4",
    f"""WITH turns AS ({TURNS}) SELECT document_id, 'Temporal context: none' || chr(10) || chr(10) || 'Snippet:' || chr(10) || string_agg('[' || number || '] ' || trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) ORDER BY number) AS user_text
        FROM turns WHERE number <= 2 GROUP BY document_id""",
)
def _(t):
    talks = _talks(t)
    answers = talks.select("document_id", F.lit('{"procedure": [[2, 1, 99]]}').alias("response"))
    routes, contexts = lanes.apply_scan(talks, answers)
    return lanes.parse_requests(lanes.valid_groups(routes, talks), contexts).select("document_id", "user_text")


ITEMS_SQL = f"SELECT *, CAST(substr(cand_id, 1, 1) AS INT) AS d FROM ({CANDIDATES})"


@query(
    "clamp_and_check_items", "B7 B9 B10",
    f"""SELECT cand_id, CASE WHEN sentence <= 5 THEN CAST(sentence AS STRING) ELSE '2,5' END AS sources,
        CASE WHEN resource_type = 'Procedure' AND note_date NOT LIKE '2001%' THEN NULL WHEN resource_type = 'Procedure' THEN performed END AS performed FROM ({CANDIDATES})
        WHERE resource_type IN ('Condition', 'Procedure')""",
)
def _(t):
    groups = F.when(F.get("item.source_sentences", F.lit(0)) <= 5, F.concat(F.col("item.source_sentences"), F.array(F.lit(7)))).otherwise(F.array(F.lit(5), F.lit(2)))
    parsed = candidate_items(t).where("resource_type IN ('Condition', 'Procedure', 'FamilyMemberHistory')").select(
        "cand_id", "resource_type", "item", groups.alias("numbers"), F.concat(F.lit("seen "), "note_date").alias("snippet"), "note_date"
    )
    return lanes.finish_items(parsed).select("cand_id", F.array_join("item.source_sentences", ",").alias("sources"), F.col("item.performed").alias("performed"))


@query(
    "date_rejects", "B9",
    f"SELECT cand_id AS document_id, 'Procedure.performed' AS field, performed AS value, 'year_not_in_snippet' AS reason FROM ({CANDIDATES}) WHERE resource_type = 'Procedure' AND note_date NOT LIKE '2001%'",
)
def _(t):
    parsed = candidate_items(t).where("resource_type = 'Procedure'").select(
        F.col("cand_id").alias("document_id"), "resource_type", "item", F.array(F.lit(1)).alias("numbers"), F.concat(F.lit("seen "), "note_date").alias("snippet"), "note_date"
    )
    return lanes.date_rejects(lanes.finish_items(parsed))


NUMBERED = f"num AS (SELECT *, row_number() OVER (PARTITION BY document_id, resource_type ORDER BY cand_pos)::INT AS number, count(*) OVER (PARTITION BY document_id, resource_type)::INT AS n FROM ({CANDIDATES}))"


@query(
    "apply_cleaner", "K5",
    f"""WITH {NUMBERED}, u AS (SELECT document_id, resource_type, string_agg(DISTINCT CAST(sentence AS STRING), ',' ORDER BY CAST(sentence AS STRING)) AS united FROM num WHERE number IN (1, 2) GROUP BY ALL)
        SELECT cand_id, CASE WHEN number = CASE WHEN n >= 2 THEN 2 ELSE 1 END THEN united ELSE CAST(sentence AS STRING) END AS sources FROM num JOIN u USING (document_id, resource_type)
        WHERE number <> 3 AND number <> CASE WHEN n >= 2 THEN 1 ELSE 0 END""",
)
def _(t):
    from pyspark.sql import Window

    per_note = Window.partitionBy("document_id", "resource_type")
    items = candidate_items(t).withColumn("number", F.row_number().over(per_note.orderBy("cand_pos"))).withColumn("n", F.count(F.lit(1)).over(per_note).cast("int"))
    answers = items.select("document_id", "resource_type").distinct().withColumn(
        "response", F.lit('{"discard": [2, 3, 99], "deduplicate": [{"group": [1, 2, 50], "keep": 2}, {"group": [77], "keep": 77}]}')
    )
    return lanes.apply_cleaner(items, answers).select("cand_id", F.array_join("item.source_sentences", ",").alias("sources"))


@query(
    "clean_requests", "K5",
    f"SELECT document_id, resource_type, count(*) AS n FROM ({CANDIDATES}) GROUP BY ALL HAVING count(*) > 1",
)
def _(t):
    requests = lanes.clean_requests(candidate_items(t))
    return requests.select("document_id", "resource_type", F.regexp_count("user_text", F.lit(r"(?m)^\[\d+\] ")).cast("bigint").alias("n"))


_GROUPED = "{KEYED}, {GROUPS}, {MARKED}, {SCOPED}, {IDS}".format(KEYED=merging.KEYED, GROUPS=merging.GROUPS, MARKED=merging.MARKED, SCOPED=merging.SCOPED, IDS=merging.IDS)


@query(
    "merge_requests", "K6",
    f"""WITH {_GROUPED}, names AS (SELECT i.patient_id, i.scope, i.group_id, k.resource_type, min(coalesce(CASE k.resource_type WHEN 'AllergyIntolerance' THEN k.substance
          WHEN 'FamilyMemberHistory' THEN k.relationship ELSE k.name END, '')) AS name, count(*) AS n FROM keyed k JOIN ids i USING (patient_id, merge_key) GROUP BY ALL),
        texts AS (SELECT patient_id, scope, string_agg('[' || group_id || '] ' || resource_type || ': "' || name || '" x' || n, chr(10) ORDER BY group_id, resource_type) AS user_text FROM names GROUP BY ALL)
        SELECT patient_id, scope, user_text, sha256(user_text || chr(0) || 'm' || chr(0) || 'v1') AS content_key FROM texts""",
)
def _(t):
    keyed = merge.with_merge_key(candidate_items(t))
    scoped = merge.adjudication_scopes(merge.mark_ambiguous(merge.merge_groups(keyed)))
    return lanes.with_key(lanes.merge_requests(merge.adjudication_ids(scoped), keyed), "m", "v1").select("patient_id", "scope", "content_key", "user_text")


@query(
    "reconcile_requests", "K8",
    f"""WITH {merging.EVIDENCE}, asked AS (SELECT *, row_number() OVER (PARTITION BY patient_id, resource_type ORDER BY cand_id) - 1 AS i,
          regexp_extract(verdict[2], ' ~ ''(.*)''$', 1) AS key FROM judged WHERE verdict[1] = 'AMBIGUOUS')
        SELECT patient_id, resource_type, string_agg('[' || i || '] Candidate: ' || coalesce(name, '') || chr(10) || '    Chart:     ' || verdict[3] || ' ' || key, chr(10) || chr(10) ORDER BY i) AS user_text
        FROM asked GROUP BY ALL""",
)
def _(t):
    return lanes.reconcile_requests(reconcile.match_candidates(candidate_items(t), chart_facts(t))).select("patient_id", "resource_type", "user_text")


@query(
    "validate_items", "B13",
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'unknown_field' WHEN 2 THEN 'missing_field' WHEN 3 THEN 'bad_value' WHEN 4 THEN 'bad_date' WHEN 5 THEN 'not_an_item' ELSE 'unknown_type' END AS problem FROM {orders}""",
)
def _(t):
    k = F.col("o_orderkey") % 7
    body = (
        F.when(k == 0, '{"source_sentences": [1], "name": "x", "value": "3", "category": "exam", "effective_date": "2020-01"}')
        .when(k == 1, '{"source_sentences": [1], "name": "x", "value": "3", "colour": "red"}')
        .when(k == 2, '{"source_sentences": [1], "name": "x"}')
        .when(k == 3, '{"source_sentences": [1], "name": "x", "value": "3", "certainty": "maybe"}')
        .when(k == 4, '{"source_sentences": [1], "name": "x", "value": "3", "effective_date": "last May"}')
        .when(k == 5, "not json")
        .otherwise('{"source_sentences": [1], "name": "x", "value": "3"}')
    )
    rows = t.orders.select("o_orderkey", F.when(k == 6, "Device").otherwise("Observation").alias("resource_type"), body.alias("json"))
    return lanes.validate_items(rows).select("o_orderkey", "problem")


__all__ = ["S", "T", "V"]
