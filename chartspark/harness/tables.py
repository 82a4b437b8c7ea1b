"""The given tables seen as charts, notes and candidates.

Every adapter is one portable SQL text, so the Spark job and its SQL twin start from the
same rows: orders placed before 1999 are the chart of a customer, later ones the candidates;
a part is a concept, a line its mention, an order the note and the encounter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.functions.clinical import coding, no_codings
from chartspark.harness.registry import Tables
from chartspark.schemas import make_item

LINES = """
SELECT CAST(o.o_custkey AS STRING) AS patient_id,
       CAST(l.l_orderkey AS STRING) AS order_id,
       concat(l.l_orderkey, '-', l.l_linenumber, '-', l.l_partkey, '-', l.l_suppkey, '-',
              CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS line_id,
       ((l.l_orderkey * 10 + l.l_linenumber) * 1000000 + l.l_partkey) * 10000 + l.l_suppkey AS pos,
       l.l_partkey AS pk,
       l.l_partkey % 300 AS concept,
       l.l_partkey % 6 AS kind,
       p.p_name AS p_name, p.p_size AS p_size, lower(p.p_type) AS p_type,
       CAST(l.l_quantity AS INT) AS qty,
       l.l_returnflag AS flag, l.l_linestatus AS line_status,
       CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS day,
       o.o_orderdate < TIMESTAMP '1999-01-01 00:00:00' AS charted
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey
"""

_TYPE = """CASE kind WHEN 0 THEN 'Condition' WHEN 1 THEN 'Observation' WHEN 2 THEN 'MedicationRequest'
       WHEN 3 THEN 'Procedure' WHEN 4 THEN 'AllergyIntolerance' ELSE 'FamilyMemberHistory' END"""
_RELATION = """CASE pk % 30 WHEN 5 THEN 'father' WHEN 11 THEN 'mother' WHEN 17 THEN 'Brother ' WHEN 23 THEN 'sister'
       ELSE 'second cousin' END"""
_ROLE = """CASE pk % 30 WHEN 5 THEN 'FTH' WHEN 11 THEN 'MTH' WHEN 17 THEN 'BRO' WHEN 23 THEN 'SIS' ELSE 'COUSN' END"""
_SNOMED_CODE = "CASE WHEN concept = 4 THEN '409137002' ELSE CAST(1000000 + concept AS STRING) END"
_LOINC_CODE = "CASE WHEN concept % 60 = 1 THEN '72166-2' ELSE concat(concept, '-', concept % 10) END"
_OBS_VALUE = """CASE WHEN concept % 60 = 1 THEN
            CASE qty % 4 WHEN 0 THEN 'Current every day smoker' WHEN 1 THEN 'former smoker'
                 WHEN 2 THEN 'Never smoker' ELSE 'quit 5 years ago' END
       ELSE CAST(qty % 3 AS STRING) END"""
_PERFORMED = "concat('2001-0', 1 + qty % 3)"

CHART = f"""
SELECT patient_id, pos AS entry_pos, {_TYPE} AS resource_type, concat('r', line_id) AS resource_id,
       CASE kind WHEN 0 THEN CASE WHEN pk % 12 = 0 THEN 'http://snomed.info/sct' ELSE 'http://hl7.org/fhir/sid/icd-10-cm' END
            WHEN 1 THEN 'http://loinc.org' WHEN 2 THEN 'http://www.nlm.nih.gov/research/umls/rxnorm'
            WHEN 5 THEN 'http://terminology.hl7.org/CodeSystem/v3-RoleCode' ELSE 'http://snomed.info/sct' END AS system,
       CASE kind WHEN 0 THEN CASE WHEN pk % 12 = 0 THEN CAST(1000000 + concept AS STRING)
                                  ELSE concat('M', lpad(CAST(concept % 100 AS STRING), 2, '0'), '.', concept) END
            WHEN 1 THEN {_LOINC_CODE} WHEN 2 THEN CAST(5000 + concept AS STRING)
            WHEN 5 THEN {_ROLE} ELSE {_SNOMED_CODE} END AS code,
       CASE kind WHEN 2 THEN CASE WHEN pk % 5 = 0 THEN concat(p_name, ' and extract 10 MG')
                                  ELSE concat(p_name, ' ', p_size, ' MG Oral Tablet') END
            WHEN 5 THEN {_RELATION} ELSE p_name END AS display,
       CASE kind WHEN 0 THEN CASE WHEN pk % 4 = 0 THEN concat('Chronic ', p_name) ELSE concat(p_name, ' of ', p_type, ' type') END
            WHEN 3 THEN '' ELSE p_name END AS text,
       CASE WHEN kind = 2 THEN CASE WHEN line_status = 'O' THEN 'active' ELSE 'stopped' END END AS status,
       CASE WHEN kind = 0 THEN CASE WHEN line_status = 'O' THEN 'active' WHEN flag = 'A' THEN NULL ELSE 'resolved' END END
            AS clinical_status,
       CASE WHEN kind = 1 THEN {_OBS_VALUE} ELSE '' END AS value,
       CASE WHEN kind = 2 AND flag <> 'N' THEN CAST(qty % 4 AS STRING) ELSE '' END AS dose,
       CASE WHEN kind = 3 THEN {_PERFORMED} ELSE '' END AS performed
FROM ({LINES}) lines WHERE charted
"""

CANDIDATES = f"""
SELECT patient_id, line_id AS cand_id, pos AS cand_pos, concat('doc-', order_id) AS document_id,
       CASE WHEN pk % 7 = 0 THEN NULL ELSE concat('Encounter/', order_id) END AS encounter_id, day AS note_date,
       {_TYPE} AS resource_type,
       CASE kind WHEN 0 THEN CASE WHEN qty % 2 = 0 THEN concat('Acute  ', p_name) ELSE p_name END
            WHEN 2 THEN concat(p_name, ' ', 'Hydrochloride')
            WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE p_name END AS name,
       CASE WHEN kind = 4 THEN p_name END AS substance,
       CASE WHEN kind = 5 THEN {_RELATION} END AS relationship,
       CASE kind WHEN 1 THEN 'http://loinc.org' WHEN 2 THEN 'http://www.nlm.nih.gov/research/umls/rxnorm'
            WHEN 5 THEN 'http://terminology.hl7.org/CodeSystem/v3-RoleCode' ELSE 'http://snomed.info/sct' END AS system0,
       CASE kind WHEN 0 THEN CAST(1000000 + concept AS STRING) WHEN 1 THEN {_LOINC_CODE}
            WHEN 2 THEN CAST(5000 + concept AS STRING) WHEN 5 THEN {_ROLE} ELSE {_SNOMED_CODE} END AS code0,
       CASE WHEN kind = 2 THEN CASE WHEN qty % 4 = 0 THEN ''
                 ELSE concat('Product containing precisely ', p_name, ' (as ', p_type, ') ', p_size, ' milligram/1 each oral tablet') END
            ELSE p_name END AS display0,
       CASE WHEN kind = 0 THEN 'http://hl7.org/fhir/sid/icd-10-cm' END AS system1,
       CASE WHEN kind = 0 THEN concat('M', lpad(CAST(concept % 100 AS STRING), 2, '0'), concept) END AS code1,
       qty % 10 = 0 AS uncoded,
       CASE qty % 3 WHEN 0 THEN 'definite' WHEN 1 THEN 'probable' ELSE 'uncertain' END AS certainty,
       CASE WHEN kind = 0 THEN flag = 'R' AND line_status = 'F' END AS negated,
       CASE kind WHEN 2 THEN CASE WHEN flag = 'R' AND line_status = 'F' THEN 'stopped' ELSE 'active' END
            WHEN 3 THEN 'completed' END AS status,
       CASE WHEN kind = 2 THEN 'order' END AS intent,
       CASE WHEN kind = 1 THEN {_OBS_VALUE} END AS value,
       CASE WHEN kind = 2 AND qty % 5 <> 0 THEN concat(qty % 4, CASE WHEN qty % 2 = 0 THEN ' mg' ELSE '' END) END AS dose_value,
       CASE WHEN kind = 3 THEN {_PERFORMED} END AS performed,
       CASE WHEN kind = 1 AND flag = 'N' THEN substr(day, 1, 7) END AS effective_date,
       CASE kind WHEN 0 THEN CASE WHEN line_status = 'F' THEN 'diagnosis' ELSE 'problem' END
            WHEN 1 THEN CASE pk % 5 WHEN 0 THEN 'vital-signs' WHEN 1 THEN 'laboratory' WHEN 2 THEN 'exam'
                             WHEN 3 THEN 'social-history' ELSE 'survey' END
            WHEN 3 THEN CASE pk % 2 WHEN 0 THEN 'diagnostic' ELSE 'surgical' END END AS category,
       CASE WHEN kind IN (0, 4) AND flag = 'A' THEN 'moderate' END AS severity,
       CASE WHEN kind = 0 THEN CASE qty % 5 WHEN 0 THEN 'Left arm' WHEN 1 THEN 'right leg' WHEN 2 THEN 'left and right knee'
                                    WHEN 3 THEN 'spine' END END AS body_site,
       1 + (pk + qty) % 9 AS sentence
FROM ({LINES}) lines WHERE NOT charted
"""


def lines(t: Tables) -> DataFrame:
    return t.sql(LINES)


def chart_facts(t: Tables) -> DataFrame:
    return t.stored("chart_facts", lambda: _chart_facts(t))


def candidate_items(t: Tables) -> DataFrame:
    """Candidate items with the wide record, coded as the chart is.

    What is stored is narrow: the fields that candidates have.  The record is put together on reading, so a reader pays for the
    fields it names, not for the forty of a record that are mostly empty.
    """
    return _items(t.stored("candidate_items", lambda: _candidates(t)))


def candidate_items_once(t: Tables) -> DataFrame:
    """The same rows for a query that passes over them once: nothing is stored, and columns it does not name are not worked out."""
    return _items(_candidates(t))


def _chart_facts(t: Tables) -> DataFrame:
    flat = t.sql(CHART)
    return flat.select(
        "patient_id", "entry_pos", "resource_type", "resource_id",
        F.array(coding(F.col("system"), F.col("code"), F.col("display"))).alias("codings"),
        "text", "status", "clinical_status", "value", "dose", "performed",
    )


#: Fields of the record that candidates have as they are.
_PLAIN = (
    "certainty", "category", "name", "severity", "negated", "value", "effective_date", "status", "intent", "performed", "substance", "relationship",
)


def _candidates(t: Tables) -> DataFrame:
    flat = t.sql(CANDIDATES)
    first = coding(F.col("system0"), F.col("code0"), F.col("display0"))
    second = coding(F.col("system1"), F.col("code1"))
    codings = (
        F.when(F.col("uncoded"), F.array(coding(None, None, None, F.coalesce("name", "substance", "relationship"))))
        .when(F.col("system1").isNotNull(), F.array(first, second))
        .otherwise(F.array(first))
    )
    return flat.select(
        "patient_id", "cand_id", "cand_pos", "document_id", "encounter_id", "note_date",
        F.coalesce("encounter_id", F.substring("note_date", 1, 10), "document_id").alias("encounter"),
        "resource_type", *_PLAIN,
        F.array("sentence").alias("source_sentences"),
        F.when(F.col("body_site").isNotNull(), F.array("body_site")).alias("body_site"),
        F.when(F.col("dose_value").isNotNull(), F.struct(F.col("dose_value").alias("value"), F.lit("mg").alias("unit"))).alias("dose"),
        codings.alias("coding"),
    )


def _items(candidates: DataFrame) -> DataFrame:
    fields = {name: F.col(name) for name in (*_PLAIN, "source_sentences", "body_site", "dose", "coding")}
    return candidates.select(
        "patient_id", "cand_id", "cand_pos", "document_id", "encounter_id", "note_date", "encounter", "resource_type",
        make_item(reasoning=F.lit(""), **fields).alias("item"),
    )


def with_n_docs(candidates: DataFrame) -> DataFrame:
    """Candidates taken one by one: each rests on one note."""
    return candidates.withColumn("n_docs", F.lit(1).cast("bigint"))


__all__ = ["CANDIDATES", "CHART", "LINES", "candidate_items", "chart_facts", "lines", "no_codings", "with_n_docs"]
