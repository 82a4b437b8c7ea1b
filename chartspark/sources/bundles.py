"""FHIR bundles and bulk exports as resource rows: ``patient_id, entry_pos, full_url, resource_type, resource_id, resource``.

``resource`` is JSON text, so it can be shuffled, compared and read with any schema; typed
views are taken where they are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions import text as T
from chartspark.functions.clinical import clinical_status
from chartspark.functions.fhir import view


def parse_bundles(files: DataFrame) -> DataFrame:
    """``value`` (one whole bundle per row) to resource rows in entry order.

    ``file_key`` is the given key of the file, or else a hash of its text.  The patient is the last Patient entry of the same row.
    """
    entries = F.expr("try_variant_get(try_parse_json(value), '$.entry', 'array<variant>')")
    key = F.col("file_key") if "file_key" in files.columns else F.xxhash64("value")
    patients = F.expr(
        "filter(transform(entries, e -> CASE WHEN try_variant_get(e, '$.resource.resourceType', 'string') = 'Patient'"
        " THEN try_variant_get(e, '$.resource.id', 'string') END), p -> p IS NOT NULL)"
    )
    parsed = files.select(key.alias("file_key"), F.inline(F.array(F.struct(entries.alias("entries")))))
    owned = parsed.select("file_key", F.try_element_at(patients, F.lit(-1)).alias("patient_id"), F.posexplode("entries").alias("entry_pos", "entry"))
    return owned.select(
        "file_key", "entry_pos",
        F.expr("try_variant_get(entry, '$.fullUrl', 'string')").alias("full_url"),
        F.expr("try_variant_get(entry, '$.resource.resourceType', 'string')").alias("resource_type"),
        F.expr("try_variant_get(entry, '$.resource.id', 'string')").alias("resource_id"),
        F.expr("to_json(variant_get(entry, '$.resource'))").alias("resource"),
        "patient_id",
    ).where("resource_type IS NOT NULL")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    return parse_bundles(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file_key")))


def read_bulk_export(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON export, one resource per line; the patient is read from subject or patient."""
    return parse_bulk_lines(spark.read.text(path))


def parse_bulk_lines(lines: DataFrame) -> DataFrame:
    def at(p):
        return F.get_json_object("value", p)

    kind = at("$.resourceType")
    owner = F.coalesce(at("$.subject.reference"), at("$.patient.reference"))
    return lines.select(
        F.when(kind == "Patient", at("$.id")).otherwise(F.regexp_extract(owner, r"Patient/([^/]+)", 1)).alias("patient_id"),
        F.monotonically_increasing_id().alias("entry_pos"),  # lines in reading order
        F.lit(None).cast("string").alias("full_url"),
        kind.alias("resource_type"),
        at("$.id").alias("resource_id"),
        F.col("value").alias("resource"),
    ).where(kind.isNotNull())


def split_by_type(resources: DataFrame) -> dict[str, DataFrame]:
    return {kind: resources.where(F.col("resource_type") == kind) for kind in ("Patient", *V.PATIENT_LINKED_TYPES)}


def without_patient(resources: DataFrame, key: str = "file_key") -> DataFrame:
    """Bundles that have no Patient resource, as error rows."""
    return (
        resources.select(key).distinct()
        .join(resources.where("resource_type = 'Patient'").select(key), key, "left_anti")
        .withColumn("error", F.lit("No Patient resource in bundle"))
    )


_DOCUMENT = (
    "id string, date string, type struct<coding:array<struct<display:string>>,text:string>, author array<struct<display:string>>,"
    "content array<struct<attachment:struct<data:string,url:string>>>, context struct<encounter:array<struct<reference:string>>>"
)


def decode_documents(resources: DataFrame) -> DataFrame:
    """DocumentReference rows to notes; text that cannot be decoded is empty, bad bytes are replaced."""
    d = resources.where("resource_type = 'DocumentReference'").withColumn("d", F.from_json("resource", _DOCUMENT))
    data = F.get("d.content", F.lit(0))["attachment"]["data"]
    with_data = d.withColumn("_data", data)
    text = F.expr("make_valid_utf8(CAST(try_to_binary(_data, 'base64') AS STRING))")
    return with_data.select(
        "patient_id",
        F.coalesce("d.id", F.lit("")).alias("document_id"),
        F.coalesce(T.first_text(F.get("d.type.coding", F.lit(0))["display"], F.col("d.type.text")), F.lit("")).alias("type"),
        F.coalesce("d.date", F.lit("")).alias("date"),
        F.coalesce(F.get("d.author", F.lit(0))["display"], F.lit("")).alias("author"),
        F.coalesce(text, F.lit("")).alias("text"),
        T.blank_to_null(F.get("d.context.encounter", F.lit(0))["reference"]).alias("encounter_id"),
    )


def referenced_actors(resources: DataFrame) -> DataFrame:
    """Distinct practitioners and organizations a patient's resources refer to, at any depth."""
    refs = F.regexp_extract_all("resource", F.lit(r'"reference"\s*:\s*"((?:Practitioner|Organization)/[^"]+)"'), F.lit(1))
    return (
        resources.select("patient_id", F.explode(F.array_distinct(refs)).alias("ref"))
        .select("patient_id", F.substring_index("ref", "/", 1).alias("kind"), F.expr("substring(ref, instr(ref, '/') + 1)").alias("actor_id"))
        .distinct()
    )


def provenance_for(resources: DataFrame, provenances: DataFrame) -> DataFrame:
    """Provenance rows with a target among a patient's resources. ``provenances``: ``resource_id, resource``."""
    owned = resources.select(F.concat_ws("/", "resource_type", "resource_id").alias("target"), "patient_id").distinct()
    targets = provenances.select("resource_id", F.explode(F.from_json("resource", "target array<struct<reference:string>>")["target"]["reference"]).alias("target"))
    return targets.join(owned, "target").select("patient_id", "resource_id").distinct()


def chart_facts(resources: DataFrame) -> DataFrame:
    """Typed chart facts of resource rows, as the look-up tables want them."""
    r = resources.where(F.col("resource_type").isin(*V.RESOURCE_TYPES)).withColumn("r", view(F.col("resource")))
    concept = (
        F.when(F.col("resource_type") == "MedicationRequest", F.col("r.medicationCodeableConcept"))
        .when(F.col("resource_type") == "FamilyMemberHistory", F.col("r.relationship"))
        .otherwise(F.col("r.code"))
    )
    value = T.first_text(
        F.col("r.valueCodeableConcept.text"), F.get("r.valueCodeableConcept.coding", F.lit(0))["display"], F.col("r.valueString"), F.col("r.valueQuantity.value")
    )
    doses = F.transform(
        F.col("r.dosageInstruction"),
        lambda i: F.struct(
            F.coalesce(F.transform(i["doseAndRate"], lambda q: q["doseQuantity"]["value"]), F.array().cast("array<string>")).alias("quantities"),
            F.coalesce(i["text"], F.lit("")).alias("text"),
        ),
    )
    return r.select(
        "patient_id", F.col("entry_pos").cast("bigint").alias("entry_pos"), "resource_type", F.coalesce("resource_id", "full_url").alias("resource_id"),
        concept["coding"].alias("codings"), F.coalesce(concept["text"], F.lit("")).alias("text"), F.col("r.status").alias("status"),
        F.when(F.col("resource_type") == "Condition", clinical_status(F.col("r.clinicalStatus.coding"))).alias("clinical_status"),
        F.coalesce(value, F.lit("")).alias("value"), F.coalesce(T.chart_dose(doses), F.lit("")).alias("dose"),
        F.coalesce(T.first_text(F.col("r.performedDateTime"), F.col("r.performedPeriod.start")), F.lit("")).alias("performed"),
    )
