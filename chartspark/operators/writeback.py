"""Accepted proposals to FHIR transaction bundles with provenance.

Ids are derived from content, so a job that runs twice writes the same bundles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions import text as T
from chartspark.operators.builders import obj, optional

SPAN_EXTENSION = "http://chartspark.example.org/StructureDefinition/source-text-span"
AUTHOR = "Chartspark"
_AGENT = "http://terminology.hl7.org/CodeSystem/provenance-participant-type"
_ACTIVITY = "http://terminology.hl7.org/CodeSystem/v3-DataOperation"


def urn(*keys: Column) -> Column:
    """A UUID-shaped urn derived from the keys."""
    h = F.sha2(F.encode(F.concat_ws("\x1f", *keys), "UTF-8"), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def superseded(proposals: DataFrame, chart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updating proposals with the id and version of the row they replace, error rows).

    ``chart``: ``patient_id, resource_id, version_id``.
    """
    updating = proposals.where("classification = 'UPDATING'").withColumn("resource_id", F.get("supersedes", F.lit(0)))
    found = updating.join(chart, ["patient_id", "resource_id"])
    lost = updating.where("resource_id IS NOT NULL").join(chart, ["patient_id", "resource_id"], "left_anti").select(
        "id", F.lit("superseded resource not found").alias("error")
    )
    empty = updating.where("resource_id IS NULL").select("id", F.lit("updating proposal without target").alias("error"))
    return found, lost.unionByName(empty)


def inline_document(text: Column, note_type: Column, date: Column, attester: Column) -> Column:
    """DocumentReference struct of a note that exists only as text."""
    return obj(
        resourceType=F.lit("DocumentReference"),
        meta=obj(profile=F.array(F.lit(V.RESOURCE_PROFILES["DocumentReference"]))),
        status=F.lit("current"),
        type=obj(
            coding=F.array(obj(system=F.lit(V.LOINC), code=F.lit("34109-9"), display=F.lit("Note"))),
            text=F.coalesce(T.blank_to_null(note_type), F.lit("Note")),
        ),
        category=F.array(
            obj(coding=F.array(obj(system=F.lit("http://hl7.org/fhir/us/core/CodeSystem/us-core-documentreference-category"), code=F.lit("clinical-note"))))
        ),
        subject=obj(reference=F.concat(F.lit("Patient/"), F.col("patient_id"))),
        date=T.blank_to_null(date),
        author=optional(attester.isNotNull(), F.array(obj(display=attester))),
        content=F.array(
            obj(attachment=obj(contentType=F.lit("text/plain; charset=UTF-8"), data=F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("\r\n"), F.lit(""))))
        ),
    )


def resolve_inline_citations(citations: DataFrame) -> DataFrame:
    """Adds ``document_ref``: notes that are only text get one derived urn per transaction and note."""
    inline = F.col("document_id").startswith("inline_")
    return citations.withColumn(
        "document_ref",
        F.when(inline, urn(F.col("id"), F.col("document_id"))).otherwise(F.concat(F.lit("DocumentReference/"), "document_id")),
    )


def provenance(target: Column, updating: Column, citations: Column, recorded: Column, attester: Column) -> Column:
    """Provenance struct; ``citations``: array of ``(document_ref, char_start, char_end, text)``."""
    documents = F.array_distinct(F.transform(citations, lambda c: c["document_ref"]))
    value = "struct<url:string,valueString:string,valueInteger:int>"

    def part(url, text=None, number=None):
        return F.struct(
            F.lit(url).alias("url"), (F.lit(None) if text is None else text).cast("string").alias("valueString"),
            (F.lit(None) if number is None else number).cast("int").alias("valueInteger"),
        ).cast(value)

    def agent(code, display):
        return obj(type=obj(coding=F.array(obj(system=F.lit(_AGENT), code=F.lit(code)))), who=obj(display=display))

    return obj(
        resourceType=F.lit("Provenance"),
        meta=obj(profile=F.array(F.lit(V.RESOURCE_PROFILES["Provenance"]))),
        target=F.array(obj(reference=target)),
        recorded=recorded,
        activity=obj(coding=F.array(obj(system=F.lit(_ACTIVITY), code=F.when(updating, "UPDATE").otherwise("CREATE")))),
        agent=F.array_compact(F.array(agent("author", F.lit(AUTHOR)), optional(attester.isNotNull(), agent("attester", attester)))),
        entity=F.transform(documents, lambda d: obj(role=F.lit("source"), what=obj(reference=d))),
        extension=F.transform(
            citations,
            lambda c: obj(
                url=F.lit(SPAN_EXTENSION),
                extension=F.array(
                    part("documentRef", c["document_ref"]), part("start", number=c["char_start"]), part("end", number=c["char_end"]), part("text", c["text"]),
                ),
            ),
        ),
    )


def transaction_bundles(accepted: DataFrame, citations: DataFrame, notes: DataFrame, recorded: str) -> DataFrame:
    """``id, patient_id, bundle`` (JSON text), one transaction per accepted proposal.

    ``accepted``: ``id, patient_id, resource_type, resource, classification, target_id, version_id,
    attester``; ``citations``: ``id, document_id, char_start, char_end, text``; ``notes``:
    ``document_id, type, date, text`` of the notes that exist only as text.  New and conflicting
    facts are posted and never retire a chart row; updates are put in place of theirs.
    """
    placed = resolve_inline_citations(citations)
    # A transaction is one document, so its citations belong to one row; they are folded by place first.
    spans = (
        placed.select("id", "document_ref", "char_start", "char_end", "text").distinct()
        .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("document_ref", "char_start", "char_end", "text"))).alias("spans"))
    )
    inline = (
        placed.where(F.col("document_id").startswith("inline_")).select("id", "document_id", "document_ref").distinct()
        .join(notes.select("document_id", F.col("type").alias("note_type"), F.col("date").alias("note_date"), F.col("text").alias("note")), "document_id")
        .join(accepted.select("id", "patient_id", "attester"), "id")
        .withColumn("entry", F.concat(
            F.lit('{"fullUrl":"'), "document_ref", F.lit('","resource":'),
            F.to_json(inline_document(F.col("note"), F.col("note_type"), F.col("note_date"), F.col("attester"))),
            F.lit(',"request":{"method":"POST","url":"DocumentReference"}}')))
        .groupBy("id").agg(F.array_sort(F.collect_list("entry")).alias("inline_entries"))
    )
    updating = F.col("classification") == "UPDATING"
    kind = F.col("resource_type")
    target_ref = F.concat(kind, F.lit("/"), F.col("target_id"))
    own_urn, provenance_urn = urn(F.col("id"), F.lit("resource")), urn(F.col("id"), F.lit("provenance"))
    versioned = F.regexp_replace("resource", r'"meta":\{', F.concat(F.lit('"meta":{"versionId":"'), F.coalesce("version_id", F.lit("")), F.lit('",')))
    body = F.when(
        updating,
        F.concat(F.lit('{"id":"'), "target_id", F.lit('",'), F.substr(F.when(F.col("version_id").isNotNull(), versioned).otherwise(F.col("resource")), F.lit(2))),
    ).otherwise(F.col("resource"))
    request = F.when(updating, F.concat(F.lit('{"method":"PUT","url":"'), target_ref, F.lit('"}'))).otherwise(
        F.concat(F.lit('{"method":"POST","url":"'), kind, F.lit('"}'))
    )
    rows = accepted.join(spans, "id", "left").join(inline, "id", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<document_ref:string,char_start:int,char_end:int,text:string>>"))
    )
    prov = F.to_json(provenance(F.when(updating, target_ref).otherwise(own_urn), updating, F.col("spans"), F.lit(recorded), F.col("attester")))
    entries = F.concat(
        F.coalesce("inline_entries", F.array().cast("array<string>")),
        F.array(
            F.concat(F.lit('{"fullUrl":"'), own_urn, F.lit('","resource":'), body, F.lit(',"request":'), request, F.lit("}")),
            F.concat(F.lit('{"fullUrl":"'), provenance_urn, F.lit('","resource":'), prov, F.lit(',"request":{"method":"POST","url":"Provenance"}}')),
        ),
    )
    return rows.select(
        "id", "patient_id",
        F.concat(F.lit('{"resourceType":"Bundle","type":"transaction","entry":['), F.array_join(entries, ","), F.lit("]}")).alias("bundle"),
        F.size(F.coalesce("inline_entries", F.array().cast("array<string>"))).alias("n_inline"),
    )


_RESPONSE = "entry array<struct<response:struct<location:string>,resource:struct<resourceType:string,id:string>>>"


def transaction_refs(responses: DataFrame) -> DataFrame:
    """``id, resource_ref, provenance_ref, error`` from server answers (``id, resource_type, n_inline, response``)."""
    entries = F.coalesce(F.from_json("response", _RESPONSE)["entry"], F.array().cast("array<struct<response:struct<location:string>,resource:struct<resourceType:string,id:string>>>"))

    def found(kind, skip):
        refs = F.transform(
            F.slice(entries, skip + 1, F.greatest(F.size(entries), F.lit(1))),
            lambda e: F.coalesce(
                T.reference_from_location(e["response"]["location"]), F.concat(e["resource"]["resourceType"], F.lit("/"), e["resource"]["id"])
            ),
        )
        return F.get(F.filter(refs, lambda r: r.startswith(F.concat(kind, F.lit("/")))), F.lit(0))

    read = responses.select(
        "id", found(F.col("resource_type"), F.col("n_inline")).alias("resource_ref"), found(F.lit("Provenance"), F.col("n_inline") + 1).alias("provenance_ref")
    )
    return read.withColumn(
        "error",
        F.when(F.col("resource_ref").isNull(), "transaction response had no resource entry").when(
            F.col("provenance_ref").isNull(), "transaction response had no Provenance entry"
        ),
    )


def decision_log(decisions: DataFrame) -> DataFrame:
    """Decisions for the log; the reviewer's free text is left out on purpose."""
    return decisions.select("action", "run_id", "resource_type", "reviewer", "resource_ref")
