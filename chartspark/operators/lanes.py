"""Model steps as tables: requests, stored responses, a pluggable batch scorer, and the apply side.

A request is ``content_key, lane, unit keys ..., system_text, user_text``.  Only requests
without a usable stored response reach the scorer; any model can stand behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark import schemas
from chartspark.functions import text as T

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def with_key(requests: DataFrame, model: str, prompt_version: str) -> DataFrame:
    return requests.withColumn("content_key", T.content_key(F.col("user_text"), F.lit(model), F.lit(prompt_version)))


def pending_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a stored response; a stored row that is not JSON counts as missing."""
    usable = responses.where(F.expr("try_parse_json(response) IS NOT NULL")).select("content_key").distinct()
    return requests.join(usable, "content_key", "left_anti")


def score(requests: DataFrame, scorer: Scorer, partitions: int | None = None) -> DataFrame:
    """Run a batch scorer over the distinct requests: ``content_key, response`` (JSON text).

    ``partitions`` bounds how many scorers run at once.
    """
    slim = requests.select("content_key", "lane", "system_text", "user_text").dropDuplicates(["content_key"])
    if partitions:
        slim = slim.repartition(partitions, "content_key")
    return slim.mapInPandas(scorer, "content_key string, response string")


# -- guardrail, scan, parse ----------------------------------------------------------------------


def guardrail_requests(notes: DataFrame, system_text: str = "") -> DataFrame:
    """One request per note the first check accepted."""
    return notes.where("reject_reason IS NULL").select(
        "document_id", F.lit("guardrail").alias("lane"), F.lit(system_text).alias("system_text"), F.col("text").alias("user_text")
    )


SCAN_RESPONSE = (
    "note_context struct<note_date:struct<value:string,source_sentences:array<int>>,"
    "admission_date:struct<value:string,source_sentences:array<int>>,discharge_date:struct<value:string,source_sentences:array<int>>>,"
    "condition array<int>, observation array<int>, allergy_intolerance array<int>, family_member_history array<int>,"
    "procedure array<array<int>>, medication_request array<array<int>>"
)
SINGLE = {
    "Condition": "condition",
    "Observation": "observation",
    "AllergyIntolerance": "allergy_intolerance",
    "FamilyMemberHistory": "family_member_history",
}
GROUPED = {"Procedure": "procedure", "MedicationRequest": "medication_request"}


def scan_requests(numbered: DataFrame, system_text: str = "") -> DataFrame:
    return numbered.select(
        "document_id", F.lit("scan").alias("lane"), F.lit(system_text).alias("system_text"), F.col("numbered_note").alias("user_text")
    )


def apply_scan(notes: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scan responses to ``routes`` (one row per sentence group) and ``contexts`` (checked dates)."""
    parsed = notes.join(responses.select("document_id", F.from_json("response", SCAN_RESPONSE).alias("scan")), "document_id")
    context = F.col("scan.note_context")
    raw = context["note_date"]["value"]
    kept = T.kept_date(raw, F.col("text"), raw)
    contexts = parsed.select(
        "document_id",
        kept.alias("note_date"),
        T.kept_date(context["admission_date"]["value"], F.col("text"), kept).alias("admission_date"),
        T.kept_date(context["discharge_date"]["value"], F.col("text"), kept).alias("discharge_date"),
    )

    def single(kind, field):
        return F.transform(F.col(f"scan.{field}"), lambda n: F.struct(F.lit(kind).alias("resource_type"), F.array(n).alias("numbers")))

    def grouped(kind, field):
        return F.transform(F.col(f"scan.{field}"), lambda g: F.struct(F.lit(kind).alias("resource_type"), g.alias("numbers")))

    empty = F.array().cast("array<struct<resource_type:string,numbers:array<int>>>")
    groups = F.flatten(
        F.array(
            *[F.coalesce(single(k, f), empty) for k, f in SINGLE.items()],
            *[F.coalesce(grouped(k, f), empty) for k, f in GROUPED.items()],
        )
    )
    routes = parsed.select("document_id", F.posexplode(groups).alias("group_pos", "g")).select("document_id", "group_pos", "g.*")
    return routes, contexts


def valid_groups(routes: DataFrame, notes: DataFrame) -> DataFrame:
    """Numbers the note does not have are dropped, then emptied groups. ``notes``: ``document_id, sentences``."""
    joined = routes.join(notes.select("document_id", "sentences"), "document_id")
    return joined.withColumn(
        "numbers", F.filter("numbers", lambda n: (n >= 1) & (n <= F.size("sentences")))
    ).where(F.size("numbers") > 0)


def restrict_types(rows: DataFrame, only: list[str] | None) -> DataFrame:
    return rows if only is None else rows.where(F.col("resource_type").isin(*only))


def parse_requests(groups: DataFrame, contexts: DataFrame, system_text: str = "") -> DataFrame:
    """One request per group: temporal context and the numbered snippet. ``groups`` as from ``valid_groups``."""
    snippet = T.numbered_lines(
        F.transform("numbers", lambda n: F.struct(n.alias("number"), F.get("sentences", n - 1)["text"].alias("text")))
    )
    context = T.temporal_context(F.col("note_date"), F.col("admission_date"), F.col("discharge_date"))
    return (
        groups.join(contexts, "document_id", "left")
        .withColumn("snippet", snippet)
        .select(
            "document_id", "resource_type", "group_pos", "numbers", "snippet", "note_date", F.lit("parse").alias("lane"),
            F.lit(system_text).alias("system_text"),
            F.concat(F.lit("Temporal context: "), context, F.lit("\n\nSnippet:\n"), F.col("snippet")).alias("user_text"),
        )
    )


def clamp_sources(cited, group):
    """Cited sentences inside the group; if none is left, the whole group in order."""
    inside = F.filter(F.coalesce(cited, F.array().cast("array<int>")), lambda n: F.array_contains(group, n))
    return F.when(F.size(inside) > 0, inside).otherwise(F.array_sort(F.array_distinct(group)))


def apply_parse(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Parsed items with clamped sources and checked dates; empty family histories are dropped.

    ``responses``: ``content_key, response``.  Adds ``date_field, date_value, date_reason``.
    """
    item_type = "struct<" + ",".join(f"{n}:{k}" for n, k in schemas.ALL_ITEM_FIELDS.items()) + ">"
    parsed = requests.join(
        responses.select("content_key", F.from_json("response", f"items array<{item_type}>").alias("r")), "content_key"
    ).select("document_id", "resource_type", "group_pos", "numbers", "snippet", "note_date", F.posexplode("r.items").alias("item_pos", "item"))
    return finish_items(parsed)


def finish_items(parsed: DataFrame) -> DataFrame:
    kind = F.col("resource_type")
    date = F.when(kind == "Observation", F.col("item.effective_date")).when(kind == "Procedure", F.col("item.performed"))
    args = (date, F.col("snippet"), F.col("note_date"))
    item = (
        F.col("item")
        .withField("source_sentences", clamp_sources(F.col("item.source_sentences"), F.col("numbers")))
        .withField("effective_date", F.when(kind == "Observation", T.kept_date(*args)))
        .withField("performed", F.when(kind == "Procedure", T.kept_date(*args)))
    )
    checked = parsed.withColumns(
        {
            "date_field": F.when(kind == "Observation", "Observation.effective_date").when(kind == "Procedure", "Procedure.performed"),
            "date_value": date,
            "date_reason": T.date_reject_reason(*args),
            "item": item,
        }
    )
    return drop_empty_family_history(checked)


def drop_empty_family_history(items: DataFrame) -> DataFrame:
    empty = (F.col("resource_type") == "FamilyMemberHistory") & (F.coalesce(F.size("item.conditions"), F.lit(0)) <= 0)
    return items.where(~empty)


def date_rejects(items: DataFrame) -> DataFrame:
    """Log rows of the dates that were not kept."""
    return items.where("date_reason IS NOT NULL").select(
        "document_id", F.col("date_field").alias("field"), F.col("date_value").alias("value"), F.col("date_reason").alias("reason")
    )


# -- clean -----------------------------------------------------------------------------------------


def clean_requests(items: DataFrame, system_text: str = "") -> DataFrame:
    """One request per (note, type) with more than one item; a note bounds the group."""
    numbered = F.transform(
        F.array_sort(F.collect_list(F.struct("cand_pos", "item"))),
        lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.to_json(s["item"])),
    )
    return (
        items.groupBy("document_id", "resource_type")
        .agg(numbered.alias("lines"))
        .where(F.size("lines") > 1)
        .select(
            "document_id", "resource_type", F.lit("clean").alias("lane"), F.lit(system_text).alias("system_text"),
            F.concat(F.lit("Resource type: "), "resource_type", F.lit("\n\n"), F.array_join("lines", "\n")).alias("user_text"),
        )
    )


CLEAN_RESPONSE = "discard array<int>, deduplicate array<struct<group:array<int>,keep:int>>"


def apply_cleaner(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Discard, then de-duplicate; numbers outside the list are ignored.

    ``items`` carry ``number`` (1-based in note and type) and ``n``; ``responses``:
    ``document_id, resource_type, response``.  A survivor takes the united sentences and is
    kept even if it was discarded; later groups overrule earlier ones.
    """
    keys = ["document_id", "resource_type"]
    decided = items.join(
        responses.select(*keys, F.from_json("response", CLEAN_RESPONSE).alias("c")), keys, "left"
    )
    groups = F.transform(
        F.filter(
            F.transform(
                F.coalesce("c.deduplicate", F.array().cast("array<struct<group:array<int>,keep:int>>")),
                lambda g: F.struct(F.filter(g["group"], lambda i: (i >= 1) & (i <= F.col("n"))).alias("group"), g["keep"].alias("keep")),
            ),
            lambda g: F.size(g["group"]) > 0,
        ),
        lambda g: F.struct(
            g["group"].alias("group"),
            F.when(F.array_contains(g["group"], g["keep"]), g["keep"]).otherwise(F.get(g["group"], F.lit(0))).alias("keep"),
        ),
    )
    decided = decided.withColumn("groups", groups)
    member = F.filter("groups", lambda g: F.array_contains(g["group"], F.col("number")))
    last = F.element_at(F.when(F.size(member) > 0, member), -1)
    discarded = F.coalesce(F.array_contains("c.discard", F.col("number")), F.lit(False))
    kept = F.when(last.isNotNull(), last["keep"] == F.col("number")).otherwise(~discarded)
    own_groups = F.filter("groups", lambda g: g["keep"] == F.col("number"))
    flagged = decided.withColumn("kept", kept).withColumn("own", F.element_at(F.when(F.size(own_groups) > 0, own_groups), -1))
    # Sentences of the members of the survivor's group.
    wanted = flagged.where("own IS NOT NULL AND kept").select(*keys, F.col("number").alias("survivor"), F.explode("own.group").alias("number"))
    united = (
        wanted.join(flagged.select(*keys, "number", F.col("item.source_sentences").alias("s")), [*keys, "number"])
        .groupBy(*keys, F.col("survivor").alias("number"))
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("united"))
    )
    return (
        flagged.where("kept")
        .join(united, [*keys, "number"], "left")
        .withColumn("item", F.when(F.col("united").isNotNull(), F.col("item").withField("source_sentences", F.col("united"))).otherwise(F.col("item")))
        .drop("c", "groups", "kept", "own", "united")
    )


# -- merge, reconcile ------------------------------------------------------------------------------


def merge_requests(ids: DataFrame, keyed: DataFrame, system_text: str = "") -> DataFrame:
    """Groups of a patient's scope as numbered lines of one request, so that any two of them can be merged."""
    names = keyed.join(ids.select("patient_id", "merge_key", "scope", "group_id"), ["patient_id", "merge_key"]).groupBy(
        "patient_id", "scope", "group_id", "resource_type"
    ).agg(F.min(T.item_name(F.col("resource_type"), F.col("item.name"), F.col("item.substance"), F.col("item.relationship"))).alias("name"), F.count(F.lit(1)).alias("n"))
    line = F.concat(
        F.lit("["), F.col("group_id").cast("string"), F.lit("] "), F.col("resource_type"), F.lit(': "'), F.coalesce("name", F.lit("")),
        F.lit('" x'), F.col("n").cast("string"),
    )
    return (
        names.groupBy("patient_id", "scope")
        .agg(F.array_sort(F.collect_list(F.struct("group_id", line.alias("line")))).alias("lines"))
        .select(
            "patient_id", "scope", F.lit("merge").alias("lane"), F.lit(system_text).alias("system_text"),
            F.array_join(F.transform("lines", lambda s: s["line"]), "\n").alias("user_text"),
        )
    )


def reconcile_requests(matched: DataFrame, system_text: str = "") -> DataFrame:
    """Ambiguous candidates as indexed pairs, one request per patient and type; only the residue is asked about."""
    asked = matched.where("classification = 'AMBIGUOUS'")
    line = F.concat(F.lit("Candidate: "), F.coalesce("item.name", F.lit("")), F.lit("\n    Chart:     "), "match_resource_id", F.lit(" "), "match_key")
    pairs = asked.groupBy("patient_id", "resource_type").agg(F.array_sort(F.collect_list(F.struct("cand_id", line.alias("line")))).alias("pairs"))
    text = F.transform("pairs", lambda p, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), p["line"]))
    return pairs.select(
        "patient_id", "resource_type", "pairs", F.array_join(text, "\n\n").alias("user_text"), F.lit("reconcile").alias("lane"), F.lit(system_text).alias("system_text")
    )


def reconcile_verdicts(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Index-addressed answers back to candidates; an index outside the request is ignored.

    ``responses``: ``patient_id, resource_type, response``.
    """
    answer = "decisions array<struct<index:int,classification:string,reasoning:string>>"
    decided = requests.join(
        responses.select("patient_id", "resource_type", F.from_json("response", answer).alias("a")), ["patient_id", "resource_type"]
    ).select("pairs", F.posexplode("a.decisions").alias("at", "d"))
    return (
        decided.where((F.col("d.index") >= 0) & (F.col("d.index") < F.size("pairs")))
        .select(F.get("pairs", F.col("d.index"))["cand_id"].alias("cand_id"), "at", "d")
        .groupBy("cand_id")
        .agg(F.max_by("d", "at").alias("d"))
        .select("cand_id", F.col("d.classification").alias("verdict_classification"), F.col("d.reasoning").alias("verdict_reasoning"))
    )


# -- validation of item JSON ---------------------------------------------------------------------


def validate_items(rows: DataFrame) -> DataFrame:
    """Strict check of item JSON: adds ``problem`` (null when fine) and the typed ``item``.

    ``rows``: ``resource_type, json``.
    """
    item_type = ", ".join(f"{n} {k}" for n, k in schemas.ITEM_FIELDS.items())
    typed = rows.withColumn("item", F.from_json("json", item_type + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    keys = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))
    problem = F.when(F.col("item._corrupt_record").isNotNull() | F.col("item").isNull(), "not_an_item").when(
        ~F.col("resource_type").isin(*schemas.ITEM_ALLOWED), "unknown_type"
    )
    for kind, allowed in schemas.ITEM_ALLOWED.items():
        mine = F.col("resource_type") == kind
        known = F.array(*[F.lit(k) for k in (*allowed, *schemas.ITEM_COMMON)])
        required = F.array(*[F.lit(k) for k in schemas.ITEM_REQUIRED[kind]])
        problem = problem.when(mine & (F.size(F.array_except(keys, known)) > 0), "unknown_field")
        problem = problem.when(mine & (F.size(F.array_except(required, keys)) > 0), "missing_field")
        for name in schemas.ITEM_REQUIRED[kind]:
            problem = problem.when(mine & F.col(f"item.{name}").isNull(), "missing_field")
        for name, values in schemas.ITEM_ENUMS[kind].items():
            problem = problem.when(mine & F.col(f"item.{name}").isNotNull() & ~F.col(f"item.{name}").isin(*values), "bad_value")
        for name in schemas.ITEM_DATES.get(kind, ()):
            problem = problem.when(mine & F.col(f"item.{name}").isNotNull() & ~T.is_valid_partial_date(F.col(f"item.{name}")), "bad_date")
    return typed.withColumn("problem", problem)
