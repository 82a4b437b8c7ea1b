"""Corpus and bundle checks: every check returns issue rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions.text import placed_matches
from chartspark.operators.json_tree import kind_of, opened, walked

# Fixed values of the corpus rules.
LENGTH_BUDGETS = {"clean": (3000, 7000), "messy": (1000, 4000), "trap": (3000, 7000)}
FACT_CATEGORIES = (
    "condition", "medication_request", "observation", "procedure", "allergy_intolerance", "family_member_history",
)
TRAP_TYPES = (
    "negation", "family_attributed", "ruled_out", "hypothetical", "historical_resolved", "wrong_subject",
    "multi_section_consolidation", "severity_inference",
)
MATCH_BASES = (
    "exact_code", "ingredient_match", "ingredient_dose_diff", "loinc_value_match", "loinc_value_diff",
    "procedure_code_date", "family_relationship_code", "specific_vs_nkda", "display_overlap_llm", "no_match",
)
SPECIALTY_PREFIXES = {"C": "cardiology", "E": "emergency_department", "N": "neurology"}


def issue(rule: str, detail: Column, severity: str = "error") -> list[Column]:
    return [F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.alias("detail")]


# -- corpus ------------------------------------------------------------------------------------


def missing_spans(labels: DataFrame, notes: DataFrame) -> DataFrame:
    """Labelled spans that do not occur in their note. ``labels``: ``document_id, label_id, span``."""
    return (
        labels.join(notes.select("document_id", "text"), "document_id")
        .where(~F.col("text").contains(F.col("span")))
        .select("document_id", *issue("verbatim_span", F.col("label_id").cast("string")))
    )


def regex_hits(text: Column, pattern: str) -> Column:
    """``array<struct(start, text)>`` of every match."""
    return F.transform(placed_matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["text"].alias("text")))


def banned_tokens(notes: DataFrame, pattern: str) -> DataFrame:
    """One row per hit of a forbidden pattern, with its offset."""
    return notes.select("document_id", F.explode(regex_hits(F.col("text"), pattern)).alias("hit")).select(
        "document_id", "hit.start", F.col("hit.text").alias("token")
    )


def length_issues(notes: DataFrame, budgets: dict | None = None) -> DataFrame:
    """Notes whose length is outside the budget of their tier, and unknown tiers."""
    budgets = budgets or LENGTH_BUDGETS
    low = F.create_map(*[F.lit(x) for tier, (a, _) in budgets.items() for x in (tier, a)])[F.col("tier")]
    high = F.create_map(*[F.lit(x) for tier, (_, b) in budgets.items() for x in (tier, b)])[F.col("tier")]
    size = F.length("text")
    checked = notes.select("document_id", "tier", size.alias("size"), low.alias("low"), high.alias("high"))
    return checked.where(F.col("low").isNull() | (F.col("size") < F.col("low")) | (F.col("size") > F.col("high"))).select(
        "document_id",
        F.when(F.col("low").isNull(), "unknown_tier").otherwise("length_budget").alias("rule"),
        F.lit("error").alias("severity"),
        F.col("size").cast("string").alias("detail"),
    )


def enum_issues(rows: DataFrame, key: str, column: str, allowed) -> DataFrame:
    return rows.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(key, *issue(column, F.col(column)))


def missing_traps(labels: DataFrame, traps: DataFrame, required: DataFrame) -> DataFrame:
    """Trap notes without their required trap type. ``required``: ``note_id, trap_type``."""
    wanted = labels.where(F.col("tier") == "trap").select("note_id").join(required, "note_id")
    return wanted.join(traps, ["note_id", "trap_type"], "left_anti").select("note_id", *issue("missing_trap", F.col("trap_type")))


def specialty_issues(labels: DataFrame) -> DataFrame:
    expected = F.create_map(*[F.lit(x) for pair in SPECIALTY_PREFIXES.items() for x in pair])[F.substring("note_id", 1, 1)]
    return labels.where(expected.isNotNull() & ~F.coalesce(F.col("specialty") == expected, F.lit(False))).select(
        "note_id", *issue("specialty_prefix", F.col("specialty"))
    )


def char_count_issues(notes: DataFrame) -> DataFrame:
    return notes.where((F.col("char_count") > 0) & (F.col("char_count") != F.length("text"))).select(
        "document_id", *issue("char_count", F.col("char_count").cast("string"), "warning")
    )


def unregistered_codes(used: DataFrame, registry: DataFrame) -> DataFrame:
    """Used (system, code) pairs the registry does not have."""
    return used.select("system", "code").distinct().join(registry, ["system", "code"], "left_anti")


def registry_health(registry: DataFrame, used: DataFrame) -> DataFrame:
    """Unused codes, duplicate codes, and entries without a source."""
    per_code = registry.groupBy("system", "code").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("source_url", F.lit("")) == "").alias("no_source")
    )
    unused = per_code.join(used.select("system", "code").distinct(), ["system", "code"], "left_anti")
    return (
        unused.select("system", "code", *issue("unused_code", F.lit("")))
        .unionByName(per_code.where("n > 1").select("system", "code", *issue("duplicate_code", F.col("n").cast("string"))))
        .unionByName(per_code.where("no_source > 0").select("system", "code", *issue("empty_source", F.lit(""))))
    )


def remap_codes(codings: DataFrame, swaps: DataFrame) -> DataFrame:
    """Replace (system, code) by its new code and display. ``swaps``: ``system, code, new_code, new_display``."""
    return (
        codings.join(swaps, ["system", "code"], "left")
        .withColumn("swapped", F.col("new_code").isNotNull())
        .withColumn("code", F.coalesce("new_code", "code"))
        .withColumn("display", F.coalesce("new_display", "display"))
        .drop("new_code", "new_display")
    )


def swap_report(codings: DataFrame, swaps: DataFrame) -> DataFrame:
    """Uses of each swap; 0 means a key that occurs nowhere."""
    uses = codings.groupBy("system", "code").agg(F.count(F.lit(1)).alias("n"))
    return swaps.select("system", "code").join(uses, ["system", "code"], "left").fillna(0, ["n"])


def label_issues(actions: DataFrame, facts: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Rules of the expected-action labels.

    ``actions``: ``note, fact_id, action, accepted_actions, target_resource_id, match_basis,
    n_changes, expected_provenance, fixture``; ``facts``: ``note, fact_id``;
    ``fixtures``: ``fixture, resource_id``.
    """
    new = F.col("action") == "NEW"
    rules = {
        "one_action": F.col("action").isNotNull() == F.col("accepted_actions").isNotNull(),
        "action_enum": F.col("action").isNotNull() & ~F.col("action").isin(*V.CLASSIFICATIONS),
        "match_basis": ~F.coalesce(F.col("match_basis").isin(*MATCH_BASES), F.lit(False)),
        "new_has_target": new & F.col("target_resource_id").isNotNull(),
        "target_missing": F.col("action").isNotNull() & ~new & F.col("target_resource_id").isNull(),
        "updating_without_changes": (F.col("action") == "UPDATING") & (F.coalesce("n_changes", F.lit(0)) == 0),
        "provenance_not_boolean": F.col("expected_provenance").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    own = actions.select("note", "fact_id", F.explode(broken).alias("rule"))
    unknown = actions.join(facts, ["note", "fact_id"], "left_anti").select("note", "fact_id", F.lit("unknown_fact").alias("rule"))
    no_action = facts.join(actions, ["note", "fact_id"], "left_anti").select("note", "fact_id", F.lit("fact_without_action").alias("rule"))
    targets = actions.where("target_resource_id IS NOT NULL").withColumnRenamed("target_resource_id", "resource_id")
    no_target = targets.join(fixtures, ["fixture", "resource_id"], "left_anti").select(
        "note", "fact_id", F.lit("target_not_in_fixture").alias("rule")
    )
    return own.unionByName(unknown).unionByName(no_action).unionByName(no_target)


def dangling_codes(registry: DataFrame, used: DataFrame, fixtures: DataFrame) -> DataFrame:
    """registry − used − fixtures, and fixtures − used, tagged."""
    keys = ["system", "code"]
    unused = registry.select(*keys).distinct().join(used, keys, "left_anti").join(fixtures, keys, "left_anti")
    only_charted = fixtures.select(*keys).distinct().join(used, keys, "left_anti")
    return unused.withColumn("kind", F.lit("registry_only")).unionByName(only_charted.withColumn("kind", F.lit("fixture_only")))


def corpus_manifest(facts: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts by each dimension in one pass: long rows (dimension, value, n)."""
    sets = [[d] for d in dimensions] + [[]]
    grouped = facts.groupingSets(sets, *dimensions).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    n = len(dimensions)
    names = F.lit("total")
    values = F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        mask = (1 << n) - 1 - (1 << (n - 1 - i))
        names = F.when(F.col("gid") == mask, d).otherwise(names)
        values = F.when(F.col("gid") == mask, F.col(d).cast("string")).otherwise(values)
    return grouped.select(names.alias("dimension"), values.alias("value"), "n")


def corpus_diversity(people: DataFrame) -> DataFrame:
    """Rule rows over the corpus: ``rule, value, need, ok``.

    ``people``: ``note, patient_name, provider, organization, sex, age, race``.
    """
    measured = people.agg(
        F.count_distinct("provider").alias("providers"),
        F.count_distinct("organization").alias("organizations"),
        F.count_distinct("sex").alias("sexes"),
        (F.max("age") - F.min("age")).alias("age_range"),
        F.count_distinct(F.when(F.col("race") != "", F.col("race"))).alias("races"),
        (F.count("patient_name") - F.count_distinct("patient_name")).alias("repeated_names"),
    )
    needs = {"providers": 12, "organizations": 3, "sexes": 2, "age_range": 40, "races": 4}
    rules = [
        F.struct(F.lit(r).alias("rule"), F.col(r).cast("bigint").alias("value"), F.lit(n).cast("bigint").alias("need"), (F.col(r) >= n).alias("ok"))
        for r, n in needs.items()
    ] + [
        F.struct(
            F.lit("repeated_names").alias("rule"), F.col("repeated_names").cast("bigint").alias("value"),
            F.lit(0).cast("bigint").alias("need"), (F.col("repeated_names") == 0).alias("ok"),
        )
    ]
    return measured.select(F.explode(F.array(*rules)).alias("r")).select("r.*")


def fixture_summary(facts: DataFrame) -> DataFrame:
    """One row per chart resource: its codes and whether it is active."""
    from chartspark.operators.chart import is_active

    return facts.select(
        "patient_id", "resource_id", "resource_type",
        F.array_join(F.array_sort(F.transform("codings", lambda c: F.concat_ws("|", c["system"], c["code"]))), ",").alias("codes"),
        is_active().alias("active"),
    )


# -- bundles ---------------------------------------------------------------------------------------


def bundle_structure(entries: DataFrame) -> DataFrame:
    """``entries``: ``bundle_id, bundle_type, entry_pos, full_url, method, url``."""
    rules = {
        "not_transaction": ~F.coalesce(F.col("bundle_type") == "transaction", F.lit(False)),
        "missing_full_url": F.coalesce("full_url", F.lit("")) == "",
        "bad_request": ~F.coalesce((F.col("method") == "POST") & (F.col("url") != ""), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    own = entries.select("bundle_id", "full_url", F.explode(broken).alias("rule"))
    twice = (
        entries.where(F.coalesce("full_url", F.lit("")) != "")
        .groupBy("bundle_id", "full_url").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("bundle_id", "full_url", F.lit("duplicate_full_url").alias("rule"))
    )
    return own.unionByName(twice)


def references_in(json_text: Column, pattern: str = r'"reference"\s*:\s*"([^"]+)"') -> Column:
    return F.array_distinct(F.regexp_extract_all(json_text, F.lit(pattern), F.lit(1)))


def unresolved_references(entries: DataFrame, prefix: str = "urn:uuid:") -> DataFrame:
    """References of the bundle's resources that point at no full URL. ``entries``: ``bundle_id, full_url, resource``."""
    asked = (
        entries.select("bundle_id", F.explode(references_in(F.col("resource"))).alias("full_url"))
        .where(F.col("full_url").startswith(prefix)).distinct()
    )
    return asked.join(entries.select("bundle_id", "full_url"), ["bundle_id", "full_url"], "left_anti").withColumnRenamed("full_url", "reference")


# Required elements: type, element path, severity. Fixed values.
REQUIRED_ELEMENTS = (
    ("Patient", "identifier", "error"), ("Patient", "name", "error"), ("Patient", "gender", "error"),
    ("Practitioner", "identifier", "error"), ("Practitioner", "name", "error"),
    ("Organization", "identifier", "error"), ("Organization", "name", "error"),
    ("Organization", "active", "warning"), ("Organization", "address", "warning"),
    ("Condition", "clinicalStatus", "error"), ("Condition", "verificationStatus", "error"), ("Condition", "code", "error"),
    ("Condition", "subject", "error"),
    ("MedicationRequest", "status", "error"), ("MedicationRequest", "intent", "error"), ("MedicationRequest", "subject", "error"),
    ("MedicationRequest", "authoredOn", "error"), ("MedicationRequest", "requester", "error"),
    ("Encounter", "status", "error"), ("Encounter", "class", "error"), ("Encounter", "subject", "error"),
    ("Encounter", "type", "error"), ("Encounter", "period", "error"), ("Encounter", "participant", "error"),
    ("DocumentReference", "status", "error"), ("DocumentReference", "type", "error"), ("DocumentReference", "category", "error"),
    ("DocumentReference", "subject", "error"), ("DocumentReference", "date", "error"), ("DocumentReference", "author", "error"),
    ("DocumentReference", "content", "error"),
)
# One of several elements must be there.
REQUIRED_CHOICES = (
    ("MedicationRequest", ("medicationCodeableConcept", "medicationReference"), "error"),
    ("MedicationRequest", ("reportedBoolean", "reportedReference"), "error"),
    ("Encounter", ("reasonCode", "reasonReference"), "warning"),
)


def required_elements(resources: DataFrame) -> DataFrame:
    """Missing elements per resource. ``resources``: ``resource_id, resource_type, resource`` (JSON text)."""
    kinds = resources.withColumn("keys", F.coalesce(F.json_object_keys("resource"), F.array().cast("array<string>")))

    def empty(name):
        value = F.get_json_object("resource", f"$.{name}")
        return ~F.array_contains("keys", name) | value.isNull() | value.isin("", "[]", "{}")

    checks = [
        F.when((F.col("resource_type") == kind) & empty(name), F.struct(F.lit(name).alias("element"), F.lit(severity).alias("severity")))
        for kind, name, severity in REQUIRED_ELEMENTS
    ] + [
        F.when(
            (F.col("resource_type") == kind) & reduce(lambda a, b: a & b, [empty(n) for n in names]),
            F.struct(F.lit("|".join(names)).alias("element"), F.lit(severity).alias("severity")),
        )
        for kind, names, severity in REQUIRED_CHOICES
    ]
    return kinds.select("resource_id", "resource_type", F.explode(F.array_compact(F.array(*checks))).alias("m")).select(
        "resource_id", "resource_type", "m.element", "m.severity"
    )


# Category codes of which a resource needs one, and extensions that are warned of where they are missing. Fixed values.
REQUIRED_CATEGORIES = {
    "Condition": ("problem-list-item", "health-concern", "encounter-diagnosis"),
    "DocumentReference": ("clinical-note",),
}
WANTED_EXTENSIONS = {"Patient": ("us-core-race", "us-core-ethnicity", "us-core-birthsex")}
EXTENSION_NAMESPACE = "http://hl7.org/fhir/us/core/StructureDefinition/"


def required_content(resources: DataFrame) -> DataFrame:
    """What must stand inside elements: ``resource_id, resource_type, element, severity``; goes with ``required_elements``.

    Conditions and notes need a category of their kind, patients are warned of missing race, ethnicity and birth sex, and an attachment needs its
    content type and its data or a URL.
    """
    texts = lambda path: F.regexp_extract_all(F.coalesce(F.get_json_object("resource", path), F.lit("")), F.lit(r'([^\[\]",]+)'), F.lit(1))
    found = lambda element, severity="error": F.struct(F.lit(element).alias("element"), F.lit(severity).alias("severity"))
    kind = F.col("resource_type")
    checks = [
        F.when((kind == of) & ~F.arrays_overlap(texts("$.category[*].coding[*].code"), F.array(*map(F.lit, codes))), found("category.coding.code")) for of, codes in REQUIRED_CATEGORIES.items()
    ]
    checks += [
        F.when((kind == of) & ~F.array_contains(texts("$.extension[*].url"), EXTENSION_NAMESPACE + name), found(f"extension {name}", "warning"))
        for of, names in WANTED_EXTENSIONS.items() for name in names
    ]
    contents = F.coalesce(
        F.from_json(F.get_json_object("resource", "$.content"), "array<struct<attachment:struct<contentType:string,data:string,url:string>>>"),
        F.array().cast("array<struct<attachment:struct<contentType:string,data:string,url:string>>>"),
    )
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    note = kind == "DocumentReference"
    checks.append(F.when(note & F.exists(contents, lambda c: blank(c["attachment"]["contentType"])), found("content.attachment.contentType")))
    checks.append(F.when(note & F.exists(contents, lambda c: blank(c["attachment"]["data"]) & blank(c["attachment"]["url"])), found("content.attachment.data|url")))
    return resources.select("resource_id", "resource_type", F.inline(F.array_compact(F.array(*checks))))


def system_issues(codings: DataFrame) -> DataFrame:
    """Mis-spelt system URIs and RxNorm codes that are not numbers."""
    s = F.lower("system")
    rules = {
        "snomed_uri": s.contains("snomed") & (F.col("system") != V.SNOMED),
        "loinc_uri": s.contains("loinc") & (F.col("system") != V.LOINC),
        "rxnorm_uri": s.contains("rxnorm") & (F.col("system") != V.SYSTEM_URIS["rxnorm"]),
        "rxnorm_code": (F.col("system") == V.SYSTEM_URIS["rxnorm"]) & ~F.col("code").rlike(r"^\d+$"),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return codings.select("system", "code", F.explode(broken).alias("rule")).distinct()


def note_issues(attachments: DataFrame) -> DataFrame:
    """Attachments that do not decode, or decode to very short notes. ``document_id, data`` (base64)."""
    bytes_ = F.expr("try_to_binary(data, 'base64')")
    text = F.expr("try_validate_utf8(CAST(try_to_binary(data, 'base64') AS STRING))")
    rule = F.when(bytes_.isNull() | text.isNull(), "not_decodable").when(F.length(text) < 200, "very_short")
    return attachments.where(F.coalesce("data", F.lit("")) != "").select("document_id", rule.alias("rule")).where("rule IS NOT NULL")


def cross_resource_issues(documents: DataFrame, encounters: DataFrame, providers: DataFrame) -> DataFrame:
    """Author against practitioner, unknown encounters, and providers other than expected for the type.

    ``documents``: ``document_id, author, encounter_id``; ``encounters``: ``encounter_id, practitioner,
    provider, kind``; ``providers``: ``kind, expected_provider``.
    """
    linked = documents.join(encounters, "encounter_id", "left")
    rule = (
        F.when(F.col("encounter_id").isNull(), "no_encounter")
        .when(F.col("kind").isNull(), "unknown_encounter")
        .when(F.col("author") != F.col("practitioner"), "author_mismatch")
    )
    docs = linked.select(F.col("document_id").alias("id"), rule.alias("rule")).where("rule IS NOT NULL")
    misplaced = (
        encounters.join(providers, "kind")
        .where(F.col("provider") != F.col("expected_provider"))
        .select(F.col("encounter_id").alias("id"), F.lit("provider_mismatch").alias("rule"))
    )
    return docs.unionByName(misplaced)


def bundle_profile(entries: DataFrame) -> DataFrame:
    """One row per bundle: ``n_entries, n_targets`` (different reference targets)``, n_codings, systems`` (sorted)``, types`` (histogram, sorted).

    ``entries``: ``bundle_id, entry_pos, resource`` (JSON text).  A reference is a string element ``reference`` at any depth, a coding an
    object with a system and a code; a resource that cannot be parsed is an entry of null type.  Each count is summed in the tasks first.
    """
    root, texts = F.try_parse_json("resource"), F.array().cast("array<string>")
    start = entries.select("bundle_id", root.alias("root")).select(
        "bundle_id", F.try_variant_get("root", "$.resourceType", "string").alias("type"), opened(F.array("root")).alias("nodes"),
        texts.alias("targets"), texts.alias("systems"), F.lit(True).alias("open"),
    )

    def level(now: DataFrame) -> DataFrame:
        objects = F.filter(F.transform("nodes", lambda n: n["members"]), lambda m: m.isNotNull())
        referring = F.transform(objects, lambda m: F.try_element_at(m, F.lit("reference")))
        targets = F.transform(F.filter(referring, lambda v: kind_of(v) == "string"), lambda v: F.try_variant_get(v, "$", "string"))
        coded = F.filter(objects, lambda m: F.map_contains_key(m, "system") & F.map_contains_key(m, "code"))
        systems = F.transform(coded, lambda m: F.try_variant_get(F.try_element_at(m, F.lit("system")), "$", "string"))
        children = F.flatten(F.transform("nodes", lambda n: F.coalesce(F.map_values(n["members"]), n["items"])))
        below = now.select("bundle_id", "type", opened(children).alias("nodes"), F.concat("targets", targets).alias("targets"), F.concat("systems", systems).alias("systems"))
        return below.withColumn("open", F.size("nodes") > 0)

    # One row an entry, whose arrays hold what the entry does.
    found = walked(start, level)
    types = found.groupBy("bundle_id", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("bundle_id").agg(
        F.sum("n").alias("n_entries"), F.sort_array(F.collect_list(F.struct("type", "n"))).alias("types")
    )
    targets = found.select("bundle_id", F.explode("targets").alias("value")).distinct().groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_targets"))
    per_system = found.select("bundle_id", F.explode("systems").alias("system")).groupBy("bundle_id", "system").agg(F.count(F.lit(1)).alias("n"))
    codings = per_system.groupBy("bundle_id").agg(F.sum("n").alias("n_codings"), F.sort_array(F.collect_set("system")).alias("systems"))
    none = F.lit(0).cast("bigint")
    return types.join(targets, "bundle_id", "left").join(codings, "bundle_id", "left").select(
        "bundle_id", "n_entries", F.coalesce("n_targets", none).alias("n_targets"), F.coalesce("n_codings", none).alias("n_codings"),
        F.coalesce("systems", F.array().cast("array<string>")).alias("systems"), "types",
    )


def date_regressions(items: DataFrame, max_drift_years: int = 20) -> DataFrame:
    """Rules kept items must meet: date form, year drift, no empty family history."""
    date = F.coalesce("item.effective_date", "item.performed")
    rule = (
        F.when(date.isNotNull() & ~date.rlike(V.PARTIAL_DATE), "date_format")
        .when(
            F.abs(F.substring(date, 1, 4).try_cast("int") - F.substring("note_date", 1, 4).try_cast("int")) > max_drift_years,
            "date_drift",
        )
        .when(
            (F.col("resource_type") == "FamilyMemberHistory") & (F.coalesce(F.size("item.conditions"), F.lit(0)) <= 0),
            "empty_family_history",
        )
    )
    return items.select("cand_id", rule.alias("rule")).where("rule IS NOT NULL")
