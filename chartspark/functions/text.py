"""Name, display, dose, date and id expressions: ``Column -> Column``, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartspark import vocab as V


def _alternatives(words) -> str:
    return "|".join(words)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White-space runs become one blank; ends are trimmed."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_text(*texts: Column) -> Column:
    """First text that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(t) for t in texts])


# -- names -----------------------------------------------------------------------------


def normalize_name(name: Column) -> Column:
    """Merge key form of a name."""
    lowered = F.lower(strip(name))
    return squeeze(F.regexp_replace(lowered, rf"^(?:{_alternatives(V.NAME_PREFIXES)})\s+", ""))


def normalize_display(text: Column) -> Column:
    """Chart look-up form of a display; inner blanks stay as they are."""
    lowered = strip(F.lower(text))
    return strip(F.regexp_replace(lowered, rf"^(?:{_alternatives(V.DISPLAY_PREFIXES)})\s+", ""))


def normalize_ingredient(display: Column) -> Column:
    """Reduce a verbose drug display to its ingredient names."""
    cleaned = reduce(
        lambda text, step: F.regexp_replace(text, step[0], step[1]),
        V.INGREDIENT_STEPS,
        strip(F.lower(display)),
    )
    return strip(cleaned)


def item_name(resource_type: Column, name: Column, substance: Column, relationship: Column) -> Column:
    return (
        F.when(resource_type == "AllergyIntolerance", substance)
        .when(resource_type == "FamilyMemberHistory", relationship)
        .otherwise(name)
    )


# -- doses -------------------------------------------------------------------------------


def normalize_dose_value(value: Column) -> Column:
    return strip(F.regexp_replace(value, V.DOSE_UNIT_TAIL, ""))


def dose_in_text(text: Column) -> Column:
    """First dose such as ``25/100`` in free text, else null."""
    return blank_to_null(F.regexp_extract(text, V.DOSE_IN_TEXT, 1))


def chart_dose(instructions: Column) -> Column:
    """First dose over an array of ``(quantities array<string>, text)`` instructions.

    Inside one instruction a coded quantity comes before the text.
    """
    found = F.transform(
        instructions,
        lambda i: F.coalesce(F.get(F.array_compact(i["quantities"]), F.lit(0)), dose_in_text(i["text"])),
    )
    return F.coalesce(F.get(F.array_compact(found), F.lit(0)), F.lit(""))


# -- tobacco --------------------------------------------------------------------------------


def canonical_tobacco(value: Column) -> Column:
    v = strip(F.lower(value))
    return (
        F.when(v.isin(*V.TOBACCO_CURRENT) | contains_any(v, V.TOBACCO_CURRENT_PARTS), "current")
        .when(v.isin(*V.TOBACCO_FORMER) | contains_any(v, V.TOBACCO_FORMER_PARTS), "former")
        .when(v.isin(*V.TOBACCO_NEVER) | contains_any(v, V.TOBACCO_NEVER_PARTS), "never")
        .otherwise(v)
    )


# -- codes -------------------------------------------------------------------------------------


def normalize_code(system: Column, code: Column) -> Column:
    """Dots are dropped for ICD-10 only."""
    is_icd10 = F.lower(system).contains("icd-10") | F.lower(system).contains("icd10")
    return F.when(is_icd10, F.replace(code, F.lit("."), F.lit(""))).otherwise(code)


def icd10_dotted(code: Column) -> Column:
    trimmed = strip(code)
    return F.when(
        trimmed.rlike(r"^[A-Z]\d{2}\d+$"), F.regexp_replace(trimmed, r"^([A-Z]\d{2})(\d+)$", "$1.$2")
    ).otherwise(code)


def normalize_codings(codings: Column) -> Column:
    """ICD-10-CM codes of a coding array get their dot back."""
    return F.transform(
        codings,
        lambda c: F.when(
            (c["system"] == V.ICD10CM) & (c["code"] != ""), c.withField("code", icd10_dotted(c["code"]))
        ).otherwise(c),
    )


# -- merge keys -----------------------------------------------------------------------------------


def completeness(item: Column, fields: dict[str, bool]) -> Column:
    """Number of filled fields. ``fields`` maps a field name to *is it an array*."""
    filled = [
        F.when(
            item[name].isNotNull() & ((F.size(item[name]) > 0) if is_array else (item[name].cast("string") != "")), 1
        ).otherwise(0)
        for name, is_array in fields.items()
    ]
    return reduce(lambda a, b: a + b, filled)


def encounter_key(encounter_id: Column, note_date: Column, document_id: Column) -> Column:
    return first_text(encounter_id, F.substring(note_date, 1, 10), document_id)


def observation_encounter_key(effective_date: Column, fallback: Column) -> Column:
    return F.when(
        effective_date.isNotNull() & (effective_date != ""),
        F.concat(F.lit("obs:"), F.substring(effective_date, 1, 7)),
    ).otherwise(fallback)


def merge_key(
    resource_type: Column,
    encounter: Column,
    normalized_name: Column,
    value: Column,
    dose_value: Column,
    dose_unit: Column,
) -> Column:
    """Group key of exact duplicates: type, encounter where it counts, name, value or dose."""
    value_part = F.when(
        resource_type == "Observation", F.concat(F.lit("::"), F.coalesce(F.lower(strip(value)), F.lit("")))
    ).otherwise("")
    encounter_part = F.when(
        resource_type.isin(*V.ENCOUNTER_LEVEL_TYPES), F.concat(F.lit("::"), encounter)
    ).otherwise("")
    dose_part = F.when(
        (resource_type == "MedicationRequest") & dose_value.isNotNull(),
        F.concat(
            F.lit("::"), F.lower(strip(dose_value)), F.lit(" "), F.coalesce(F.lower(strip(dose_unit)), F.lit(""))
        ),
    ).otherwise("")
    return F.concat(resource_type, encounter_part, F.lit("::"), normalized_name, value_part, dose_part)


# -- laterality, markers ------------------------------------------------------------------------------


def laterality(body_sites: Column) -> Column:
    """Sides named in the body sites, as a sorted array."""
    text = F.lower(F.array_join(F.coalesce(body_sites, F.array().cast("array<string>")), " "))
    return F.array_compact(
        F.array(F.when(text.contains("left"), F.lit("left")), F.when(text.contains("right"), F.lit("right")))
    )


def laterality_conflict(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def marker_polarity(value: Column) -> Column:
    v = F.lower(F.coalesce(value, F.lit("")))
    return (
        F.when(contains_any(v, V.NEGATIVE_WORDS), "neg").when(contains_any(v, V.POSITIVE_WORDS), "pos").otherwise("none")
    )


def squeezed_marker(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), V.MARKER_SEPARATORS, "")


def marker_family(name: Column) -> Column:
    """ER / PR / HER2 / KI67: long forms first, then short forms at word borders; else null."""
    squeezed = squeezed_marker(name)
    shorts = {family: pattern for family, _, pattern, _, _ in V.MARKER_FAMILIES}
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for family, forms, _, _, _ in V.MARKER_FAMILIES:
        rule = rule.when(contains_any(squeezed, forms), family)
    for family in V.MARKER_SHORT_ORDER:
        rule = rule.when(F.coalesce(name, F.lit("")).rlike(shorts[family]), family)
    return rule


def is_tumor_marker(name: Column) -> Column:
    return contains_any(squeezed_marker(name), V.MARKER_LONG_FORMS) | F.coalesce(name, F.lit("")).rlike(
        V.MARKER_SHORT_FORMS
    )


# -- numbers, dates ---------------------------------------------------------------------------------------


def parse_blood_pressure(value: Column) -> Column:
    """``struct(systolic, diastolic)`` of the first ``d/d``; null without one."""
    systolic = F.regexp_extract(value, r"(\d+)\s*/\s*(\d+)", 1).try_cast("int")
    diastolic = F.regexp_extract(value, r"(\d+)\s*/\s*(\d+)", 2).try_cast("int")
    return F.when(systolic.isNotNull(), F.struct(systolic.alias("systolic"), diastolic.alias("diastolic")))


def parse_onset_age(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def parse_integer(text: Column) -> Column:
    return F.regexp_extract(text, r"(-?\d+)", 1).try_cast("int")


def is_valid_partial_date(text: Column) -> Column:
    return text.rlike(V.PARTIAL_DATE)


def is_numeric(text: Column) -> Column:
    return strip(text).rlike(V.NUMBER_WITH_COMPARATOR)


def parse_document_date(raw: Column) -> Column:
    """ISO date or timestamp, ``Z`` allowed; null otherwise."""
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
    return F.when(raw.rlike(iso), F.try_to_timestamp(raw))


def years_in(text: Column) -> Column:
    """Stand-alone four-digit years of a text."""
    return F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{4})(?!\d)"), F.lit(1))


def date_reject_reason(value: Column, snippet: Column, note_date: Column, max_drift_years: int = 20) -> Column:
    """Why a date read from a note is not kept; null when it is kept or empty."""
    year = F.substring(value, 1, 4)
    note_year = F.when(
        F.substring(note_date, 1, 4).rlike(r"^\d{4}$"), F.substring(note_date, 1, 4).try_cast("int")
    )
    return (
        F.when(value.isNull() | (value == ""), F.lit(None).cast("string"))
        .when(~is_valid_partial_date(value), "bad_format")
        .when(~F.array_contains(years_in(F.coalesce(snippet, F.lit(""))), year), "year_not_in_snippet")
        .when(F.abs(year.try_cast("int") - note_year) > max_drift_years, f"drift_gt_{max_drift_years}y")
    )


def kept_date(value: Column, snippet: Column, note_date: Column, max_drift_years: int = 20) -> Column:
    return F.when(
        date_reject_reason(value, snippet, note_date, max_drift_years).isNull(), blank_to_null(value)
    )


# -- search text ---------------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric runs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def _drop_leading_stopwords(words: Column) -> Column:
    """Words after the leading run of stop words."""
    first_kept = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))),
        F.lit(0),
        lambda kept, i: F.when(
            (kept == 0) & ~F.coalesce(F.lower(F.get(words, i - 1)).isin(*V.LEADING_STOPWORDS), F.lit(True)), i
        ).otherwise(kept),
    )
    return F.when(first_kept > 0, F.slice(words, first_kept, F.size(words))).otherwise(
        F.array().cast("array<string>")
    )


def backoff_variants(term: Column) -> Column:
    """Shorter forms of a search term, most specific first, distinct without regard to case."""
    term = F.coalesce(term, F.lit(""))
    norm = squeeze(F.replace(term, F.lit("-"), F.lit(" ")))
    words = F.split(norm, " ")
    n = F.size(words)
    none = F.lit(None).cast("array<string>")
    head = F.split(squeeze(F.split(term, ",")[0]), " ")
    windows = F.array(
        F.when(term.contains(","), head).otherwise(none),
        F.when(n > 2, F.slice(words, 2, n)).otherwise(none),
        F.when(n > 3, F.slice(words, 3, n)).otherwise(none),
        F.when(n > 3, F.slice(words, F.greatest(n - 2, F.lit(1)), 3)).otherwise(none),
        F.when(n > 2, F.slice(words, F.greatest(n - 1, F.lit(1)), 2)).otherwise(none),
    )
    texts = F.filter(
        F.transform(F.array_compact(windows), lambda w: F.array_join(_drop_leading_stopwords(w), " ")),
        lambda v: v != "",
    )
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(_distinct_texts(texts))


def _distinct_texts(texts: Column) -> Column:
    """The first of texts that are equal without regard to case; the texts are computed once per row, not once per element."""
    return let(texts, lambda every: let(F.transform(every, F.lower), lambda low: F.filter(every, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)))


def query_variants(term: Column) -> Column:
    """The term and its clean-ups, one rule each, then the spelled-out abbreviation; distinct without regard to case."""
    plain = squeeze(F.coalesce(term, F.lit("")))
    cleaned = [squeeze(F.regexp_replace(plain, pattern, to)) for pattern, to in V.VARIANT_STEPS]
    table = F.create_map(*[F.lit(x) for pair in V.ABBREVIATIONS for x in pair])
    spelled = F.array_join(F.transform(F.split(F.lower(plain), " "), lambda w: F.coalesce(table[w], w)), " ")
    return _distinct_texts(F.filter(F.array(plain, *cleaned, spelled), lambda v: v != ""))


def bench_normal_display(text: Column) -> Column:
    """Comparison form of a display in retrieval metrics."""
    no_tag = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), V.SEMANTIC_TAGS, "")
    no_filler = F.regexp_replace(no_tag, r"\b(?:nos|unspecified)\b", "")
    return strip(F.regexp_replace(no_filler, r"[^a-z0-9]+", " "))


def bench_normal_code(system_key: Column, code: Column) -> Column:
    """Comparison form of a code: upper case, no dots in ICD-10."""
    upper = F.upper(strip(code))
    return F.when(system_key == "icd10", F.replace(upper, F.lit("."), F.lit(""))).otherwise(upper)


# -- keys -------------------------------------------------------------------------------------------------------


def content_key(*parts: Column, closing_nul: bool = False) -> Column:
    """SHA-256 over the parts with a NUL between them (and after the last, if asked)."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    joined = F.concat_ws("", *[p for part in parts for p in (part, nul)][: None if closing_nul else -1])
    return F.sha2(F.encode(joined, "UTF-8"), 256)


def stable_id(prefix: str, *keys: Column) -> Column:
    """``prefix_`` and eight Crockford base-32 digits, derived from the key: retries give the same id."""
    digest = F.sha2(F.encode(F.concat_ws("\x1f", *keys), "UTF-8"), 256)
    digits = F.lpad(F.conv(F.substring(digest, 1, 10), 16, 32), 8, "0")
    crockford = F.translate(F.lower(digits), "ijklmnopqrstuv", "jkmnpqrstvwxyz")
    return F.concat(F.lit(prefix + "_"), crockford)


def model_key(model: Column) -> Column:
    return F.split(model, "-20", 2)[0]


def reference_from_location(location: Column) -> Column:
    """``Type/id`` out of a location URL; null without one."""
    pattern = r"(?:^|/)([A-Z][A-Za-z]+)/([^/?#]+)"
    kind = blank_to_null(F.regexp_extract(location, pattern, 1))
    return F.concat(kind, F.lit("/"), F.regexp_extract(location, pattern, 2))


def numbered_lines(sentences: Column) -> Column:
    """``[n] text`` lines from an array of ``(number, text)``, in number order."""
    return F.array_join(
        F.transform(
            F.array_sort(sentences),
            lambda s: F.concat(F.lit("["), s["number"].cast("string"), F.lit("] "), squeeze(s["text"])),
        ),
        "\n",
    )


def temporal_context(note_date: Column, admission_date: Column, discharge_date: Column) -> Column:
    labelled = [
        F.concat(F.lit(label + "="), value)
        for label, value in (
            ("note_date", note_date),
            ("admission_date", admission_date),
            ("discharge_date", discharge_date),
        )
    ]
    return F.coalesce(blank_to_null(F.concat_ws("; ", *labelled)), F.lit("none"))


# -- places of matches ---------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, also where lambdas use it for every element."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column, block: int = 256) -> Column:
    """Sum of an integer array up to and with each element; block by block, so long arrays stay near linear."""

    def within(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(
            part, start,
            lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["sums"], s["sum"] + x).alias("sums")),
            lambda s: s["sums"],
        )

    def shifted(parts: Column) -> Column:
        ends = within(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.transform(within(p), lambda x: x + F.coalesce(F.get(e, i - 1), F.lit(0))))))

    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(block))
    return let(F.transform(starts, lambda a: F.slice(values, a + 1, block)), shifted)


def placed_matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, text>>`` of every match; the pieces around the matches give the places."""

    def placed(hits: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        lengths = let(pieces, lambda p: F.transform(hits, lambda h, i: F.length(p[i]) + F.length(h)))
        return let(
            running_sums(lengths),
            lambda ends: F.transform(hits, lambda h, i: F.struct((ends[i] - F.length(h)).alias("start"), ends[i].alias("end"), h.alias("text"))),
        )

    def found(hits: Column) -> Column:
        return F.when(F.size(hits) > 0, placed(hits)).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)
