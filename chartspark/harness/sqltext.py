"""SQL fragments the twins share: the same rules, said in DuckDB SQL."""

from __future__ import annotations

from chartspark import vocab as V


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(q(v) for v in values)


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def normalize_name(x: str) -> str:
    heads = "|".join(V.NAME_PREFIXES)
    return strip(rf"regexp_replace(regexp_replace(lower({strip(x)}), '^(?:{heads})\s+', ''), '\s+', ' ', 'g')")


def normalize_display(x: str) -> str:
    heads = "|".join(V.DISPLAY_PREFIXES)
    return strip(rf"regexp_replace({strip(f'lower({x})')}, '^(?:{heads})\s+', '')")


def normalize_ingredient(x: str) -> str:
    out = strip(f"lower({x})")
    for pattern, replacement in V.INGREDIENT_STEPS:
        out = f"regexp_replace({out}, {q(pattern)}, {q(replacement)}, 'g')"
    return strip(out)


def normalize_dose(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(V.DOSE_UNIT_TAIL)}, '')")


def tobacco(x: str) -> str:
    v = strip(f"lower({x})")
    return (
        f"CASE WHEN {v} IN ({names(V.TOBACCO_CURRENT)}) OR {any_of(v, V.TOBACCO_CURRENT_PARTS)} THEN 'current' "
        f"WHEN {v} IN ({names(V.TOBACCO_FORMER)}) OR {any_of(v, V.TOBACCO_FORMER_PARTS)} THEN 'former' "
        f"WHEN {v} IN ({names(V.TOBACCO_NEVER)}) OR {any_of(v, V.TOBACCO_NEVER_PARTS)} THEN 'never' ELSE {v} END"
    )


def normal_code(system: str, code: str) -> str:
    return (
        f"CASE WHEN contains(lower({system}), 'icd-10') OR contains(lower({system}), 'icd10') "
        f"THEN replace({code}, '.', '') ELSE {code} END"
    )


def marker_family(x: str) -> str:
    squeezed = rf"regexp_replace(lower(coalesce({x}, '')), '[\s\-/,]+', '', 'g')"
    short = {f: p for f, _, p, _, _ in V.MARKER_FAMILIES}
    whens = [f"WHEN {any_of(squeezed, forms)} THEN '{f}'" for f, forms, _, _, _ in V.MARKER_FAMILIES]
    whens += [f"WHEN regexp_matches(coalesce({x}, ''), {q(short[f])}) THEN '{f}'" for f in V.MARKER_SHORT_ORDER]
    return "CASE " + " ".join(whens) + " END"


def stable_id(prefix: str, key: str) -> str:
    digest = f"('0x' || substr(sha256({key}), 1, 10))::BIGINT"
    digits = " || ".join(
        f"substr('0123456789abcdefghjkmnpqrstvwxyz', (({digest} >> {5 * i}) & 31)::INT + 1, 1)" for i in range(7, -1, -1)
    )
    return f"('{prefix}_' || {digits})"


def merge_key(p: str = "") -> str:
    """Merge key over the flat candidate columns."""
    name = normalize_name(
        f"coalesce(CASE {p}resource_type WHEN 'AllergyIntolerance' THEN {p}substance WHEN 'FamilyMemberHistory' "
        f"THEN {p}relationship ELSE {p}name END, '')"
    )
    return (
        f"{p}resource_type || CASE WHEN {p}resource_type IN ('Observation', 'Procedure') THEN '::' || {p}encounter_key ELSE '' END "
        f"|| '::' || {name} || CASE WHEN {p}resource_type = 'Observation' THEN '::' || coalesce(lower(trim({p}value)), '') ELSE '' END "
        f"|| CASE WHEN {p}resource_type = 'MedicationRequest' AND {p}dose_value IS NOT NULL THEN '::' || lower(trim({p}dose_value)) || ' mg' ELSE '' END"
    )
