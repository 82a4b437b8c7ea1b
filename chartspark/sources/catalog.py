"""Guide catalog and presets resolved into one rule row per resource type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark import vocab as V

_CODE = "struct<system:string,code:string,display:string>"
_GUIDE = f"struct<id:string,resources:map<string,struct<profiles:array<string>,fixed:array<{_CODE}>>>>"
CATALOG = f"base array<{_GUIDE}>, specialties array<{_GUIDE}>"
_VERSIONS = "struct<active_version:int,versions:array<struct<version:int,text:string>>>"
PRESET = (
    "id string, ig struct<base:string,specialty:string>, resources map<string,struct<enabled:boolean>>,"
    f"coding map<string,struct<systems:array<string>,codes:array<{_CODE}>,subset:array<{_CODE}>,"
    "code_overrides:array<struct<match:string,system:string,code:string,display:string>>>>,"
    f"prompts map<string,{_VERSIONS}>, capture_prompts map<string,{_VERSIONS}>,"
    "extensions array<struct<url:string,attach_to:string,datatype:string,value:string>>"
)
DEFAULT_BASE = "us-core@6.1.0"


def system_uri(key: Column) -> Column:
    """URI of a system key; an unknown key passes through."""
    table = F.create_map(*[F.lit(x) for pair in V.SYSTEM_URIS.items() for x in pair])
    return F.coalesce(table[key], key)


def read_ig_catalog(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``value`` (whole JSON) to candidate profiles and fixed codes per guide and type, in catalog order."""
    parsed = lines.select(F.from_json("value", CATALOG).alias("c"))
    guides = parsed.select(F.explode(F.concat("c.base", F.coalesce("c.specialties", F.array().cast(f"array<{_GUIDE}>")))).alias("g"))
    rules = guides.select(F.col("g.id").alias("guide"), F.explode("g.resources").alias("resource_type", "rule"))
    profiles = rules.select("guide", "resource_type", F.posexplode("rule.profiles").alias("position", "profile"))
    fixed = (
        rules.select("guide", "resource_type", F.posexplode("rule.fixed").alias("position", "f"))
        .where(F.coalesce("f.code", F.lit("")) != "")
        .select("guide", "resource_type", "position", system_uri(F.col("f.system")).alias("system"), "f.code", F.coalesce("f.display", F.lit("")).alias("display"))
    )
    return profiles, fixed


def active_prompt(versions: Column) -> Column:
    """Text of the active version, else of the last one listed."""
    chosen = F.get(F.filter(versions["versions"], lambda v: v["version"] == versions["active_version"]), F.lit(0))
    last = F.element_at(F.when(F.size(versions["versions"]) > 0, versions["versions"]), -1)
    return F.coalesce(chosen, last)["text"]


def resolve_rules(presets: DataFrame) -> DataFrame:
    """One rule row per preset and type: ``preset_id, resource_type, enabled, open_systems,
    pinned, code_overrides, extensions, extract_prompt, capture_prompt, guide_base, guide_specialty``.

    ``presets``: ``value`` (JSON).  Null open systems mean all are open; the older ``subset``
    key means those codes only.
    """
    p = presets.select(F.from_json("value", PRESET).alias("p")).select("p.*")
    kinds = F.array(*[F.lit(k) for k in V.RESOURCE_TYPES])
    rows = p.select("*", F.explode(kinds).alias("resource_type"))
    coding = F.col("coding")[F.col("resource_type")]
    legacy = coding["codes"].isNull() & (F.coalesce(F.size(coding["subset"]), F.lit(0)) > 0)
    no_codes = F.array().cast(f"array<{_CODE}>")
    return rows.select(
        F.col("id").alias("preset_id"),
        "resource_type",
        F.coalesce(F.col("resources")[F.col("resource_type")]["enabled"], F.lit(True)).alias("enabled"),
        F.when(legacy, F.array().cast("array<string>")).otherwise(coding["systems"]).alias("open_systems"),
        F.when(legacy, coding["subset"]).otherwise(F.coalesce(coding["codes"], no_codes)).alias("pinned"),
        F.filter(coding["code_overrides"], lambda o: F.coalesce(o["code"], F.lit("")) != "").alias("code_overrides"),
        F.filter("extensions", lambda e: e["attach_to"] == F.col("resource_type")).alias("extensions"),
        active_prompt(F.col("prompts")[F.col("resource_type")]).alias("extract_prompt"),
        active_prompt(F.col("capture_prompts")[F.col("resource_type")]).alias("capture_prompt"),
        F.coalesce("ig.base", F.lit(DEFAULT_BASE)).alias("guide_base"),
        F.col("ig.specialty").alias("guide_specialty"),
    )


def effective_rules(presets: DataFrame, profiles: DataFrame, fixed: DataFrame) -> DataFrame:
    """``resolve_rules`` with what the preset's guides add: ``candidate_profiles`` and ``fixed`` codes, one row per preset and type.

    ``profiles`` and ``fixed`` as from ``read_ig_catalog``.  Candidate profiles are those of the specialty guide, in its order.  Fixed codes are the base
    guide's, then the specialty's; of equal (system, code) the first stays.  A preset that repeats is one preset; ``profiles`` that go
    on every resource are none, as the builders write the base guide's themselves.
    """
    rules = resolve_rules(presets).dropDuplicates(["preset_id", "resource_type"])
    key = ["preset_id", "resource_type"]
    layers = rules.select(*key, F.posexplode(F.array("guide_base", "guide_specialty")).alias("layer", "guide"))
    codes = (
        layers.join(fixed.where("system IS NOT NULL"), ["guide", "resource_type"])
        .groupBy(*key, "system", "code").agg(F.min(F.struct("layer", "position", "display")).alias("first"))
        .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first.layer", "first.position", "system", "code", "first.display"))).alias("f"))
        .select(*key, F.transform("f", lambda c: F.struct(c["system"].alias("system"), c["code"].alias("code"), c["display"].alias("display"))).alias("fixed"))
    )
    fitting = (
        layers.where("layer = 1").join(profiles, ["guide", "resource_type"])
        .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("position", "profile"))).alias("p"))
        .select(*key, F.transform("p", lambda x: x["profile"]).alias("candidate_profiles"))
    )
    none = F.array().cast("array<string>")
    return rules.join(codes, key, "left").join(fitting, key, "left").withColumns(
        {"fixed": F.coalesce("fixed", F.array().cast(f"array<{_CODE}>")), "candidate_profiles": F.coalesce("candidate_profiles", none), "profiles": none}
    )


def rule_key(rows: DataFrame, rules: DataFrame) -> list[str]:
    """What rows and rules are joined on: the type, and the preset where both name one.  Rules of several presets need rows that name theirs."""
    if "preset_id" in rules.columns and "preset_id" not in rows.columns:
        raise ValueError("rules are by preset: rows need a preset_id")
    return ["preset_id", "resource_type"] if "preset_id" in rules.columns else ["resource_type"]


def drop_disabled_types(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates of the types their preset switched off leave; types without a rule stay."""
    key = rule_key(candidates, rules)
    return candidates.join(rules.where(~F.col("enabled")).select(*key).distinct(), key, "left_anti")
