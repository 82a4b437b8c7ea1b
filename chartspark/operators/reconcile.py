"""Classify candidates against the chart: NEW / DUPLICATE / UPDATING / CONFLICTING.

All six kinds of candidate share one equality join on (patient, type, system, code);
only the residue of conditions and medications goes on to the name look-up.  The verdict
is then a CASE per type (``VERDICTS``), so adding a type means adding one expression.

``candidates`` needs ``cand_id, patient_id, resource_type, item`` (the wide record).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions import text as T
from chartspark.functions.clinical import is_discontinued, is_negated, no_codings
from chartspark.operators import chart
from chartspark.operators.containment import first_containment
from chartspark.session import Held, cut_lineage, fixed, settings


def _codings() -> Column:
    return F.coalesce(F.col("item.coding"), no_codings())


def exact_hits(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """First coding of a candidate that the chart knows, and what it matches.

    Conditions that are negated and medications that were stopped look at every coding;
    ``n_matches`` and ``first_active`` cover all of them.
    """
    usable = F.filter(
        _codings(),
        lambda c: c["system"].isNotNull()
        & c["code"].isNotNull()
        & ((F.col("resource_type") != "Observation") | (c["system"] == V.LOINC)),
    )
    pairs = F.array_distinct(
        F.transform(
            usable,
            lambda c: F.struct(c["system"].alias("system"), T.normalize_code(c["system"], c["code"]).alias("code")),
        )
    )
    coded = candidates.select(
        "cand_id", "patient_id", "resource_type", F.posexplode(pairs).alias("coding_pos", "pair")
    ).select("cand_id", "patient_id", "resource_type", "coding_pos", "pair.system", "pair.code")
    hits = coded.join(chart.code_index(facts), ["patient_id", "resource_type", "system", "code"])
    return hits.groupBy("patient_id", "cand_id").agg(
        F.min(F.struct("coding_pos", "system", "code", "first", "n_matches")).alias("exact"),
        F.min(F.when(F.col("first_active").isNotNull(), F.struct("coding_pos", "first_active"))).alias("exact_active"),
        F.min(F.when(F.col("first_shown").isNotNull(), F.struct("coding_pos", "first_shown"))).alias("exact_shown"),
        F.sum("n_matches").alias("exact_all"),
    )


def procedure_dates(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Procedures whose code and date are both in the chart: first such resource."""
    chart_dates = (
        chart.chart_codes(facts.where(F.col("resource_type") == "Procedure"))
        .where(F.coalesce("performed", F.lit("")) != "")
        .groupBy("patient_id", "system", "code", "performed")
        .agg(F.min(F.struct("entry_pos", "resource_id", "display")).alias("dated"))
    )
    first_code = (
        candidates.where((F.col("resource_type") == "Procedure") & (F.coalesce("item.performed", F.lit("")) != ""))
        .select("cand_id", "patient_id", F.col("item.performed").alias("performed"), "exact.system", "exact.code")
    )
    return first_code.join(chart_dates, ["patient_id", "system", "code", "performed"]).select("patient_id", "cand_id", "dated")


def name_hits(residue: DataFrame, facts: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Name look-up of the residue: exact ingredient, else first text containment in chart order.  ``keep`` stores what is read twice."""
    conditions = residue.where(F.col("resource_type") == "Condition").select(
        "cand_id", "patient_id", "resource_type", F.lit(0).alias("try"),
        T.normalize_display(F.coalesce("item.name", F.lit(""))).alias("name"),
    )
    drug_name = T.normalize_ingredient(F.coalesce("item.name", F.lit("")))
    drugs = residue.where(F.col("resource_type") == "MedicationRequest").select(
        "cand_id", "patient_id", "resource_type", F.posexplode(_codings()).alias("try", "coding"), drug_name.alias("_own")
    ).select(
        "cand_id", "patient_id", "resource_type", "try",
        T.first_text(T.normalize_ingredient(F.coalesce("coding.display", F.lit(""))), F.col("_own")).alias("name"),
    )
    wanted = keep(conditions.unionByName(drugs))
    index = keep(chart.display_index(facts.where(F.col("resource_type") == "Condition")).unionByName(
        chart.ingredient_index(facts)
    ))
    positions = index.select("patient_id", "resource_type", F.col("key").alias("display"), F.col("first.order").alias("position"))
    contained = first_containment(
        wanted,
        positions,
        ["patient_id", "resource_type"],
        prefer_equal=F.col("resource_type") == "MedicationRequest",
    )
    keyed = (
        wanted.join(contained, ["patient_id", "resource_type", "name"])
        .withColumn("key", F.col("display"))
        # The first coding that leads anywhere decides.
        .groupBy("cand_id", "patient_id", "resource_type")
        .agg(F.min(F.struct("try", "name", "key")).alias("named"))
        .withColumn("key", F.col("named.key"))
    )
    return keyed.join(index, ["patient_id", "resource_type", "key"]).select(
        "patient_id", "cand_id",
        F.struct(F.col("named.name").alias("name"), "key", "first", "first_active", "first_shown", "n_matches").alias("named"),
    )


# -- verdicts ------------------------------------------------------------------------------


def _verdict(classification: str, reasoning: Column, match_type: str | None = None) -> Column:
    return F.struct(
        F.lit(classification).alias("classification"),
        reasoning.alias("reasoning"),
        F.lit(match_type).cast("string").alias("match_type"),
    )


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


NO_MATCH = "no match in chart"


def condition_verdict() -> Column:
    negated = is_negated(F.col("resource_type"), F.col("item.negated"))
    name = T.normalize_display(F.coalesce("item.name", F.lit("")))
    exact, named = F.col("exact").isNotNull(), F.col("named").isNotNull()
    active = F.when(exact, F.col("exact_active.first_active.display")).otherwise(F.col("named.first_active.display"))
    # A negation shows the resource's own display, which the index of names keeps apart.
    shown = F.coalesce(T.blank_to_null(active), name)
    negation = (
        F.when(~exact & ~named, _verdict("NEW", _text("negated assertion has no chart anchor")))
        .when(
            active.isNotNull() & exact,
            _verdict("CONFLICTING", _text("note negates this; chart shows active: ", shown), "exact_code"),
        )
        .when(
            active.isNotNull(),
            _verdict("CONFLICTING", _text("note negates this; chart shows active: ", shown), "display_text"),
        )
        .when(exact, _verdict("DUPLICATE", _text("chart already records this as resolved/inactive"), "exact_code"))
        .otherwise(_verdict("DUPLICATE", _text("chart already records this as resolved/inactive"), "display_text"))
    )
    assertion = (
        F.when(exact, _verdict("DUPLICATE", _text("exact code match ", F.col("exact.code")), "exact_code"))
        .when(
            named,
            _verdict("AMBIGUOUS", _text("display overlap: '", name, "' ~ '", F.col("named.key"), "'"), "display_text"),
        )
        .otherwise(_verdict("NEW", _text(NO_MATCH)))
    )
    return F.when(negated, negation).otherwise(assertion)


def medication_verdict() -> Column:
    stopped = is_discontinued(F.col("resource_type"), F.col("item.status"))
    exact, named = F.col("exact").isNotNull(), F.col("named").isNotNull()
    active = F.when(exact, F.col("exact_active.first_active.display")).otherwise(F.col("named.first_active.display"))
    shown = F.coalesce(T.blank_to_null(active), F.col("item.name"))
    stop = (
        F.when(~exact & ~named, _verdict("NEW", _text("discontinuation has no chart anchor")))
        .when(
            active.isNotNull() & exact,
            _verdict("CONFLICTING", _text("note says discontinued; chart shows active: ", shown), "exact_code"),
        )
        .when(
            active.isNotNull(),
            _verdict("CONFLICTING", _text("note says discontinued; chart shows active: ", shown), "ingredient"),
        )
        .when(exact, _verdict("DUPLICATE", _text("chart already records this as discontinued"), "exact_code"))
        .otherwise(_verdict("DUPLICATE", _text("chart already records this as discontinued"), "ingredient"))
    )
    own_dose = F.coalesce("item.dose.value", F.lit(""))
    chart_dose = F.col("named.first.dose")
    own, other = T.normalize_dose_value(own_dose), T.normalize_dose_value(chart_dose)
    same = _text("same ingredient '", F.col("named.name"), "'")
    start = (
        F.when(exact, _verdict("DUPLICATE", _text("exact RxNorm match ", F.col("exact.code")), "exact_code"))
        .when(
            named & (own != "") & (other != "") & (own != other),
            _verdict("UPDATING", _text(same, ", dose ", chart_dose, "->", own_dose), "ingredient"),
        )
        .when(named, _verdict("DUPLICATE", same, "ingredient"))
        .otherwise(_verdict("NEW", _text(NO_MATCH)))
    )
    return F.when(stopped, stop).otherwise(start)


def allergy_verdict() -> Column:
    specific = ~F.exists(_codings(), lambda c: c["system"].isNotNull() & (F.coalesce(c["code"], F.lit("")) == V.NKDA_CODE))
    return (
        F.when(
            specific & F.col("nkda_resource_id").isNotNull(),
            _verdict(
                "CONFLICTING",
                _text("chart records NKDA but candidate asserts allergy to ", F.coalesce("item.substance", F.lit("unknown"))),
                "exact_code",
            ),
        )
        .when(
            F.col("exact").isNotNull(),
            _verdict("DUPLICATE", _text("exact allergy code match ", F.col("exact.code")), "exact_code"),
        )
        .otherwise(_verdict("NEW", _text(NO_MATCH)))
    )


def observation_verdict() -> Column:
    own = F.coalesce("item.value", F.lit(""))
    charted = F.col("exact.first.value")
    code = F.col("exact.code")
    own_status, chart_status = T.canonical_tobacco(own), T.canonical_tobacco(charted)
    tobacco = F.when(
        own_status == chart_status, _verdict("DUPLICATE", _text("same tobacco status: ", own_status), "exact_code")
    ).otherwise(
        _verdict("UPDATING", _text("tobacco status changed: ", chart_status, " -> ", own_status), "exact_code")
    )
    other = F.when(
        F.lower(T.strip(own)) == F.lower(T.strip(charted)),
        _verdict("DUPLICATE", _text("same LOINC ", code, ", same value"), "exact_code"),
    ).otherwise(
        _verdict("UPDATING", _text("same LOINC ", code, ", value changed: '", charted, "' -> '", own, "'"), "exact_code")
    )
    return (
        F.when(F.col("exact").isNull(), _verdict("NEW", _text("no LOINC match in chart")))
        .when(code == V.TOBACCO_LOINC, tobacco)
        .otherwise(other)
    )


def procedure_verdict() -> Column:
    return (
        F.when(
            F.col("dated").isNotNull(),
            _verdict("DUPLICATE", _text("same procedure code + date ", F.col("item.performed")), "exact_code"),
        )
        .when(F.col("exact").isNotNull(), _verdict("NEW", _text("same procedure code but different date")))
        .otherwise(_verdict("NEW", _text(NO_MATCH)))
    )


def family_verdict() -> Column:
    return F.when(
        F.col("exact").isNotNull(),
        _verdict("DUPLICATE", _text("same relationship code ", F.col("exact.code")), "exact_code"),
    ).otherwise(_verdict("NEW", _text(NO_MATCH)))


# Registry: resource type -> verdict expression. New types plug in here.
VERDICTS: dict[str, Callable[[], Column]] = {
    "Condition": condition_verdict,
    "MedicationRequest": medication_verdict,
    "AllergyIntolerance": allergy_verdict,
    "Observation": observation_verdict,
    "Procedure": procedure_verdict,
    "FamilyMemberHistory": family_verdict,
}


#: Joins and aggregates on a patient and something else use a partitioning by patient, which an adaptive plan would not tell of.
LOCAL = {"spark__sql__requireAllClusterKeysForCoPartition": "false", "spark__sql__adaptive__enabled": "false"}
#: Filters of deep plans need no restating over every alias.  Packed tables look small to Spark: no side of a join is gathered on that account.
PLAIN = {"spark__sql__constraintPropagation__enabled": "false", "spark__sql__autoBroadcastJoinThreshold": "-1"}
#: Fields of an item that the rules read.
MATCHED_FIELDS = ("coding", "name", "negated", "status", "dose", "substance", "value", "performed")
#: Columns of the chart that the rules read.
CHART_FIELDS = ("patient_id", "entry_pos", "resource_type", "resource_id", "codings", "text", "status", "clinical_status", "value", "dose", "performed")
#: Chart rows and candidates of one patient that a task is trusted with.
LARGEST_PATIENT = 500_000


def match_candidates(candidates: DataFrame, facts: DataFrame, largest_patient: int = LARGEST_PATIENT) -> DataFrame:
    """Deterministic verdicts, AMBIGUOUS included. Adds::

        classification, reasoning, match_type, match_key, match_resource_id,
        match_display, n_matches

    Chart and candidates are dealt out by patient once; every look-up then stays where the patient is.  Patients of more than
    ``largest_patient`` rows are matched by the same steps, each dealt out by its own keys.  The verdicts are stored, and what led to
    them is deleted; a ``cand_id`` is unique.
    """
    spark = candidates.sparkSession
    # What the rules read; the wide records move once, to their verdicts.
    slim = candidates.select("patient_id", "cand_id", "resource_type", F.struct(*(F.col(f"item.{name}").alias(name) for name in MATCHED_FIELDS)).alias("item"))
    with settings(spark, **PLAIN), Held(spark) as held:
        charted, own = dealt_by_patient(facts.select(*CHART_FIELDS), held), dealt_by_patient(slim, held)
        sizes = own.select("patient_id").unionAll(charted.select("patient_id")).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
        large = fixed(sizes.where(F.col("n") > largest_patient).select("patient_id"))
        some = not large.isEmpty()
        rest = lambda df: dealt_by_patient(df.join(large, "patient_id", "left_anti"), held) if some else df
        with settings(spark, **LOCAL):
            found = fixed(_matched(rest(own), rest(charted), lambda df: held.kept(df, "patient_id")))
        if some:
            hot = lambda df: fixed(df.join(large, "patient_id", "left_semi"))
            found = found.unionByName(fixed(_matched(hot(own), hot(charted), fixed)))
    # The verdicts are as many as the candidates, whatever their packed size says.
    found = found.drop("patient_id").hint("merge")
    return candidates.join(found, "cand_id", "left").select(*candidates.columns, *(c for c in found.columns if c != "cand_id"))


def dealt_by_patient(df: DataFrame, held: Held | None = None) -> DataFrame:
    """The rows, stored as they lie after a shuffle by patient; plans on the result know that.  Without ``held`` they are a checkpoint."""
    if held is not None:
        return held.dealt(df, "patient_id")
    spark = df.sparkSession
    with settings(spark, spark__sql__adaptive__enabled="false"):
        return cut_lineage(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "patient_id"))


def _matched(candidates: DataFrame, facts: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """``keep`` stores what is read again, as it lies."""
    key = ["patient_id", "cand_id"]
    joined = keep(candidates.join(exact_hits(candidates, facts), key, "left"))
    dates = procedure_dates(joined, facts)
    residue = joined.where(
        F.col("exact").isNull() & F.col("resource_type").isin("Condition", "MedicationRequest")
    ).select("cand_id", "patient_id", "resource_type", "item")
    return _apply_verdicts(
        joined.join(dates, key, "left")
        .join(name_hits(residue, facts, keep), key, "left")
        .join(chart.no_known_allergy(facts), "patient_id", "left"),
        key,
    )


def _apply_verdicts(evidence: DataFrame, keep: list[str]) -> DataFrame:
    unknown = _verdict("NEW", _text("unknown resource type ", F.col("resource_type")))
    verdict = F.when(F.lit(False), unknown)
    for resource_type, rule in VERDICTS.items():
        verdict = verdict.when(F.col("resource_type") == resource_type, rule())
    judged = evidence.withColumn("verdict", verdict.otherwise(unknown))

    kind = F.col("verdict.match_type")
    by_code, by_name = kind == "exact_code", kind.isin("display_text", "ingredient")
    nkda = (F.col("resource_type") == "AllergyIntolerance") & (F.col("verdict.classification") == "CONFLICTING")
    takes_all = is_negated(F.col("resource_type"), F.col("item.negated")) | is_discontinued(
        F.col("resource_type"), F.col("item.status")
    )
    display = (
        F.when(kind.isNull(), F.lit(None).cast("string"))
        .when(nkda, "No known drug allergy")
        .when(F.col("resource_type") == "FamilyMemberHistory", "")
        .when(F.col("resource_type") == "Observation", F.col("exact.first.value"))
        .when(F.col("resource_type") == "Procedure", F.col("dated.display"))
        .when(by_code, F.coalesce(F.col("exact_shown.first_shown.display"), F.lit("")))
        .when(kind == "display_text", F.col("named.key"))
        .otherwise(F.coalesce(F.col("named.first_shown.display"), F.lit("")))
    )
    return judged.select(
        *keep,
        "verdict.classification",
        "verdict.reasoning",
        "verdict.match_type",
        F.when(nkda, F.lit("nkda"))
        .when(by_code, F.concat_ws("|", "exact.system", "exact.code"))
        .when(by_name, F.col("named.key"))
        .alias("match_key"),
        F.when(nkda, F.col("nkda_resource_id"))
        .when(F.col("dated").isNotNull() & by_code, F.col("dated.resource_id"))
        .when(by_code, F.col("exact.first.resource_id"))
        .when(by_name, F.col("named.first.resource_id"))
        .alias("match_resource_id"),
        display.alias("match_display"),
        F.when(nkda, F.col("nkda_matches"))
        .when(by_code & F.col("resource_type").isin("Observation", "Procedure"), F.lit(1))
        .when(by_code & takes_all, F.col("exact_all"))
        .when(by_code, F.col("exact.n_matches"))
        .when(by_name, F.col("named.n_matches"))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("n_matches"),
    )


def apply_verdicts(matched: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Settle AMBIGUOUS rows: take the verdict row of the candidate, else NEW with the reason.

    ``verdicts``: ``cand_id, verdict_classification, verdict_reasoning``.
    """
    if verdicts is None:
        settled = matched.withColumn("verdict_classification", F.lit(None).cast("string")).withColumn(
            "verdict_reasoning", F.lit(None).cast("string")
        )
    else:
        settled = matched.join(verdicts, "cand_id", "left")
    ambiguous = F.col("classification") == "AMBIGUOUS"
    answered = F.col("verdict_classification").isin(*V.CLASSIFICATIONS)
    return (
        settled.withColumn(
            "reasoning",
            F.when(ambiguous & answered, _text(F.col("reasoning"), "; LLM: ", F.col("verdict_reasoning")))
            .when(ambiguous, _text(F.col("reasoning"), "; LLM failed, defaulting to NEW"))
            .otherwise(F.col("reasoning")),
        )
        .withColumn(
            "classification",
            F.when(ambiguous & answered, F.col("verdict_classification"))
            .when(ambiguous, F.lit("NEW"))
            .otherwise(F.col("classification")),
        )
        .drop("verdict_classification", "verdict_reasoning")
    )


def reconcile(candidates: DataFrame, facts: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    return apply_verdicts(match_candidates(candidates, facts), verdicts)


def best_match_type(matches: DataFrame, *keys: str) -> DataFrame:
    """Strongest kind of match per key: exact_code over ingredient over display_text."""
    strength = F.when(F.col("match_type") == "exact_code", 3).when(F.col("match_type") == "ingredient", 2).when(
        F.col("match_type") == "display_text", 1
    ).otherwise(0)
    return matches.groupBy(*keys).agg(F.max_by("match_type", strength).alias("best_match_type"))
