"""Check queries of the ledger, the evaluation metrics and the quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark import vocab as V
from chartspark.functions.clinical import text_coding
from chartspark.harness import sqltext as S
from chartspark.harness.registry import query, with_json
from chartspark.harness.tables import CANDIDATES, CHART, candidate_items, chart_facts
from chartspark.operators import evaluate, ledger, quality, spans
from chartspark.sources import usage

# -- ledger: events as model calls --------------------------------------------------------------

CALLS = """
SELECT event_id, concat('run-', user_id, '-', substr(CAST(ts AS STRING), 1, 10)) AS run_id, CAST(user_id AS STRING) AS user_key,
       event_type AS stage, ts AS finished_at, concat('doc-', event_id % 37) AS document_id,
       CASE user_id % 3 WHEN 0 THEN 'gemini-3.5-flash' WHEN 1 THEN 'gemini-3.1-flash-lite-2026-01-20' ELSE 'other-model' END AS model,
       CAST(substr(props, 7, length(props) - 7) AS BIGINT) * 1003 AS input_tokens,
       CAST(substr(props, 7, length(props) - 7) AS BIGINT) % 40 * 2001 AS cached_tokens,
       CAST(floor(value * 10) AS BIGINT) AS output_tokens, CAST(user_id % 5 AS BIGINT) AS reasoning_tokens,
       CAST(floor(value) AS BIGINT) AS latency_ms, event_id % 4 = 0 AS regional
FROM {events}
"""
_RATES = " ".join(f"WHEN '{m}' THEN {{}}" for m, *_ in V.MODEL_RATES)


def _rate(i: int) -> str:
    whens = " ".join(f"WHEN '{r[0]}' THEN {r[i]}::DECIMAL(10,3)" for r in V.MODEL_RATES)
    return f"CASE string_split(model, '-20')[1] {whens} ELSE 0::DECIMAL(10,3) END"


# Micro-dollars with 11 decimals, rounded half-even to 6 places in integer arithmetic.
_MICRO = (
    f"(greatest(input_tokens - cached_tokens, 0)::HUGEINT * ({_rate(1)} * 1000)::HUGEINT + cached_tokens::HUGEINT * ({_rate(2)} * 1000)::HUGEINT "
    f"+ output_tokens::HUGEINT * ({_rate(3)} * 1000)::HUGEINT) * CASE WHEN regional THEN 110 ELSE 100 END"
)
PRICED = f"""priced AS (SELECT *, ((micro // 100000) + CASE WHEN micro % 100000 > 50000 OR (micro % 100000 = 50000 AND (micro // 100000) % 2 = 1) THEN 1 ELSE 0 END)::BIGINT AS cost
    FROM (SELECT *, {_MICRO} AS micro FROM ({CALLS})))"""


def _calls(t):
    return t.sql(CALLS)


def _priced(t):
    return ledger.price_calls(_calls(t), ledger.default_rates(t.spark), regional="regional")


def _micro(column):
    return (F.col(column) * 1000000).cast("bigint")


@query("price_calls", "C28 H35", f"WITH {PRICED} SELECT event_id, cost AS micro_usd FROM priced")
def _(t):
    return _priced(t).select("event_id", _micro("usd_cost").alias("micro_usd"))


@query(
    "run_totals", "D9",
    f"""WITH {PRICED} SELECT run_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(reasoning_tokens)::BIGINT AS reasoning_tokens,
        sum(cost)::BIGINT AS micro_usd, (epoch_us(max(finished_at)) - epoch_us(min(finished_at))) // 1000 AS duration_ms, count(DISTINCT document_id) AS doc_count FROM priced GROUP BY run_id""",
)
def _(t):
    totals = ledger.run_totals(_priced(t).withColumn("started_at", F.col("finished_at")))
    return totals.withColumn("micro_usd", _micro("cost_usd")).drop("cost_usd")


def _ledger_rows(t):
    return _priced(t).select(F.col("run_id"), F.col("event_id").alias("id"), "user_key", F.col("finished_at").alias("created_at"), "input_tokens", "output_tokens", F.col("usd_cost").alias("cost_usd"))


@query(
    "usage_summary", "D10",
    f"""WITH {PRICED}, u AS (SELECT DISTINCT CAST(c_custkey AS STRING) AS user_key FROM {{customer}})
        SELECT u.user_key, count(event_id) AS runs, coalesce(sum(cost), 0)::BIGINT AS micro_usd, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens
        FROM u LEFT JOIN priced USING (user_key) GROUP BY u.user_key""",
)
def _(t):
    users = t.customer.select(F.col("c_custkey").cast("string").alias("user_key"))
    return ledger.usage_summary(_ledger_rows(t), users).withColumn("micro_usd", _micro("total_cost_usd")).drop("total_cost_usd")


@query(
    "recent_runs", "F2",
    f"""SELECT user_key, event_id AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY finished_at DESC, event_id) AS rank FROM ({CALLS})) WHERE rank <= 20""",
)
def _(t):
    return ledger.recent_runs(_ledger_rows(t), 20).select("user_key", "id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "stage_usage", "D11",
    f"""WITH {PRICED} SELECT stage, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cached_tokens)::BIGINT AS cached_tokens,
        sum(reasoning_tokens)::BIGINT AS reasoning_tokens, sum(latency_ms)::BIGINT AS wall_ms, sum(cost)::BIGINT AS micro_usd FROM priced GROUP BY ROLLUP (stage)""",
)
def _(t):
    return ledger.stage_usage(_priced(t)).withColumn("micro_usd", _micro("usd")).drop("usd")


@query("stage_models", "D11", f"SELECT stage, model, count(*) AS calls FROM ({CALLS}) GROUP BY ALL")
def _(t):
    return ledger.stage_models(_calls(t))


@query(
    "unit_economics", "D33",
    f"""WITH {PRICED}, runs AS (SELECT run_id, sum(latency_ms) AS wall, sum(cost) / 1e6 AS usd FROM priced GROUP BY run_id), a AS (SELECT avg(wall) AS wall, avg(usd) AS usd FROM runs)
        SELECT round(usd / 18, 8) AS cost_per_note, round(usd / 77, 8) AS cost_per_fact, round(usd / 18 * 3, 8) AS cost_per_chart_3, round(usd / 18 * 8, 8) AS cost_per_chart_8, round(wall / 1000 / 18, 8) AS wall_s_per_note FROM a""",
)
def _(t):
    rows = ledger.unit_economics(ledger.run_averages(_priced(t)), 18, 77)
    return rows.select(*[F.round(c, 8).alias(c) for c in rows.columns])


@query(
    "usage_rows", "A17",
    f"""WITH {PRICED} SELECT run_id AS id, sum(input_tokens)::BIGINT AS input_tokens, sum(cost)::BIGINT AS micro_usd, count(DISTINCT document_id) AS doc_count FROM priced GROUP BY run_id
        UNION ALL SELECT 'run-' || c_custkey, 0, 0, 0 FROM {{customer}}""",
)
def _(t):
    priced = _priced(t).withColumn("started_at", F.col("finished_at"))
    idle = t.customer.select(F.concat(F.lit("run-"), "c_custkey").alias("run_id"))
    runs = priced.select("run_id").distinct().unionByName(idle).select(
        "run_id", F.lit("u").alias("user_key"), F.current_timestamp().alias("created_at"), F.lit("completed").alias("status")
    )
    return ledger.usage_rows(ledger.run_totals(priced), runs).select("id", "input_tokens", _micro("cost_usd").alias("micro_usd"), "doc_count")


@query(
    "clinician_activity", "D29",
    """SELECT CAST(user_id AS STRING) AS user_key, count(*) AS seen_count, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
        arg_max(event_type, (ts, event_id)) FILTER (event_id % 3 <> 0) AS role FROM {events} GROUP BY user_id""",
)
def _(t):
    sessions = t.events.select(
        F.col("user_id").cast("string").alias("user_key"), "ts", "event_id", F.lit("").alias("display_name"), F.lit(None).cast("string").alias("workspace_id"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).otherwise("").alias("role"),
    )
    return ledger.clinician_activity(sessions).select(
        "user_key", "seen_count", F.unix_micros(F.col("first_seen_at").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_seen_at").cast("timestamp")).alias("last_us"), "role"
    )


@query(
    "read_llm_events", "A13",
    """SELECT event_id, 'llm_call' AS event, event_type AS stage, CAST(substr(props, 7, length(props) - 7) AS BIGINT) AS input_tokens FROM {events} WHERE event_id % 5 <> 0""",
)
def _(t):
    lines = t.events.select(
        F.concat(
            F.lit('{"event": "'), F.when(F.col("event_id") % 5 == 0, "run_started").otherwise("llm_call"), F.lit('", "call_id": "'), F.col("event_id"),
            F.lit('", "stage": "'), "event_type", F.lit('", "input_tokens": '), F.expr("substr(props, 7, length(props) - 7)"), F.lit("}"),
        ).alias("value")
    )
    return usage.parse_llm_events(lines).where("event = 'llm_call'").select(F.col("call_id").cast("bigint").alias("event_id"), "event", "stage", "input_tokens")


# -- evaluation rows: five runs over the orders -----------------------------------------------------

RUNS = 5
ROWS = """
SELECT r_regionkey AS run_id, concat('note-', o_custkey) AS note, CASE o_custkey % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'messy' WHEN 2 THEN 'trap' ELSE '' END AS tier,
       concat('f', o_orderkey) AS fact_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'DUPLICATE' WHEN 2 THEN 'UPDATING' ELSE 'CONFLICTING' END AS expected,
       CASE WHEN ((o_orderkey * 3 + r_regionkey * 7) % 11 < 6 OR o_orderkey % 9 = 0) AND o_orderkey % 8 <> 5 THEN
              CASE o_orderkey % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'DUPLICATE' WHEN 2 THEN 'UPDATING' ELSE 'CONFLICTING' END
            WHEN (o_orderkey + r_regionkey) % 3 = 0 THEN 'MISSING' ELSE CASE o_orderkey % 4 WHEN 1 THEN 'NEW' ELSE 'DUPLICATE' END END AS actual,
       o_orderkey % 2 AS two_systems, (o_orderkey + r_regionkey) % 4 <> 0 AS coded, (o_orderkey + r_regionkey) % 5 AS provenance_count
FROM {orders} CROSS JOIN {region}
"""
RATES = f"rates AS (SELECT *, (expected = actual)::INT AS hit FROM ({ROWS}))"


def _rows(t):
    raw = t.sql(ROWS)
    return raw.withColumn(
        "expected_systems", F.when(F.col("two_systems") == 1, F.array(F.lit("ICD-10"), F.lit("SNOMED"))).otherwise(F.array(F.lit("SNOMED")))
    ).withColumn("code_matched", F.when(F.col("actual") != "MISSING", F.col("coded")))


def _rounded(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if c in names else F.col(c) for c in df.columns])


@query(
    "confusion_matrix", "D12",
    f"SELECT expected, " + ", ".join(f'count(*) FILTER (actual = \'{a}\') AS "{a}"' for a in (*V.CLASSIFICATIONS, "MISSING")) + f" FROM ({ROWS}) GROUP BY expected",
)
def _(t):
    return evaluate.confusion_matrix(_rows(t))


_MMM = "round(avg(rate), 9) AS mean, round(min(rate), 9) AS min, round(max(rate), 9) AS max"


@query(
    "class_accuracy", "D13",
    f"WITH {RATES}, r AS (SELECT expected, run_id, avg(hit) AS rate, count(*) AS n FROM rates GROUP BY ALL) SELECT expected, {_MMM}, sum(n)::BIGINT // {RUNS} AS n FROM r GROUP BY expected",
)
def _(t):
    return _rounded(evaluate.class_accuracy(_rows(t), RUNS), "mean", "min", "max")


@query("tier_accuracy", "D14", f"WITH {RATES}, r AS (SELECT tier, run_id, avg(hit) AS rate FROM rates WHERE tier <> '' GROUP BY ALL) SELECT tier, {_MMM} FROM r GROUP BY tier")
def _(t):
    return _rounded(evaluate.tier_accuracy(_rows(t)), "mean", "min", "max")


@query("overall_accuracy", "D15", f"WITH {RATES}, r AS (SELECT run_id, avg(hit) AS rate FROM rates GROUP BY ALL) SELECT {_MMM} FROM r")
def _(t):
    return _rounded(evaluate.overall_accuracy(_rows(t)), "mean", "min", "max")


STABLE = f"""{RATES}, counts AS (SELECT note, fact_id, expected, actual, count(*) AS n, min(run_id) AS first_run FROM rates GROUP BY ALL),
    stable AS (SELECT note, fact_id, expected, sum(CASE WHEN actual = expected THEN n ELSE 0 END)::BIGINT AS hits, arg_max(actual, (n, -first_run)) AS most_common_actual,
      round(max(n) / {RUNS}, 2) AS agreement, string_agg(actual || '=' || n, ',' ORDER BY actual) AS distribution FROM counts GROUP BY ALL),
    judged AS (SELECT *, CASE hits WHEN {RUNS} THEN 'stable_right' WHEN 0 THEN 'stable_wrong' ELSE 'flaky' END AS stability FROM stable)"""
def _flat():
    return F.array_join(F.transform(F.map_entries("distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@query("fact_stability", "D16", f"WITH {STABLE} SELECT * FROM judged")
def _(t):
    return evaluate.fact_stability(_rows(t), RUNS).withColumn("distribution", _flat())


@query(
    "consistency", "D16",
    f"""WITH {STABLE} SELECT round(avg((hits >= 4)::INT), 9) AS consistency, count(*) FILTER (stability = 'stable_right') AS stable_right,
        count(*) FILTER (stability = 'flaky') AS flaky, count(*) FILTER (stability = 'stable_wrong') AS stable_wrong FROM judged""",
)
def _(t):
    return _rounded(evaluate.consistency(evaluate.fact_stability(_rows(t), RUNS), RUNS), "consistency")


@query("hit_histogram", "D16", f"WITH {STABLE} SELECT hits, count(*) AS n_facts FROM judged GROUP BY hits")
def _(t):
    return evaluate.hit_histogram(evaluate.fact_stability(_rows(t), RUNS))


@query("stability_report_order", "F4", f"WITH {STABLE} SELECT note, fact_id, stability FROM judged ORDER BY stability <> 'stable_wrong', stability <> 'flaky', fact_id, note")
def _(t):
    return evaluate.stability_order(evaluate.fact_stability(_rows(t), RUNS)).select("note", "fact_id", "stability")


@query("stable_wrong_cases", "D17", f"WITH {STABLE} SELECT note, fact_id, expected, most_common_actual AS always_actual, distribution FROM judged WHERE stability = 'stable_wrong'")
def _(t):
    return evaluate.stable_wrong_cases(evaluate.fact_stability(_rows(t), RUNS)).withColumn("distribution", _flat())


@query(
    "code_accuracy", "D18",
    f"""WITH {RATES}, j AS (SELECT * FROM rates WHERE actual <> 'MISSING') SELECT NULL AS system, round(avg(coded::INT), 9) AS accuracy, count(*) AS n FROM j
        UNION ALL SELECT 'SNOMED', round(avg(coded::INT), 9), count(*) FROM j UNION ALL SELECT 'ICD-10', round(avg(coded::INT), 9), count(*) FROM j WHERE two_systems = 1""",
)
def _(t):
    return _rounded(evaluate.code_accuracy(_rows(t)), "accuracy")


@query(
    "error_decomposition", "D19",
    f"""SELECT CASE WHEN actual = 'MISSING' THEN 'extraction_miss' WHEN NOT coded THEN 'coding_miss' ELSE 'reconciler_miss' END AS kind, count(*) AS n FROM ({ROWS}) WHERE expected <> actual GROUP BY ALL""",
)
def _(t):
    return evaluate.error_decomposition(_rows(t))


@query("provenance_coverage", "D21", f"SELECT round(avg((provenance_count > 0)::INT), 9) AS coverage FROM ({ROWS}) WHERE expected <> 'DUPLICATE' AND actual <> 'MISSING'")
def _(t):
    return _rounded(evaluate.provenance_coverage(_rows(t)), "coverage")


@query("spurious_facts", "D25", f"SELECT DISTINCT note, fact_id FROM ({ROWS}) WHERE actual <> 'MISSING' AND fact_id NOT IN (SELECT fact_id FROM ({ROWS}) WHERE expected = 'NEW')")
def _(t):
    rows = _rows(t)
    return evaluate.spurious_facts(rows.where("actual <> 'MISSING'"), rows.where("expected = 'NEW'").select("note", "fact_id").distinct())


# -- retrieval metrics: each part asks for its name, the hits are the parts next to it -------------------

EXPECTED = "SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN 'icd10' ELSE 'snomed' END AS system, concat('c', p_partkey % 100, '.', p_partkey % 7) AS code, concat(p_name, ' (disorder)') AS display FROM {part}"
HITS = "SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN 'icd10' ELSE 'snomed' END AS system, concat('C', (p_partkey + p_size % 3 - r_regionkey) % 100, '.', (p_partkey + p_size % 3 - r_regionkey) % 7) AS code, CASE WHEN p_size % 4 = r_regionkey THEN upper(p_name) ELSE p_brand END AS display, r_regionkey + 1 AS rank FROM {part} CROSS JOIN {region}"
_NC = "CASE WHEN {0}.system = 'icd10' THEN replace(upper(trim({0}.code)), '.', '') ELSE upper(trim({0}.code)) END"
_ND = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}.display), '" + V.SEMANTIC_TAGS + r"', '', 'g'), '\b(?:nos|unspecified)\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_CODE_EQ = f"{_NC.format('e')} = {_NC.format('h')}"
_TEXT_EQ = f"{_ND.format('e')} = {_ND.format('h')}"


def _recall_sql(match: str) -> str:
    return f"""WITH e AS ({EXPECTED}), h AS ({HITS}) SELECT system, round(avg(hit), 9) AS recall, count(*) AS n FROM (
        SELECT e.system, (EXISTS (SELECT 1 FROM h WHERE h.query_id = e.query_id AND h.rank <= 3 AND ({match})))::INT AS hit FROM e) GROUP BY ROLLUP (system)"""


@query("recall_at_k", "D22", _recall_sql(_CODE_EQ))
def _(t):
    return _rounded(evaluate.recall_at_k(t.sql(EXPECTED), t.sql(HITS), 3), "recall")


@query("recall_at_k_display", "D22", _recall_sql(f"{_CODE_EQ} OR {_TEXT_EQ}"))
def _(t):
    return _rounded(evaluate.recall_at_k(t.sql(EXPECTED), t.sql(HITS), 3, by_display=True), "recall")


@query(
    "rank_buckets", "D23",
    f"""WITH e AS (SELECT query_id, system, upper(code) AS code FROM ({EXPECTED})), h AS ({HITS}), i AS (SELECT DISTINCT system, code FROM h WHERE rank = 5),
        r AS (SELECT e.*, (SELECT min(rank) FROM h WHERE h.query_id = e.query_id AND h.system = e.system AND h.code = e.code) AS rank,
              EXISTS (SELECT 1 FROM i WHERE i.system = e.system AND i.code = e.code) AS present FROM e)
        SELECT system, count(*) AS n, count(*) FILTER (present) AS in_index, count(*) FILTER (rank = 1) AS top1, count(*) FILTER (rank <= 3) AS topk, count(*) FILTER (rank IS NULL OR rank > 3) AS miss FROM r GROUP BY system""",
)
def _(t):
    hits = t.sql(HITS)
    return evaluate.rank_buckets(t.sql(EXPECTED).withColumn("code", F.upper("code")), hits, hits.where("rank = 5"), 3)


@query(
    "selection_accuracy", "D24",
    f"WITH e AS ({EXPECTED}), h AS (SELECT * FROM ({HITS}) WHERE rank = 1) SELECT e.system, round(avg(({_CODE_EQ} OR {_TEXT_EQ})::INT), 9) AS accuracy, count(*) AS n FROM e JOIN h USING (query_id) GROUP BY e.system",
)
def _(t):
    chosen = t.sql(HITS).where("rank = 1").select("query_id", "code", "display")
    return _rounded(evaluate.selection_accuracy(t.sql(EXPECTED), chosen), "accuracy")


# -- spans: lines of an order as spans of a note --------------------------------------------------------------

SPANS = "SELECT l_orderkey AS note, concat(l_linenumber, '-', l_partkey, '-', l_suppkey) AS span_id, CAST(l_partkey % 1500 AS BIGINT) AS start, CAST(l_partkey % 1500 + l_quantity * 7 AS BIGINT) AS \"end\", l_returnflag AS flag FROM {lineitem}"
SPARK_SPANS = SPANS.replace('"end"', "`end`")


def _spans(t):
    return t.sql(SPARK_SPANS)


@query(
    "span_overlap", "C30",
    f"""WITH s AS ({SPANS}) SELECT a.note, a.span_id AS a_id, b.span_id AS b_id FROM s a JOIN s b ON a.note = b.note AND a.flag = 'A' AND b.flag = 'R'
        AND NOT (a."end" <= b.start OR b."end" <= a.start)""",
)
def _(t):
    s = _spans(t)
    right = s.where("flag = 'R'").select("note", F.col("span_id").alias("b_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return spans.overlapping(s.where("flag = 'A'"), right, ["note"]).select("note", F.col("span_id").alias("a_id"), "b_id")


@query(
    "merge_ranges", "E3",
    f"""WITH s AS (SELECT DISTINCT note, start, "end" FROM ({SPANS})), r AS (SELECT *, max("end") OVER (PARTITION BY note ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
        i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY note ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)
        SELECT note, min(start) AS start, max("end") AS "end" FROM i GROUP BY note, island""",
)
def _(t):
    return spans.merge_ranges(_spans(t), ["note"])


@query(
    "trap_rejection", "D20",
    f"""WITH s AS ({SPANS}), traps AS (SELECT *, note % 5 AS run_id FROM s WHERE flag = 'R'),
        r AS (SELECT run_id, avg((NOT EXISTS (SELECT 1 FROM s c WHERE c.note = traps.note AND c.flag = 'A' AND c.start < traps."end" AND traps.start < c."end"))::INT) AS rate FROM traps GROUP BY run_id)
        SELECT {_MMM} FROM r""",
)
def _(t):
    s = _spans(t)
    traps = s.where("flag = 'R'").withColumn("run_id", F.col("note") % 5)
    hit = spans.touched(traps, s.where("flag = 'A'"), ["note"]).select("note", "span_id").withColumn("hit", F.lit(True))
    judged = traps.join(hit, ["note", "span_id"], "left").select("run_id", F.col("hit").isNull().alias("rejected"))
    return _rounded(evaluate.trap_rejection(judged), "mean", "min", "max")


MAPPED = f"""SELECT l_orderkey AS note, (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey AS pos, l_returnflag AS flag,
        CAST(l_partkey % 1500 AS BIGINT) AS start, CAST(l_partkey % 1500 + l_quantity * 7 AS BIGINT) AS stop, CAST(p_partkey % 9 AS STRING) AS code,
        concat(p_name, ' ', p_size, ' mg') AS display FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""
#: The three walks, candidate by candidate: a row for each step, whose state is the facts taken so far.
WALK = """WITH RECURSIVE r AS ({rows}), c AS (SELECT DISTINCT note, pos FROM r WHERE flag = 'A'),
    hits AS (SELECT a.note, a.pos AS cand, min(b.pos) AS fact FROM r a JOIN r b ON a.note = b.note AND a.code = b.code AND a.flag = 'A' AND b.flag = 'R' GROUP BY ALL),
    p1 AS (SELECT note, fact, min(cand) AS cand FROM hits GROUP BY ALL),
    e2 AS (SELECT DISTINCT a.note, a.pos AS cand, b.pos AS fact FROM r a JOIN r b ON a.note = b.note AND a.flag = 'A' AND b.flag = 'R' AND {ingredient_a} = {ingredient_b} AND {ingredient_a} <> ''
        WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.note = a.note AND h.cand = a.pos) AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.note = b.note AND p1.fact = b.pos)),
    l2 AS (SELECT note, cand, list(fact ORDER BY fact) AS facts, row_number() OVER (PARTITION BY note ORDER BY cand) AS k FROM e2 GROUP BY note, cand),
    w2 AS (SELECT note, 0::BIGINT AS k, NULL::BIGINT AS cand, NULL::BIGINT AS fact, []::BIGINT[] AS taken FROM l2 WHERE k = 1
        UNION ALL SELECT note, k, cand, fact, CASE WHEN fact IS NULL THEN taken ELSE list_append(taken, fact) END
        FROM (SELECT l2.note, l2.k, l2.cand, w2.taken, list_filter(l2.facts, lambda f: NOT list_contains(w2.taken, f))[1] AS fact FROM w2 JOIN l2 ON l2.note = w2.note AND l2.k = w2.k + 1)),
    p2 AS (SELECT note, fact, cand FROM w2 WHERE fact IS NOT NULL),
    e3 AS (SELECT DISTINCT a.note, a.pos AS cand, b.pos AS fact FROM r a JOIN r b ON a.note = b.note AND a.flag = 'A' AND b.flag = 'R' AND a.stop > b.start AND b.stop > a.start
        WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.note = a.note AND h.cand = a.pos) AND NOT EXISTS (SELECT 1 FROM p2 WHERE p2.note = a.note AND p2.cand = a.pos)
          AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.note = b.note AND p1.fact = b.pos) AND NOT EXISTS (SELECT 1 FROM p2 WHERE p2.note = b.note AND p2.fact = b.pos)),
    l3 AS (SELECT note, cand, list(fact ORDER BY fact) AS facts, row_number() OVER (PARTITION BY note ORDER BY cand) AS k FROM e3 GROUP BY note, cand),
    w3 AS (SELECT note, 0::BIGINT AS k, NULL::BIGINT AS cand, NULL::BIGINT AS fact, []::BIGINT[] AS taken FROM l3 WHERE k = 1
        UNION ALL SELECT note, k, cand, fact, CASE WHEN fact IS NULL THEN taken ELSE list_append(taken, fact) END
        FROM (SELECT l3.note, l3.k, l3.cand, w3.taken, list_filter(l3.facts, lambda f: NOT list_contains(w3.taken, f))[1] AS fact FROM w3 JOIN l3 ON l3.note = w3.note AND l3.k = w3.k + 1))
    SELECT note, fact AS fact_pos, cand AS cand_pos, 1 AS pass_no FROM p1 UNION ALL SELECT note, fact, cand, 2 FROM p2 UNION ALL SELECT note, fact, cand, 3 FROM w3 WHERE fact IS NOT NULL"""


@query("map_facts", "C29 M3", WALK.format(rows=MAPPED, ingredient_a=S.normalize_ingredient("a.display"), ingredient_b=S.normalize_ingredient("b.display")))
def _(t):
    """Lines of an order: flag A are candidates, R are labelled facts."""
    rows = t.sql(MAPPED).withColumn("end", F.col("stop")).withColumn("system", F.lit("rx"))
    c = rows.where("flag = 'A'").withColumnRenamed("pos", "cand_pos").withColumn("resource_type", F.lit("MedicationRequest"))
    f = rows.where("flag = 'R'").withColumnRenamed("pos", "fact_pos").withColumn("category", F.lit("medication_request"))
    return evaluate.map_facts(c, f, c.select("note", "cand_pos", "start", "end"), f.select("note", "fact_pos", "start", "end"))


# -- quality -------------------------------------------------------------------------------------------------------


def _notes(t):
    return t.documents.select(F.col("doc_id").alias("document_id"), "text", F.col("n_chars").alias("char_count"))


@query(
    "verbatim_spans", "J6",
    "SELECT d.doc_id AS document_id, CAST(b.item_id AS STRING) AS detail FROM {documents} d JOIN {benchmark} b ON b.item_id = d.doc_id % 40 WHERE NOT contains(d.text, b.text)",
)
def _(t):
    labels = t.documents.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 40).alias("item_id")).join(
        t.benchmark.select("item_id", F.col("text").alias("span")), "item_id"
    )
    return quality.missing_spans(labels.withColumnRenamed("item_id", "label_id"), _notes(t)).select("document_id", "detail")


@query(
    "banned_tokens", "J7",
    r"""WITH h AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{3,}') AS hits, string_split_regex(text, '[0-9]{3,}') AS pieces FROM {documents}),
        n AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h)
        SELECT doc_id AS document_id, (list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda p: length(p))), 0))::BIGINT AS start, hits[i] AS token FROM n""",
)
def _(t):
    return quality.banned_tokens(_notes(t), "[0-9]{3,}").select("document_id", F.col("start").cast("bigint").alias("start"), "token")


_TIER = "CASE doc_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'messy' WHEN 2 THEN 'trap' ELSE 'odd' END"


@query(
    "length_budget", "J8",
    f"""SELECT doc_id AS document_id, CASE tier WHEN 'odd' THEN 'unknown_tier' ELSE 'length_budget' END AS rule, CAST(length(text) AS STRING) AS detail FROM (SELECT *, {_TIER} AS tier FROM {{documents}})
        WHERE tier = 'odd' OR (tier = 'messy' AND length(text) NOT BETWEEN 1000 AND 4000) OR (tier IN ('clean', 'trap') AND length(text) NOT BETWEEN 3000 AND 7000)""",
)
def _(t):
    return quality.length_issues(_notes(t).withColumn("doc_id", F.col("document_id")).withColumn("tier", F.expr(_TIER))).select("document_id", "rule", "detail")


@query(
    "label_enums", "J9",
    "SELECT doc_id, lang AS detail FROM {documents} WHERE lang NOT IN ('en', 'fr') OR lang IS NULL",
)
def _(t):
    return quality.enum_issues(t.documents, "doc_id", "lang", ("en", "fr")).select("doc_id", "detail")


@query(
    "missing_traps", "J9",
    "SELECT DISTINCT d.source AS note_id, b.lang AS trap_type FROM {documents} d JOIN (SELECT DISTINCT 'src' || (doc_id % 30) AS note_id, lang FROM {documents}) b ON b.note_id = d.source WHERE NOT EXISTS (SELECT 1 FROM {documents} x WHERE x.source = d.source AND x.lang = b.lang AND x.n_chars > 12000)",
)
def _(t):
    notes = t.documents
    labels = notes.select(F.col("source").alias("note_id"), F.lit("trap").alias("tier")).distinct()
    required = notes.select(F.concat(F.lit("src"), F.col("doc_id") % 30).alias("note_id"), F.col("lang").alias("trap_type")).distinct()
    traps = notes.where("n_chars > 12000").select(F.col("source").alias("note_id"), F.col("lang").alias("trap_type")).distinct()
    return quality.missing_traps(labels, traps, required).select("note_id", F.col("detail").alias("trap_type"))


@query(
    "specialty_and_size", "J9",
    """SELECT note_id, 'specialty_prefix' AS rule FROM (SELECT concat(CASE doc_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'E' WHEN 2 THEN 'N' ELSE 'X' END, doc_id) AS note_id, CASE WHEN doc_id % 3 = 0 THEN 'cardiology' ELSE 'neurology' END AS s FROM {documents})
        WHERE (note_id LIKE 'C%' AND s <> 'cardiology') OR note_id LIKE 'E%' OR (note_id LIKE 'N%' AND s <> 'neurology')
        UNION ALL SELECT CAST(doc_id AS STRING), 'char_count' FROM {documents} WHERE n_chars - doc_id % 2 <> length(text) AND n_chars - doc_id % 2 > 0""",
)
def _(t):
    prefix = F.expr("CASE doc_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'E' WHEN 2 THEN 'N' ELSE 'X' END")
    labels = t.documents.select(F.concat(prefix, F.col("doc_id")).alias("note_id"), F.when(F.col("doc_id") % 3 == 0, "cardiology").otherwise("neurology").alias("specialty"))
    sizes = _notes(t).withColumn("char_count", F.col("char_count") - F.col("document_id") % 2)
    return quality.specialty_issues(labels).select("note_id", "rule").unionByName(
        quality.char_count_issues(sizes).select(F.col("document_id").cast("string").alias("note_id"), "rule")
    )


REGISTRY = "SELECT 'rx' AS system, CAST(p_partkey % 1900 AS STRING) AS code, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_brand END AS source_url FROM {part}"
USED = "SELECT 'rx' AS system, CAST(CASE WHEN l_quantity > 40 AND l_discount > 0.05 THEN l_partkey ELSE l_partkey % 97 END AS STRING) AS code FROM {lineitem}"


@query("unregistered_codes", "C32", f"SELECT DISTINCT system, code FROM ({USED}) WHERE code NOT IN (SELECT code FROM ({REGISTRY}))")
def _(t):
    return quality.unregistered_codes(t.sql(USED), t.sql(REGISTRY).select("system", "code").distinct())


@query(
    "registry_health", "D28",
    f"""WITH r AS (SELECT code, count(*) AS n, count(*) FILTER (source_url = '') AS blank FROM ({REGISTRY}) GROUP BY code)
        SELECT code, 'unused_code' AS rule FROM r WHERE code NOT IN (SELECT code FROM ({USED})) UNION ALL SELECT code, 'duplicate_code' FROM r WHERE n > 1 UNION ALL SELECT code, 'empty_source' FROM r WHERE blank > 0""",
)
def _(t):
    return quality.registry_health(t.sql(REGISTRY), t.sql(USED)).select("code", "rule")


@query(
    "dangling_codes", "G6",
    f"""WITH r AS (SELECT DISTINCT code FROM ({REGISTRY})), u AS (SELECT DISTINCT code FROM ({USED})), f AS (SELECT DISTINCT CAST(CASE WHEN l_quantity < 3 THEN l_partkey ELSE l_partkey % 97 END AS STRING) AS code FROM {{lineitem}})
        SELECT code, 'registry_only' AS kind FROM (SELECT code FROM r EXCEPT SELECT code FROM u EXCEPT SELECT code FROM f) UNION ALL SELECT code, 'fixture_only' FROM (SELECT code FROM f EXCEPT SELECT code FROM u)""",
)
def _(t):
    code = F.when(F.col("l_quantity") < 3, F.col("l_partkey")).otherwise(F.col("l_partkey") % 97)
    fixtures = t.lineitem.select(F.lit("rx").alias("system"), code.cast("string").alias("code")).distinct()
    return quality.dangling_codes(t.sql(REGISTRY), t.sql(USED).distinct(), fixtures).select("code", "kind")


@query(
    "remap_codes", "C33",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_size % 5 = 0 THEN 'new-' || l_partkey ELSE CAST(l_partkey AS STRING) END AS code, p_size % 5 = 0 AS swapped FROM {lineitem} JOIN {part} ON p_partkey = l_partkey",
)
def _(t):
    codings = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.lit("rx").alias("system"), F.col("l_partkey").cast("string").alias("code"), F.lit("d").alias("display"))
    swaps = t.part.where("p_size % 5 = 0").select(F.lit("rx").alias("system"), F.col("p_partkey").cast("string").alias("code"), F.concat(F.lit("new-"), "p_partkey").alias("new_code"), F.col("p_name").alias("new_display"))
    return quality.remap_codes(codings, swaps).select("l_orderkey", "l_linenumber", "l_partkey", "code", "swapped")


@query("swap_report", "C33", "SELECT p_partkey AS code, count(c) AS n FROM {part} LEFT JOIN (SELECT CASE WHEN l_quantity = 50 THEN l_partkey ELSE l_partkey % 97 END AS c FROM {lineitem}) ON c = p_partkey WHERE p_size % 5 = 0 GROUP BY p_partkey")
def _(t):
    code = F.when(F.col("l_quantity") == 50, F.col("l_partkey")).otherwise(F.col("l_partkey") % 97)
    codings = t.lineitem.select(F.lit("rx").alias("system"), code.alias("code"))
    swaps = t.part.where("p_size % 5 = 0").select(F.lit("rx").alias("system"), F.col("p_partkey").alias("code"))
    return quality.swap_report(codings, swaps).select("code", "n")


@query(
    "label_integrity", "C34",
    """WITH a AS (SELECT o_custkey AS note, o_orderkey AS fact_id, CASE o_orderkey % 6 WHEN 0 THEN 'NEW' WHEN 1 THEN 'DUPLICATE' WHEN 2 THEN 'UPDATING' WHEN 3 THEN 'ODD' WHEN 4 THEN NULL ELSE 'CONFLICTING' END AS action,
          o_orderkey % 8 = 4 AS accepted, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 500 END AS target FROM {orders} WHERE o_orderkey % 10 <> 0),
        f AS (SELECT o_custkey AS note, o_orderkey AS fact_id FROM {orders} WHERE o_orderkey % 11 <> 0), x AS (SELECT DISTINCT p_partkey AS target FROM {part} WHERE p_partkey < 400)
        SELECT fact_id, 'one_action' AS rule FROM a WHERE (action IS NOT NULL) = accepted UNION ALL SELECT fact_id, 'action_enum' FROM a WHERE action = 'ODD'
        UNION ALL SELECT fact_id, 'new_has_target' FROM a WHERE action = 'NEW' AND target IS NOT NULL UNION ALL SELECT fact_id, 'target_missing' FROM a WHERE action <> 'NEW' AND target IS NULL
        UNION ALL SELECT fact_id, 'updating_without_changes' FROM a WHERE action = 'UPDATING' AND fact_id % 4 = 0
        UNION ALL SELECT fact_id, 'unknown_fact' FROM a WHERE fact_id % 11 = 0 UNION ALL SELECT fact_id, 'fact_without_action' FROM f WHERE fact_id % 10 = 0
        UNION ALL SELECT fact_id, 'target_not_in_fixture' FROM a WHERE target IS NOT NULL AND target NOT IN (SELECT target FROM x)""",
)
def _(t):
    k = F.col("o_orderkey")
    actions = t.orders.where("o_orderkey % 10 <> 0").select(
        F.col("o_custkey").alias("note"), k.alias("fact_id"),
        F.when(k % 6 == 0, "NEW").when(k % 6 == 1, "DUPLICATE").when(k % 6 == 2, "UPDATING").when(k % 6 == 3, "ODD").when(k % 6 == 5, "CONFLICTING").alias("action"),
        F.when(k % 8 == 4, F.array(F.lit("NEW"))).alias("accepted_actions"), F.when(k % 7 != 0, k % 500).alias("target_resource_id"),
        F.lit("exact_code").alias("match_basis"), (k % 4).alias("n_changes"), F.lit(True).alias("expected_provenance"), F.lit("one").alias("fixture"),
    )
    facts = t.orders.where("o_orderkey % 11 <> 0").select(F.col("o_custkey").alias("note"), k.alias("fact_id"))
    fixtures = t.part.where("p_partkey < 400").select(F.lit("one").alias("fixture"), F.col("p_partkey").alias("resource_id"))
    return quality.label_issues(actions, facts, fixtures).select("fact_id", "rule")


@query(
    "corpus_manifest", "D26",
    """SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM {documents} GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM {documents} GROUP BY source UNION ALL SELECT 'total', NULL, count(*) FROM {documents}""",
)
def _(t):
    return quality.corpus_manifest(t.documents, ["lang", "source"])


@query(
    "corpus_diversity", "D27",
    """WITH p AS (SELECT o_clerk, o_custkey % 5 AS org, o_orderstatus AS sex, o_orderkey % 60 AS age, o_orderpriority AS race FROM (SELECT *, o_custkey % 40 AS o_clerk FROM {orders})),
        m AS (SELECT count(DISTINCT o_clerk) AS providers, count(DISTINCT org) AS organizations, count(DISTINCT sex) AS sexes, max(age) - min(age) AS age_range, count(DISTINCT race) AS races, count(*) - count(DISTINCT o_clerk) AS repeated_names FROM p),
        r AS (SELECT unnest(['providers', 'organizations', 'sexes', 'age_range', 'races', 'repeated_names']) AS rule, unnest([providers, organizations, sexes, age_range, races, repeated_names]) AS value, unnest([12, 3, 2, 40, 4, 0]) AS need FROM m)
        SELECT rule, value::BIGINT AS value, need::BIGINT AS need, CASE WHEN rule = 'repeated_names' THEN value = 0 ELSE value >= need END AS ok FROM r""",
)
def _(t):
    people = t.orders.select(
        F.col("o_orderkey").alias("note"), (F.col("o_custkey") % 40).cast("string").alias("patient_name"), (F.col("o_custkey") % 40).alias("provider"),
        (F.col("o_custkey") % 5).alias("organization"), F.col("o_orderstatus").alias("sex"), (F.col("o_orderkey") % 60).alias("age"), F.col("o_orderpriority").alias("race"),
    )
    return quality.corpus_diversity(people)


@query(
    "fixture_summary", "D31",
    f"SELECT patient_id, resource_id, system || '|' || code AS codes, CASE resource_type WHEN 'Condition' THEN coalesce(clinical_status, 'active') ELSE coalesce(status, 'active') END = 'active' AS active FROM ({CHART})",
)
def _(t):
    return quality.fixture_summary(chart_facts(t)).select("patient_id", "resource_id", "codes", "active")


ENTRIES = """SELECT c.c_nationkey AS bundle_id, CASE WHEN c.c_nationkey % 5 = 0 THEN 'batch' ELSE 'transaction' END AS bundle_type, o.o_orderkey AS entry_pos,
    CASE WHEN o.o_orderkey % 13 = 0 THEN '' ELSE concat('urn:uuid:', o.o_orderkey % 9000) END AS full_url, CASE WHEN o.o_orderkey % 17 = 0 THEN 'PUT' ELSE 'POST' END AS method, o.o_orderstatus AS url,
    concat('{"resourceType": "Condition", "subject": {"reference": "urn:uuid:', o.o_custkey, '"}, "code": {"coding": [{"system": "http://loinc.org", "code": "1"}]}}') AS resource
    FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey"""


def _entries(t):
    k = F.col("o_orderkey")
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").alias("bundle_id"), F.when(F.col("c_nationkey") % 5 == 0, "batch").otherwise("transaction").alias("bundle_type"), k.alias("entry_pos"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("urn:uuid:"), k % 9000)).alias("full_url"), F.when(k % 17 == 0, "PUT").otherwise("POST").alias("method"), F.col("o_orderstatus").alias("url"),
        F.lit("Condition").alias("resource_type"),
        F.concat(F.lit('{"resourceType": "Condition", "subject": {"reference": "urn:uuid:'), "o_custkey", F.lit('"}, "code": {"coding": [{"system": "http://loinc.org", "code": "1"}]}}')).alias("resource"),
    )


@query(
    "bundle_structure", "J10",
    f"""WITH e AS ({ENTRIES}) SELECT bundle_id, full_url, 'not_transaction' AS rule FROM e WHERE bundle_type <> 'transaction' UNION ALL SELECT bundle_id, full_url, 'missing_full_url' FROM e WHERE full_url = ''
        UNION ALL SELECT bundle_id, full_url, 'bad_request' FROM e WHERE method <> 'POST' UNION ALL SELECT bundle_id, full_url, 'duplicate_full_url' FROM e WHERE full_url <> '' GROUP BY ALL HAVING count(*) > 1""",
)
def _(t):
    return quality.bundle_structure(_entries(t))


@query(
    "unresolved_references", "C31",
    f"""WITH e AS ({ENTRIES}) SELECT DISTINCT bundle_id, regexp_extract(resource, '"reference": "([^"]+)"', 1) AS reference FROM e x WHERE NOT EXISTS
        (SELECT 1 FROM e y WHERE y.bundle_id = x.bundle_id AND y.full_url = regexp_extract(x.resource, '"reference": "([^"]+)"', 1))""",
)
def _(t):
    return quality.unresolved_references(_entries(t))


#: Nested codings, a decoy of one in a text, and an identifier, which has a system and no code.
PROFILED = """SELECT c.c_nationkey AS bundle_id, o.o_orderkey AS entry_pos, concat('{"resourceType": "', CASE o.o_orderstatus WHEN 'F' THEN 'Condition' WHEN 'O' THEN 'Observation' ELSE 'Procedure' END,
    '", "subject": {"reference": "urn:uuid:', o.o_custkey % 60, '"}, "identifier": [{"system": "urn:only", "value": "1"}], "code": {"text": "a \\"system\\": \\"b\\" here", "coding": [',
    CASE o.o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{"system": "urn:one", "code": "1"}' ELSE concat('{"system": "urn:one", "code": "1"}, {"code": "2", "system": "urn:c', o.o_orderkey % 4, '"}') END,
    ']}, "note": [{"authorReference": {"reference": "Practitioner/', o.o_custkey % 7, '"}, "text": "x"}]}') AS resource
    FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey"""


@query(
    "bundle_profile", "D32",
    """WITH e AS (SELECT c.c_nationkey AS bundle_id, o.o_orderkey AS k, o.o_custkey AS cust, CASE o.o_orderstatus WHEN 'F' THEN 'Condition' WHEN 'O' THEN 'Observation' ELSE 'Procedure' END AS type
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey),
        types AS (SELECT bundle_id, string_agg(type || '=' || n, ',' ORDER BY type) AS types FROM (SELECT bundle_id, type, count(*) AS n FROM e GROUP BY ALL) GROUP BY bundle_id),
        systems AS (SELECT bundle_id, string_agg(s, ',' ORDER BY s) AS systems FROM (SELECT bundle_id, 'urn:one' AS s FROM e WHERE k % 3 > 0 UNION SELECT bundle_id, 'urn:c' || k % 4 FROM e WHERE k % 3 = 2) GROUP BY bundle_id)
        SELECT bundle_id, count(*) AS n_entries, count(DISTINCT cust % 60) + count(DISTINCT cust % 7) AS n_targets, sum(k % 3)::BIGINT AS n_codings, coalesce(any_value(systems), '') AS systems, any_value(types) AS types
        FROM e JOIN types USING (bundle_id) LEFT JOIN systems USING (bundle_id) GROUP BY bundle_id""",
)
def _(t):
    found = quality.bundle_profile(t.sql(with_json(PROFILED)))
    told = F.array_join(F.transform("types", lambda x: F.concat(x["type"], F.lit("="), x["n"])), ",")
    return found.withColumns({"systems": F.array_join("systems", ","), "types": told})


@query(
    "required_elements", "J11",
    """SELECT o_orderkey, element FROM (SELECT o_orderkey, unnest(['clinicalStatus', 'verificationStatus', CASE WHEN o_orderkey % 3 = 0 THEN 'code' END, CASE WHEN o_orderkey % 4 = 0 THEN 'subject' END]) AS element FROM {orders}) WHERE element IS NOT NULL""",
)
def _(t):
    k = F.col("o_orderkey")
    body = F.concat(
        F.lit('{"resourceType": "Condition", "code": '), F.when(k % 3 == 0, "[]").otherwise('{"text": "x"}'),
        F.when(k % 4 == 0, "").otherwise(', "subject": {"reference": "Patient/1"}'), F.lit("}"),
    )
    rows = t.orders.select(k.alias("resource_id"), F.lit("Condition").alias("resource_type"), body.alias("resource"))
    return quality.required_elements(rows).select(F.col("resource_id").alias("o_orderkey"), "element")


CONTENTS = """SELECT concat('c', o_orderkey) AS resource_id, 'Condition' AS resource_type, concat('{"resourceType": "Condition"', CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ', "category": [{"coding": [{"code": "other"}]}]'
      WHEN 2 THEN ', "category": [{"coding": [{"code": "x"}]}, {"coding": [{"code": "y"}, {"code": "health-concern"}]}]' ELSE ', "category": [{"coding": [{"code": "problem-list-item"}]}]' END, '}') AS resource FROM {orders}
    UNION ALL SELECT concat('p', c_custkey), 'Patient', concat('{"resourceType": "Patient", "extension": [{"url": "http://x/us-core-race"}', CASE WHEN c_custkey % 2 = 0 THEN ', {"url": "http://hl7.org/fhir/us/core/StructureDefinition/us-core-race"}' ELSE '' END,
      CASE WHEN c_custkey % 3 = 0 THEN ', {"url": "http://hl7.org/fhir/us/core/StructureDefinition/us-core-ethnicity"}' ELSE '' END, ', {"url": "http://hl7.org/fhir/us/core/StructureDefinition/us-core-birthsex"}]}') FROM {customer}
    UNION ALL SELECT concat('d', s_suppkey), 'DocumentReference', concat('{"resourceType": "DocumentReference", "category": [{"coding": [{"code": "', CASE WHEN s_suppkey % 2 = 0 THEN 'clinical-note' ELSE 'note' END, '"}]}], "content": [{"attachment": {"contentType": "text/plain", "url": "u"}}, {"attachment": {',
      CASE s_suppkey % 3 WHEN 0 THEN '"contentType": "text/plain", "data": ""' WHEN 1 THEN '"data": "eA=="' ELSE '"contentType": "text/plain", "url": "u"' END, '}}]}') FROM {supplier}"""


@query(
    "required_content", "J11",
    """SELECT 'c' || o_orderkey AS resource_id, 'category.coding.code' AS element, 'error' AS severity FROM {orders} WHERE o_orderkey % 4 < 2
        UNION ALL SELECT 'p' || c_custkey, 'extension us-core-race', 'warning' FROM {customer} WHERE c_custkey % 2 <> 0 UNION ALL SELECT 'p' || c_custkey, 'extension us-core-ethnicity', 'warning' FROM {customer} WHERE c_custkey % 3 <> 0
        UNION ALL SELECT 'd' || s_suppkey, 'category.coding.code', 'error' FROM {supplier} WHERE s_suppkey % 2 <> 0 UNION ALL SELECT 'd' || s_suppkey, 'content.attachment.data|url', 'error' FROM {supplier} WHERE s_suppkey % 3 = 0
        UNION ALL SELECT 'd' || s_suppkey, 'content.attachment.contentType', 'error' FROM {supplier} WHERE s_suppkey % 3 = 1""",
)
def _(t):
    return quality.required_content(t.sql(with_json(CONTENTS))).drop("resource_type")


@query(
    "code_system_issues", "J12",
    """WITH c AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'http://snomed.info/sct/' WHEN 1 THEN 'http://LOINC.org' WHEN 2 THEN 'http://www.nlm.nih.gov/research/umls/rxnorm' ELSE 'urn:rxnorm' END AS system,
        CASE WHEN p_size % 7 = 0 THEN 'x' ELSE '' END || p_partkey AS code FROM {part})
        SELECT system, code, CASE WHEN system LIKE '%snomed%' THEN 'snomed_uri' WHEN system LIKE '%LOINC%' THEN 'loinc_uri' WHEN system = 'urn:rxnorm' THEN 'rxnorm_uri' ELSE 'rxnorm_code' END AS rule FROM c
        WHERE NOT (system LIKE '%umls/rxnorm' AND code NOT LIKE 'x%')""",
)
def _(t):
    k = F.col("p_partkey") % 4
    system = F.when(k == 0, "http://snomed.info/sct/").when(k == 1, "http://LOINC.org").when(k == 2, V.SYSTEM_URIS["rxnorm"]).otherwise("urn:rxnorm")
    codings = t.part.select(system.alias("system"), F.concat(F.when(F.col("p_size") % 7 == 0, "x").otherwise(""), "p_partkey").alias("code"))
    return quality.system_issues(codings)


@query(
    "note_decodable", "J13",
    "SELECT doc_id AS document_id, CASE WHEN doc_id % 9 = 0 THEN 'not_decodable' ELSE 'very_short' END AS rule FROM {documents} WHERE doc_id % 9 = 0 OR length(text) < 200",
)
def _(t):
    data = F.when(F.col("doc_id") % 9 == 0, "*no base64*").otherwise(F.base64(F.encode("text", "UTF-8")))
    return quality.note_issues(t.documents.select(F.col("doc_id").alias("document_id"), data.alias("data")))


@query(
    "cross_resource", "J14",
    """WITH d AS (SELECT o_orderkey AS document_id, o_custkey % 50 AS author, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey % 120 END AS enc FROM {orders}), e AS (SELECT s_suppkey AS enc, s_suppkey % 50 AS practitioner, s_nationkey AS provider, s_suppkey % 2 AS kind FROM {supplier})
        SELECT document_id AS id, CASE WHEN d.enc IS NULL THEN 'no_encounter' WHEN e.enc IS NULL THEN 'unknown_encounter' ELSE 'author_mismatch' END AS rule FROM d LEFT JOIN e USING (enc) WHERE d.enc IS NULL OR e.enc IS NULL OR author <> practitioner
        UNION ALL SELECT enc, 'provider_mismatch' FROM e WHERE provider <> CASE kind WHEN 0 THEN 3 ELSE 7 END""",
)
def _(t):
    docs = t.orders.select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 50).alias("author"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey") % 120).alias("encounter_id"))
    encounters = t.supplier.select(F.col("s_suppkey").alias("encounter_id"), (F.col("s_suppkey") % 50).alias("practitioner"), F.col("s_nationkey").alias("provider"), (F.col("s_suppkey") % 2).alias("kind"))
    providers = t.nation.where("n_nationkey < 2").select(F.col("n_nationkey").cast("bigint").alias("kind"), F.when(F.col("n_nationkey") == 0, 3).otherwise(7).alias("expected_provider"))
    return quality.cross_resource_issues(docs, encounters, providers)


@query(
    "date_regressions", "J16",
    f"""SELECT cand_id, CASE WHEN resource_type = 'FamilyMemberHistory' THEN 'empty_family_history' ELSE 'date_drift' END AS rule FROM ({CANDIDATES})
        WHERE resource_type = 'FamilyMemberHistory' OR abs(CAST(substr(coalesce(effective_date, performed), 1, 4) AS INT) - CAST(substr(note_date, 1, 4) AS INT)) > 1""",
)
def _(t):
    return quality.date_regressions(candidate_items(t), 1)
