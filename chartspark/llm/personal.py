"""Personal data: base patterns, high-recall candidates, boosted trees, calibrated thresholds; DataFrame functions only.

Base spans are found by pattern and check and always stay.  Generators propose further, looser
spans; each has a few discrete features of format and context.  Its weak label is whether it lies on
a base span of its kind, or is a card number by itself that the base pattern lost in a longer one.
Features have few values, so the whole corpus of candidates sums up to one
small table of distinct feature rows with counts; the trees are boosted on that table, which is exact and
not a sample.  Per kind the threshold is the lowest score down to which ``PRECISION`` of the labels at every
score hold.  Trees become SQL expressions.  A document's spans never leave its row: nothing is shuffled but the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.llm.common import stored
from chartspark.llm.line_chunks import let

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
TREES = 24
DEPTH = 3
RATE = 0.3
#: The base patterns, with possessive loops: they give the same matches and stay linear in long runs.  A run can
#: only match from its start or from where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE = {
    "mail": r"(?i)[a-z0-9][a-z0-9._%+-]{0,63}\x20?(?:@|[(\[]at[)\]])\x20?[a-z0-9-]{1,63}\x20?(?:\.|[(\[]dot[)\]])\x20?[a-z]{2,24}",
    "address": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){5,7})",
    "number": r"[0-9](?:[\x20().-]{0,2}[0-9])++",
    "run": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
}
LOOSE_HINTS = {"mail": r"(?i)@|[(\[]at[)\]]", "address": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:", "number": r"[0-9]", "run": r"[0-9]{4}"}
CONTEXT = r"(?i)(?:mail|contact|phone|tel|call|mobile|fax|card|visa|iban|account|ip|host|addr)\W{0,3}(?:\w{1,8}\W{1,3})?$"
FEATURES = ("kind", "digits", "groups", "checked", "before", "after", "context", "marks")
REACH = 24
BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of all elements up to each; in blocks, so that long arrays stay near linear."""

    def sums(values: Column) -> Column:
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"] + x).alias("out"))
        return F.aggregate(values, state, step, lambda s: s["out"])

    def blocks(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        before = lambda ends, i: F.when(i == 0, F.lit(0)).otherwise(ends[F.greatest(i - 1, F.lit(0))])
        return let(sums(totals), lambda ends: F.flatten(F.transform(parts, lambda p, i: F.transform(sums(p), lambda x: x + before(ends, i)))))

    count = F.floor((F.size(lengths) - 1) / BLOCK).cast("int")
    return let(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda g: F.slice(lengths, g * BLOCK + 1, BLOCK)), blocks)


def matches(text: Column, pattern: str, hint: str) -> Column:
    """``array<struct<start, end, value, before, after>>`` of leftmost non-overlapping matches, in code points.

    Places follow from the lengths of the pieces between matches, which also are the context.
    """
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"

    def placed(values: Column, pieces: Column) -> Column:
        gaps = F.transform(values, lambda v, i: F.length(pieces[i]) + F.when(i == 0, F.lit(0)).otherwise(F.length(values[F.greatest(i - 1, F.lit(0))])))
        return let(
            _running(gaps),
            lambda starts: F.transform(
                values,
                lambda v, i: F.struct(
                    starts[i].alias("start"), (starts[i] + F.length(v)).alias("end"), v.alias("value"),
                    F.right(pieces[i], F.lit(REACH)).alias("before"), F.left(pieces[i + 1], F.lit(1)).alias("after"),
                ),
            ),
        )

    def found(values: Column) -> Column:
        return F.when(F.size(values) > 0, let(F.split(text, pattern, -1), lambda pieces: placed(values, pieces))).otherwise(F.array().cast(kind))

    return F.when(text.rlike(hint), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)).otherwise(F.array().cast(kind))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    short = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, r"\.", -1), lambda part: (F.length(short(part)) <= 3) & (F.coalesce(short(part).try_cast("int"), F.lit(999)) <= 255))


def _luhn(value: Column) -> Column:
    return F.call_function("luhn_check", _digits(value))


def _valid(kind: str, value: Column) -> Column:
    size = F.length(_digits(value))
    return {"email": F.lit(True), "ip": _octets(value), "card": size.between(12, 19) & _luhn(value), "phone": size.between(9, 15)}[kind]


def base_spans(text: Column) -> Column:
    """``array<struct<start, kind, end>>`` of the base kinds; kinds are places in ``KINDS``."""

    def of(k: int, kind: str) -> Column:
        valid = F.filter(matches(text, BASE[kind], HINTS[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))

    return F.sort_array(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def _class(char: Column) -> Column:
    """0 for none or white space, 1 for a letter, 2 for a digit or sign of a number, 3 for others."""
    return F.when(char.rlike(r"^\s*$"), 0).when(char.rlike(r"\p{L}"), 1).when(char.rlike(r"[0-9+#.-]"), 2).otherwise(3)


def candidates(text: Column) -> Column:
    """Loose spans with their features, as ``array<struct<start, end, kind, ...>>``; spans may overlap."""

    def described(generator: str, m: Column) -> Column:
        value, size = m["value"], F.length(_digits(m["value"]))
        kind = {"mail": F.lit(0), "address": F.lit(1)}.get(generator, F.when(size >= 12, 2).otherwise(3))
        checked = {"mail": F.instr(value, "@") > 0, "address": ~F.contains(value, F.lit(":")) & _octets(value)}.get(generator, (size >= 12) & _luhn(value))
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), kind.alias("kind"),
            F.when(size < 7, 0).when(size < 9, 1).when(size < 12, 2).when(size < 16, 3).when(size < 20, 4).otherwise(5).alias("digits"),
            F.least(F.regexp_count(value, F.lit("[0-9]+")), F.lit(5)).alias("groups"), checked.cast("int").alias("checked"),
            _class(F.right(m["before"], F.lit(1))).alias("before"), _class(m["after"]).alias("after"),
            m["before"].rlike(CONTEXT).cast("int").alias("context"),
            F.when(value.rlike(r"[()\[\]]"), 1).when(F.contains(value, F.lit(" ")), 2).when(value.rlike(r"[.-]"), 3).otherwise(0).alias("marks"),
        )

    def of(generator: str) -> Column:
        found = matches(text, LOOSE[generator], LOOSE_HINTS[generator])
        if generator == "number":
            found = F.filter(found, lambda m: F.length(_digits(m["value"])) >= 7)
        return F.transform(found, lambda m: described(generator, m))

    return F.concat(*map(of, LOOSE))


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """Rows with ``feature`` <= ``at`` go left."""

    feature: str
    at: int
    left: Split | Leaf
    right: Split | Leaf


def grow(rows: list[tuple[dict[str, int], float, float]], depth: int) -> Split | Leaf:
    """A tree for ``(features, gradient, curvature)`` rows, by the usual gain; ties go to the first feature and least value."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    if depth:
        for feature in FEATURES:
            sums: dict[int, list[float]] = {}
            for x, dg, dh in rows:
                s = sums.setdefault(x[feature], [0.0, 0.0])
                s[0] += dg
                s[1] += dh
            left_g = left_h = 0.0
            for at in sorted(sums)[:-1]:
                left_g, left_h = left_g + sums[at][0], left_h + sums[at][1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, feature, at)
    if best is None:
        return Leaf(RATE * g / (h + 1))
    _, feature, at = best
    low, high = [r for r in rows if r[0][feature] <= at], [r for r in rows if r[0][feature] > at]
    return Split(feature, at, grow(low, depth - 1), grow(high, depth - 1))


def value_of(tree: Split | Leaf, x: dict[str, int]) -> float:
    while isinstance(tree, Split):
        tree = tree.left if x[tree.feature] <= tree.at else tree.right
    return tree.value


def boost(table: list[tuple[dict[str, int], int, int]]) -> list[Split | Leaf]:
    """Logistic boosting on distinct feature rows with numbers of positive and of all candidates."""
    scores, trees = [0.0] * len(table), []
    for _ in range(TREES):
        chance = [1 / (1 + math.exp(-s)) for s in scores]
        rows = [(x, good - n * p, n * p * (1 - p)) for (x, good, n), p in zip(table, chance)]
        trees.append(grow(rows, DEPTH))
        scores = [s + value_of(trees[-1], x) for s, (x, _, _) in zip(scores, table)]
    return trees


def thresholds(table: list[tuple[dict[str, int], int, int]], trees: list[Split | Leaf]) -> list[float]:
    """Per kind the lowest score down to which every score level has ``PRECISION`` of its labels; infinite where there is none."""
    out = []
    for kind in range(len(KINDS)):
        levels: dict[float, list[int]] = {}
        for x, good, n in table:
            if x["kind"] == kind:
                level = levels.setdefault(round(sum(value_of(t, x) for t in trees), 9), [0, 0])
                level[0] += good
                level[1] += n
        limit = math.inf
        for score in sorted(levels, reverse=True):
            good, n = levels[score]
            if score <= 0 or good < PRECISION * n:
                break
            limit = score
        out.append(limit)
    return out


def _expression(tree: Split | Leaf, row: Callable[[str], Column]) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    return F.when(row(tree.feature) <= tree.at, _expression(tree.left, row)).otherwise(_expression(tree.right, row))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, added)``: one row per row of ``docs``; spans are ``(start, kind, end)`` in code points, by start, then kind.

    Added spans overlap no base span.  A null text is empty and has none; null and repeated ids are rows like others; without
    candidates the model adds nothing.  Other columns are not read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    meets = lambda c, b: (b["start"] < c["end"]) & (c["start"] < b["end"])
    within = lambda c, b: meets(c, b) & (b["kind"] == c["kind"])
    alone = lambda c: (c["kind"] == KINDS.index("card")) & (c["checked"] == 1) & c["digits"].between(3, 4)
    found = rows.select("doc_id", F.inline(F.array(F.struct(base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("loose")))))
    labelled = F.transform("loose", lambda c: F.struct(c.alias("c"), (alone(c) | F.exists("base", lambda b: within(c, b))).alias("label"), F.exists("base", lambda b: meets(c, b)).alias("taken")))
    found = stored(found.select("doc_id", "base", labelled.alias("loose")), "spans")
    counted = (
        found.select(F.explode("loose").alias("x"))
        .groupBy(*(F.col(f"x.c.{f}").alias(f) for f in FEATURES))
        .agg(F.sum(F.col("x.label").cast("long")).alias("good"), F.count("*").alias("n"))
        .orderBy(*FEATURES)
    )
    table = [({f: r[f] for f in FEATURES}, r["good"], r["n"]) for r in counted.collect()]  # at most the product of the features' values
    trees = boost(table) if table else []
    limits = F.array(*map(F.lit, thresholds(table, trees)))

    def chosen(x: Column) -> Column:
        score = sum((_expression(t, lambda f: x["c"][f]) for t in trees), F.lit(0.0))
        return ~x["taken"] & (score >= limits[x["c"]["kind"]] - 1e-9)

    spans = F.transform(F.filter("loose", chosen), lambda x: F.struct(x["c"]["start"].alias("start"), x["c"]["kind"].alias("kind"), x["c"]["end"].alias("end")))
    return found.select("doc_id", "base", F.sort_array(F.array_distinct(spans)).alias("added"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first stands for all it covers."""
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        put = F.concat(F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))), F.lit("["), names[x["kind"]], F.lit("]"))
        return F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.array_append(s["parts"], put).alias("parts"))).otherwise(
            F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["parts"].alias("parts"))
        )

    return F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
