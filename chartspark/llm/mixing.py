"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Documents fall into cells of source, language and topic.  Cell token weights are raked until the
sums over each source, language and topic meet their targets, given shares or powers of the corpus' own; a document is then kept with
its cell's calibrated probability.  A cell that would need more than all of its documents keeps all of them and
makes up the rest by weight: kept documents weigh what their cell's share asks for, and weighted sums meet the targets.  The corpus is summed once into cells (partial sums before
the shuffle, so a hot source is no burden); the fitting works on the cells, and no document moves.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartspark.llm.common import stored, unit_hash

KEYS = ("source", "lang", "topic")
NONE = "(none)"
#: A document's topic is the first rule its text meets.
TOPICS = (
    ("table", r"\|[^|\n]*\|"),
    ("code", r"[{}=<>][^\n]*[{}=<>;]"),
    ("rights", r"(?i)licen[cs]e|copyright"),
    ("figures", r"[0-9]{3}"),
)
PLAIN = "prose"


@dataclass(frozen=True)
class Plan:
    """Targets are shares: ``targets`` gives them by key and value, as ``{"source": {"web": 0.4}, ...}``.

    Values that a key's targets leave out divide what is left of 1 in proportion to (tokens of the value) ** power, and all
    values do where a key has none: a power of 1 keeps a marginal, 0 levels it.  Values that do not occur are left out, and the
    others' shares grow in proportion.  A share of 0 drops a value.

    ``keep`` is the share of all tokens to expect in the sample; raking stops when no marginal is off by more
    than ``tolerance`` of its target, or after ``sweeps``, which is warned of: such targets cannot be met together, or not
    soon, and ``marginals`` tells what each value reached.
    """

    powers: tuple[float, float, float] = (0.5, 0.7, 1.0)
    keep: float = 0.5
    tolerance: float = 1e-6
    sweeps: int = 60
    sweeps_at_once: int = 6
    seed: str = "mixing"
    targets: Mapping[str, Mapping[str, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for key, shares in self.targets.items():
            if key not in KEYS or not shares or min(shares.values()) < 0 or sum(shares.values()) > 1 + 1e-9 or not all(map(math.isfinite, shares.values())):
                raise ValueError(f"targets of {key!r}: known keys are {KEYS}, shares are at least 0 and at most 1 together")


def topic_of(text: Column) -> Column:
    found = F.lit(PLAIN)
    for name, pattern in reversed(TOPICS):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def tokens_of(text: Column) -> Column:
    """Words between white space; a text without any has none."""
    trimmed = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " "))).cast("long")


def named(label: Column) -> Column:
    return F.coalesce(F.nullif(label.cast("string"), F.lit("")), F.lit(NONE))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens, draw)`` of every row; null or empty labels are ``(none)``.

    The topic is that of ``topic_col`` where one is named, else of the form rules.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    topic = named(docs[topic_col]) if topic_col else topic_of(text)
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), named(docs[source_col]).alias("source"), named(docs[lang_col]).alias("lang"),
        topic.alias("topic"), tokens_of(text).alias("n_tokens"), draw_of(docs[id_col], text).alias("draw"),
    )


def draw_of(doc_id: Column, text: Column, seed: str = Plan.seed) -> Column:
    """The row's number in [0, 1): the same in every run; rows that repeat id and text share it."""
    return unit_hash(F.lit(seed), doc_id.cast("long"), text)


def targets(cells: DataFrame, plan: Plan) -> DataFrame:
    """Adds each cell's three target shares."""
    for key, power in zip(KEYS, plan.powers):
        given = plan.targets.get(key, {})
        share = F.try_element_at(F.create_map(*(F.lit(x) for name, n in given.items() for x in (name, float(n)))), F.col(key)) if given else F.lit(None)
        rest = max(0.0, 1 - sum(given.values())) if given else 1.0
        sums = cells.groupBy(key).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("size"))
        sums = sums.withColumn("given", share.cast("double"))
        others = sums.agg(F.sum(F.when(F.col("given").isNull(), F.col("size")))).first()[0] or 1.0
        goals = sums.select(key, F.coalesce("given", F.col("size") * F.lit(rest / others)).alias("goal"))
        total = goals.agg(F.sum("goal")).first()[0]
        if not total:
            raise ValueError(f"targets of {key!r}: no value that occurs has a share")
        cells = cells.join(goals.select(key, (F.col("goal") / F.lit(total)).alias(f"goal_{key}")), key)
    return cells


def _part(value: Column, whole: Column) -> Column:
    """``value / whole``, and 0 where the whole is 0."""
    return F.coalesce(F.try_divide(value, whole), F.lit(0.0))


def rake(cells: DataFrame, plan: Plan) -> DataFrame:
    """``cells`` with ``share``, the fitted token share.  A few sweeps are one plan; between plans the cells are stored."""
    total = cells.agg(F.sum("tokens")).first()[0]
    now = stored(targets(cells, plan).withColumn("share", F.col("tokens") / F.lit(float(total))), "cells")
    for _ in range(0, plan.sweeps, plan.sweeps_at_once):
        for _ in range(plan.sweeps_at_once):
            for key in KEYS:
                now = now.withColumn("share", _part(F.col("share") * F.col(f"goal_{key}"), F.sum("share").over(Window.partitionBy(key))))
        now = stored(now, "cells")
        off = max(marginals(now).where(F.col("key") == key).agg(F.max("off")).first()[0] for key in KEYS)
        if off <= plan.tolerance:
            return now
    warnings.warn(f"raking stopped after {plan.sweeps} sweeps with a marginal off by {off:.3g} of its target", stacklevel=2)
    return now


def marginals(cells: DataFrame) -> DataFrame:
    """``(key, value, goal, share, off)`` of raked cells: what each value was to reach, what it reached, and the difference as a part of the goal."""
    found = None
    for key in KEYS:
        goal = F.first(f"goal_{key}").alias("goal")
        sums = cells.groupBy(F.lit(key).alias("key"), F.col(key).alias("value")).agg(goal, F.sum("share").alias("share"))
        found = sums if found is None else found.union(sums)
    off = F.coalesce(F.abs(F.try_divide("share", "goal") - 1), F.when(F.col("share") > 0, float("inf")).otherwise(0.0))
    return found.withColumn("off", off)


def _scale(cells: DataFrame, ratio: Column, goal: float) -> float:
    """The scale at which cells that keep min(1, scale x ratio) of their tokens keep ``goal`` of them.

    The kept tokens are linear between the scales at which a cell is whole (1 / ratio).  Sections narrow the logarithm of the scale down
    to a stretch without such a point, or of no width, and there the line is solved; only sums reach the driver.
    """
    whole = F.sum(F.when(ratio > 0, F.col("tokens")).otherwise(0)).alias("whole")
    least, most, reach = cells.agg(F.min(F.when(ratio > 0, ratio)), F.max(ratio), whole).first()
    if reach <= goal:
        return 1 / least if 1 / least < math.inf else math.nextafter(math.inf, 0)
    low, high = -math.log(most), -math.log(least)

    def kept(scale: float) -> Column:
        return F.sum(F.col("tokens") * F.least(F.lit(1.0), ratio * F.lit(scale)))

    if goal <= cells.agg(kept(math.exp(low))).first()[0]:  # no cell is whole yet
        return goal / cells.agg(F.sum(F.col("tokens") * ratio)).first()[0]
    for _ in range(8):  # 64-fold sections
        points = [low + (high - low) * k / 64 for k in range(65)]
        sizes = cells.agg(*(kept(math.exp(min(x, 709.0))).alias(f"k{k}") for k, x in enumerate(points))).first()
        k = max((k for k in range(64) if sizes[k] <= goal), default=0)
        low, high = points[k], points[k + 1]
    middle = math.exp(min((low + high) / 2, 709.0))
    full = ratio * F.lit(middle) >= 1
    fixed, slope = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(~full, F.col("tokens") * ratio).otherwise(0.0))).first()
    solved = (goal - fixed) / slope if slope else middle
    return min(max(solved, math.exp(min(low, 709.0))), math.exp(min(high, 709.0)))


def probabilities(cells: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``probability`` = min(1, scale x share / actual share), with the scale at which ``keep`` of all tokens is expected, and ``weight``.

    ``weight`` = share / actual share / probability is one number for all cells whose probability is below 1 and larger
    in a cell that is kept whole and still too small; expected weighted tokens of a cell are its share of all tokens.
    A cell whose share is 0 has probability and weight 0.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0])
    ratio = F.col("share") * total / F.col("tokens")
    scale = _scale(cells, ratio, plan.keep * total)
    return cells.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(scale))).withColumn("weight", _part(ratio, F.col("probability")))


def fit(found: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``(source, lang, topic, tokens, share, probability, weight)`` of every cell with tokens."""
    cells = stored(found.groupBy(*KEYS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "cells")
    if cells.isEmpty():
        return cells.withColumns({x: F.lit(0.0) for x in ("share", "probability", "weight")})
    return stored(probabilities(rake(cells, plan), plan).select(*KEYS, "tokens", "share", "probability", "weight"), "cells")


def sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", plan: Plan = Plan(), topic_col: str | None = None
) -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens, probability, weight, kept)``: one row per row of ``docs``.

    ``weight`` is the cell's for kept rows, else 0: weighted token sums over the sample estimate the target shares of all tokens.
    (Weights of 1 / ``probability`` estimate the corpus as it is.)
    Rows without a word have probability 0 in a cell without tokens and their cell's else.  Null labels are a value
    of their own; repeated rows share one decision; no rows give no rows.
    """
    found = stored(features(docs, id_col, text_col, source_col, lang_col, topic_col), "features")
    cells = fit(found, plan).select(*KEYS, "probability", "weight")
    joined = found.join(cells, list(KEYS), "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    kept = F.col("draw") < F.col("probability")
    return joined.select(
        "doc_id", *KEYS, "n_tokens", "probability", F.when(kept, F.col("weight")).otherwise(F.lit(0.0)).alias("weight"), kept.alias("kept")
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", plan: Plan = Plan(), topic_col: str | None = None
) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, ``topic``, ``probability`` and ``weight``; a name that is taken gets a leading ``mix_``, or more than one.

    The rows are those that ``sample`` keeps: null labels are a value of their own, a null text is an empty one, rows that repeat id
    and text share one decision, long texts are read whole.  No rows give no rows.
    """
    cells = fit(features(docs, id_col, text_col, source_col, lang_col, topic_col), plan)
    d, c = docs.alias("d"), cells.alias("c")
    col = lambda x: F.col(f"d.`{x}`")
    text = F.coalesce(col(text_col), F.lit(""))
    topic = named(col(topic_col)) if topic_col else topic_of(text)
    same = (named(col(source_col)) == F.col("c.source")) & (named(col(lang_col)) == F.col("c.lang")) & (topic == F.col("c.topic"))
    p = F.col("c.probability")
    names = {}
    for x in ("topic", "probability", "weight"):
        name = x
        while name in (*docs.columns, *names.values()):
            name = f"mix_{name}"
        names[x] = name
    return (
        d.join(c, same)
        .where(draw_of(col(id_col), text, plan.seed) < p)
        .select(*(col(x) for x in docs.columns), F.col("c.topic").alias(names["topic"]), p.alias(names["probability"]), F.col("c.weight").alias(names["weight"]))
    )
