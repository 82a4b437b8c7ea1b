"""Decontamination, mixing, nearest neighbours and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chartspark.llm import decontaminate, mixing, neighbours

from .conftest import SCHEMA, prose

ITEMS = "item_id long, text string"


def test_leaks_match_a_search_of_every_item(spark, docs, no_docs):
    rng = random.Random(8)
    items = [(i, prose(rng, "en", rng.randint(8, 40)) + ". " + prose(rng, "en", rng.randint(1, 6)).replace("\n", " ")) for i in range(30)] + [(40, ""), (41, None), (42, "two words")]
    rows = []
    for i in range(150):
        text = prose(rng, "en", rng.randint(5, 300))
        if i % 3 == 0:
            cut = rng.randint(0, len(text))
            text = text[:cut] + " " + items[rng.randrange(30)][1].upper() + ", " + text[cut:]
        rows.append((i, text, "en", "s", 1))
    table = spark.createDataFrame(rows, SCHEMA)
    benchmark = spark.createDataFrame(items, ITEMS)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(table, benchmark).collect()}
    texts = {i: b" " + b" ".join(decontaminate.words_of(t)) + b" " for i, t, *_ in rows}
    whole = {(d, i) for d, t in texts.items() for i, x in items if decontaminate.words_of(x) and b" " + b" ".join(decontaminate.words_of(x)) + b" " in t}
    assert whole <= found
    for d, i in found - whole:  # nearly whole copies
        q, a = decontaminate.question_and_answer(dict(items)[i])
        assert decontaminate.overlap(q + a, decontaminate.words_of(rows[d][1])) >= 0.8
    kept = decontaminate.clean(table, benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in found}
    assert decontaminate.clean(docs, benchmark).columns == docs.columns
    assert decontaminate.find_leaks(no_docs, benchmark).count() == 0
    empty = spark.createDataFrame([], ITEMS)
    assert decontaminate.find_leaks(table, empty).count() == 0 and decontaminate.clean(table, empty).count() == len(rows)


def test_retrieval_is_that_of_a_full_scan():
    rng = random.Random(9)
    items = [(i, decontaminate.words_of(prose(rng, "en", 25)), decontaminate.words_of(prose(rng, "en", 4))) for i in range(50)]
    df = Counter(w for _, q, a in items for w in set(q + a))
    index = decontaminate.Index.build(items, df, 60, 29.0)
    for _ in range(60):
        text = decontaminate.words_of(prose(rng, "en", rng.randint(1, 400)))
        if rng.random() < 0.7:
            _, q, a = items[rng.randrange(50)]
            at = rng.randint(0, len(text))
            text[at:at] = (q + a)[: rng.randint(1, len(q + a))]
        expected = set()
        for k in range(-(-len(text) // index.step)):
            inside = set(text[k * index.step : (k + 2) * index.step])
            for i in range(50):
                part = slice(index.item_starts[i], index.item_starts[i + 1])
                names = list(index.terms)
                total = sum(w for t, w in zip(index.item_terms[part], index.item_weights[part]) if names[t] in inside)
                if total >= decontaminate.MIN_SCORE - decontaminate.SLACK:
                    expected.add((i, k, round(float(total), 9)))
        assert {(i, k, round(s, 9)) for i, k, s in index.retrieve(text)} == expected


def test_mixing_meets_its_targets(spark, docs, no_docs):
    rng = random.Random(10)
    rows = [(i, prose(rng, "en", rng.randint(5, 80)) + (" | a | b |" if i % 7 == 0 else ""), ["en", "fr"][i % 3 == 0], f"s{min(i % 5, 2)}", 1) for i in range(600)]
    found = mixing.sample(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(600))
    total = sum(r["n_tokens"] for r in found)
    assert total == sum(len(r[1].split()) for r in rows)
    expected = sum(r["probability"] * r["n_tokens"] for r in found)
    assert expected == pytest.approx(mixing.Plan.keep * total, rel=1e-3)
    if max(r["probability"] for r in found) < 1:
        for key, power in zip(mixing.KEYS, mixing.Plan.powers):
            have, goal = defaultdict(float), defaultdict(float)
            for r in found:
                have[r[key]] += r["probability"] * r["n_tokens"] / expected
                goal[r[key]] += r["n_tokens"]
            scale = sum(v**power for v in goal.values())
            for v in goal:
                assert have[v] == pytest.approx(goal[v] ** power / scale, rel=1e-4)
    kept = mixing.mixed(spark.createDataFrame(rows, SCHEMA))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if r["kept"]}
    clashing = mixing.mixed(docs)
    assert clashing.columns == [*docs.columns, "mix_topic", "mix_probability", "mix_weight"]
    assert Counter(r["doc_id"] for r in clashing.collect()) == Counter(r["doc_id"] for r in mixing.sample(docs).where("kept").collect())
    assert mixing.sample(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_weights_meet_the_targets_of_skewed_sources(spark):
    rng = random.Random(14)
    sizes = {"hot": 300, "tiny": 2} | {f"s{k}": 35 for k in range(18)}
    labels = [(s, "fr" if k % 3 == 0 else "en") for s, n in sizes.items() for k in range(n)]
    labels += [(s, "rare") for s in sizes]
    rows = [(i, prose(rng, "en", 3 if lang == "rare" else 40), lang, s, 1) for i, (s, lang) in enumerate(labels)]
    table = spark.createDataFrame(rows, SCHEMA)
    cells = mixing.fit(mixing.features(table)).collect()
    assert max(r["probability"] for r in cells) == 1  # some targets are out of reach of the documents there are
    total = sum(r["tokens"] for r in cells)
    assert sum(r["probability"] * r["tokens"] for r in cells) == pytest.approx(mixing.Plan.keep * total, rel=1e-3)
    for key, power in zip(mixing.KEYS, mixing.Plan.powers):
        have, size = defaultdict(float), defaultdict(float)
        for r in cells:
            have[r[key]] += r["probability"] * r["weight"] * r["tokens"] / total
            size[r[key]] += r["tokens"]
        scale = sum(v**power for v in size.values())
        for v in size:
            assert have[v] == pytest.approx(size[v] ** power / scale, rel=1e-4)
    weights = {tuple(r[k] for k in mixing.KEYS): r["weight"] for r in cells}
    found = mixing.sample(table).collect()
    assert all(r["weight"] == pytest.approx(weights[tuple(r[k] for k in mixing.KEYS)] if r["kept"] else 0) for r in found)
    kept = {r["doc_id"]: r["weight"] for r in mixing.mixed(table).collect()}
    assert kept == pytest.approx({r["doc_id"]: r["weight"] for r in found if r["kept"]})


def test_raking_says_when_targets_cannot_be_met(spark):
    rows = [(i, "a few words of prose", "en" if i < 90 else "fr", "s1" if i < 90 else "s2", 1) for i in range(100)]  # each source has a language of its own
    with pytest.warns(UserWarning, match="marginal off by"):
        mixing.fit(mixing.features(spark.createDataFrame(rows, SCHEMA)), mixing.Plan(sweeps=6))


def slow_rake(tokens, goals, sweeps):
    """Shares by the plain loop; goals by place in the cell's key, then value."""
    share = {cell: n / sum(tokens.values()) for cell, n in tokens.items()}
    for _ in range(sweeps):
        for k, wanted in enumerate(goals):
            sums = defaultdict(float)
            for cell, x in share.items():
                sums[cell[k]] += x
            share = {cell: x * wanted[cell[k]] / sums[cell[k]] if sums[cell[k]] else 0.0 for cell, x in share.items()}
    return share


def slow_probabilities(tokens, share, keep):
    """The scale by plain bisection."""
    total = sum(tokens.values())
    ratio = {c: share[c] * total / n for c, n in tokens.items()}
    low, high = 0.0, 1.0 / min(x for x in ratio.values() if x > 0)
    for _ in range(2000):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(n * min(1, ratio[c] * middle) for c, n in tokens.items()) <= keep * total else (low, middle)
    return {c: min(1, ratio[c] * low) for c in tokens}


def cells_of(rows):
    out = defaultdict(int)
    for _, text, lang, source, _ in rows:
        out[source, lang, mixing.PLAIN] += len(text.split())
    return dict(out)


def test_raking_is_the_plain_loop(spark):
    rng = random.Random(18)
    rows = [(i, prose(rng, "en", rng.randint(3, 60)), rng.choice(["en", "en", "fr", "de"]), f"s{min(rng.randrange(9), 4)}", 1) for i in range(400)]
    tokens = cells_of(rows)
    plan = mixing.Plan(sweeps=12, tolerance=0.0, keep=0.3)
    goals = []
    for k, power in enumerate(plan.powers):
        sizes = defaultdict(float)
        for cell, n in tokens.items():
            sizes[cell[k]] += n
        scale = sum(n**power for n in sizes.values())
        goals.append({v: n**power / scale for v, n in sizes.items()})
    share = slow_rake(tokens, goals, 12)
    expected = slow_probabilities(tokens, share, plan.keep)
    with pytest.warns(UserWarning):
        found = mixing.fit(mixing.features(spark.createDataFrame(rows, SCHEMA)), plan).collect()
    assert {tuple(r[k] for k in mixing.KEYS): r["tokens"] for r in found} == tokens
    for r in found:
        cell = tuple(r[k] for k in mixing.KEYS)
        assert r["share"] == pytest.approx(share[cell], rel=1e-9) and r["probability"] == pytest.approx(expected[cell], rel=1e-6)


def test_targets_that_cannot_be_met_leave_a_sample(spark):
    """One source holds nearly all of one language and a few rows of the other: a cell's share is driven towards 0."""
    rng = random.Random(19)
    labels = [("web", "fr")] * 990 + [("web", "en")] * 2 + [("wiki", "en")] * 10
    rows = [(i, prose(rng, "en", 40), lang, source, 1) for i, (source, lang) in enumerate(labels)]
    table = spark.createDataFrame(rows, SCHEMA)
    with pytest.warns(UserWarning, match="marginal off by"):
        found = mixing.sample(table).collect()
    total = sum(r["n_tokens"] for r in found)
    assert all(0 <= r["probability"] <= 1 and math.isfinite(r["weight"]) for r in found)
    assert sum(r["probability"] * r["n_tokens"] for r in found) == pytest.approx(mixing.Plan.keep * total, rel=1e-6)
    assert 0.4 < sum(r["kept"] for r in found) / len(found) < 0.6
    with pytest.warns(UserWarning):
        mixing.mixed(table).count()


def test_given_targets_are_met(spark):
    rng = random.Random(20)
    rows = [(i, prose(rng, "en", 30), rng.choice(["en", "fr", "fr"]), f"s{min(rng.randrange(12), 3)}", 1) for i in range(900)]
    rows += [(2000 + i, prose(rng, "en", 30), "xx", "s0", 1) for i in range(20)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("theme", F.when(F.col("doc_id") % 4 == 0, "news").otherwise("talk"))
    targets = {"source": {"s0": 0.4, "s1": 0.3, "never": 0.2}, "lang": {"en": 0.6, "xx": 0.0}, "topic": {"news": 0.5, "talk": 0.5}}
    plan = mixing.Plan(targets=targets, keep=0.02)
    found = mixing.sample(table, plan=plan, topic_col="theme").collect()
    expected = sum(r["probability"] * r["n_tokens"] for r in found)
    assert expected == pytest.approx(0.02 * sum(r["n_tokens"] for r in found), rel=1e-6) and max(r["probability"] for r in found) < 1
    have = defaultdict(float)
    for r in found:
        for key in mixing.KEYS:
            have[key, r[key]] += r["probability"] * r["n_tokens"] / expected
    # What does not occur leaves the others their proportion: 0.4 and 0.3 named, 0.1 for the two sources that are not.
    assert [have["source", "s0"], have["source", "s1"]] == pytest.approx([0.5, 0.375], rel=1e-4)
    assert have["source", "s2"] + have["source", "s3"] == pytest.approx(0.125, rel=1e-4)
    assert [have["lang", "en"], have["lang", "fr"], have["lang", "xx"]] == pytest.approx([0.6, 0.4, 0.0], rel=1e-4)
    assert [have["topic", "news"], have["topic", "talk"]] == pytest.approx([0.5, 0.5], rel=1e-4)
    assert not any(r["kept"] for r in found if r["lang"] == "xx")
    with pytest.raises(ValueError):
        mixing.Plan(targets={"source": {"a": 0.7, "b": 0.7}})
    both = table.withColumns({"topic": F.lit("x"), "mix_topic": F.lit("y")})
    assert mixing.mixed(both, plan=plan, topic_col="theme").columns[-3:] == ["mix_mix_topic", "probability", "weight"]


VECTORS = "vec_id long, embedding array<float>, list string, entry string"


def nearest(rows, k, every):
    usable = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in usable:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)
            out[q] = scored[:k]
    return out


def test_neighbours_of_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.standard_normal(12)], "x", "y") for i in range(300)]
    common = rows[17][1]
    rows += [(400 + i, common, "x", "y") for i in range(150)] + [rows[5]]
    rows += [(900, None, "x", "y"), (920, [0.0] * 12, "x", "y"), (940, [1.0] * 11 + [None], "x", "y"), (960, [float("nan")] * 12, "x", "y"), (980, [float("inf")] * 12, "x", "y"), (None, common, "x", "y")]
    found = defaultdict(list)
    for r in sorted(neighbours.search(spark.createDataFrame(rows, VECTORS), k=20, every=20).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((-r["score"], r["vec_id"]))
    expected = nearest(rows, 20, 20)
    assert found.keys() == expected.keys()
    for q, best in expected.items():
        assert [i for _, i in found[q]] == [i for _, i in best]
        assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for (a, _), (b, _) in zip(found[q], best))
    few = neighbours.search(spark.createDataFrame(rows[:5], VECTORS)).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, k) for k in (1, 2, 3, 4)]
    assert neighbours.search(spark.createDataFrame([], VECTORS)).count() == 0


def test_lists_reach_their_recall_with_few_scouts(spark, monkeypatch):
    """Many more vectors than the sample and the scouts hold: what is found comes out of the probed lists."""
    monkeypatch.setattr(neighbours, "SAMPLE", 1_000)
    monkeypatch.setattr(neighbours, "SCOUTS", 30)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 24))
    x = (centres[rng.integers(0, 60, 8000)] + 0.6 * rng.standard_normal((8000, 24))).astype(np.float32)
    rows = [(i, v, "x", "y") for i, v in enumerate(x.tolist())]
    found = defaultdict(set)
    for r in neighbours.search(spark.createDataFrame(rows, VECTORS).repartition(4), k=10, every=100).collect():
        found[r["query_id"]].add(r["vec_id"])
    scores = x[::100].astype(float) @ x.T.astype(float)
    hits = 0
    for i, own in enumerate(scores):
        own[i * 100] = -np.inf
        hits += len(found[i * 100] & set(np.argsort(-own)[:10].tolist()))
    assert hits / (80 * 10) >= 0.9 and all(len(v) == 10 for v in found.values())


def test_adaptive_scan_reaches_its_recall():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 48))
    x = centres[rng.integers(0, 20, 6000)] + 0.7 * rng.standard_normal((6000, 48))
    norm = float(np.sqrt((x**2).sum(axis=1).max()))
    frame = neighbours.fit(x, np.arange(len(x)), len(x), norm, 20)
    home = frame.nearest_lists(frame.raised(x, False), 1)[:, 0]
    queries = x[:60]
    limit, scouts, _ = frame.scouted(queries)
    probed = frame.nearest_lists(frame.raised(queries, True), frame.probes)
    hits = 0
    for i, q in enumerate(queries):
        rows = np.flatnonzero(np.isin(home, probed[i]))
        (_, at, score), *_ = list(neighbours.scan(q[None], limit[i : i + 1], x[rows], frame)) or [(0, np.zeros(0, int), None)]
        pool = np.union1d(rows[at], scouts[i])
        mine = pool[np.argsort(-(x[pool] @ q))][:20]
        hits += len(set(mine) & set(np.argsort(-(x @ q))[:20]))
    assert hits / (60 * 20) >= 0.9


def test_pipeline_stages_keep_columns_and_decide(spark, docs, no_docs, tmp_path):
    rng = random.Random(12)
    items = [(i, prose(rng, "en", 30)) for i in range(5)]
    folder = str(tmp_path)
    spark.createDataFrame(items, ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    rows = [(i, prose(rng, ["en", "fr"][i % 2], 80), ["en", "fr"][i % 2], f"s{i % 4}", 1) for i in range(300)]
    rows += [(400 + i, rows[i][1], rows[i][2], "s9", 1) for i in range(10)]
    rows += [(500 + i, prose(rng, "en", 40) + "\n" + items[i][1] + "\n" + prose(rng, "en", 40), "en", "s1", 1) for i in range(5)]
    rows += [(600, None, "en", "s1", 1), (601, "123 456", "en", "s1", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    now, left = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, now, folder).write.parquet(path)
        now = spark.read.parquet(path)
        left[name] = Counter(r["doc_id"] for r in now.select("doc_id").collect())
        assert now.columns[:5] == SCHEMA.names and max(left[name].values()) == 1
    ids = {r[0] for r in rows}
    assert set(left["language_id"]) == ids - {600, 601}
    assert left["line_dedup"] == left["language_id"]
    assert {i for i in range(500, 505)} <= set(left["near_dedup"])
    assert set(left["near_dedup"]) - set(left["decontamination"]) == set(range(500, 505))
    assert 0 < len(left["mixing"]) < len(left["decontamination"])
    assert corpus_pipeline.run(spark, folder).count() == len(left["mixing"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, folder).count() == 0
        assert stage(spark, docs, folder).columns[: len(docs.columns)] == docs.columns
