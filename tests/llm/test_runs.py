import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from chartspark.llm import runs

from .conftest import CLASHING, SCHEMA


def slow_runs(words):
    """All maximal stretches with a period, the smallest period of each kept."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = words[i : i + length]
                if not any(all(part[k] == part[k + r] for k in range(length - r)) for r in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text, seed=True):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if seed and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a, original = g % n, list(words)
            p = 1 + (n - a) // (3 + g % 8)
            words = [original[a + (i - a) % p] if i >= a else original[i] for i in range(n)]
    found = slow_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept)), found, kept


def periodic(rng):
    """Words with runs of many periods, touching, nested and cut short."""
    out = []
    for _ in range(rng.randint(0, 6)):
        unit = [rng.choice("abcd") for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17]))]
        if rng.random() < 0.3:
            unit = unit * rng.randint(2, 5) + [rng.choice("abcd")]
        out += (unit * rng.randint(1, 9))[: rng.randint(1, 120)]
        if rng.random() < 0.5:
            out += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]
    return out


def test_runs_match_a_search_of_all_periods():
    rng = random.Random(21)
    texts = [[w.encode() for w in periodic(rng)] for _ in range(400)] + [[], [b"a"], [b"a"] * 6, [b"a"] * 5, [b"a", b"b"] * 4, [b"a", b"b"] * 4 + [b"a"]]
    for at in range(0, len(texts), 37):
        some = texts[at : at + 37]
        start, stop, period = runs.find_runs(*runs._numbered(some))
        base, found = np.cumsum([0, *map(len, some)]), []
        for k, words in enumerate(some):
            found += [(int(base[k]) + s, int(base[k]) + s + n, q) for s, n, q in slow_runs(words)]
        assert list(zip(start.tolist(), stop.tolist(), period.tolist())) == found


def test_rows_match_brute_force(spark, doc_rows, docs, no_docs):
    rng = random.Random(22)
    rows = [(i, rng.choice([" ", "\n", "\t \r"]).join(periodic(rng)), "x", "y", 1) for i in range(150)]
    rows += [r for r in doc_rows if len(r[1] or "") < 4000] + [(1000 + i, "é " * i, None, None, None) for i in range(9)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for seed in (True, False):
        found = runs.collapse(table, seed_runs=seed)
        key = lambda r: (r[0] is None, r[0] or 0, r[7])
        expected = sorted((slow_row(r[0], r[1], seed) for r in rows), key=lambda r: key(r[0]))
        got = sorted(found.collect(), key=key)
        assert [tuple(r)[:8] for r in got] == [r[0] for r in expected]
        assert [[tuple(x) for x in r["runs"]] for r in got] == [r[1] for r in expected]
        assert [r["collapsed"] for r in got] == [r[2] for r in expected]
    assert {c for r in runs.collapse(table, texts=False).select("runs", "collapsed").distinct().collect() for c in r} == {None}
    assert runs.collapse(no_docs).count() == 0
    assert set(CLASHING) <= set(docs.columns) and runs.collapse(docs).count() == len(doc_rows)


def test_a_very_long_text_of_one_word_is_one_run(spark):
    words = 300_000
    rows = [(1, "so " * words, "x", "y", 1), (3, "a b c " * (words // 3) + "d", "x", "y", 1)]
    found = runs.collapse(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    assert [(r["n_runs"], r["start"], r["length"], r["period"], r["collapsed"]) for r in found] == [(1, 0, words, 1, "so"), (1, 0, words, 3, "a b c d")]
