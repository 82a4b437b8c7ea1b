import random
import re
import zlib
from collections import Counter

from chartspark.llm import spelling

from .conftest import CLASHING, SCHEMA


def slow_words(rows, damage=True):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if damage and doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """One letter inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(words):
    forms, rows = {}, {}
    for w, n in words.items():
        mine = [x for x in words if near(w, x)]
        best = min(mine, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        rows[w] = (n, len(mine), words[best] if forms[w] else None)
    out = set()
    for w, (n, k, m) in rows.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, n, forms[w], k, m, root))
    return out


def edited(rng, word, letters):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:]])


def test_variants_match_all_pairs(spark):
    rng = random.Random(31)
    letters = "abé"  # dense: most words have neighbours, many letters repeat
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(120)]
    base += ["a" * n for n in range(4, 14)] + ["ab" * 40, "ab" * 40 + "a", "x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149]
    words = base + [edited(rng, w, letters) for w in base for _ in range(2)]
    weights = [rng.choice([1, 1, 3, 9, 30]) for _ in words]
    rows = []
    for i in range(500):
        picked = rng.choices(words, weights, k=40)
        rows.append((i, "".join(w.upper() + ", " if rng.random() < 0.1 and w.isascii() else w + rng.choice([" ", "7", "-", "\n"]) for w in picked), "x", "y", 1))
    rows += [(None, "aaaaa abéab " * 5, "x", "y", 1), (7, None, "x", "y", 1), (7, "", "x", "y", 1), rows[3]]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for damage in (True, False):
        found = [tuple(r) for r in spelling.variants(table, damage=damage).collect()]
        assert len(found) == len(set(found)) and set(found) == slow_variants(slow_words(rows, damage))


def test_chains_end_at_their_root(spark):
    words = [("aaaaaaaa"[:k] + "bbbbbbbb"[k:], 3 * 2**k) for k in range(9)]
    found = {r["word"]: r for r in spelling.forms(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {r["root"] for r in found.values()} == {"aaaaaaaa"} and found["bbbbbbbb"]["form"] == "abbbbbbb" and found["aaaaaaaa"]["form"] is None
    ties = [("aaaaa", 1), ("aaaab", 2), ("aaaac", 2), ("zzzzz", 9)]
    found = {r["word"]: (r["form"], r["n_near"], r["form_n"], r["root"]) for r in spelling.forms(spark.createDataFrame(ties, "word string, n long")).collect()}
    assert found == {"aaaaa": ("aaaab", 2, 2, "aaaab"), "aaaab": (None, 2, None, "aaaab"), "aaaac": (None, 2, None, "aaaac"), "zzzzz": (None, 0, None, "zzzzz")}


def test_edge_tables(spark, doc_rows, docs, no_docs):
    assert set(CLASHING) <= set(docs.columns)
    assert {tuple(r) for r in spelling.variants(docs, damage=True).collect()} == slow_variants(slow_words(doc_rows))
    assert spelling.variants(no_docs).count() == 0
    one = spark.createDataFrame([(1, "hello hello hello", "x", "y", 1)], SCHEMA)
    assert [tuple(r) for r in spelling.variants(one).collect()] == [("hello", 3, None, 0, None, "hello")]


def test_no_join_gathers_a_side_on_the_driver(spark, monkeypatch):
    """The size that Spark takes a table for says little after an explode or packing, so tables this small would all be broadcast."""
    plans, stored = [], spelling.stored

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(spelling, "stored", watched)
    words = [("abcdefgh"[:k] + "z" * (8 - k), 3 + k) for k in range(9)] + [("abcde", 3), ("abcdf", 9)]
    result = spelling.forms(spark.createDataFrame(words, "word string, n long"))
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) > 4 and not any("Broadcast" in p for p in plans)
