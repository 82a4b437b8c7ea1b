from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from chartspark.llm import simhash
from chartspark.llm.graph import components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def slow_components(prints):
    """Component (smallest print) of each print, all pairs compared."""
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {p: find(p) for p in prints}


def test_fingerprint_is_that_of_spark_hashes(spark):
    for text in ("", " \n", "One two", "a b c", "Grüße AUS Köln und Übersee\tzwei", "a b c d e f g " * 50):
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64(b"a b c", seed=42).intdigest()


def test_near_copies_match_all_pairs(docs, doc_rows):
    prints = [slow_fingerprint(r[1]) for r in doc_rows]
    found = slow_components(set(prints))
    least = defaultdict(list)
    for r, p in zip(doc_rows, prints):
        least[found[p]].append(r[0])
    expected = Counter((r[0], p, min((i for i in least[found[p]] if i is not None), default=None)) for r, p in zip(doc_rows, prints))
    assert Counter(tuple(r) for r in simhash.near_copies(docs).collect()) == expected


def test_links_join_what_is_connected(spark):
    import random

    rng = random.Random(5)
    prints = set()
    for _ in range(25):  # chains of prints three bits apart, and crowds around one print
        at = rng.getrandbits(64)
        for _ in range(12):
            prints.add(at)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                at ^= 1 << b
    centre = rng.getrandbits(64)
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(150)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r["node"]: r["component"] for r in components(simhash.links(nodes), "a", "b").collect()}
    assert {p: got.get(p, p) for p in signed} == slow_components(set(signed))


def test_survivors_keep_one_of_each_group(docs, doc_rows):
    kept = simhash.survivors(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[None] == 2  # rows without an id stay
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(docs).collect()}
    assert {i: 1 for i, c in groups if i is not None and i == c} == {i: n for i, n in ids.items() if i is not None}


def test_nothing_in_nothing_out(no_docs):
    assert simhash.near_copies(no_docs).collect() == [] and simhash.survivors(no_docs).collect() == []
