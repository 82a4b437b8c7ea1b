import hashlib
import random
from collections import Counter, defaultdict

from chartspark.llm import exact

from .conftest import SCHEMA, prose

WEAK = exact.Polynomial(primes=(3,), bases=(2,))


def slow_classes(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = [i == keep and ids[:k].count(i) == 0 for k, i in enumerate(ids)]
        out += [(i, keep, len(ids), k, hashlib.sha256(text.encode()).hexdigest()) for i, k in zip(ids, kept)]
    return Counter(out)


def test_fingerprints_are_polynomials_and_compose():
    rng = random.Random(4)
    poly = exact.Polynomial()
    for n in (0, 1, 7, exact.BLOCK - 1, exact.BLOCK, exact.BLOCK + 1, 3 * exact.BLOCK, 20_000):
        data = rng.randbytes(n)
        expected = tuple(sum(x * pow(b, n - 1 - i, p) for i, x in enumerate(data)) % p for p, b in zip(exact.PRIMES, exact.BASES))
        assert poly.of(data) == expected
        for cut in (0, n // 3, n):
            assert poly.joined(poly.of(data[:cut]), poly.of(data[cut:]), n - cut) == expected


def test_classes_match_equal_texts(spark, doc_rows, docs, no_docs):
    assert Counter(tuple(r) for r in exact.classes(docs).collect()) == slow_classes(doc_rows)
    assert exact.classes(no_docs).count() == 0 and exact.survivors(no_docs).columns == SCHEMA.names


def test_collisions_and_chunk_borders(spark):
    rng = random.Random(5)
    long = prose(rng, "fr", 400)
    texts = [prose(rng, "fr", 3)[:8] for _ in range(25)] + [long, long[:-1] + "!", "!" + long[1:], "é" * 64, "é" * 63 + "è", "", None, "\x00", "\x00\x00"]
    rows = [(i, texts[rng.randrange(len(texts))], "x", "y", 1) for i in range(300)]
    rows += [(7, texts[3], "x", "y", 1), (7, texts[4], "x", "y", 1), (None, long, "x", "y", 1), (None, long, "x", "y", 1), (None, "only here", "x", "y", 1)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = slow_classes(rows)
    assert Counter(tuple(r) for r in exact.classes(table, chunk_bytes=64).collect()) == expected
    assert Counter(tuple(r) for r in exact.classes(table, chunk_bytes=64, hashing=WEAK).collect()) == expected  # most texts collide


def test_a_third_of_all_rows_in_one_group(spark):
    rows = [(i, "the same page" if i % 3 == 0 else f"page {i}", "x", "y", 1) for i in range(3000)]
    found = exact.classes(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()
    assert Counter(tuple(r) for r in found) == slow_classes(rows)


def test_parts_in_several_rows_combine(spark):
    rng = random.Random(6)
    texts = {i: rng.randbytes(rng.randint(0, 9000)) for i in range(30)}
    rows = []
    for i, data in texts.items():
        cuts = [0, *sorted(rng.randint(0, len(data)) for _ in range(5)), len(data)]
        rows += [(i, k, bytearray(data[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rng.shuffle(rows)
    found = exact.fingerprints_of_parts(spark.createDataFrame(rows, "doc_id long, part long, bytes binary").repartition(6)).collect()
    poly = exact.Polynomial()
    assert {r["doc_id"]: (r["n_bytes"], bytes(r["fp"])) for r in found} == {i: (len(x), b"".join(h.to_bytes(4, "big") for h in poly.of(x))) for i, x in texts.items()}


def test_survivors_are_one_row_of_each_text(spark, doc_rows, docs):
    kept = exact.survivors(docs)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    expected = slow_classes(doc_rows)
    assert Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in found) == Counter((x[0], x[4]) for x, n in expected.items() for _ in range(n) if x[3])
