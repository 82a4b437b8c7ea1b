"""Language ID, line chunks, personal data, licences, repeats and back-off scores, mostly against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chartspark.llm import backoff, language, licenses, line_chunks, personal, repeats

from .conftest import SCHEMA, prose


# Language


def test_language_is_learnt_and_noise_rejected(spark, docs, no_docs):
    rng = random.Random(1)
    rows = [(i, prose(rng, "en" if i % 2 else "fr", 80), "en" if i % 2 else "fr", "s", 1) for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA)
    model = language.train(table)
    assert model.languages == ["en", "fr"]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    names, score, rejected = model.predict([r[1] for r in held])
    assert sum(a == r[2] for a, r in zip(names, held)) / len(held) > 0.97 and not rejected.any() and (score > 0.5).all()
    names, score, rejected = model.predict(["", "12 !", "Привет мир, как дела сегодня"])
    assert names[:2] == ["und", "und"] and list(score[:2]) == [0, 0] and rejected.all()
    assert {(r["doc_id"], r["h"]) for r in table.select("doc_id", language.held_out().alias("h")).collect()} == {(r[0], r in held) for r in rows}
    found = language.predict(docs, model)
    assert found.count() == docs.count()
    assert {r["lang_pred"] for r in found.where("doc_id IN (120, 121)").collect()} == {"und"}
    assert language.accepted(docs, model).columns == docs.columns
    assert language.predict(no_docs, model).count() == 0
    nothing = language.train(no_docs)
    assert nothing.languages == [] and {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}


def test_probabilities_of_a_context_sum_to_one():
    import numpy as np

    counts = {k: np.unique(language.keys_of(language.symbols_of(language.points(t))), return_counts=True) for k, t in {"a": "abc abd abe cab " * 5, "b": "xyz abx"}.items()}
    model = language.fit({k: (x, n.astype(float)) for k, (x, n) in counts.items()})
    for context in (counts["a"][0][3] >> np.uint64(16), np.uint64(7)):
        keys = (context << np.uint64(16)) | np.append(model.grams[0][0], np.uint64(999))
        assert np.allclose(np.exp(model.logs(keys).astype(float)).sum(axis=0), 1, atol=1e-3)


def slow_kneser_ney(counts, symbols):
    """Interpolated Kneser-Ney by the book: probability of a tuple's last symbol after the others."""
    levels = {4: counts}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def probability(gram):
        k = len(gram)
        if not k:
            return 1 / (symbols + 1)
        level = levels[k]
        same = [n for g, n in level.items() if g[:-1] == gram[:-1]]
        if not same:
            return probability(gram[1:])
        ones, twos = (sum(n == x for n in level.values()) for x in (1, 2))
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        return (max(level[gram] - discount, 0) + discount * len(same) * probability(gram[1:])) / sum(same)

    return probability


def test_models_are_kneser_ney_by_the_book():
    rng = random.Random(23)
    texts = {"en": prose(rng, "en", 150), "fr": prose(rng, "fr", 120), "x": "zzz zz z zzzz"}
    grams = {}
    for name, text in texts.items():
        line = [0, 0, 0, *language.symbols_of(language.points(text)).tolist()]
        grams[name] = Counter(tuple(line[i : i + 4]) for i in range(len(line) - 3))
    packed = lambda g: sum(x << (16 * (3 - k)) for k, x in enumerate(g))
    counts = {}
    for name, own in grams.items():
        keys = sorted((packed(g), n) for g, n in own.items())
        counts[name] = (np.array([k for k, _ in keys], np.uint64), np.array([n for _, n in keys], float))
    model = language.fit(counts)
    known = sorted({x for own in grams.values() for g in own for x in g})
    symbols = len({g[3] for own in grams.values() for g in own})
    asked = [g for own in grams.values() for g in own] + [tuple(rng.choice([*known, 9999]) for _ in range(4)) for _ in range(200)]
    found = np.exp(model.logs(np.array([packed(g) for g in asked], np.uint64)).astype(float))
    for j, name in enumerate(model.languages):
        expected = [slow(g) for slow in [slow_kneser_ney(grams[name], symbols)] for g in asked]
        assert np.allclose(found[:, j], expected, rtol=1e-4)


# Line chunks


def slow_chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    ends = [i + 1 for i in range(1, len(lines) - 1) if (h[i - 1] * 257 + h[i]) % 1_000_003 % 3 == 0] + [len(lines)]
    return lines, list(zip([0, *ends[:-1]], ends))


def test_repeated_chunks_go_but_the_first(docs, doc_rows, no_docs):
    order = lambda r: (r[0] is None, r[0] or 0)
    places = {}
    for r in doc_rows:
        lines, chunks = slow_chunks(r[1] or "")
        for a, b in chunks:
            if b - a >= 2:
                places.setdefault("\n".join(lines[a:b]), set()).add((*order(r), r[0], r[1], a))
    expected = Counter()
    for r in doc_rows:
        lines, chunks = slow_chunks(r[1] or "")
        kept = []
        for a, b in chunks:
            found = places.get("\n".join(lines[a:b]), set())
            first = min((x[:2] for x in found), default=None)
            gone = b - a >= 2 and (order(r) != first or a != min(x[4] for x in found if x[:2] == first and x[3] == r[1]))
            kept += [] if gone else lines[a:b]
        expected[r[0], None if r[1] is None else "\n".join(kept)] += 1
    found = line_chunks.dedup_lines(docs)
    assert found.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in found.collect()) == expected
    assert sum((r[1] or "") != "" for r in doc_rows) and any(t != r[1] for r in doc_rows for (i, t) in expected if i == r[0])
    assert line_chunks.dedup_lines(no_docs).count() == 0


def slow_passages(rows):
    """Per row the text without pairs of neighbouring full lines that stand at an earlier place."""
    order = lambda r: (r[0] is None, r[0] or 0)
    places, marks = {}, []
    for r in rows:
        lines = (r[1] or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        marks.append((lines, [(i, j, "\n".join(lines[i : j + 1])) for i, j in zip(full, full[1:])]))
        for i, _, piece in marks[-1][1]:
            places.setdefault(piece, set()).add((order(r), r[1], i))
    for r, (lines, pairs) in zip(rows, marks):
        gone = {k for i, j, piece in pairs if len(places[piece]) > 1 and min(places[piece]) != (order(r), r[1], i) for k in range(i, j + 1)}
        yield r[0], None if r[1] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)


def test_repeated_passages_go_whole(spark, docs, no_docs):
    rng = random.Random(13)
    word = lambda n: " ".join(prose(rng, "en", 3).replace("\n", " ") + str(rng.random()) for _ in range(n))
    passages = ["\n".join(word(2) for _ in range(n)) for n in (2, 3, 4, 6, 10, 20)] + ["one\n\n \ntwo\n\nthree", "a\na\na"]
    rows = []
    for i in range(60):
        parts = [rng.choice([word(3), passages[rng.randrange(len(passages))], "common line", "", word(1)]) for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(parts), None, None, None))
    rows += [(70, rows[7][1], None, None, None), (71, None, None, None, None), (None, rows[9][1], None, None, None), rows[3], (72, "\n\n\n", None, None, None), (73, "\n\n\n", None, None, None)]
    found = line_chunks.dedup_passages(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter((r["doc_id"], r["text"]) for r in found.collect()) == Counter(slow_passages(rows))
    for p in passages[:6]:  # every passage stands once, wherever its surroundings end
        lines = Counter(x for i, t in dict(slow_passages(rows)).items() if i != 70 for x in (t or "").split("\n"))
        assert all(lines[x] == 1 for x in p.split("\n"))
    assert line_chunks.dedup_passages(docs).columns == docs.columns and line_chunks.dedup_passages(docs).count() == docs.count()
    assert line_chunks.dedup_passages(no_docs).count() == 0


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits)))) % 10 == 0


def slow_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns(spark, no_docs):
    rng = random.Random(2)
    bits = ["a@b.co", "x_y@z.de.fr", "@", ".", "1.2.3.4", "1.2.3.4.5.6.7.8", "001.0002.3.255", "1.2.3.256", "4465758382889437", "4465 7583 8288 9437", "446575838288943", " ", "-", "+49 (30) 123-4567", "+1", "é", "ß@ü", "\n", "99999999999999999999.1.1.1", "a@b", "q@w.e@r.t"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["", None, "1." * 900, "a" * 20_000 + "@", "1 " * 12_000, "+1" * 3000]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in personal.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(x) for x in found[i]["base"]] == slow_spans(t or ""), t
        assert all(not any(b[0] < x[2] and x[0] < b[2] for b in found[i]["base"]) for x in found[i]["added"])
    assert personal.find(no_docs).count() == 0


def test_trees_add_what_looks_like_base_spans(spark, docs):
    good = ["7536784127813050 4845168114407329"]  # the base pattern takes both as one number and drops it
    rows = [(i, f"pay 4465758382889437 for call +1 (523) 555-{1000 + i} now", "en", "s", 1) for i in range(500)]
    rows += [(900, f"cards {good[0]} end", "en", "s", 1), (901, "order 9807915762804490 shipped", "en", "s", 1)]
    found = {r["doc_id"]: r for r in personal.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    valid = [(6, 2, 22), (23, 2, 39)]
    assert all(luhn(n) == ((s, 2, s + 16) in [tuple(x) for x in found[900]["added"]]) for n, (s, _, _) in zip(good[0].split(), valid))
    assert found[901]["added"] == []
    assert personal.find(docs).count() == docs.count()
    row = spark.createDataFrame([("mail a@b.co or call", [(5, 0, 11)])], "text string, spans array<struct<start:int,kind:int,end:int>>")
    assert row.select(personal.redacted(F.col("text"), F.col("spans"))).first()[0] == "mail [email] or call"


# Licences

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_licence_places_match_brute_force(spark, docs, no_docs):
    rng = random.Random(4)
    bits = "gnu general public license Apache License, cc by CC-BY nc mit MIT license. the lesser word Ünder".split()
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", None, "license", "by cc by", "mit licenseé"]
    texts.append("This program is free software: you can redistribute it and/or modify it under these terms of the GNU General Public License")
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(texts):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = sorted((k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert found[i]["n_words"] == len(words)
        assert sorted((m["start"], m["label"]) for m in found[i]["matches"] if m["base"]) == places
    assert [m["label"] for m in found[len(texts) - 1]["matches"] if not m["base"]] == ["gpl"]  # one word differs
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(no_docs).count() == 0


# Repeats


def slow_repeats(rows):
    """Per row the mask of removed bytes."""
    key = lambda r: (r[0] is None, r[0] or 0)
    places = {}
    for r in rows:
        data = (r[1] or "").encode()
        for p in range(len(data) - 99):
            at = (*key(r), p)
            places[data[p : p + 100]] = min(places.get(data[p : p + 100], at), at)
    for r in rows:
        data = (r[1] or "").encode()
        mask = bytearray(len(data))
        for p in range(len(data) - 99):
            if places[data[p : p + 100]] != (*key(r), p):
                mask[p : p + 100] = b"\1" * 100
        yield r[0], data, mask


def test_repeated_bytes_go(spark, docs, doc_rows, no_docs):
    extra = [(200, "ab" * 400, None, None, None), (201, "y" * 250, None, None, None), (202, "é" * 120 + "x" + "é" * 120, None, None, None), (203, "z" * 99, None, None, None), (204, "z" * 99, None, None, None)]
    rows = doc_rows + extra
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, SCHEMA).select("doc_id", "text"))
    expected = Counter()
    for i, data, mask in slow_repeats(rows):
        kept = bytes(b for b, m in zip(data, mask) if not m)
        spans = sum(1 for k, m in enumerate(mask) if m and (k == 0 or not mask[k - 1]))
        expected[i, len(data), len(data) - len(kept), spans, kept] += 1
    found = repeats.remove_repeats(table).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found) == expected
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept"]).hexdigest() for r in found)
    assert repeats.remove_repeats(no_docs).count() == 0


def test_pieces_and_flushes_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    block = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(i, block[: rng.randint(200, 900)] + "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 400))) + block, None, None, None) for i in range(6)]
    import numpy as np

    masks = {i: sum(m) for i, _, m in slow_repeats(rows)}
    found = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == masks
    monkeypatch.setattr(repeats, "WINDOWS_AT_ONCE", 64)
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    assert sum(len(p) - 99 for _, p in repeats.pieces(data)) == len(data) - 99


# Back-off scores


def slow_scores(rows, corpus, order):
    """(words, summed logarithms) of each id by plain counts of all n-grams."""
    words = lambda t: (t or "").encode().lower().split()
    grams = Counter()
    for r in corpus:
        w = words(r[1])
        grams.update(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(n for g, n in grams.items() if len(g) == 1)

    def log_score(gram):
        if len(gram) == 1:
            return math.log(max(grams[gram], 1) / total)
        return math.log(grams[gram] / grams[gram[:-1]]) if grams[gram] else math.log(0.4) + log_score(gram[1:])

    expected = {}
    for r in rows:
        w = words(r[1])
        n0, s0 = expected.get(r[0], (0, 0.0))
        expected[r[0]] = (n0 + len(w), s0 + sum(log_score(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w))))
    return expected


def check_scores(found, expected):
    found = {r["doc_id"]: r for r in found.collect()}
    assert found.keys() == expected.keys()
    for i, (n, s) in expected.items():
        assert found[i]["n_words"] == n and math.isclose(found[i]["log_score"], s, rel_tol=1e-9, abs_tol=1e-6)
        assert (found[i]["mean_log"] is None) == (n == 0)


def test_scores_match_counts(docs, doc_rows, no_docs):
    check_scores(backoff.score(docs), slow_scores(doc_rows, doc_rows, 2))
    assert backoff.score(no_docs).count() == 0


def test_scores_of_any_order_and_corpus(spark, docs, doc_rows, no_docs, monkeypatch):
    for order in (3, 4):
        check_scores(backoff.score(docs, order=order), slow_scores(doc_rows, doc_rows, order))
    rng = random.Random(20)
    rows = [(i, prose(rng, "en", rng.randint(0, 60)) + " the the the of the", None, None, None) for i in range(30)] + [(40, "never seen words", None, None, None), (41, "zzz", None, None, None)]
    other = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check_scores(backoff.score(other, corpus=docs, order=3), slow_scores(rows, doc_rows, 3))
    for heavy in (3, 10**6):  # hardly any or nearly all n-grams are heavy
        monkeypatch.setattr(backoff, "HEAVY", heavy)
        check_scores(backoff.score(other, corpus=docs, order=3), slow_scores(rows, doc_rows, 3))
    check_scores(backoff.score(other), slow_scores(rows, rows, 2))
    assert backoff.score(no_docs, corpus=docs).count() == 0


def test_long_texts_come_in_parts(monkeypatch):
    import pyarrow as pa

    texts = ["a b c d e f g h i", "", "j", None, "k l m n o p"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["doc", "text"])
    whole = list(backoff._places(iter([batch]), 3))
    monkeypatch.setattr(backoff, "FLUSH_WORDS", 4)
    parts = list(backoff._places(iter([batch]), 3))
    assert len(whole) == 1 and len(parts) > 2

    def grams(runs):
        return [(int(p.doc[i]), int(p.pos[i]), bool(p.end[i]), *(int(x[0]) for x in p.grams(np.array([i]), min(3, int(p.pos[i]) + 1)))) for p in runs for i in np.flatnonzero(p.own)]

    assert grams(parts) == grams(whole)


def test_a_pair_with_a_third_of_all_places(spark):
    rows = [(i, "x " * 60 + f"word{i} other{i % 7}", None, None, None) for i in range(200)]
    check_scores(backoff.score(spark.createDataFrame(rows, SCHEMA)), slow_scores(rows, rows, 2))
