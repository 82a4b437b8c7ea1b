"""Licence scan by a positional index of rare tokens; DataFrame functions only.

Document frequencies of all licence words are counted over the corpus.  Of each template the words with the highest IDF are
indexed with their positions: as many as may be missing from an accepted match, and two more.  In a
file each indexed word at place ``i`` votes for its templates at ``i - position``; two votes for one start
are the intersection of postings by relative position, and no acceptable match has fewer.  Each
such start is verified word by word: the template's key phrase must stand whole, and of the other words
enough.  Everything happens inside the row of a file, so neither files nor hits are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.llm.line_chunks import let

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_SHARE = 0.8
MARGIN = 1024  # a template may seem to start that far before the text


@dataclass(frozen=True)
class Template:
    """``text`` as words; ``key`` is the mandatory phrase in it.  A base template is matched whole."""

    label: str
    text: str
    key: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def exact(self) -> bool:
        return self.base or not self.key

    @property
    def key_at(self) -> tuple[int, int]:
        words, key = self.words, (self.key or self.text).split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return at, len(key)

    @property
    def need(self) -> int:
        """Words that must match."""
        n = len(self.words)
        return n if self.exact else -int(-LEAST_SHARE * n // 1)


#: Phrases of licences and their labels.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("bsd", "bsd license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "with or without fee"),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute it and or modify it"),
    Template("apache", "you may not use this file except in compliance with the license", "except in compliance with"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
)


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII.

    ``lower`` also folds letters beyond ASCII; those stay inside words, and no licence word has them.
    """
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def frequencies(texts: Column, docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """In how many documents each licence word stands: a row per word of the fixed templates reaches the driver."""
    wanted = sorted({w for t in templates for w in t.words})
    found = docs.select(F.explode(F.array_intersect(words_of(texts), F.array(*map(F.lit, wanted)))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in wanted}


def postings(df: dict[str, int], templates: tuple[Template, ...]) -> dict[str, list[tuple[int, int]]]:
    """For each indexed word its ``(template, position)``; the rarest words of a template come first, ties by position."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        words = template.words
        chosen = sorted(range(len(words)), key=lambda k: (df.get(words[k], 0), k))[: len(words) - template.need + 2]
        for k in chosen * (2 if len(words) == 1 else 1):  # a single word votes twice
            index.setdefault(words[k], []).append((t, k))
    return index


def _starts(words: Column, index: dict[str, list[tuple[int, int]]]) -> Column:
    """``template << 32 | start + MARGIN`` of every alignment that two indexed words agree on."""
    places = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(list(index)), i)))
    table = F.create_map(*(x for w, found in sorted(index.items()) for x in (F.lit(w), F.array(*(F.lit((t << 32) + MARGIN - k).cast("long") for t, k in found)))))
    votes = F.flatten(F.transform(places, lambda i: F.transform(table[words[i]], lambda p: p + i)))

    def agreed(votes: Column) -> Column:
        return F.array_distinct(F.filter(votes, lambda v, i: (i > 0) & (votes[F.greatest(i - 1, F.lit(0))] == v)))

    return let(F.sort_array(votes), agreed)


def _verified(words: Column, starts: Column, templates: tuple[Template, ...]) -> Column:
    """``array<struct<template, start, share>>`` of the alignments that hold."""
    texts = F.array(*(F.array(*map(F.lit, t.words)) for t in templates))
    value = lambda values, t: F.array(*map(F.lit, values))[t]
    key_from, key_size, need = ([t.key_at[0] for t in templates], [t.key_at[1] for t in templates], [t.need for t in templates])

    def check(v: Column) -> Column:
        t = F.shiftright(v, 32).cast("int")
        start = v.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int") - MARGIN
        same = lambda k: F.get(words, start + k) == F.get(texts[t], k)
        matched = lambda a, n: F.size(F.filter(F.sequence(a, a + n - 1), same))
        whole = matched(F.lit(0), F.size(texts[t]))
        key = matched(value(key_from, t), value(key_size, t)) == value(key_size, t)
        ok = (start >= 0) & (whole >= value(need, t)) & key
        return F.when(ok, F.struct(t.alias("template"), start.alias("start"), (whole / F.size(texts[t])).alias("share")))

    return F.array_compact(F.transform(starts, check))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``(doc_id, n_words, matches)``: one row per row of ``docs``; matches are ``(template, label, base, start, share)`` by start.

    A null text is empty: no words, no matches.  Repeated ids and null ids are rows like others.  Other columns are not read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    index = postings(frequencies(F.col("text"), rows, templates), templates)
    labels = F.array(*(F.lit(t.label) for t in templates))
    base = F.array(*(F.lit(t.base) for t in templates))

    def found(words: Column) -> Column:
        holds = _verified(words, _starts(words, index), templates)
        named = F.transform(
            holds,
            lambda m: F.struct(m["start"].cast("long").alias("start"), m["template"].alias("template"), labels[m["template"]].alias("label"), base[m["template"]].alias("base"), m["share"].alias("share")),
        )
        return F.struct(F.size(words).cast("long").alias("n_words"), F.sort_array(named).alias("matches"))

    # Stored in an array first, so that the result is computed once however many columns use it.
    return rows.select("doc_id", F.inline(F.array(let(words_of(F.col("text")), found))))
