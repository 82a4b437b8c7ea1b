"""Stupid-backoff scores of documents under a corpus' n-gram counts, joined by hash and summed per document.

A word after ``order - 1`` others scores ``count(n-gram) / count(context)`` if the n-gram occurs at all, else ``ALPHA`` times its
score after one word less; a single word scores ``count / words``.  A text's first words have shorter contexts.

1.  Word counts over the whole corpus (combined in each task) make a table.  N-grams that are at least one in ``HEAVY`` of all places
    are no more than ``HEAVY``; they are counted first, travel as a broadcast, and are scored where they stand.
2.  One job for each order from the highest down.  All other n-grams, with the documents that ask for their scores, are dealt out by the
    hash of their context: a bucket holds the count table of its contexts, counts it, and joins it to the n-grams asked for.  A
    heavy context's n-grams are dealt out by their own hash, as its count is known.  What does not occur asks the next job.
3.  What is known is summed by document.

Scored under its own corpus a document asks each order for one place at most but the highest, and nothing backs off.  Tuples travel packed:
sorted columns, compressed, one blob per task and bucket; 48 bits name a word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.llm import packing
from chartspark.llm.common import stored

ALPHA = 0.4
ORDER = 2
HEAVY = 2_000
PLACES_PER_BUCKET = 600_000
FLUSH_WORDS = 400_000
KNOWN_WORDS = 1_000_000
LAST = (1 << 63) - 1
U = np.uint64
#: Marks in the place of a word: the first word of a text asks for its own count; a text's end counts its last context.
START, END = 0, 1
SUM, ONE = 0, 1
SUMS = {"doc": "<i8", "sum": "<f8"}


def tuples(order: int) -> packing.Columns:
    """Types of the tuples of an order: words, document, places counted, places asked for, times backed off."""
    return {f"w{k}": "u6" for k in range(order)} | {"doc": "<i8", "times": "<u4", "asked": "<u4", "depth": "u1"}


class Words(dict):
    """48-bit hashes of words, none of them a mark; the memory is emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = max(xxhash.xxh64_intdigest(word) >> 16, END + 1)
        return found


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _bucket(columns: list[np.ndarray], buckets: int) -> np.ndarray:
    now = np.zeros(len(columns[0]), U)
    for column in columns:
        now = now * U(0x9E3779B97F4A7C15) + column
    return (_spread(now) % U(buckets)).astype(np.int64)


@dataclass
class Heavy:
    """Heavy words and n-grams with their counts: a level is ``(codes, counts)``, sorted; a code is (place of the rest in its level, last word)."""

    levels: list[tuple[np.ndarray, np.ndarray]]

    def _at(self, level: int, codes: np.ndarray, known: np.ndarray) -> np.ndarray:
        own = self.levels[level - 1][0]
        if not len(own):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
        return np.where(known & (own[at] == codes), at, -1)

    def words(self, words: np.ndarray) -> np.ndarray:
        """Each word's place in the first level, or -1."""
        return self._at(1, words.astype(np.int64), np.ones(len(words), bool))

    def longer(self, level: int, rest: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Places in a level of n-grams from those of their first words and of their last word."""
        return self._at(level, rest * len(self.levels[0][0]) + last, (rest >= 0) & (last >= 0))

    def grams(self, columns: list[np.ndarray]) -> np.ndarray:
        found = self.words(columns[0])
        for level, column in enumerate(columns[1:], 2):
            found = self.longer(level, found, self.words(column))
        return found

    def logs(self, level: int, at: np.ndarray) -> np.ndarray:
        counts = self.levels[level - 1][1]
        return np.log(counts[at].astype(float)) if len(counts) else np.zeros(len(at))


@dataclass
class Places:
    """All words of some texts in a row.  ``pos`` is the place in the text; words that only lead up to a later part are not ``own``."""

    word: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    own: np.ndarray
    end: np.ndarray

    def heavy(self, heavy: Heavy, level: int) -> list[np.ndarray]:
        """For each level up to the given one, the heavy n-gram that ends at each place, or -1."""
        single = heavy.words(self.word)
        found = [single]
        for k in range(2, level + 1):
            before = np.concatenate(([-1], found[-1][:-1]))
            found.append(np.where(self.pos >= k - 1, heavy.longer(k, before, single), -1))
        return found

    def grams(self, at: np.ndarray, order: int) -> list[np.ndarray]:
        return [self.word[at - k] for k in range(order - 1, -1, -1)]


def _places(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[Places]:
    """Documents and texts as runs of places; a very long text comes in parts that repeat the words before them."""
    known = Words()
    parts: list[tuple[int, int, int, int, bool]] = []
    waiting: list[np.ndarray] = []

    def flush() -> Places:
        doc, size, first, lead, end = (np.array(x) for x in zip(*parts))
        start = np.cumsum(size) - size
        word = np.concatenate(waiting)
        inside = np.arange(len(word)) - np.repeat(start, size)
        last = np.zeros(len(word), bool)
        last[(start + size - 1)[end]] = True
        out = Places(word, np.repeat(doc.astype(np.int64), size), inside + np.repeat(first, size), inside >= np.repeat(lead, size), last)
        parts.clear(), waiting.clear()
        return out

    held = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = words_of(text.as_py())
            for at in range(0, len(words), FLUSH_WORDS):
                lead = min(at, order - 1)
                part = words[at - lead : at + FLUSH_WORDS]
                parts.append((doc, len(part), at - lead, lead, at + FLUSH_WORDS >= len(words)))
                waiting.append(np.fromiter(map(known.__getitem__, part), U, len(part)))
                held += len(part)
                if held >= FLUSH_WORDS:
                    yield flush()
                    held = 0
    if waiting:
        yield flush()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, seen = Words(), Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column(1):
            seen.update(map(known.__getitem__, words_of(text.as_py())))
            if len(seen) > KNOWN_WORDS:
                yield flush()
    yield flush()


def _count_heavy(level: int, shared):
    """Counts of n-grams whose first and whose last words are heavy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        for places in _places(batches, level):
            *_, rest = places.heavy(heavy, level - 1)
            last = heavy.words(places.word)
            at = np.flatnonzero(places.own & (places.pos >= level - 1) & (last >= 0))
            at = at[rest[at - 1] >= 0]
            codes, n = np.unique(rest[at - 1] * len(heavy.levels[0][0]) + last[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    return run


def _by_doc(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    docs, at = np.unique(doc, return_inverse=True)
    return docs, np.bincount(at, weights=value, minlength=len(docs))


def _packed_sums(doc: np.ndarray, value: np.ndarray, buckets: int) -> list[tuple[int, int, int, bytes]]:
    docs, sums = _by_doc(doc, value)
    return packing.pack(SUM, SUMS, {"doc": docs, "sum": sums}, _bucket([docs.astype(U)], buckets))


def _packed(columns: list[np.ndarray], doc: np.ndarray, times: np.ndarray, asked: np.ndarray, depth: np.ndarray, bucket: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Tuples, sorted by bucket and first word."""
    if not len(doc):
        return []
    if int(bucket.max()) < 1 << 16:
        order = np.argsort((bucket.astype(U) << U(48)) | columns[0])
    else:
        order = np.lexsort((columns[0], bucket))
    rows = {f"w{k}": x[order] for k, x in enumerate(columns)} | {"doc": doc[order], "times": times[order], "asked": asked[order], "depth": depth[order]}
    return packing.pack(len(columns), tuples(len(columns)), rows, bucket[order])


def _tuples(level: int, order: int, buckets: int, shared, log_total: float, counting: bool, asking: bool):
    """The tuples of one order of some texts, as parts of the corpus (``counting``), as what is scored (``asking``), or both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        for places in _places(batches, order):
            *_, contexts, whole = places.heavy(heavy, level)
            at = np.flatnonzero(places.own & (places.pos >= level - 1))
            wanted = (asking and level == order) | (asking & (places.pos[at] == level - 1))
            known = whole[at] >= 0
            settled = at[known & wanted]
            sums = [(places.doc[settled], heavy.logs(level, whole[settled]) - heavy.logs(level - 1, contexts[settled - 1]))]
            at, wanted = at[~known & (wanted | counting)], wanted[~known & (wanted | counting)]
            columns = places.grams(at, level)
            bucket = np.where(contexts[at - 1] >= 0, _bucket(columns, buckets), _bucket(columns[:-1], buckets))
            rows = [(columns, np.where(wanted, places.doc[at], 0), np.full(len(at), counting), wanted, bucket)]
            if counting:  # the last context of a text has no word after it
                at = np.flatnonzero(places.end & (places.pos >= level - 2))
                at = at[contexts[at] < 0]
                context = places.grams(at, level - 1)
                rows.append(([*context, np.full(len(at), END, U)], np.zeros(len(at), np.int64), np.ones(len(at)), np.zeros(len(at)), _bucket(context, buckets)))
            if asking and level == 2:
                at = np.flatnonzero(places.own & (places.pos == 0))
                known = contexts[at] >= 0
                sums.append((places.doc[at[known]], heavy.logs(1, contexts[at[known]]) - log_total))
                at = at[~known]
                rows.append(([places.word[at], np.full(len(at), START, U)], places.doc[at], np.zeros(len(at)), np.ones(len(at)), _bucket([places.word[at]], buckets)))
            columns = [np.concatenate(x) for x in zip(*(r[0] for r in rows))]
            doc, times, asked, bucket = (np.concatenate([r[k] for r in rows]) for k in range(1, 5))
            found = _packed(columns, doc.astype(np.int64), times.astype(np.uint32), asked.astype(np.uint32), np.zeros(len(doc), np.uint8), bucket)
            yield packing.batch(found + _packed_sums(*(np.concatenate(x) for x in zip(*sums)), buckets))

    return run


def _judge(level: int, buckets: int, shared, log_total: float):
    """Counts a bucket's n-grams and contexts; sums what they settle, and sends the rest to the next lower order."""

    def run(packed: pa.Table) -> pa.RecordBatch:
        heavy = shared.value
        rows = packing.unpack(packed, level, tuples(level))
        sums = packing.unpack(packed, SUM, SUMS)
        out = []
        if len(rows["doc"]):
            columns = [rows[f"w{k}"] for k in range(level)]
            order = np.lexsort(columns[::-1])
            rows = packing.taken(rows, order)
            columns = [x[order] for x in columns]
            changes = [x[1:] != x[:-1] for x in columns]
            new = np.flatnonzero(np.concatenate(([True], np.any(changes, axis=0))))
            count = np.add.reduceat(rows["times"].astype(np.int64), new)
            whole = heavy.grams([x[new] for x in columns])  # backed off to: heavy n-grams themselves are not dealt out
            count[whole >= 0] = heavy.levels[level - 1][1][whole[whole >= 0]]
            count = np.repeat(count, np.diff(np.append(new, len(order))))
            first = np.flatnonzero(np.concatenate(([True], np.any(changes[:-1], axis=0))))
            size = np.diff(np.append(first, len(order)))
            context = np.log(np.maximum(np.add.reduceat(rows["times"].astype(np.int64), first), 1).astype(float))
            known = heavy.grams([x[first] for x in columns[:-1]])
            context = np.repeat(np.where(known >= 0, heavy.logs(level - 1, known), context), size)
            single = columns[-1] == START
            asked = rows["asked"] > 0
            good = asked & ((count > 0) | single)
            value = np.where(single[good], context[good] - log_total, np.log(np.maximum(count[good], 1)) - context[good]) + rows["depth"][good] * math.log(ALPHA)
            sums = packing.stacked([sums, {"doc": rows["doc"][good], "sum": value * rows["asked"][good]}])
            back = np.flatnonzero(asked & ~good)
            if len(back):
                lower = [x[back] for x in columns[1:]]
                if level == 2:
                    bucket = _bucket(lower, buckets)
                else:
                    rest = heavy.grams(lower[:-1])
                    bucket = np.where(rest >= 0, _bucket(lower, buckets), _bucket(lower[:-1], buckets))
                out = _packed(lower, rows["doc"][back], np.zeros(len(back), np.int64), rows["asked"][back].astype(np.int64), rows["depth"][back] + np.uint8(1), bucket)
        return pa.Table.from_batches([packing.batch(out + _packed_sums(sums["doc"], sums["sum"], buckets))])

    return run


def _sum_docs(packed: pa.Table) -> pa.Table:
    docs, sums = _by_doc(*packing.unpack(packed, SUM, SUMS).values())
    return pa.table({"doc": pa.array(docs, pa.int64()), "log_score": pa.array(sums, pa.float64())})


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tuples of single words as rows."""
    for batch in batches:
        rows = packing.unpack(pa.Table.from_batches([batch]), ONE, tuples(1))
        arrays = [pa.array(rows[x].astype(np.int64)) for x in ("w0", "doc", "asked", "depth")]
        yield pa.RecordBatch.from_arrays(arrays, names=["word", "doc", "asked", "depth"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corpus: DataFrame | None = None, order: int = ORDER) -> DataFrame:
    """``(doc_id, n_words, log_score, mean_log)``: one row per id; natural logarithms.  ``order`` is 2 or more.

    The counts are those of ``corpus`` (with the same columns), or of ``docs`` themselves; every row counts, repeated ones too.  Rows with one id are
    one document whose texts are scored apart and summed; null ids are one such document.  A document without words has score 0 and
    a null mean; null texts are empty, very long ones are read in parts.  A word that the corpus lacks scores as if it stood there
    once.  No rows give no rows.
    """
    if order < 2:
        raise ValueError("order is 2 or more")
    spark = docs.sparkSession

    def rows_of(frame: DataFrame) -> DataFrame:
        return frame.select(F.coalesce(frame[id_col].cast("long"), F.lit(LAST)).alias("doc"), frame[text_col].cast("string").alias("text"), frame[id_col].cast("long").alias("doc_id"))

    rows = rows_of(docs)
    given = (rows if corpus is None else rows_of(corpus)).select("doc", "text")
    counts = stored(given.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0

    def level_of(found: DataFrame, code: str) -> tuple[np.ndarray, np.ndarray]:
        heavy = sorted((r[code], r["n"]) for r in found.where(F.col("n") * HEAVY >= total).collect())  # at most HEAVY of them
        return np.array([h[0] for h in heavy], np.int64), np.array([h[1] for h in heavy], np.int64)

    heavy = Heavy([level_of(counts, "word")])
    for level in range(2, order + 1):
        if len(heavy.levels[-1][0]):
            shared = spark.sparkContext.broadcast(heavy)
            heavy = Heavy([*heavy.levels, level_of(given.mapInArrow(_count_heavy(level, shared), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "code")])
        else:
            heavy = Heavy([*heavy.levels, (np.zeros(0, np.int64),) * 2])
    shared = spark.sparkContext.broadcast(heavy)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PLACES_PER_BUCKET))
    log_total = math.log(max(total, 1))
    texts, below = rows.select("doc", "text"), None
    for level in range(order, 1, -1):
        deal = lambda frame, **kind: frame.mapInArrow(_tuples(level, order, buckets, shared, log_total, **kind), packing.SCHEMA)  # noqa: B023, E731
        own = deal(texts, counting=True, asking=True) if corpus is None else deal(texts, counting=False, asking=True).unionByName(deal(given, counting=True, asking=False))
        below = (own if below is None else own.unionByName(below)).groupBy("bucket").applyInArrow(_judge(level, buckets, shared, log_total), packing.SCHEMA)
    if corpus is not None:
        below = stored(below, "backed")
    sums = below.where(F.col("kind") == SUM).groupBy("bucket").applyInArrow(_sum_docs, "doc long, log_score double")
    if corpus is not None:
        singles = below.where(F.col("kind") == ONE).mapInArrow(_singles, "word long, doc long, asked long, depth long")
        valued = singles.join(counts, "word", "left").select("doc", (F.col("asked") * (F.log(F.coalesce("n", F.lit(1))) - F.lit(log_total) + F.col("depth") * F.lit(math.log(ALPHA)))).alias("log_score"))
        sums = sums.unionByName(valued).groupBy("doc").agg(F.sum("log_score").alias("log_score"))
    text = F.coalesce("text", F.lit(""))
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    n_words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")
    sizes = rows.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.sum(n_words).alias("n_words"))
    score = F.coalesce("log_score", F.lit(0.0))
    return sizes.join(sums, "doc", "left").select("doc_id", "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_log"))
