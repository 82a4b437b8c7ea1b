"""Benchmark decontamination: every training passage queries a BM25 index of test items by block-max WAND.

The index holds the test items; word weights come from document frequencies over all training
documents.  A passage is a window of words twice as long as the longest item, and windows step by that
length, so every copy of an item lies whole inside some window.  BM25 scores are divided by the item's
score for itself: an item is retrieved where a passage reaches ``MIN_SCORE``.

WAND's pivot is set per item: its lightest words together stay below the threshold, so a passage
without any of the other ("essential") words cannot reach it and is skipped.  Items stand in
blocks; a pair of passage and item goes on only if the block's largest weights of the passage's
words can reach the threshold, and is then scored in full.

Retrieved items are verified: shares of the five-word shingles of question and answer found in the passage.

The index grows with the benchmark alone.  It is built and shipped in parts of at most about
``INDEX_CHARS`` of item text, each of which is held against all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.7
MIN_OVERLAP = 0.8
SHINGLE_WORDS = 5
BLOCKS = 64
INDEX_CHARS = 16_000_000
K1, B = 1.2, 0.75
SLACK = 1e-6
SENTENCE_END = re.compile(r"[.!?]\s+|\n+")


_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII characters other than letters and digits part them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of several ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def question_and_answer(text: str | None, answer: str | None = None) -> tuple[list[bytes], list[bytes]]:
    """Words of both parts; without an answer of its own, the last sentence that has words is the answer."""
    if answer is not None:
        return words_of(text), words_of(answer)
    parts = [w for w in map(words_of, SENTENCE_END.split(text or "")) if w]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Shingles of five words; of fewer words the whole sequence."""
    n = min(SHINGLE_WORDS, len(words))
    return set(zip(*(words[k:] for k in range(n)))) if n else set()


def overlap(wanted: list[bytes], passage: list[bytes]) -> float:
    """Share of the shingles of ``wanted`` that stand in ``passage``; 1 where nothing is wanted."""
    need = shingles(wanted)
    if not need:
        return 1.0
    n = min(SHINGLE_WORDS, len(wanted))
    return len(need & set(zip(*(passage[k:] for k in range(n))))) / len(need)


@dataclass
class Index:
    """Postings of one part of the items, as arrays by term."""

    ids: list[int]
    questions: list[list[bytes]]
    answers: list[list[bytes]]
    terms: dict[bytes, int]
    item_starts: np.ndarray  # of each item's terms and weights
    item_terms: np.ndarray
    item_weights: np.ndarray
    posting_starts: np.ndarray  # of each term's items for which it is essential
    postings: np.ndarray
    block_of: np.ndarray
    block_max: np.ndarray  # term x block
    step: int

    @classmethod
    def build(cls, items: list[tuple[int, list[bytes], list[bytes]]], df: dict[bytes, int], n_docs: int, mean_words: float) -> Index:
        terms: dict[bytes, int] = {}
        item_terms, item_weights = [], []
        for _, q, a in items:
            counts: dict[bytes, int] = {}
            for w in q + a:
                counts[w] = counts.get(w, 0) + 1
            tf, seen = np.array(list(counts.values()), float), np.array([df.get(w, 0) for w in counts], float)
            idf = np.log1p((n_docs - seen + 0.5) / (seen + 0.5))
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(q + a) / mean_words))
            item_terms.append(np.array([terms.setdefault(w, len(terms)) for w in counts]))
            item_weights.append(weight / weight.sum())
        block_of = np.arange(len(items)) * min(BLOCKS, len(items)) // len(items)
        block_max = np.zeros((len(terms), block_of[-1] + 1), np.float32)
        owners, essential = [], []
        for i, (t, w) in enumerate(zip(item_terms, item_weights)):
            heavy = t[(order := np.argsort(w, kind="stable"))[np.cumsum(w[order]) >= MIN_SCORE - SLACK]]
            essential.append(heavy)
            owners.append(np.full(len(heavy), i))
            block_max[t, block_of[i]] = np.maximum(block_max[t, block_of[i]], w)
        essential, owners = np.concatenate(essential), np.concatenate(owners)
        order = np.argsort(essential, kind="stable")
        sizes = [len(t) for t in item_terms]
        return cls(
            [x[0] for x in items], [x[1] for x in items], [x[2] for x in items], terms,
            np.cumsum([0, *sizes]), np.concatenate(item_terms), np.concatenate(item_weights),
            np.searchsorted(essential[order], np.arange(len(terms) + 1)), owners[order],
            block_of, block_max, max(len(q) + len(a) for _, q, a in items),
        )

    def retrieve(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """``(item, window, score)`` of every window and item at ``MIN_SCORE`` or more."""
        found = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        places = np.flatnonzero(found >= 0)
        if not len(places):
            return []
        found, window = found[places], places // self.step
        degree = self.posting_starts[found + 1] - self.posting_starts[found]
        heavy = np.flatnonzero(degree)
        if not len(heavy):
            return []
        many = degree[heavy]
        items = self.postings[_ranges(self.posting_starts[found[heavy]], many)]
        windows = np.repeat(window[heavy], many)
        # A place lies in its own window and, where there is one, in the window before.
        pairs = np.unique(np.concatenate((windows * len(self.ids) + items, (windows * len(self.ids) + items)[windows > 0] - len(self.ids))))
        own, items = pairs // len(self.ids), pairs % len(self.ids)
        size = len(self.terms)
        keys = window * size + found
        keys = np.unique(np.concatenate((keys, keys[window > 0] - size)))
        opened, at = np.unique(own, return_inverse=True)
        starts = np.searchsorted(keys, opened * size)
        ends = np.searchsorted(keys, (opened + 1) * size)
        bounds = np.stack([self.block_max[keys[a:b] % size].sum(axis=0) for a, b in zip(starts, ends)])
        able = np.flatnonzero(bounds[at, self.block_of[items]] >= MIN_SCORE - SLACK)
        if not len(able):
            return []
        own, items = own[able], items[able]
        many = self.item_starts[items + 1] - self.item_starts[items]
        at = _ranges(self.item_starts[items], many)
        wanted = np.repeat(own * size, many) + self.item_terms[at]
        there = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
        scores = np.add.reduceat(self.item_weights[at] * there, np.cumsum(many) - many)
        return [(int(items[k]), int(own[k]), float(scores[k])) for k in np.flatnonzero(scores >= MIN_SCORE - SLACK)]

    def leaks(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """``(item id, score, question overlap, answer overlap, first word of the passage)``: the best passage of each leaked item."""
        words = words_of(text)
        best: dict[int, tuple] = {}
        for i, k, score in self.retrieve(words):
            passage = words[k * self.step : (k + 2) * self.step]
            q, a = overlap(self.questions[i], passage), overlap(self.answers[i], passage)
            whole = overlap(self.questions[i] + self.answers[i], passage)
            if min(q, a) >= MIN_OVERLAP or whole >= MIN_OVERLAP:
                rank = (-q, -a, -score, k)
                if i not in best or rank < best[i][0]:
                    best[i] = (rank, (self.ids[i], score, q, a, k * self.step))
        return [best[i][1] for i in sorted(best)]


def _frequencies(texts: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of one part of the index stands."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(shared.value.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    return {bytes(r["word"]): r["n"] for r in texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def indexes(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> Iterator[Index]:
    """The index in parts of bounded size.  Items without a word are not looked for; of items that share an id each is one."""
    answer = benchmark[answer_col] if answer_col else F.lit(None)
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[item_text_col].alias("text"), answer.cast("string").alias("answer")).distinct()
    said = F.concat_ws(" ", "text", "answer")
    size = items.agg(F.count("*").alias("n"), F.sum(F.length(said)).alias("chars"), F.avg(F.size(F.split(F.trim(said), r"\s+"))).alias("words")).first()
    n_docs = docs.count() if size["n"] else 0
    parts = -(-(size["chars"] or 0) // INDEX_CHARS)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item", "text", "answer"), F.lit(parts)) == part).orderBy("item", "text", "answer").collect()
        split = [(r["item"], *question_and_answer(r["text"], r["answer"])) for r in rows]
        split = [x for x in split if x[1] or x[2]]
        if split:
            texts = docs.select(docs[text_col])
            yield Index.build(split, _frequencies(texts, {w for _, q, a in split for w in q + a}), n_docs, size["words"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap, first_word)``: a row per document row and leaked item.

    Leaked: some passage reaches ``MIN_SCORE`` and holds 0.8 of the shingles of question and answer, or of the whole
    item.  Null and empty texts leak nothing; rows that repeat an id answer for themselves; an empty benchmark finds nothing.
    Of equal passages the earliest is told.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    context = docs.sparkSession.sparkContext
    found = docs.sparkSession.createDataFrame([], schema)
    for part in indexes(docs, benchmark, text_col, item_col, item_text_col, answer_col):
        shared = context.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in shared.value.leaks(text)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], kind) for c, kind in enumerate(kinds)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        found = found.union(rows.mapInArrow(run, schema))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` in which no item leaks, with all their columns; no shuffle."""
    place = docs.columns.index(text_col)
    kept = docs
    for part in indexes(docs, benchmark, text_col, item_col, item_text_col, answer_col):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.leaks(t) for t in batch.column(place).to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
