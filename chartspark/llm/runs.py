"""Periodic runs of words by a dictionary of basic factors, and texts with their runs collapsed.

The basic factors of a text are its stretches of 1, 2, 4, ... words.  A level names them: equal factors have one name, and a
name of the next level is that of a pair of names.  At the level of length ``L`` each factor's successor is the next place of
the same name.  Successors at a distance ``q`` above ``L / 2`` and up to ``L`` propose the period ``q``; places in a row that propose one
period are arithmetic progressions of occurrences, and together they extend to one run.

A run of smallest period ``q`` that is at least ``q + L`` words long holds, from its first to its last but ``q + L`` words,
exactly the places whose successor is ``q`` away: a nearer one would give the run a smaller period.  So each row
of places is one run, whole, and each run of four periods or more shows at one level only.  The rows of a
run's further progressions (distances ``2 q``, ...) fall away by themselves, as the successor is the nearest place.

Factors that occur once in their document cannot repeat when they grow, so a level keeps the others only.  A batch
of documents is worked on at once with numpy; a document meets no other and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_WORDS = 6
LEAST_POWER = 4
#: Words that one pass of numpy takes; a longer document is a pass of its own.
WORDS_AT_ONCE = 1 << 19
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def seeded(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the tail that the digest contract repeats in every tenth document (by the CRC of its id)."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def _places(name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by name and place, and where in that order a name equals the one before."""
    order = np.argsort(name, kind="stable")
    sorted_ = name[order]
    return order, sorted_, sorted_[1:] == sorted_[:-1]


def find_runs(names: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of all runs in documents that lie one behind the other.

    ``names`` are the words' numbers, different in different documents; ``ends`` has each word's document's end.
    """
    place, name, end = np.arange(len(names)), names, ends
    dense = np.full(len(names) + 1, -1, np.int64)
    found = []
    length = 1
    while len(place):
        order, _, same = _places(name)
        at = place[order]
        gap = np.zeros(len(place), np.int64)
        gap[order[:-1][same]] = (at[1:] - at[:-1])[same]
        mine = np.flatnonzero((2 * gap > length) & (gap <= length))
        if len(mine):
            p, q = place[mine], gap[mine]
            new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1]))))
            last = np.append(new[1:], len(p)) - 1
            start, period, stop = p[new], q[new], p[last] + q[new] + length
            good = stop - start >= np.maximum(LEAST_WORDS, LEAST_POWER * period)
            found.append((start[good], stop[good], period[good]))
        # Names for the next level: of places whose factor occurs again, and whose double fits into the document.
        again = np.zeros(len(place), bool)
        again[order[:-1][same]] = True
        again[order[1:][same]] = True
        place, name, end = place[again], name[again], end[again]
        dense[place] = name
        fits = place + 2 * length <= end
        left, other = place[fits], dense[np.minimum(place[fits] + length, len(dense) - 1)]
        pair = name[fits] * (int(name.max(initial=0)) + 1) + other
        whole = other >= 0
        dense[place] = -1
        place, pair, end = left[whole], pair[whole], end[fits][whole]
        order, _, same = _places(pair)
        name = np.empty(len(pair), np.int64)
        name[order] = np.cumsum(np.concatenate(([0], ~same))) if len(pair) else 0
        length *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, stop, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words, of its own for each document, and the documents' ends, word by word."""
    known: dict[bytes, int] = {}
    names, first, ends = [], 0, []
    for words in texts:
        known.clear()
        names.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + first)
        first += len(known)
        ends.append(len(words))
    return np.concatenate(names) if names else np.zeros(0, np.int64), np.repeat(np.cumsum(ends), ends)


def _told(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]], texts: bool) -> tuple:
    """The result row of a document with runs of (start, length, period), by start and period."""
    best, keep = None, None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:  # exact; earlier runs win ties
            best = (start, length, period)
        keep = np.ones(len(words), bool) if keep is None else keep
        keep[start + period : start + length] = False
    kept = words if keep is None else [words[i] for i in np.flatnonzero(keep)]
    collapsed = b" ".join(kept)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
    own = ([{"start": s, "length": n, "period": p} for s, n, p in runs], collapsed.decode("utf-8", "surrogatepass")) if texts else (None, None)
    return (doc_id, len(runs), *top, *digests, *own)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    run = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(run), pa.string()]
    names = [x.split(":")[0].split()[0] for x in SCHEMA.replace("array<struct<start:long,length:long,period:long>>", "a").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, seed_runs: bool = False) -> DataFrame:
    """One row per row of ``docs``: its runs, the run of greatest exact length / period, and the text without repetitions.

    A run is a stretch of ``LEAST_WORDS`` words and ``LEAST_POWER`` smallest periods at least that no neighbouring word extends; ``collapsed``
    has the words outside runs and each run's first period, joined by single spaces.  Of equal exponents the run
    of smallest start, then period, is the greatest.  ``texts`` off leaves ``runs`` and ``collapsed`` null; the digests are
    always there.  ``seed_runs`` repeats the tails of every tenth document first, as the digest contract asks.

    A null or empty text has no words and no run.  A null id is kept (and never seeded); repeated rows get a row each; no rows
    give none.  Other columns are not read.  A document must fit into a task, with some 100 bytes for each word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        waiting: list[list[bytes]] = []

        def flush() -> pa.RecordBatch:
            names, ends = _numbered(waiting)
            start, stop, period = find_runs(names, ends)
            first = np.cumsum([0, *map(len, waiting)])
            cut = np.searchsorted(start, first)
            rows = []
            for k, (doc_id, words) in enumerate(zip(ids, waiting)):
                part = slice(cut[k], cut[k + 1])
                own = zip((start[part] - first[k]).tolist(), (stop[part] - start[part]).tolist(), period[part].tolist())
                rows.append(_told(doc_id, words, list(own), texts))
            ids.clear(), waiting.clear()
            return _batch(rows)

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                ids.append(doc_id)
                waiting.append(seeded(words, doc_id) if seed_runs else words)
                size += len(words) + 1
                if size >= WORDS_AT_ONCE:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
