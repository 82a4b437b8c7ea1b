"""Removal of repeated byte strings by content-chosen grams and hashed windows.  Not the induced sorting of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier.  No suffix is sorted here and no common prefix is
computed: Python code cannot touch each suffix in a queue within the time allowed (see the README).  Each window of ``LENGTH`` bytes is
represented by the least of its 32-byte grams (leftmost of ties), about one place in 35.  Equal windows have equal
representatives at equal offsets, so:

1.  Consecutive windows with one representative are a run.  Runs with equal gram and equal bytes are copies: all but the first
    go, whole.  Tasks combine copies before the shuffle, so a passage in a third of all documents leaves each task once.
2.  Where runs with one gram differ (the edges of a repeat), their single windows are judged: a window
    goes unless it is the first with its bytes.  Only windows are asked whose side of the gram another run shares, and they are
    dealt out by their own hash.

A task holds one bucket of fixed-width tuples.  All different surroundings of one gram meet in one bucket, which grows with them: a
short boilerplate of 32 to 100 bytes in very many documents is a hot bucket.  Equality rests on polynomial hashes modulo 2^64 of
randomly mapped bytes, not on the bytes: runs by 48 bits each of gram and of bytes and offsets together, windows by 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.llm.common import stored
from chartspark.llm.packing import SCHEMA, Columns, batch, pack, stacked, taken, unpack

LENGTH = 100
GRAM = 32
WINDOWS_AT_ONCE = 1 << 20
BYTES_PER_BUCKET = 16 << 20
FLUSH_RUNS = 1 << 18
FLUSH_WINDOWS = 1 << 20
LAST = (1 << 63) - 1
U = np.uint64
_TABLES: dict[str, np.ndarray] = {}
RUN = {"gram": "u6", "run": "u6", "left": "<u2", "right": "<u2", "doc": "<i8", "tag": "<i4", "at": "<i4", "off": "u1", "more": "u1"}
WINDOW = {"key": "<u8", "doc": "<i8", "tag": "<i4", "at": "<i4"}
SPAN = {"doc": "<i8", "tag": "<i4", "start": "<i4", "end": "<i4"}
OPEN, GONE = 0, 1
#: Of the bytes around a gram a window has at least this many on one side.
SIDE = (LENGTH - GRAM) // 2


def _tables() -> dict[str, np.ndarray]:
    """Random values of bytes, and powers of an odd base with their inverses modulo 2^64."""
    if not _TABLES:
        size = WINDOWS_AT_ONCE + 2 * LENGTH
        base = 0x9E3779B97F4A7C15
        powers = np.full(size, base, U)
        inverses = np.full(size, pow(base, -1, 1 << 64), U)
        powers[0] = inverses[0] = 1
        _TABLES.update(
            bytes=np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=U), powers=np.cumprod(powers, dtype=U), inverses=np.cumprod(inverses, dtype=U)
        )
    return _TABLES


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


class Hashes:
    """Hashes of substrings of at most ``WINDOWS_AT_ONCE + 2 x LENGTH`` bytes."""

    def __init__(self, data: np.ndarray):
        tables = _tables()
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(tables["bytes"][data] * tables["powers"][: len(data)], out=self.sums[1:])
        self.inverses = tables["inverses"]

    def of(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.inverses[starts])


def runs_of(data: np.ndarray) -> Columns:
    """All runs of a piece of at least ``LENGTH`` bytes: hashes of gram, bytes and sides; first window, gram's offset, further windows."""
    hashes = Hashes(data)
    places = len(data) - GRAM + 1
    grams = hashes.of(slice(0, places), slice(GRAM, len(data) + 1))
    least = (grams & U(0xFFFFFFFF00000000)) | np.arange(places, dtype=U)
    width, goal = 1, LENGTH - GRAM + 1
    while width < goal:
        step = min(width, goal - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    chosen = (least & U(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(chosen)) + 1))
    more = np.diff(np.append(first, len(chosen))) - 1
    gram = chosen[first]
    off = gram - first
    run = hashes.of(first, first + more + LENGTH) ^ _mixed(((off << 8) | more).astype(U) + U(1))
    left = hashes.of(np.maximum(gram - SIDE, 0), gram) & U(0xFFFF)
    right = hashes.of(gram + GRAM, np.minimum(gram + GRAM + SIDE, len(data))) & U(0xFFFF)
    # 0 is no side: none of the run's windows reaches that far.
    left = np.where(gram < SIDE, U(0), np.maximum(left, U(1)))
    right = np.where(gram + GRAM + SIDE > len(data), U(0), np.maximum(right, U(1)))
    return {"gram": grams[gram] >> U(16), "run": run >> U(16), "left": left, "right": right, "at": first, "off": off, "more": more}


def pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A document's bytes in pieces that hold every window once.  A run cut in two only leaves more for the second step."""
    windows = len(data) - LENGTH + 1
    for at in range(0, windows, WINDOWS_AT_ONCE):
        yield at, data[at : min(at + WINDOWS_AT_ONCE, windows) + LENGTH - 1]


def firsts(rows: Columns, keys: tuple[str, ...]) -> tuple[Columns, np.ndarray, np.ndarray]:
    """Rows sorted by keys, document and place, without repetitions; whether each opens its keys, and whether it stands where that one does."""
    order = np.lexsort((rows["tag"], rows["at"], rows["doc"], *(rows[k] for k in reversed(keys))))
    rows = taken(rows, order)
    n = len(order)
    changed = lambda names: np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in names])
    distinct = np.ones(n, bool)
    distinct[1:] = changed((*keys, "doc", "at", "tag"))
    rows = taken(rows, distinct)
    new = np.ones(len(rows["doc"]), bool)
    new[1:] = changed(keys)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return rows, new, (rows["doc"] == rows["doc"][head]) & (rows["at"] == rows["at"][head])


def _merged_spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> Columns:
    """Spans of a document that touch are one."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    # Spans here have nearly one length, so the span before reaches furthest.
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    ends = np.maximum.reduceat(end, at) if len(at) else end
    return {"doc": doc[at], "tag": tag[at], "start": start[at], "end": ends}


def _settled(gone: list[Columns], key: np.ndarray, buckets: int) -> list[tuple[int, int, int, bytes]]:
    """Spans that a task settles by itself; they pass through any bucket."""
    spans = _merged_spans(*(np.concatenate([g[c] for g in gone]) for c in ("doc", "tag", "start", "end")))
    return pack(GONE, SPAN, spans, np.full(len(spans["doc"]), int(key[0] % U(buckets)) if len(key) else 0))


def _runs(buckets: int):
    """Tuples of all runs, packed by gram; of the copies within a task only the first is still open."""

    def flush(waiting: list[Columns]) -> Iterator[pa.RecordBatch]:
        rows, _, first = firsts(stacked(waiting), ("gram", "run"))
        waiting.clear()
        gone, kept = taken(rows, ~first), taken(rows, first)
        spans = {"doc": gone["doc"], "tag": gone["tag"], "start": gone["at"], "end": gone["at"] + gone["more"] + LENGTH}
        yield batch(pack(OPEN, RUN, kept, (kept["gram"] % U(buckets)).astype(np.int64)) + _settled([spans], rows["gram"], buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Columns] = []
        size = 0
        for part in batches:
            for doc, tag, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if len(data) < LENGTH:
                    continue
                for start, piece in pieces(data):
                    rows = runs_of(piece)
                    n = len(rows["at"])
                    waiting.append(rows | {"at": rows["at"] + start, "doc": np.full(n, doc, np.int64), "tag": np.full(n, tag, np.int32)})
                    size += n
                    if size >= FLUSH_RUNS:
                        yield from flush(waiting)
                        size = 0
        if waiting:
            yield from flush(waiting)

    return run


def _shared(rows: Columns, new: np.ndarray, side: str) -> np.ndarray:
    """Whether another run has the row's gram and the same bytes on a side of it."""
    key = (rows["gram"] << U(16)) | rows[side].astype(U)
    _, group = np.unique(key, return_inverse=True)
    return (np.bincount(group, weights=new, minlength=len(key))[group] > 1) & (rows[side] != 0)


def _judge_runs(packed: pa.Table) -> pa.Table:
    """Spans of copies of runs; and open spans: the windows of first runs that may stand in another run.

    A common window has ``SIDE`` common bytes left of the gram, or right of it, and only the windows of that side are open.
    """
    settled = unpack(packed, GONE, SPAN)
    rows, new, first = firsts(unpack(packed, OPEN, RUN), ("gram", "run"))
    left, right = _shared(rows, new, "left"), _shared(rows, new, "right")
    at, off, more = rows["at"].astype(np.int64), rows["off"].astype(np.int64), rows["more"].astype(np.int64)
    start = np.where(left, at, np.maximum(at, at + off - SIDE))
    end = np.where(right, at + more, np.minimum(at + more, at + off - SIDE))
    open_ = first & (left | right) & (start <= end)
    spans = (
        (settled["doc"], settled["tag"], settled["start"], settled["end"]),
        (rows["doc"][~first], rows["tag"][~first], at[~first], (at + more)[~first] + LENGTH),
        (rows["doc"][open_], rows["tag"][open_], start[open_], end[open_] + LENGTH),
    )
    sizes = [len(x[0]) for x in spans]
    doc, tag, start, end = (np.concatenate([x[c] for x in spans]) for c in range(4))
    return pa.table({"open": np.arange(len(doc)) >= sizes[0] + sizes[1], "doc": doc, "tag": tag.astype(np.int32), "start": start.astype(np.int32), "end": end.astype(np.int32)})


def _windows(buckets: int):
    """Tuples of the windows of open spans, packed by their own hash; of equal ones within a task only the first is still open."""

    def flush(waiting: list[Columns]) -> Iterator[pa.RecordBatch]:
        rows, _, first = firsts(stacked(waiting), ("key",))
        waiting.clear()
        gone, kept = taken(rows, ~first), taken(rows, first)
        spans = {"doc": gone["doc"], "tag": gone["tag"], "start": gone["at"], "end": gone["at"] + LENGTH}
        yield batch(pack(OPEN, WINDOW, kept, (kept["key"] % U(buckets)).astype(np.int64)) + _settled([spans], rows["key"], buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Columns] = []
        size = 0
        for part in batches:
            for doc, tag, text, ranges in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                flat = ranges.values
                for start, end in merged(flat.field("start").to_numpy(), flat.field("end").to_numpy(), LENGTH - 1):
                    for at, piece in pieces(data[start:end]):
                        n = len(piece) - LENGTH + 1
                        key = Hashes(piece).of(slice(0, n), slice(LENGTH, len(piece) + 1))
                        waiting.append({"key": key, "doc": np.full(n, doc, np.int64), "tag": np.full(n, tag, np.int32), "at": np.arange(n) + start + at})
                        size += n
                        if size >= FLUSH_WINDOWS:
                            yield from flush(waiting)
                            size = 0
        if waiting:
            yield from flush(waiting)

    return run


def _judge_windows(packed: pa.Table) -> pa.Table:
    """Spans of the windows that are not the first with their bytes."""
    settled = unpack(packed, GONE, SPAN)
    rows, _, first = firsts(unpack(packed, OPEN, WINDOW), ("key",))
    gone = taken(rows, ~first)
    at = gone["at"].astype(np.int64)
    spans = _merged_spans(*(np.concatenate(x) for x in ((settled["doc"], gone["doc"]), (settled["tag"], gone["tag"]), (settled["start"], at), (settled["end"], at + LENGTH))))
    return pa.table({"doc": spans["doc"], "tag": spans["tag"].astype(np.int32), "start": spans["start"].astype(np.int32), "end": spans["end"].astype(np.int32)})


def merged(starts: np.ndarray, ends: np.ndarray, slack: int = 0) -> list[tuple[int, int]]:
    """Sorted, disjoint ranges; those that overlap by more than ``slack``, or touch where it is 0, are one."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1] - slack))
    at = np.flatnonzero(new)
    return list(zip(starts[at].tolist(), ends[np.append(at[1:] - 1, len(ends) - 1)].tolist()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, ranges in zip(batch.column(1), batch.column(2)):
            data = memoryview(text.as_buffer())
            found = merged(ranges.values.field("start").to_numpy(), ranges.values.field("end").to_numpy()) if ranges.is_valid and len(ranges) else []
            at, kept = 0, []
            for start, end in found:
                kept.append(data[at:start])
                at = end
            kept.append(data[at:])
            left = b"".join(kept)
            for values, x in zip(out, (len(data), len(data) - len(left), len(found), hashlib.sha256(left).hexdigest(), left)):
                values.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)``: one row per row of ``docs``; ``kept`` are the remaining bytes.

    A null text is empty; texts below ``LENGTH`` bytes lose nothing.  Rows with one id are one document: only an earlier
    start counts among them, so rows that repeat id and text keep the same bytes.  Null ids are one document after all
    others.  Ranges that touch are one span.  No rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("doc"), text.cast("binary").alias("text"), docs[id_col].cast("long").alias("doc_id"))
    # Texts under one id are told apart by a tag; ids are nearly all unique, and then it is 0.
    repeated = stored(rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").drop("n").withColumn("again", F.lit(True)), "ids")
    rows = rows.join(repeated, "doc", "left").withColumn("tag", F.when(F.col("again"), F.hash("text")).otherwise(F.lit(0))).drop("again")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_PER_BUCKET))
    span = "doc long, tag int, start int, end int"
    judged = rows.select("doc", "tag", "text").mapInArrow(_runs(buckets), SCHEMA).groupBy("bucket").applyInArrow(_judge_runs, f"open boolean, {span}")
    judged = stored(judged, "runs")
    ranges = lambda df: df.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))  # noqa: E731  of one document
    # One exchange serves both joins.
    dealt = rows.repartition(buckets, "doc", "tag")
    opened = dealt.join(ranges(judged.where("open")), ["doc", "tag"]).select("doc", "tag", "text", "ranges")
    induced = opened.mapInArrow(_windows(buckets), SCHEMA).groupBy("bucket").applyInArrow(_judge_windows, span)
    gone = ranges(judged.where("not open").drop("open").unionByName(induced))
    return dealt.join(gone, ["doc", "tag"], "left").select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
