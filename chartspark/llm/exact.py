"""Exact dedup: composable polynomial fingerprints, then a chunkwise comparison of all that share one.

The fingerprint of bytes ``b0 .. bn`` is their polynomial in a base, modulo several primes below 2^31.  Fingerprints
compose: that of two strings in a row is the first one's, shifted by the second one's length, plus the second one's.  A
text is hashed in blocks whose products are exact in doubles; its blocks, its chunks, or parts of it
that lie in different rows on different machines (``fingerprints_of_parts``) combine by that rule.

Texts of one length and fingerprint are then compared with the one of largest id, chunk by chunk, in a join by group and
chunk.  What differs from it (a collision) is compared among itself in a further round, so equality never rests on a hash.
The bytes of a text move only if it may have a copy: a bitmap of a fixed largest size, which may
let too much through and never too little, keeps the others in their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.llm.common import stored

#: A base for each prime; four pairs make 124 bits.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1664525, 22695477, 134775813, 214013)
#: Products of a byte and a residue stay below 2^39, sums over a block below 2^51: exact in doubles.
BLOCK = 4096
CHUNK_BYTES = 1 << 20
#: Members of a large group that meet one copy of its first text's chunk.
MEMBERS_AT_ONCE = 128
BITS_PER_ROW = 16
MOST_BITS = 1 << 27


class Polynomial:
    """Fingerprints under the given primes and bases; ``zero`` is that of no bytes."""

    def __init__(self, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES):
        self.primes, self.bases = primes, bases
        self.zero = (0,) * len(primes)
        powers = np.ones((BLOCK, len(primes)))
        for k, (p, b) in enumerate(zip(primes, bases)):
            now = 1
            for i in range(BLOCK - 1, -1, -1):
                powers[i, k] = now
                now = now * b % p
        self.powers = powers
        self.shift = tuple(pow(b, BLOCK, p) for p, b in zip(primes, bases))

    def of(self, data: bytes) -> tuple[int, ...]:
        """Fingerprint of bytes: whole blocks by one matrix product, combined like any other parts."""
        values = np.frombuffer(data, np.uint8)
        whole = len(values) // BLOCK
        rest = values[whole * BLOCK :].astype(float)
        tail = [int(x) % p for x, p in zip(rest @ self.powers[BLOCK - len(rest) :], self.primes)]
        if not whole:
            return tuple(tail)
        now = list(self.zero)
        for row in (values[: whole * BLOCK].reshape(whole, BLOCK).astype(float) @ self.powers).tolist():
            now = [(h * s + int(x)) % p for h, s, x, p in zip(now, self.shift, row, self.primes)]
        return self.joined(tuple(now), tuple(tail), len(rest))

    def joined(self, left: tuple[int, ...], right: tuple[int, ...], right_bytes: int) -> tuple[int, ...]:
        return tuple((a * pow(b, right_bytes, p) + c) % p for a, c, b, p in zip(left, right, self.bases, self.primes))


def _named(hashes: list[tuple[int, ...]]) -> pa.Array:
    return pa.array([np.array(h, ">u4").tobytes() for h in hashes], pa.binary())


def parts_of(data: Column, chunk_bytes: int) -> Column:
    """The chunks of a binary column as ``array<struct<part, bytes>>``; no bytes are one empty chunk."""
    starts = F.sequence(F.lit(0), F.greatest((F.octet_length(data) - 1) / chunk_bytes, F.lit(0)).cast("int"))
    return F.transform(starts, lambda k: F.struct(k.alias("part"), F.substring(data, k * chunk_bytes + 1, F.lit(chunk_bytes)).alias("bytes")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, hashing: Polynomial | None = None) -> DataFrame:
    """``(doc_id, n_bytes, tag, sha, fp)``: one row per row of ``docs``.

    A text passes as a run of chunk rows, so a very long one needs the memory of a chunk; ``tag`` is its xxHash64.
    """
    poly = hashing or Polynomial()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = poly.zero
        for batch in batches:
            found, last = [], []
            for part, data, is_last in zip(batch.column(4).to_pylist(), batch.column(5), batch.column(6).to_pylist()):
                own = poly.of(data.as_buffer())
                now = own if part == 0 else poly.joined(now, own, len(data.as_buffer()))
                last.append(is_last)
                if is_last:
                    found.append(now)
            ends = batch.filter(pa.array(last, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*ends.columns[:4], _named(found)], names=["doc_id", "n_bytes", "tag", "sha", "fp"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("data"))
    size = F.octet_length("data").cast("long")
    told = rows.select("doc_id", size.alias("n_bytes"), F.xxhash64("data").alias("tag"), F.unhex(F.sha2("data", 256)).alias("sha"), F.inline(parts_of(F.col("data"), chunk_bytes)))
    last = (F.col("part").cast("long") + 1) * chunk_bytes >= F.col("n_bytes")
    return told.select("doc_id", "n_bytes", "tag", "sha", "part", "bytes", last.alias("last")).mapInArrow(run, "doc_id long, n_bytes long, tag long, sha binary, fp binary")


def fingerprints_of_parts(parts: DataFrame, id_col: str = "doc_id", part_col: str = "part", bytes_col: str = "bytes", hashing: Polynomial | None = None) -> DataFrame:
    """``(doc_id, n_bytes, fp)`` of documents that lie in several rows, each part hashed where it lies.

    Parts are joined in the order of ``part_col``, which is unique within a document.  A part's share of the sum is its hash
    times the base to the power of the bytes that follow it, so only fixed-width rows are shuffled.  Null bytes are empty.
    """
    poly = hashing or Polynomial()
    lanes = range(len(poly.primes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.array([poly.of(x.as_buffer()) for x in batch.column(2)], np.int64).reshape(-1, len(poly.primes))
            sizes = [len(x.as_buffer()) for x in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *(pa.array(hashes[:, k]) for k in lanes)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "part", "size", *(f"h{k}" for k in lanes)])

    data = F.coalesce(parts[bytes_col].cast("binary"), F.lit("").cast("binary"))
    hashed = parts.select(parts[id_col].cast("long").alias("doc_id"), parts[part_col].cast("long").alias("part"), data.alias("bytes")).mapInArrow(
        run, "doc_id long, part long, size long, " + ", ".join(f"h{k} long" for k in lanes)
    )

    def combine(doc: pa.Table) -> pa.Table:
        """One document's part hashes: fixed-width rows, 48 bytes for each part."""
        doc = doc.sort_by("part")
        now, total = poly.zero, 0
        for size, *own in zip(doc.column("size").to_pylist(), *(doc.column(f"h{k}").to_pylist() for k in lanes)):
            now, total = poly.joined(now, tuple(own), size), total + size
        return pa.table({"doc_id": doc.column("doc_id")[:1], "n_bytes": pa.array([total], pa.int64()), "fp": _named([now])})

    return hashed.groupBy("doc_id").applyInArrow(combine, "doc_id long, n_bytes long, fp binary")


def _bitmap(members: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``(word, bits)``: 64 bits a row, set where a member's tag falls; at most ``MOST_BITS`` bits, so its broadcast is bounded."""
    bits = 1 << 16
    while bits < min(MOST_BITS, rows * BITS_PER_ROW):
        bits *= 2
    at = F.pmod("tag", F.lit(bits))
    one = F.expr(f"shiftleft(1L, cast(pmod(tag, {bits}L) % 64 AS int))")
    return members.groupBy((at / 64).cast("long").alias("word")).agg(F.bit_or(one).alias("bits")), bits


def _compared(texts: DataFrame, left: DataFrame) -> DataFrame:
    """``(fp, n_bytes, doc_id, tag, n, same)``: whether each member's chunks equal those of its group's row of largest id.

    ``texts`` holds at least the members' chunks.  Groups are spread over salts; each salt has its own copy of the first text's chunk.
    """
    key = ["fp", "n_bytes"]
    node = F.struct("doc_id", "tag")
    reps = left.groupBy(*key).agg(F.max(node).alias("rep"), F.count("*").alias("members"))
    reps = stored(reps.withColumn("salts", F.ceil(F.col("members") / MEMBERS_AT_ONCE).cast("long")), "leaders")
    l, r = left.alias("l"), reps.alias("r")
    asked = l.join(r, key).select(*key, "doc_id", "tag", "n", "rep", "salts")
    a, t = asked.alias("a"), texts.alias("t")
    same_row = F.col("a.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("a.tag") == F.col("t.tag")) & (F.col("a.n_bytes") == F.col("t.n_bytes"))
    chunks = t.join(a, same_row).select("a.*", "t.part", "t.bytes", "t.place")
    chunks = stored(chunks.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tag", "place"), F.col("salts"))), "members")
    first = chunks.where(node.eqNullSafe(F.col("rep"))).dropDuplicates([*key, "part"])
    first = first.select(*key, "part", F.col("bytes").alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    told = chunks.join(first, [*key, "part", "salt"]).select(*key, "doc_id", "tag", "n", (F.col("bytes") == F.col("first")).alias("same"))
    return told.groupBy(*key, "doc_id", "tag", "n").agg(F.min("same").alias("same"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, hashing: Polynomial | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, sha)``: one row per row of ``docs``, with its class of equal texts.

    The row of largest id stays (``kept``); a null id is smaller than any other.  Rows that repeat id and text are
    members of their group, and one of them stays.  A null text is an empty one.  ``keep_id`` is null where no
    member has an id.  No rows give no rows; other columns are not read.
    """
    marked = stored(fingerprints(docs, id_col, text_col, chunk_bytes, hashing), "fingerprints")
    key = ["fp", "n_bytes"]
    # Rows of one id, tag and fingerprint are one node: they could differ only by colliding in both at once under one id.
    nodes = stored(marked.groupBy(*key, "doc_id", "tag").agg(F.count("*").alias("n"), F.first("sha").alias("sha")), "nodes")
    # Stored, here and below, so that the join deals out both sides itself and adaptive execution may split a hot group.
    groups = stored(nodes.groupBy(*key).agg(F.count("*").alias("nodes")).where("nodes > 1").drop("nodes"), "groups")
    left = stored(nodes.drop("sha").join(groups, key), "repeated")
    settled = None
    if not left.isEmpty():
        bitmap, bits = _bitmap(left, nodes.count())
        data = F.coalesce(docs[text_col], F.lit("")).cast("binary")
        rows = docs.select(docs[id_col].cast("long").alias("doc_id"), data.alias("data")).select("*", F.xxhash64("data").alias("tag"))
        at = F.pmod("tag", F.lit(bits))
        hit = F.expr(f"(bits & shiftleft(1L, cast(pmod(tag, {bits}L) % 64 AS int))) <> 0")
        near = rows.withColumn("word", (at / 64).cast("long")).join(F.broadcast(bitmap), "word").where(hit).drop("word", "bits")
        # A salt for rows that share id and text; any value finds its group's chunk.
        named = near.withColumn("place", F.spark_partition_id()).withColumn("n_bytes", F.octet_length("data").cast("long"))
        texts = named.select("doc_id", "tag", "n_bytes", "place", F.inline(parts_of(F.col("data"), chunk_bytes)))
        round_ = 0
        while True:
            found = stored(_compared(texts, left), "compared")
            equal = found.where("same").withColumn("round", F.lit(round_))
            settled = equal if settled is None else settled.union(equal)
            if found.where("not same").isEmpty():
                break
            left, round_ = found.where("not same").drop("same"), round_ + 1
    if settled is None:
        sized = nodes.withColumn("group_size", F.col("n")).withColumn("keep_id", F.col("doc_id"))
    else:
        totals = stored(settled.groupBy(*key, "round").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "totals")
        # All members of a class have one text; the node of largest id is known, other nodes with that id had other texts.
        placed = settled.join(totals, [*key, "round"]).select(*key, "doc_id", "tag", "keep_id", "group_size")
        s, p = nodes.alias("s"), placed.alias("p")
        same_node = F.col("s.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("s.tag") == F.col("p.tag")) & (F.col("s.fp") == F.col("p.fp")) & (F.col("s.n_bytes") == F.col("p.n_bytes"))
        alone = F.col("p.tag").isNull()
        sized = s.join(p, same_node, "left").select(
            "s.doc_id", "s.n", "s.sha", F.when(alone, F.col("s.doc_id")).otherwise(F.col("p.keep_id")).alias("keep_id"), F.coalesce("p.group_size", "s.n").alias("group_size")
        )
    each = sized.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("sha"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts that of largest id; of rows that repeat id and text one."""
    kept = classes(docs, id_col, text_col, chunk_bytes).where("kept").select("doc_id", "sha")
    d, k = docs.alias("d"), stored(kept, "kept").alias("k")
    digest = F.sha2(F.coalesce(F.col(f"d.`{text_col}`"), F.lit("")).cast("binary"), 256)
    found = d.join(k, F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("k.doc_id")) & (digest == F.col("k.sha")), "left_semi")
    return found.dropDuplicates([id_col, text_col])
