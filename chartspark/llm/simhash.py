"""SimHash near-dedup: a popcount embedding, a grid range join under Manhattan distance, exact checks.

The 64 bits are 32 segments of two.  Bit counts of the segments (0, 1 or 2) are the embedding;
a differing bit changes one count by one at most, so the Manhattan distance of two embeddings
is a lower bound of the Hamming distance of the fingerprints.  Counts are stored as
thermometer codes (0, 1, 2 as 00, 01, 11): Manhattan distance is then the popcount of an XOR.

The grid has the embedding's two halves as coordinates.  At a distance of at most 3 one half is
within 1, so a range query visits the cell itself and the cells one step away: an equality join.
Of two half vectors one step apart one has an odd sum; only that one is spread to its
neighbour cells.  Chance meetings in a cell are about one in 150,000 pairs.

Copies share a fingerprint and are one node.  A crowded cell (thousands of variants of one
text) would still make all pairs, so nodes are contracted first: each node is tied to a hub of
the nodes that share 56 of its 64 bits, and pairs of one tied group are not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.llm.common import cut_lineage, stored, texts_of
from chartspark.llm.graph import components

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
BITS_AT_ONCE = 1 << 18


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of one text as a signed long; no words give zero."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[k:] for k in range(words))))
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[at : at + BITS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: one row per document, the whole text read.  A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _embedded(nodes: DataFrame) -> DataFrame:
    """Adds ``t``, the thermometer codes of the 32 segment counts."""
    low = F.lit(0x5555555555555555).cast("long")
    either = F.col("fp").bitwiseOR(F.shiftrightunsigned("fp", 1)).bitwiseAND(low)
    both = F.col("fp").bitwiseAND(F.shiftrightunsigned("fp", 1)).bitwiseAND(low)
    return nodes.withColumn("t", either.bitwiseOR(F.shiftleft(both, 1)))


def _halves(nodes: DataFrame) -> DataFrame:
    """Two rows per node: the cell of each half of its embedding."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("t").bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")),
        F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("t", 32).alias("cell")),
    )
    return nodes.select("fp", "t", "hub", F.inline(sides))


def _neighbours() -> F.Column:
    """Cells one step away: a low bit changes where the high one is unset, a high bit where the low one is set."""
    steps = []
    for k in range(16):
        code = F.shiftright("cell", 2 * k).bitwiseAND(F.lit(3))
        steps.append(F.when(code != 3, F.col("cell").bitwiseXOR(F.lit(1 << (2 * k)))))
        steps.append(F.when(code != 0, F.col("cell").bitwiseXOR(F.lit(1 << (2 * k + 1)))))
    return F.array_compact(F.array(*steps))


def _hubs(nodes: DataFrame) -> DataFrame:
    """``(fp, hub)``: verified ties of each node to the least node that shares seven of its eight bytes, closed."""
    masks = [~(0xFF << (8 * k)) & 0xFFFFFFFFFFFFFFFF for k in range(8)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select(
        "fp",
        F.inline(
            F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("rest")) for k, m in enumerate(signed)))
        ),
    )
    least = keyed.groupBy("k", "rest").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = keyed.join(least, ["k", "rest"]).where((F.col("fp") != F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= MAX_DISTANCE))
    return components(ties, "fp", "least").select(F.col("node").alias("fp"), F.col("component").alias("hub"))


def links(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: links between different fingerprints at ``MAX_DISTANCE`` or less that join all that is connected.

    ``nodes`` has one row per distinct ``fp``.  Ties to a hub come first; from the grid come all
    pairs whose hubs differ.
    """
    hubs = cut_lineage(_hubs(nodes))
    placed = _embedded(nodes).join(hubs, "fp", "left").withColumn("hub", F.coalesce("hub", "fp"))
    own = _halves(placed)
    odd = own.where(F.bit_count("cell") % 2 == 1)
    spread = odd.select("fp", "t", "hub", "side", F.explode(_neighbours()).alias("cell")).withColumn("step", F.lit(1))
    probes = own.withColumn("step", F.lit(0)).unionByName(spread)
    a, b = own.alias("a"), probes.alias("b")
    met = a.join(
        b,
        (F.col("a.side") == F.col("b.side"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.hub") != F.col("b.hub"))
        & ((F.col("b.step") == 1) | (F.col("a.fp") < F.col("b.fp")))
        & (F.bit_count(F.col("a.t").bitwiseXOR(F.col("b.t"))) <= MAX_DISTANCE)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_DISTANCE),
    )
    between = met.select(F.col("a.hub").alias("a"), F.col("b.hub").alias("b"))
    return between.union(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("b")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per document with the smallest id it is connected to.

    A null text counts as empty; empty texts have fingerprint zero and are linked like any other.  Rows
    with one id are rows of one document: each is kept and linked by its own text.  A null id is
    kept and never the smallest; a component of null ids has a null ``component_id``.  No rows give
    no rows.  Other columns are not read.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(links(nodes.select("fp")), "a", "b").select(F.col("node").alias("fp"), "component")
    classed = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # Each fingerprint alone has its smallest id; the smallest of a component is an aggregate over fingerprints.
    least = classed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return marked.join(classed.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")



def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group of near copies, once each, with all columns."""
    return least_of_groups(docs, near_copies(docs, id_col, text_col), id_col)


def least_of_groups(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group in ``found`` (doc_id, component_id).

    Ids decide, so rows without one cannot be told apart and stay.  Of rows that repeat a surviving id one stays.
    """
    groups = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("n"))
    kept = stored(groups.where("doc_id = least").select("doc_id", "n"), "survivors")
    d, k = docs.alias("d"), kept.alias("k")
    found = d.join(k, F.col(f"d.`{id_col}`").cast("long") == F.col("k.doc_id"))
    once = found.where("k.n = 1").select("d.*")
    repeated = found.where("k.n > 1").select("d.*").dropDuplicates([id_col])
    return once.union(repeated).union(docs.where(docs[id_col].isNull()))
