"""Line dedup by content-defined chunks of lines; DataFrame functions only.

A line's hash is the first 32 bits of its MD5.  The rolling hash of two neighbouring lines is
``previous x 257 + this`` modulo a prime; where it divides by ``MEAN_LINES`` a chunk ends.  Boundaries
inside a passage depend on the passage alone, so its chunks are the same wherever it stands.

A chunk of two or more lines that occurs more than once keeps its first place in the document with
the smallest id; elsewhere its lines go, after its bytes have been compared with the kept ones.

Only 16-byte keys are counted and joined over the corpus; the text of repeated chunks alone is
compared, and the documents themselves are dealt out once, by id.  Hot chunks combine before
the shuffle, and joins on a hot chunk are plain equality joins that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartspark.llm.common import stored

BASE = 257
PRIME = 1_000_003
MEAN_LINES = 3
LEAST_LINES = 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, also where lambdas use it for every element."""
    return F.transform(F.array(value), body)[0]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _joined(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, end - start), "\n")


def chunks(text: Column) -> Column:
    """Chunks of two or more lines as ``array<struct<start, end, key>>``; lines count from 0, ends are exclusive."""

    def spans(lines: Column, hashes: Column) -> Column:
        inner = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(lines) - 2, F.lit(1))),
            lambda i: (i < F.size(lines) - 1) & ((hashes[i - 1] * BASE + hashes[i]) % PRIME % MEAN_LINES == 0),
        )
        ends = F.concat(F.transform(inner, lambda i: i + 1), F.array(F.size(lines)))

        def cut(ends: Column) -> Column:
            start = lambda j: F.when(j == 0, F.lit(0)).otherwise(ends[j - 1])
            pairs = F.transform(ends, lambda end, j: F.struct(start(j).alias("start"), end.alias("end")))
            long = F.filter(pairs, lambda p: p["end"] - p["start"] >= LEAST_LINES)
            return F.transform(
                long,
                lambda p: F.struct(
                    p["start"].alias("start"),
                    p["end"].alias("end"),
                    F.xxhash64(_joined(lines, p["start"], p["end"])).alias("key"),
                ),
            )

        return let(ends, cut)

    number = lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")
    return let(lines_of(text), lambda lines: let(F.transform(lines, number), lambda hashes: spans(lines, hashes)))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tag, cuts)``: line ranges to remove, for the documents that lose any.

    ``tag`` is the hash of the text: rows are told apart by id and text, so rows that repeat both get the
    same answer, and of two texts under one id each keeps its own first place.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text"))
    found = rows.where(F.instr("text", "\n") > 0).select("doc_id", "tag", F.inline(chunks(F.col("text"))))
    # Stored, so that the join below deals out both sides itself and adaptive execution may split a hot chunk.
    repeated = stored(found.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).where("n > 1"), "chunks")
    marks = (
        found.join(repeated.drop("n"), "key")
        .select("doc_id", "tag", F.struct("start", "end", "key", F.col("doc_id").eqNullSafe(F.col("keeper")).alias("kept")).alias("mark"))
        .groupBy("doc_id", "tag")
        .agg(F.sort_array(F.collect_list("mark")).alias("marks"))  # at most the chunks of one document and its repeated rows
        .select("doc_id", "tag", F.array_distinct("marks").alias("marks"))
    )
    m = marks.alias("m")
    same = F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.tag") == F.col("m.tag"))


    def piece(lines: Column, mark: Column) -> Column:
        return mark.withField("piece", _joined(lines, mark["start"], mark["end"]))

    pieces_of = let(lines_of(F.col("r.text")), lambda lines: F.transform("m.marks", lambda mark: piece(lines, mark)))
    texts = rows.alias("r").join(m, same).select("r.doc_id", "r.tag", pieces_of.alias("pieces"))
    # In the keeping document the first place of a chunk stays; a later place with the same bytes goes.
    pieces = texts.select("doc_id", "tag", F.inline("pieces"))
    first = F.min("start").over(Window.partitionBy("doc_id", "tag", "key", "piece"))
    # Stored: the branches below would otherwise deal out all documents once each.
    pieces = stored(pieces.withColumn("later", F.col("kept") & (F.col("start") > first)), "pieces")
    keepers = pieces.where("kept and not later").select("key", "piece").distinct()
    other = pieces.where("not kept").join(keepers, ["key", "piece"]).select("doc_id", "tag", "start", "end")
    cuts = other.union(pieces.where("later").select("doc_id", "tag", "start", "end"))
    return cuts.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))


def without_lines(text: Column, cuts: Column) -> Column:
    """The text without the lines of sorted, disjoint ranges."""

    def parts(lines: Column) -> Column:
        before = lambda j: F.when(j == 0, F.lit(0)).otherwise(cuts[j - 1]["end"])
        kept = F.transform(cuts, lambda c, j: F.slice(lines, before(j) + 1, c["start"] - before(j)))
        last = cuts[F.size(cuts) - 1]["end"]
        tail = F.slice(lines, last + 1, F.size(lines) - last)
        return F.array_join(F.concat(F.flatten(kept), tail), "\n")

    return F.when(F.size(cuts) > 0, let(lines_of(text), parts)).otherwise(text)


def windows(text: Column) -> Column:
    """Each line that is not blank with the next such line, and what stands between, as ``array<struct<start, end, key>>``."""

    def spans(lines: Column) -> Column:
        full = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(r"\S"), i)), lambda i: i.isNotNull())

        def pairs(full: Column) -> Column:
            firsts = F.slice(full, 1, F.greatest(F.size(full) - 1, F.lit(0)))
            return F.transform(
                firsts,
                lambda i, k: F.struct(
                    i.alias("start"),
                    (full[k + 1] + 1).alias("end"),
                    F.unhex(F.substring(F.sha2(_joined(lines, i, full[k + 1] + 1).cast("binary"), 256), 1, 32)).alias("key"),
                ),
            )

        return let(full, pairs)

    return let(lines_of(text), spans)


def _merged(cuts: Column) -> Column:
    """Sorted windows, whose ends are sorted too, as disjoint ranges."""
    starts = F.filter(cuts, lambda c, j: (j == 0) | (cuts[F.greatest(j - 1, F.lit(0))]["end"] <= c["start"]))
    last = F.size(cuts) - 1
    ends = F.filter(cuts, lambda c, j: (j == last) | (cuts[F.least(j + 1, last)]["start"] >= c["end"]))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tag, cuts)``: lines to remove so that of every passage of two or more lines the first place alone stays.

    A repeated passage is a row of repeated windows, so no boundary has to fall into it: every window that stands
    earlier goes.  Places are ordered by id (null last), hash of the text and line; windows are equal by 128 bits of SHA-256.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text"))
    found = rows.where(F.instr("text", "\n") > 0).select("doc_id", "tag", F.inline(windows(F.col("text"))))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag", "start")
    found = stored(found.select("key", "end", place.alias("place")), "windows")
    firsts = found.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    # Stored, so that the join below deals out both sides itself and adaptive execution may split a hot window.
    repeated = stored(firsts.where("first <> last").select("key", "first"), "repeated")
    later = found.join(repeated, "key").where(~F.col("place").eqNullSafe(F.col("first")))
    cuts = later.select("place.doc_id", "place.tag", F.struct("place.start", "end").alias("cut")).groupBy("doc_id", "tag")
    return cuts.agg(F.array_sort(F.collect_set("cut")).alias("cuts")).select("doc_id", "tag", let(F.col("cuts"), _merged).alias("cuts"))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cuts_col: str | None = None) -> DataFrame:
    """``docs`` without the lines of ``removed_passages``; every row stays, and so do the other columns."""
    return _without(docs, removed_passages(docs, id_col, text_col), id_col, text_col, cuts_col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cuts_col: str | None = None) -> DataFrame:
    """``docs`` with the repeated chunks' lines removed from the text; every row stays, and so do the other columns.

    A null text stays null; an empty text or one line has no chunk.  A null id comes after all others: its
    chunks stay only where no row with an id has them.  ``cuts_col`` names a column for the removed line ranges.
    """
    return _without(docs, removed_lines(docs, id_col, text_col), id_col, text_col, cuts_col)


def _without(docs: DataFrame, cuts: DataFrame, id_col: str, text_col: str, cuts_col: str | None) -> DataFrame:
    d, c = docs.alias("d"), cuts.alias("c")
    same = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("c.doc_id")) & (F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))) == F.col("c.tag"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    ranges = F.coalesce(F.col("c.cuts"), none)
    kept = [without_lines(F.col(f"d.`{x}`"), ranges).alias(x) if x == text_col else F.col(f"d.`{x}`") for x in docs.columns]
    return d.join(c, same, "left").select(*kept, *([ranges.alias(cuts_col)] if cuts_col else []))
