"""Spelling variants: words one edit apart, found by a frontier of states over a distributed trie, and chains to their common form.

The trie of all words is a table of edges: a node is a prefix, named by its hash, and an edge leads to it by a letter.  A state is
(word, position, node, edits).  States without an edit are the word's own prefixes.  One edit leads on: past a letter
of the word (deletion), or along another letter of the node's edges (replacement; the greater letter only, as
the pair is found from its other side as well; an insertion is a deletion seen from the other word).  From then on a
state follows its word: level by level it is joined to the edge table, and those whose next node does not exist go.  A
level reads twice as many letters as the one before, so words of any length need few levels.  A state at its last
letter whose node is a word makes two neighbours; they are compared as strings, so no hash decides.

An edit lies in the second half of the word, or it does so when all words are spelt backwards: with a trie for either
direction no state starts near a root, where edges are dense and every word meets.  Edits and first letters are joined
as rows of fixed width; the strings join those states only that survive.

All joins are of tables that grow with the vocabulary, and Spark sizes them by the packed files below them, without the rows that an explode
adds; they are told to sort and merge, so that none is gathered on the driver on such a guess.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.llm.common import stored

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS = 5
LEAST_COUNT = 3
#: A form counts at least so many times its variant.
RATIO = 2
WORDS_AT_ONCE = 500_000
#: The hint of every join (see above); unlike a setting it also holds for what the caller plans later.
MERGED = "merge"
RUN = re.compile(f"[{LETTERS}]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(run: str) -> str:
    """A-Z alone in lower case."""
    return run.lower() if run.isascii() else run.translate(LOWER)


def damaged(run: str, start: int) -> str:
    """The run without a letter where the digest contract asks for it; ``start`` is the CRC of ``<doc_id>:``."""
    h = zlib.crc32(run.encode("utf-8", "surrogatepass"), start)
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, damage: bool = False) -> DataFrame:
    """``(word, n)``: the runs of letters of all texts that are long and frequent enough, with their counts.

    Each task sums before the shuffle.  ``damage`` drops letters as the digest contract asks; a null id drops none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{doc_id}:".encode())
                harm = damage and doc_id is not None
                for word, n in Counter(RUN.findall(text.as_py())).items():
                    if len(word) >= least_letters:
                        word = lowered(word)
                        if harm:
                            word = damaged(word, start)
                            if len(word) < least_letters:
                                continue
                        seen[word] += n
                if len(seen) >= WORDS_AT_ONCE:
                    yield flush()
        yield flush()

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _node(side: Column, prefix: Column) -> Column:
    return F.xxhash64(side, prefix)


def _placed(words: DataFrame) -> DataFrame:
    """A row for each place of each word, forwards and backwards, from the middle of the shortest word on: the trie's edges."""
    both = words.select(F.xxhash64("word").alias("id"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s")))).alias("x"))
    both = both.select("id", "x.side", "x.s", F.length("x.s").alias("size"))
    least = both.agg(F.min("size")).first()[0] or 0
    return both.where(F.col("size") > least // 2).select("id", "side", "s", "size", F.explode(F.sequence(F.lit(least // 2), F.col("size") - 1)).alias("at"))


def _letter(at: Column) -> Column:
    return F.col("s").substr(at + 1, F.lit(1))


def _head(at: Column) -> Column:
    return F.col("s").substr(F.lit(1), at)


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: all pairs of words that differ by one letter inserted, deleted or replaced, in both orders.

    ``words`` has distinct non-null ``word`` of one letter at least, and ``n``.
    """
    at, side = F.col("at"), F.col("side")
    placed = _placed(words)
    edges = placed.select(_node(side, _head(at)).alias("node"), _letter(at).alias("letter"), _node(side, _head(at + 1)).alias("child"))
    edges = stored(edges.distinct(), "edges")
    nodes = edges.select(F.col("child").alias("node"))
    # One row for a node with several edges; there are no more letters than the alphabet has.
    fans = edges.groupBy("node").agg(F.collect_list("letter").alias("letters")).where(F.size("letters") > 1)
    half = F.floor((F.col("size") + side) / 2)
    starts = placed.where(at >= half)
    own = starts.select("id", "side", "at", _node(side, _head(at)).alias("node"), _letter(at).alias("own"))
    replaced = own.join(fans.hint(MERGED), "node").select("id", "side", "at", F.explode(F.filter("letters", lambda x: x > F.col("own"))).alias("letter"))
    # Of equal letters in a row the last one goes; the word's end needs no edge.
    last = at + 1 == F.col("size")
    dropped = starts.where(last | (_letter(at) != _letter(at + 1)))
    ends = dropped.where(last).select("id", "side", "at")
    inner = dropped.where(~last).select("id", "side", "at", _node(side, F.concat(_head(at), _letter(at + 1))).alias("node"))
    inner = inner.join(nodes.hint(MERGED), "node", "left_semi").select("id", "side", "at")
    edited = replaced.unionByName(inner.union(ends).withColumn("letter", F.lit("")))
    named = words.select("word", "n", F.xxhash64("word").alias("id"))
    s = F.when(side == 0, F.col("word")).otherwise(F.reverse("word"))
    spelt = F.concat(s.substr(F.lit(1), at), F.col("letter"), s.substr(at + 2, F.length("word")))
    states = edited.join(named.hint(MERGED), "id").select("side", "word", "n", spelt.alias("path"), (at + 1).alias("position"))
    done, stride = None, 1
    states = stored(states, "frontier")
    while True:
        arrived = F.col("position") >= F.length("path")
        whole = states.where(arrived).select("word", "n", F.when(side == 0, F.col("path")).otherwise(F.reverse("path")).alias("near"))
        done = whole if done is None else done.union(whole)
        further = states.where(~arrived).withColumn("position", F.least(F.col("position") + stride, F.length("path")))
        if further.isEmpty():
            break
        followed = further.withColumn("node", _node(side, F.col("path").substr(F.lit(1), F.col("position"))))
        states = stored(followed.join(nodes.hint(MERGED), "node", "left_semi").drop("node"), "frontier")
        stride *= 2
    # Strings decide; a word that shares the hash of another may have lent it a state, so pairs are made distinct.
    found = stored(done.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint(MERGED), "near").where("word <> near"), "pairs")
    turned = found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.select(turned.columns).union(turned).distinct()


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, n, form, n_near, form_n, root)`` of every word: its near word of largest count (ties: smallest), if that counts ``ratio`` times as much.

    ``root`` is where the forms lead; counts grow along the way, so chains are short, and pointers jump twice as far each round.
    """
    words = stored(words, "words")
    pairs = neighbours(words)
    better = F.when(F.col("near_n") >= F.col("n") * ratio, F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(better).alias("best"))
    w, b = words.alias("w"), best.alias("b")
    named = w.join(b.hint(MERGED), F.col("w.word") == F.col("b.word"), "left").select(
        "w.word", "w.n", F.col("b.best.form").alias("form"), F.coalesce("b.n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("b.best.less")).alias("form_n")
    )
    named = stored(named, "forms")
    pointers = named.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        p, q = pointers.alias("p"), pointers.alias("q")
        jumped = p.join(q.hint(MERGED), F.col("p.root") == F.col("q.word"), "left")
        pointers = stored(jumped.select("p.word", F.coalesce("q.root", "p.root").alias("root"), F.col("q.root").isNotNull().alias("moved")), "roots")
        more = not pointers.where("moved").isEmpty()
        pointers = pointers.drop("moved")
        if not more:
            break
    n, r = named.alias("n"), pointers.alias("r")
    return n.join(r.hint(MERGED), F.col("n.word") == F.col("r.word"), "left").select("n.*", F.coalesce("r.root", "n.word").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, damage: bool = False) -> DataFrame:
    """``(word, n, form, n_near, form_n, root)``: the words of all texts, grouped with their spelling variants.

    Null and empty texts have no words; rows that repeat count again; no rows give no rows.  Other columns are not
    read.  A word is a row: very long words cost the square of their letters in hashing, and their length in memory.
    """
    return forms(vocabulary(docs, id_col, text_col, least_letters, least_count, damage), ratio)
