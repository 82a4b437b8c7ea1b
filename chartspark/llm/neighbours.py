"""Approximate nearest neighbours by largest inner product: probed lists with an adaptive dimension scan.

Vectors get one more component, so that all have one norm and the largest inner product is the least distance.
Lists are cells of k-means fitted on a bounded sample; every vector is in the index.  Within a probed list
vectors lie rotated at random in column blocks.  After each block a hypothesis test compares the
distance so far with what a vector at the current k-th distance would show; those that fail are
abandoned, and the survivors get their exact score on the original vectors in double precision.
Each query starts from a limit it knows before any list: its k-th distance among a few vectors of the sample, as many at every
size ("scouts"), which are candidates too, so that no query finds fewer than it should.  Its ``FIRST`` nearest lists then
give the limit that the others are scanned with.

How many lists to probe is measured on the sample, for a recall of ``RECALL`` against brute force there.

Equal vectors are one entry that keeps the ``k + 1`` smallest ids, as no result can hold more of them, and
equal queries are searched once.  A list is split so that a task meets at most ``LIST_ROWS`` entries and
``LIST_QUERIES`` queries at a time, however full the list is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartspark.llm.common import stored, unit_hash

SAMPLE = 20_000
SCOUTS = 500
FIRST = 4
LISTS = 4_096
ROUNDS = 8
RECALL = 0.97
COLUMNS = 16
EPSILON = 2.1
LIST_ROWS = 4_096
LIST_QUERIES = 2_048


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


@dataclass
class Frame:
    """What every task knows: the rotation, the norm, the centres and the scouts."""

    norm: float
    rotation: np.ndarray
    centres: np.ndarray
    scouts: np.ndarray
    scout_entries: np.ndarray
    probes: int
    k: int

    def raised(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors with the added component; a query's is zero."""
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))
        return np.column_stack((x, last))

    def nearest_lists(self, raised: np.ndarray, count: int) -> np.ndarray:
        far = (self.centres**2).sum(axis=1) - 2 * raised @ self.centres.T
        count = min(count, far.shape[1])
        found = np.argpartition(far, count - 1, axis=1)[:, :count]
        return np.take_along_axis(found, np.argsort(np.take_along_axis(far, found, axis=1), axis=1, kind="stable"), axis=1)

    def scouted(self, queries: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Per query the squared distance within which ``k + 1`` scouts lie (infinite where there are fewer), those scouts and their scores."""
        q, x = self.raised(queries, True), self.raised(self.scouts, False)
        count = min(self.k + 1, len(x))
        limit, found, scores = np.full(len(q), np.inf), [], []
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            score = queries[at : at + 256] @ self.scouts.T
            best = np.argpartition(-score, count - 1, axis=1)[:, :count]
            top = np.take_along_axis(score, best, axis=1)
            if count > self.k:
                limit[at : at + 256] = (part**2).sum(axis=1) + self.norm**2 - 2 * top.min(axis=1)
            found += list(self.scout_entries[best])
            scores += list(top)
        return limit * (1 + 1e-9) + 1e-9 * self.norm**2, found, scores


def scan(queries: np.ndarray, limits: np.ndarray, rows: np.ndarray, frame: Frame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the places and exact scores of its best ``k + 1`` rows among those not abandoned."""
    x = frame.raised(rows, False) @ frame.rotation
    q = frame.raised(queries, True) @ frame.rotation
    size = x.shape[1]
    blocks = [(a, np.ascontiguousarray(x[:, a : a + COLUMNS])) for a in range(0, size, COLUMNS)]
    for i in range(len(q)):
        alive = np.arange(len(x))
        far = np.zeros(len(x))
        for a, block in blocks:
            seen = min(a + COLUMNS, size)
            far = far + ((block[alive] - q[i, a : a + COLUMNS]) ** 2).sum(axis=1)
            # At distance d, the first `seen` of `size` rotated columns hold about d * sqrt(seen / size).
            bound = limits[i] * seen / size * ((1 + EPSILON / np.sqrt(seen)) ** 2 if seen < size else 1 + 1e-9)
            kept = far <= bound + 1e-12
            alive, far = alive[kept], far[kept]
        if len(alive):
            score = rows[alive] @ queries[i]
            if len(alive) > frame.k + 1:
                least = np.partition(score, len(score) - frame.k - 1)[len(score) - frame.k - 1]
                kept = score >= least  # with all ties
                alive, score = alive[kept], score[kept]
            yield i, alive, score


def kmeans(x: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), count, replace=False)]
    for _ in range(ROUNDS):
        near = np.concatenate([((centres**2).sum(axis=1) - 2 * x[a : a + 4096] @ centres.T).argmin(axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=count)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, entries: np.ndarray, total: int, norm: float, k: int) -> Frame:
    """Lists, rotation and the number of probes from the sample."""
    rng = np.random.default_rng(11)
    size = sample.shape[1] + 1
    rotation, _ = np.linalg.qr(rng.standard_normal((size, size)))
    frame = Frame(norm, rotation, np.zeros((1, size)), sample[:SCOUTS], entries[:SCOUTS], 1, k)
    raised = frame.raised(sample, False)
    frame.centres = kmeans(raised, int(np.clip(1.5 * np.sqrt(total), 1, min(LISTS, max(1, len(sample) // 4)))))
    tried = rng.choice(len(sample), min(200, len(sample)), replace=False)
    home = np.concatenate([frame.nearest_lists(raised[a : a + 4096], 1)[:, 0] for a in range(0, len(raised), 4096)])
    ranks = []
    for i in tried:
        score = sample @ sample[i]
        score[i] = -np.inf
        best = np.argsort(-score)[: min(k, len(sample) - 1)]
        far = (frame.centres**2).sum(axis=1) - 2 * frame.centres @ frame.raised(sample[i : i + 1], True)[0]
        place = np.empty(len(far), np.int64)
        place[np.argsort(far, kind="stable")] = np.arange(len(far))
        ranks.append(place[home[best]])
    ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0)
    if len(ranks):
        frame.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))))]) + 1
    return frame


def usable(vector: Column) -> Column:
    """Neither null nor zero nor holding a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id divisible by ``every`` its ``k`` nearest found, nearest first, ties to smaller ids.

    Unusable vectors, rows without an id and vectors of another length than most (ties to the longer) take no part.  Rows that repeat
    id and vector count once; no candidate has the query's id.  Fewer candidates give fewer rows, none give none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # -0.0 and 0.0 are one value.
    rows = stored(rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    most = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == most["size"])
    few = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    entries = rows.distinct().withColumn("n", few).where(F.col("n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stored(entries.withColumn("entry", F.col("ids")[0]), "entries")
    asked = stored(
        rows.where(F.col("vec_id") % every == 0).select("vec_id", "vector").distinct().join(entries.select("vector", "entry"), "vector").select(F.col("vec_id").alias("query_id"), "vector", "entry"), "asked"
    )
    facts = entries.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).first()
    share = SAMPLE / facts["n"]
    drawn = entries.where(unit_hash(F.lit("vectors"), F.col("entry")) < share).orderBy(F.xxhash64("entry"), "entry").limit(2 * SAMPLE).select("vector", "entry").toArrow()
    frame = fit(matrix(drawn.column(0)), drawn.column(1).to_numpy(), facts["n"], float(np.sqrt(facts["square"])), k)
    shared = spark.sparkContext.broadcast(frame)

    def place(count: int, query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    known = shared.value
                    x = matrix(batch.column(1))
                    lists = known.nearest_lists(known.raised(x, query), count)
                    limit, found, scores = known.scouted(x) if query else (np.zeros(len(x)), [[]] * len(x), [[]] * len(x))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0), batch.column(1), pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32())), pa.array(limit),
                            pa.array(found, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64())),
                        ],
                        names=["entry", "vector", "lists", "limit", "scouts", "scores"],
                    )

        return run

    kind = "entry long, vector array<double>, lists array<int>, limit double, scouts array<long>, scores array<double>"
    homes = stored(entries.select("entry", "vector").mapInArrow(place(1, False), kind).select("entry", "vector", F.col("lists")[0].alias("list")), "homes")
    probing = stored(asked.select("entry", "vector").distinct().mapInArrow(place(frame.probes, True), kind), "probing")

    def pieces(df: DataFrame, most_rows: int) -> Column:
        """Number of pieces of each list, as a look-up; lists are at most ``LISTS``."""
        found = {r["list"]: -(-r["n"] // most_rows) for r in df.groupBy("list").agg(F.count("*").alias("n")).collect()}
        table = F.create_map(*(F.lit(x) for pair in sorted(found.items()) for x in pair)) if found else F.lit(None).cast("map<int,int>")
        return F.coalesce(table[F.col("list")], F.lit(1))

    own = lambda n: F.pmod(F.xxhash64("entry"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            ids, asking = rows.column("entry").to_numpy(), queries.column("entry").to_numpy()
            for i, at, score in scan(matrix(queries.column("vector")), queries.column("limit").to_numpy(), matrix(rows.column("vector")), shared.value):
                out[0].append(np.full(len(at), asking[i]))
                out[1].append(ids[at])
                out[2].append(score)
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"query": join(out[0], pa.int64()), "entry": join(out[1], pa.int64()), "score": join(out[2], pa.float64())})

    def visited(wanted: DataFrame) -> DataFrame:
        """``(query, entry, score)`` found in the lists asked for, each with the query's limit."""
        row_pieces, query_pieces = pieces(homes, LIST_ROWS), pieces(wanted, LIST_QUERIES)
        left = homes.select("*", own(row_pieces).alias("row_piece"), all_of(query_pieces).alias("query_piece"))
        right = wanted.select("*", own(query_pieces).alias("query_piece"), all_of(row_pieces).alias("row_piece"))
        keys = ("list", "row_piece", "query_piece")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query long, entry long, score double")

    scouts = probing.select(F.col("entry").alias("query"), F.inline(F.arrays_zip(F.col("scouts").alias("entry"), F.col("scores").alias("score"))))
    near = F.slice("lists", F.lit(1), F.least(F.lit(FIRST), F.size("lists")))
    met = visited(probing.select("entry", "vector", "limit", F.explode(near).alias("list"))).unionByName(scouts)
    met = met.groupBy("query", "entry").agg(F.max("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))
    met = stored(met.withColumn("place", order).where(F.col("place") <= k + 1), "near")
    # The (k + 1)-th best so far as a squared distance, with some room for rounding.
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    far = (square + F.lit(frame.norm**2) - 2 * F.col("worst")) * F.lit(1 + 1e-9) + F.lit(1e-9 * frame.norm**2)
    worst = met.where(F.col("place") == k + 1).select(F.col("query").alias("entry"), F.col("score").alias("worst"))
    rest = probing.where(F.size("lists") > FIRST).join(worst, "entry", "left").select(
        "entry", "vector", F.coalesce(F.least("limit", far), F.col("limit")).alias("limit"), F.explode(F.slice("lists", FIRST + 1, F.size("lists"))).alias("list")
    )
    each = visited(stored(rest, "rest")).unionByName(met.drop("place")).groupBy("query", "entry").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))
    top = each.withColumn("place", best).where(F.col("place") <= k + 1)
    top = top.join(entries, "entry").join(probing.select(F.col("entry").alias("query"), F.col("vector").alias("asked")), "query")
    product = F.aggregate(F.zip_with("vector", "asked", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    top = top.select("query", "ids", product.alias("score"))
    # The ids a query may be given; the query itself is still among them, and queries with one vector share them.
    offered = top.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("offers"))
    given = asked.join(offered, asked["entry"] == offered["query"]).select("query_id", F.inline("offers")).select("query_id", "score", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return given.where("vec_id <> query_id").distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
