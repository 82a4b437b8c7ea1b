"""One registered query per operator, over its whole table with production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.llm import backoff, decontaminate, exact, language, licenses, line_chunks, mixing, neighbours, personal, repeats, runs, simhash, spelling
from chartspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of near copies of every document."""
    found = simhash.near_copies(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; learnt without the held-out third."""
    docs = table(spark, folder, "documents")
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query
def op8_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines removed from every document, and what is left of its text."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.size(line_chunks.lines_of(F.coalesce("text", F.lit("")))).alias("n_lines"))
    found = line_chunks.dedup_lines(docs, cuts_col="cuts")
    removed = F.aggregate("cuts", F.lit(0), lambda n, c: n + c["end"] - c["start"])
    return found.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"),
        F.size("cuts").cast("long").alias("n_chunks"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE["op8_line_chunks"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines
), rolled AS (
  SELECT *, lag(h) OVER w AS before FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), placed AS (
  SELECT *, coalesce(sum(CASE WHEN (before * 257 + h) % 1000003 % 3 = 0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM rolled
), pieces AS (
  SELECT doc_id, chunk, count(*) AS n, min(i) AS start, string_agg(line, chr(10) ORDER BY i) AS piece FROM placed GROUP BY ALL
), judged AS (
  SELECT *, n >= 2 AND row_number() OVER (PARTITION BY piece, n >= 2 ORDER BY doc_id, start) > 1 AS gone FROM pieces
)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
       (count(*) FILTER (gone))::BIGINT AS n_chunks,
       sha256(coalesce(string_agg(piece, chr(10) ORDER BY start) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that leak into documents."""
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Cell, calibrated probability and decision of every document."""
    return mixing.sample(table(spark, folder, "documents"))


@query
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    found = licenses.scan(table(spark, folder, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    labels = lambda matches: F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


@query
def op4_personal(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    found = personal.find(table(spark, folder, "documents"))
    names = F.array(*map(F.lit, personal.KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(personal.KINDS)),
        F.sha2(told("base"), 256).alias("base_sha256"), told(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


@query
def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return neighbours.search(table(spark, folder, "embeddings"))


@query
def op9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without repeated strings of 100 bytes."""
    return repeats.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query
def op3_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Stupid-backoff score of every document under the corpus' counts."""
    found = backoff.score(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log", 6).alias("mean_log"))


ORACLE["op3_backoff"] = """
WITH trimmed AS (
  SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS text
  FROM documents
), texts AS (
  SELECT doc_id, CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+') END AS words FROM trimmed
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM texts
), paired AS (
  SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM placed
), singles AS (
  SELECT word, count(*) AS n FROM placed GROUP BY word
), pairs AS (
  SELECT before, word, count(*) AS n FROM paired WHERE before IS NOT NULL GROUP BY ALL
), scored AS (
  SELECT p.doc_id, CASE WHEN p.before IS NULL THEN ln(w.n) - ln((SELECT count(*) FROM placed))
    WHEN c.n >= 1 THEN ln(c.n) - ln(b.n)
    ELSE ln(0.4) + ln(w.n) - ln((SELECT count(*) FROM placed)) END AS s
  FROM paired p JOIN singles w ON w.word = p.word
  LEFT JOIN pairs c ON c.before = p.before AND c.word = p.word
  LEFT JOIN singles b ON b.word = p.before
), sums AS (
  SELECT doc_id, count(*) AS n, sum(s) AS s FROM scored GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(s, 0), 6) AS log_score, round(s / n, 6) AS mean_log
FROM (SELECT DISTINCT doc_id FROM texts) t LEFT JOIN sums USING (doc_id)
"""


@query
def op13_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents stay of those with equal texts."""
    found = exact.classes(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


ORACLE["op13_exact"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents) WINDOW w AS (PARTITION BY body)
"""


#: CRC-32 of a list of bytes, spelt out bit by bit.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295], {bytes}), lambda c, b:
    list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y:
      CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""


@query
def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, and its digest without them."""
    found = runs.collapse(table(spark, folder, "documents"), texts=False, seed_runs=True)
    return found.drop("runs", "collapsed")


ORACLE["op12_runs"] = f"""
WITH trimmed AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS text FROM documents
), texts AS (
  SELECT doc_id, CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+') END AS words,
    {CRC.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} AS h FROM trimmed
), numbers AS (
  SELECT doc_id, words, len(words) AS n, h, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM texts
), tails AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM numbers
), placed AS (
  SELECT doc_id, n, i, words[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM tails)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM placed x JOIN placed y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
), periodic AS (
  SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM islands GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM periodic r WHERE NOT EXISTS (SELECT 1 FROM periodic s WHERE s.doc_id = r.doc_id AND s.q < r.q
    AND r.q % s.q = 0 AND s.start <= r.start AND s.start + s.length >= r.start + r.length)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::HUGEINT * 1000000000000000 // q DESC, start, q) AS place FROM runs
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS told FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT p.doc_id, p.i FROM placed p JOIN runs r ON r.doc_id = p.doc_id AND p.i >= r.start + r.q AND p.i < r.start + r.length
), collapsed AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM placed ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.q::BIGINT AS period,
       (1000 * b.length // b.q)::BIGINT AS exponent_milli, sha256(coalesce(l.told, '')) AS runs_sha256, sha256(coalesce(c.kept, '')) AS collapsed_sha256
FROM texts d LEFT JOIN listed l USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (doc_id) LEFT JOIN collapsed c USING (doc_id)
"""


@query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    found = spelling.variants(table(spark, folder, "documents"), damage=True)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


ORACLE["op11_spelling"] = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents WHERE text IS NOT NULL
), counted AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found GROUP BY ALL
), bytes AS (
  SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM counted
), marked AS (
  SELECT doc_id, run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE
    {CRC.format(bytes="list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)")} END AS h FROM bytes
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM marked
), vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM vocabulary)
), paired AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, a.n, b.word, b.n FROM cut a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, b.n, a.word, a.n FROM cut a JOIN vocabulary b ON a.rest = b.word
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM paired
), formed AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.near_n >= 2 * v.n THEN r.near END AS form,
         CASE WHEN r.near_n >= 2 * v.n THEN r.near_n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1
), followed AS (
  SELECT word, word AS root FROM formed
  UNION ALL
  SELECT f.word, g.form FROM followed f JOIN formed g ON g.word = f.root WHERE g.form IS NOT NULL
), roots AS (
  SELECT f.word, f.root FROM followed f JOIN formed g ON g.word = f.root WHERE g.form IS NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r ON r.word = f.word
"""
