import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
WORDS = {
    "en": "the of and to in is that for with was on are this have from they which there would their about".split(),
    "fr": "le la les des une dans pour que qui avec sur sont cette mais nous vous leur être plus très".split(),
}
CLASHING = ("tag", "key", "fp", "hub", "component_id", "doc", "start", "cuts", "topic", "probability", "weight", "share", "score", "word", "bucket", "n", "__id", "list")


def prose(rng: random.Random, lang: str = "en", words: int = 60) -> str:
    out = [rng.choice(WORDS[lang]) + rng.choice(["", "", rng.choice(WORDS[lang])]) for _ in range(words)]
    return "".join(w + ("\n" if rng.random() < 0.12 else " ") for w in out).strip()


def rows_of(seed: int = 3, n: int = 40) -> list[tuple]:
    """Random documents with copies, near copies, shared lines, nulls in every column, an empty text and a very long one."""
    rng = random.Random(seed)
    shared = "\n".join(prose(rng, "en", 14).replace("\n", " ") for _ in range(9))
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        text = prose(rng, lang, rng.randint(1, 120))
        if i % 5 == 0:
            text = text + "\n" + shared + "\n" + prose(rng, lang, 20)
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [(100 + k, rows[k][1], rows[k][2], None, None) for k in (1, 2, 5)]
    rows += [(110, rows[3][1] + " tail", "en", "s0", 1), rows[4], (120, "", "en", "s1", 0), (121, None, None, None, None), (None, rows[5][1], "fr", "s2", 3), (None, None, None, None, None)]
    rows.append((130, " ".join(prose(rng, "en", 4000) for _ in range(5)), "en", "s0", 9))
    rows.append((131, "x" * 3000, "en", "s0", 9))
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return rows_of()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    frame = spark.createDataFrame(doc_rows, SCHEMA).repartition(3)
    return frame.select("*", *(F.lit("x").alias(c) for c in CLASHING)).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
