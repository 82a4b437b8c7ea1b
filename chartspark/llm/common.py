"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.session import checkpoint_folder, cut_lineage

__all__ = ["Scratch", "cut_lineage", "only_tagged", "stored", "table", "texts_of", "unit_hash"]

BITS_PER_ROW = 16
MOST_BITS = 1 << 27


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, compressed and columnar, in the shared checkpoint folder, and read again.

    Several readers then share one computation, and a lost executor costs a read, not a rerun.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables stored for the time of a ``with`` block: dropped one by one, or all at its end, also on failure."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*self.paths)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once under a name of its own and read again."""
        if name in self.paths:
            raise ValueError(f"{name} is stored")
        path = self.paths[name] = f"{checkpoint_folder(self.spark)}/llm-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def only_tagged(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """The rows whose ``tag`` (long) may be among ``tags``, without a shuffle; all that are, and few others.

    A broadcast bitmap decides, of ``MOST_BITS`` bits at most: where there are more tags than it can tell apart, it lets more rows through.
    """
    bits = 1 << 16
    while bits < min(MOST_BITS, tags.count() * BITS_PER_ROW):
        bits *= 2
    word = lambda: (F.pmod("tag", F.lit(bits)) / 64).cast("long")
    bit = F.expr(f"shiftleft(1L, cast(pmod(tag, {bits}L) % 64 AS int))")
    bitmap = tags.groupBy(word().alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = rows.withColumn("word", word()).join(F.broadcast(bitmap), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    return found.drop("word", "bits")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names: other columns cannot clash.  A null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the values alone, so a rerun of a lost task draws it again."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))
