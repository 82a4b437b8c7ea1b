"""Session helpers: a sensible local session, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chartspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small local inputs still keep every core busy: the rule expressions cost more than their bytes.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: HotSpot's HugeMethodLimit, in bytes of bytecode.
JIT_LIMIT = 8_000
#: Wide records of hundreds of small expressions: one fused method for all of them is too long for the JVM to compile.
UNFUSED = {"spark__sql__codegen__wholeStage": "false"}
#: A table that is stored needs the shuffle files behind it no longer; otherwise they wait for the driver's next garbage collection.
CLEANED = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


def tune(spark: SparkSession) -> SparkSession:
    """Settings the deep plans of this package want; safe to call on any session.

    Constraint propagation re-derives filters over every alias of every rule expression, which
    grows out of hand on plans with many renamed, computed keys; the operators state the
    filters they need themselves.  Times are read as UTC.

    A generated method of more than ``JIT_LIMIT`` bytes is never compiled by the JVM but interpreted row by row; Spark lets through
    eight times that.  Stages of rule expressions beyond it run as single operators, whose code is split into small methods.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_LIMIT))
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return spark


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (dots written as ``__``) for what is planned and run inside the block; the session gets its own back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for stored intermediate tables: what the context or ``spark.checkpoint.dir`` names.

    Where neither is set, only a session on one machine gets a scratch folder; a cluster must name one that
    the driver and all executors share.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="chartspark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fixed(df: DataFrame) -> DataFrame:
    """The rows stored once, columnar and compressed, in the shared folder: later steps read the columns they name.

    A checkpoint holds whole rows uncompressed, so wide records go here; a checkpoint is for rows whose partitioning must be kept.
    What Parquet cannot hold (columns without a type or with one name) is checkpointed.
    """
    folder = checkpoint_folder(df.sparkSession)
    if not _columnar(df):
        return cut_lineage(df)
    path = f"{folder}/fixed-{uuid.uuid4().hex}"
    with settings(df.sparkSession, **CLEANED):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _columnar(df: DataFrame) -> bool:
    """Whether Parquet can hold the rows: columns with a type and names of their own."""
    names = [c.lower() for c in df.columns]
    return bool(names) and len(set(names)) == len(names) and "void" not in df.schema.simpleString()


class Held:
    """Tables in buckets of a key, for the time of a ``with`` block; gone at its end, also on failure.

    Plans know how the rows lie, as they do of a checkpoint after a shuffle, but the files are columnar and compressed.  They are in the
    shared folder, so a lost executor costs a read.  What is to outlive the block is stored otherwise before its end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Held:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*self.paths)

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """The rows shuffled by ``key`` and stored as they lie then."""
        return self.kept(df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key), key)

    def kept(self, df: DataFrame, key: str) -> DataFrame:
        """Rows that lie by ``key`` already, stored so: each task writes one file.  Other rows are stored rightly too, in more files."""
        with settings(self.spark, **CLEANED, spark__sql__adaptive__enabled="false", spark__sql__maxConcurrentOutputFileWriters="2"):
            folder = checkpoint_folder(self.spark)
            if not _columnar(df):
                return cut_lineage(df)
            name = f"spark_catalog.default.held_{uuid.uuid4().hex}"
            self.paths[name] = f"{folder}/{name.rpartition('.')[2]}"
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.option("compression", "zstd").option("path", self.paths[name]).format("parquet").bucketBy(buckets, key).saveAsTable(name)
            return self.spark.table(name)

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
